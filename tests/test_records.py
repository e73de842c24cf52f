"""Records, logs and digests against plain versions, and on hard rows."""

import hashlib
import random

from pyspark.sql import functions as F

from tessella.operators import audit, frames, records, search
from tessella.functions import texts


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_digest(hashes, leaf=audit.LEAF_ROWS):
    counts = {h: hashes.count(h) for h in hashes}
    depth = 0
    while leaf * 16**depth < len(counts):
        depth += 1
    nodes = {}
    for h, n in counts.items():
        nodes.setdefault(h[:depth], []).append(f"{h}:{n}")
    while True:
        hashed = {p: sha(",".join(sorted(c))) for p, c in nodes.items()}
        if depth == 0:
            return hashed[""]
        depth, nodes = depth - 1, {}
        for p, d in hashed.items():
            nodes.setdefault(p[:depth], []).append(f"{p}:{d}")


def test_digest_trees_equal_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(audit, "LEAF_ROWS", 2)
    rng = random.Random(1)
    rows = [("a", str(rng.randrange(60))) for _ in range(90)] + [("b", "x"), ("b", "x"), (None, "y")]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, x string")
    for some in (frame, frame.orderBy("x")):
        got = {r.k: (r.n_rows, r.digest) for r in audit.set_digest(some, F.sha2("x", 256), "k").collect()}
        assert set(got) == {"a", "b", None}
        for k in got:
            own = [sha(x) for key, x in rows if key == k]
            assert got[k] == (len(own), plain_digest(own, 2))
    whole = audit.set_digest(frame, F.sha2("x", 256)).first()
    assert (whole.n_rows, whole.digest) == (93, plain_digest([sha(x) for _, x in rows], 2))
    assert audit.set_digest(frame.limit(0), F.sha2("x", 256), "k").count() == 0


def test_digest_trees_with_one_level_equal_a_plain_one(spark, monkeypatch):
    """Sets whose tree would be deeper, as in the SQL of ``set_digest``."""
    monkeypatch.setattr(audit, "LEAF_ROWS", 2)
    rows = [("a", str(i % 140)) for i in range(200)] + [("b", "x"), ("b", "x"), (None, "y")]
    frame = spark.createDataFrame(rows, "k string, x string")
    got = {r.k: (r.n_rows, r.digest) for r in audit.set_digest(frame, F.sha2("x", 256), "k", levels=1).collect()}

    def plain(k):
        own = [sha(x) for key, x in rows if key == k]
        lines = sorted(f"{h}:{own.count(h)}" for h in set(own))
        if len(lines) <= 2:
            return len(own), sha(",".join(lines))
        return len(own), sha(",".join(f"{p}:{sha(','.join(x for x in lines if x[0] == p))}" for p in sorted({x[0] for x in lines})))

    assert got == {k: plain(k) for k in ("a", "b", None)}


def test_evidence_bundles_equal_plain_ones(spark):
    """A session with more files than a digest tree's leaf holds, repeated files, and sessions without files or key."""
    sessions = spark.createDataFrame([(1, "s"), (2, "t"), (2, "u"), (3, "v"), (None, "w")], "k int, x string")
    files = [(1, "N", sha(str(i % 300))) for i in range(400)] + [(1, "A", sha("a")), (2, "R", sha("r")), (2, "X", sha("r")), (2, "A", None), (None, "A", sha("a")), (9, "A", sha("a"))]
    found = audit.evidence_bundle(sessions, spark.createDataFrame(files, "k int, kind string, sha256 string"), "k", ("A", "N", "R"))

    def plain(k, x):
        parts, n = [], 0
        for kind in ("A", "N", "R"):
            own = [h for key, c, h in files if key == k and c == kind and h and k is not None]
            n += len(own)
            parts.append(f"{kind}=" + (sha(",".join(sorted(f"{h}:{own.count(h)}" for h in set(own)))) if own else ""))
        own = sha('{"k":%s,"x":"%s"}' % ("null" if k is None else k, x))
        return k, n, sha("|".join([own, *parts]))

    key = lambda r: str(r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted([plain(k, x) for k, x in ((1, "s"), (2, "t"), (2, "u"), (3, "v"), (None, "w"))], key=key)


def test_chain_states(spark):
    rows = [(k, i, f"t{i}") for k in ("ok", "tail", "state", "free") for i in range(3)]
    chain = audit.chain_append(spark.createDataFrame(rows, "k string, i int, t string"), "k", "i", F.col("t"))
    last = {r.k: r.event_hash for r in chain.where("i = 2").collect()}
    states = [("ok", last["ok"], "s", "s"), ("tail", "no", "s", "s"), ("state", last["state"], "s", "z"), ("free", last["free"], "s", None), ("none", "GENESIS", "s", "s"), ("lost", None, "s", "s")]
    states = spark.createDataFrame(states, "k string, tail_hash string, state_hash string, expected_hash string")
    found = audit.chain_verify(chain, "k", "i", F.sha2(F.concat_ws("|", "prev_hash", "body"), 256), states)
    got = {r.k: (r.n_events, r.failure_seq, r.reason, r.bound, r.latest_hash) for r in found.collect()}
    assert got == {
        "ok": (3, None, "ok", True, last["ok"]), "tail": (3, 2, "session state audit tail mismatch", False, last["tail"]),
        "state": (3, 2, "session state content hash mismatch", False, last["state"]), "free": (3, None, "ok", False, last["free"]),
        "none": (0, None, "ok", True, "GENESIS"), "lost": (0, None, "session state audit tail mismatch", False, "GENESIS"),
    }


def plain_replay(log, limit):
    """Verdicts of one session's log by a second, naive writing of the rules."""
    used, open_, claimed, done, locked, out = 0.0, None, False, set(), False, []
    for kind, run, load, valid in log:
        if kind == "reserve":
            if open_:
                v = "ALREADY_RESERVED"
            elif run is None or load is None or run in done:
                v = "INVALID"
            elif locked:
                v = "LOCKED"
            elif used + load > limit + 1e-9:
                v = "OVER_BUDGET"
            else:
                v, open_ = "RESERVED", (run, load)
        elif kind not in ("claim", "settle"):
            v = "UNKNOWN_KIND"
        elif run in done:
            v = "ALREADY_SETTLED"
        elif not open_ or run != open_[0]:
            v = "NOT_RESERVED"
        elif kind == "claim":
            v, claimed = ("IN_PROGRESS" if claimed else "CLAIMED"), True
        else:
            used += max(0.0, load) if valid and load is not None else open_[1]
            locked = locked or not valid or used > limit + 1e-9
            v = "SETTLED" if valid else "SETTLED_AT_PREDICTION"
            done.add(run)
            open_, claimed = None, False
        out.append((v, round(used, 6), round(open_[1], 6) if open_ else 0.0, locked))
    return out


def test_action_logs_equal_a_plain_replay(spark):
    rng = random.Random(4)
    logs = {s: [(rng.choice(["reserve", "claim", "settle", "settle", None, "odd"]), rng.choice(["r1", "r2", "r3", None]), rng.choice([None, 0.5, 1.25, -1.0, 3.0]), rng.choice([True, True, False, None])) for _ in range(40)] for s in range(25)}
    rows = [(s, i, *entry) for s, log in logs.items() for i, entry in enumerate(log)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "session bigint, seq bigint, kind string, run string, load double, valid boolean")
    got = {(r.session, r.seq): (r.verdict, r.used, r.reserved, r.locked) for r in records.replay_actions(frame, 4.0).collect()}
    want = {(s, i): v for s, log in logs.items() for i, v in enumerate(plain_replay(log, 4.0))}
    assert got == want
    assert {"RESERVED", "CLAIMED", "SETTLED", "OVER_BUDGET", "LOCKED", "ALREADY_SETTLED"} <= {v[0] for v in want.values()}
    assert records.replay_actions(frame.limit(0), 4.0).count() == 0


def test_answers_that_are_no_answers(spark):
    shown = spark.createDataFrame([(i, "c1", "FRONT") for i in range(1, 6)], "answer_id bigint, capture_id string, view_code string")
    body = '{"observations":[{"capture_id":"c1","view_code":"FRONT","text":"seen"}],"cross_view_observations":[],"limitations":[],"capture_issues":[],"ood_risk":"LOW"}'
    rows = [(1, body), (2, None), (3, "no json"), (4, "{}"), (5, body.replace('"limitations":[]', '"limitations":null'))]
    found = records.answer_violations(spark.createDataFrame(rows, "answer_id bigint, body string"), shown).collect()
    by = {}
    for r in found:
        by.setdefault(r.answer_id, set()).add(r.rule)
    assert 1 not in by and {"fields", "capture_not_represented"} <= by[2] & by[3] & by[4] and {"limitations_texts", "limitations_bounded"} <= by[5]


def test_strings_at_any_depth(spark):
    rows = [('{"a":"x","b":[{"c":"y"},"z",1,null],"d":{"e":{"f":"w"}}}',), ("[]",), ("not json",), (None,), ('"bare"',)]
    got = spark.createDataFrame(rows, "t string").select(records.json_strings(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [["x", "y", "z", "w"], [], [], [], ["bare"]]


def test_scope_is_compared_part_by_part(spark):
    rows = [({"materials": ["*"]},), ({"materials": ["Clay ", "glass"]},), ({"materials": ["bronze"], "regions": ["*"]},), ({},), (None,)]
    frame = spark.createDataFrame(rows, "scope map<string,array<string>>")
    check = lambda attributes: [r[0] for r in frame.select(texts.scope_compatible(attributes, F.col("scope"))).collect()]
    assert check({"material": " CLAY"}) == [True, True, False, False, False]
    assert check({"material": ["", "  "], "note": "any"}) == [True] * 5
    assert check({"material": "bronze", "region": ["north"]}) == [False, False, True, False, False]


def test_tokens_cover_the_whole_han_range(spark):
    text = "㐀㐁 x-1.b_c Ab 䶿䷀鿿"
    want = sorted(["㐀", "㐁", "㐀㐁", "x-1.b_c", "ab", "䶿", "鿿"])
    assert sorted(search.python_tokens(text)) == want
    assert sorted(spark.createDataFrame([(text,)], "t string").select(texts.tokens(F.col("t"))).first()[0]) == want


def test_clashing_column_names_stay(spark):
    docs = spark.createDataFrame([("a b", 1, 2, 3), (None, 4, 5, 6)], "text string, _tokens int, measured int, m int")
    scored = search.lexical_scores(docs, "a c")
    assert scored.columns == [*docs.columns, "lexical"] and sorted(r.lexical for r in scored.collect())[0] == 0.0


def test_frames_without_hash_or_key(spark):
    rows = [(1, 10, 0, "0" * 16), (1, 11, 1, None), (1, 12, 2, "0" * 15 + "1"), (None, 13, 0, "0" * 16), (None, 14, 1, "zz"), (None, 15, 2, "0" * 16)]
    frame = spark.createDataFrame(rows, "c int, frame_id bigint, ts bigint, dhash string")
    got = {r.frame_id: r.duplicate_of for r in frames.mark_duplicates(frame, "c").collect()}
    assert got == {10: None, 11: None, 12: 10, 13: None, 14: None, 15: 13}
    usable = frames.usable_frames(frame.withColumn("passed", F.col("frame_id") != 13), "c").collect()
    assert {r.frame_id for r in usable} == {10, 11, 14}


def test_one_and_two_representatives(spark):
    rows = [(1, 10, 5, 0.5), (2, 20, 1, 0.1), (2, 21, 9, 0.2), (3, 30, 0, 0.1), (3, 31, 4, 0.1), (3, 32, 6, 0.9), (3, 33, 10, 0.1)]
    got = frames.representatives(spark.createDataFrame(rows, "c int, frame_id bigint, ts bigint, quality double"), "c").collect()
    assert sorted((r.c, r.position, r.frame_id) for r in got) == [(1, 1, 10), (2, 1, 20), (2, 2, 21), (3, 1, 30), (3, 2, 32), (3, 3, 33)]


def test_json_of_any_shape(spark):
    import json

    texts = ['{"b":1,"a":{"d":[1.0,2,{"z":null,"y":"\\u00e9\\n"}],"c":1e3}}', "[]", "3", '"x"', '{"a":1,"a":2}', '{"n":12345678901234567890123456789}', '{"x":NaN}', "{", "", None, "[1e999]", '{"log":{"in":[1]}}', '{"log":[1]}', '{"log":{"in":3}}', '{"log":null}']
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.c, r.a) for r in frame.select("i", records.canonical_text(F.col("t")).alias("c"), records.with_appended(F.col("t"), ["log", "in"], F.lit('{"k" : [2]}')).alias("a")).collect()}
    plain = lambda t: json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    bad = (6, 7, 8, 9, 10)
    assert all(got[i][0] == (None if i in bad else plain(t)) for i, t in enumerate(texts))
    assert [got[i][1] for i in (11, 12, 13, 14, 1)] == ['{"log":{"in":[1,{"k":[2]}]}}', None, None, None, None]
    assert got[4][1] == '{"a":2,"log":{"in":[{"k":[2]}]}}' and all(got[i][1] is None for i in bad)
