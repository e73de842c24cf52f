import random
from functools import reduce
from itertools import combinations

import numpy as np
import pytest

from tessella.llm import near_texts
from tessella.llm.near_texts import band_keys, jaccard, keep_one, near_text_groups, shingle_set
from tessella.llm.simhash import fingerprint

SF = "/root/testdata/sf0.01"


def plain_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b) and bool(a | b)


def plain_groups(texts):
    """{text: its group} by all pairs: SimHash within four bits, or shingle sets at 0.8."""
    sets, fps = {t: plain_set(t) for t in texts}, {t: fingerprint((t or "").encode()) for t in texts}
    root = {t: t for t in texts}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in combinations(list(root), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 4 or near(sets[a], sets[b]):
            root[top(a)] = top(b)
    return {t: top(t) for t in texts}


def edited_copies(rng, n, words, share):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(int(share * words)):
            copy[rng.randrange(words)] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return [" ".join(base), *out]


def test_sets_and_similarity_equal_a_second_writing():
    rng = random.Random(1)
    texts = ["", " \n", "one", "One two\tthree", "a b c d e", "A B c D e f", "日本語 text \x0b İ ß"] + edited_copies(rng, 8, 60, 0.03)
    for a, b in combinations(texts, 2):
        x, y, p, q = shingle_set(a.encode()), shingle_set(b.encode()), plain_set(a), plain_set(b)
        assert len(x) == len(p) and len(y) == len(q)
        assert jaccard(x, y) == pytest.approx(len(p & q) / max(1, len(p | q)))


def test_band_keys_meet_as_often_as_the_rule_says():
    rng, met = np.random.default_rng(2), []
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 160).astype(np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, 20).astype(np.uint64)])) for _ in range(2))
        met.append(bool(set(band_keys(a).tolist()) & set(band_keys(b).tolist())))
    assert np.mean(met) >= 0.96  # 0.991 expected at 0.8


def test_groups_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_texts, "FEW", 2)
    rng = random.Random(3)
    texts = edited_copies(rng, 40, 120, 0.01) + edited_copies(rng, 3, 200, 0.015) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(20)] + ["", " ", "one two", "ONE two"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (3, texts[3]), (None, texts[5]), (200, texts[0])]
    got = near_text_groups(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as node", "2 as root", "3 as n")).collect()
    want = plain_groups({t for _, t in rows} | {""})
    as_sets = lambda pairs: sorted(sorted(g) for g in pairs.values())
    hashes = {t: spark.sql("SELECT xxhash64(:t)", args={"t": t}).first()[0] for t in {t for _, t in rows}}
    mine, theirs = {}, {}
    for r in got:
        mine.setdefault(r.group, []).append(r.text_hash)
    for t in {t for _, t in rows}:
        theirs.setdefault(want[t], []).append(hashes[t])
    assert as_sets(mine) == as_sets(theirs)
    assert sum(r.n for r in got) == len(rows)


def test_sets_that_left_a_list_meet_the_others(spark, monkeypatch):
    """A chain in one list: each number's set is near its neighbours' only, so whatever hub is met links few."""
    monkeypatch.setattr(near_texts, "FEW", 2)
    for step in (10, 15):
        made = {i: np.arange(i * step, i * step + 160, dtype=np.uint64) for i in range(24)}
        assert jaccard(made[0], made[1]) >= 0.8 > jaccard(made[0], made[3])
        lists = spark.createDataFrame([(7, i, len(made)) for i in made], "list bigint, node bigint, n bigint")
        sets = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in made.items()], "node bigint, shingles binary")
        links = {tuple(sorted((r.u, r.v))) for r in near_texts.jaccard_links(lists, sets).collect()}
        assert all(jaccard(made[u], made[v]) >= 0.8 for u, v in links)
        group = list(range(24))
        for u, v in links:
            group = [group[u] if g == group[v] else g for g in group]
        assert len(set(group)) == 1


def test_a_long_list_of_other_sets_takes_few_rounds(spark, monkeypatch):
    """Jobs and plans of a round lie in the driver's memory: the rounds grow with the logarithm to base eight, and all pairs are met, once."""
    made = {i: np.arange(i * 1000, i * 1000 + 160, dtype=np.uint64) for i in range(60)}
    made[37] = np.arange(5 * 1000 + 10, 5 * 1000 + 170, dtype=np.uint64)
    labels, met = [], []

    def noted(df, label):
        labels.append(label)
        out = whole(df, label)
        if label == "pairs":
            met.extend(tuple(sorted((r.u, r.v))) for r in out.collect())
        return out

    whole = near_texts.materialise
    monkeypatch.setattr(near_texts, "materialise", noted)
    lists = spark.createDataFrame([(7, i, len(made)) for i in made] + [(8, i, 2) for i in (5, 6)], "list bigint, node bigint, n bigint")
    sets = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in made.items()], "node bigint, shingles binary")
    links = {tuple(sorted((r.u, r.v))) for r in near_texts.jaccard_links(lists, sets).collect()}
    assert links == {(5, 37)}
    assert labels.count("hubs") == 3  # of 1, 8 and 64
    assert len(set(met)) >= 60 * 59 / 2 - 58 and len(met) <= len(set(met)) + 10


def test_a_forest_holds_the_groups_of_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    for share in (0.05, 0.15, 0.3):
        sets = [np.unique(np.where(rng.random(60) < share * rng.random(), rng.integers(0, 1 << 63, 60).astype(np.uint64), base)) for _ in range(40)] + [base[:1], base[:3], base]
        sets = [np.unique(s) for s in sets]
        edges = near_texts.near_forest(sets)
        assert all(jaccard(sets[u], sets[v]) >= 0.8 for u, v in edges)
        joined = lambda pairs: reduce(lambda g, p: [g[p[0]] if x == g[p[1]] else x for x in g], pairs, list(range(len(sets))))
        want = joined([p for p in combinations(range(len(sets)), 2) if jaccard(sets[p[0]], sets[p[1]]) >= 0.8])
        assert [x == y for x, y in combinations(joined(edges), 2)] == [x == y for x, y in combinations(want, 2)]
        assert len(edges) == len(sets) - len(set(want))


def test_lists_that_fit_a_block_take_no_rounds_and_no_rows_of_pairs(spark, monkeypatch):
    """Near copies of one text make lists of dozens; others go through the hubs, with the same groups."""
    rng = random.Random(6)
    texts = edited_copies(rng, 60, 120, 0.02) + edited_copies(rng, 3, 200, 0.01)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels, whole = [], near_texts.materialise
    monkeypatch.setattr(near_texts, "materialise", lambda df, label: labels.append(label) or whole(df, label))

    def groups():
        found = {}
        for r in near_text_groups(docs).collect():
            found.setdefault(r.group, set()).add(r.text_hash)
        return sorted(map(sorted, found.values()))

    got = groups()
    assert not {"hubs", "meetings", "pairs"} & set(labels)
    monkeypatch.setattr(near_texts, "SHINGLES", 400)
    assert groups() == got and "hubs" in labels


def test_recall_at_a_similarity_of_four_fifths(spark):
    """All pairs of different texts of sf0.01 at 0.8 or more, against the groups."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: plain_set(r.text) for r in docs.collect()}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {p for ids in holders.values() for p in combinations(sorted(ids), 2)}
    pairs = {(a, b) for a, b in pairs if sets[a] != sets[b] and near(sets[a], sets[b])}
    hashed = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(text) AS h").collect()}
    group = {r.text_hash: r.group for r in near_text_groups(docs).collect()}
    found = sum(group[hashed[a]] == group[hashed[b]] for a, b in pairs)
    assert len(pairs) > 3 and found >= 0.9 * len(pairs)
    kept = {r.doc_id for r in keep_one(docs).collect()}
    assert kept == {min(i for i in hashed if group[hashed[i]] == g) for g in set(group.values())}


def test_hard_rows(spark, hard, clashing, empty):
    kept = keep_one(hard).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 4, 5, 6, 8] and len(kept) == 6
    some = keep_one(clashing)
    assert some.columns == clashing.columns and some.count() == 6
    assert keep_one(empty).count() == 0
