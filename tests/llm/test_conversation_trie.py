import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from tessella.llm.conversation_trie import conversation_trie
from tessella.llm.digests import joined_sha256

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows):
    """{conv_id: its turns}, by a second, plain writing."""
    said = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    convs = {}
    for c, n, r, t in rows:
        if c is not None:
            r, t = r or "", t or ""
            convs.setdefault(c, []).append(((n is not None, n or 0), r.encode(), t[:64].encode(), said(r, t), (r, t)))
    turns = {c: [x[-1] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = tuple(turns.get(base, [])[:h] + own[h:])
    return out


def brute(rows):
    convs = rebuilt(rows)
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = Counter()
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[:-1] == n for m in below if len(m) == len(n) + 1)]
        words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        saved = sum((len(nodes[n]) - 1) * words(n) for n in below)
        ends = ",".join(map(str, sorted(c for c in members if convs[c] == node)))
        parent = min(nodes[node[:-1]]) if node else None
        out[min(members), len(node), parent, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def found(df):
    return Counter(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()))


def random_rows(seed):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice("ua"), rng.choice(["x", "y z", "w"])) for c in rng.sample(range(-25, 70), 50) for t in range(rng.randint(1, 6))]
    rng.shuffle(rows)
    return rows


HARD = [
    (None, 1, "user", "nobody's"), (20, None, None, None), (20, None, None, None), (20, 1, "user", ""), (20, 1, "user", "   "), (20, 2, "a", "word " * 30_000), (21, 5, "user", "日本語 text\x00"),
    (21, 5, "assistant", "tie"), (21, 5, "assistant", "tie"), (-3, 0, "u", "minus"), (-40, 0, "u", "minus"), (41, 0, "u", "base is missing"), (9_000_000_000, 0, "u", "large"),
]
CASES = {
    "random": random_rows(1),
    "copies": [(c, t, "u", f"same {t}") for c in range(40, 90) for t in range(3)] + random_rows(2),
    "one long conversation": [(7, t, "u", f"turn {t % 3}") for t in range(120)] + [(c, 0, "u", "short") for c in range(8)],
    "hard": HARD,
    "null only": [(None, None, None, None)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_trie_equals_brute_force(spark, name):
    got = conversation_trie(spark.createDataFrame(CASES[name], SCHEMA).selectExpr("*", "'clash' as id", "1 as depth", "2 as head", "3 as pos"))
    assert found(got) == brute(CASES[name])


def test_query_equals_brute_force(spark):
    from tessella.llm.queries import queries

    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries()["op12_conversation_trie"](spark, folder)) == brute(rows)


def test_joined_digests(spark):
    rows = [("hot", i) for i in range(9000)] + [(f"k{i % 5}", -i) for i in range(50)] + [(None, 1)]
    random.Random(5).shuffle(rows)
    want = {}
    for k, v in rows:
        want.setdefault(k, []).append(v)
    got = {r.key: r.sha256 for r in joined_sha256(spark.createDataFrame(rows, "key string, value bigint"), "key", "value").collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}
    assert joined_sha256(spark.createDataFrame([], "key string, value bigint"), "key", "value").count() == 0
