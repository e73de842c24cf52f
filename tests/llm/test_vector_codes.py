import hashlib
import math
import random

import numpy as np
import pytest

from tessella.llm import vector_codes
from tessella.llm.queries import queries

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """A second, plain writing in Python's integers."""
    ints = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    whole = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) and abs(x) < 2**18 for x in r[1])]
    order = lambda r: (r[0] is None, r[0] or 0, ints(r[1]))
    whole = sorted((r for r in whole if len(r[1]) % parts == 0), key=order)
    kept = [(i, ints(v), label) for i, v, label in whole if len(v) == len(whole[0][1])]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for _, v, _ in kept:
                met.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(met[i]) for c in zip(*met[i])] if i in met else e for i, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = []
    for i, v, label in kept:
        best = [nearest(cut(v, p), books[p]) for p in range(parts)]
        coded.append((i, "".join(f"{b:02x}" for _, b in best), sum(d for d, _ in best), label))
    of = {}
    for _, _, e, label in coded:
        of[label] = of.get(label, 0) + e
    return sorted(((i, c, e, of[label], digest) for i, c, e, label in coded), key=repr)


def vectors(n, dims, seed, spread=1.0):
    rng = random.Random(seed)
    return [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(n)]


def hard_rows():
    rows = [(i, v, i % 3 if i % 4 else None) for i, v in enumerate(vectors(90, 32, 1))]
    v = rows[5][1]
    bad = [None, [], [None] * 32, [float("nan"), *v[1:]], [float("inf"), *v[1:]], [-float("inf"), *v[1:]], v[:16], v[:7], [1e30, *v[1:]], [float(2**18), *v[1:]]]
    rows += [(-i, b, 1) for i, b in enumerate(bad)] + [(5, v, 2), (5, v, 2), (None, v, None), (-50, [0.0] * 32, 0), (-49, [-1e-9] * 32, 0), (700, [2.0**18 - 1] * 32, 9), (701, [1 - 2.0**18] * 32, 9)]
    random.Random(2).shuffle(rows)
    return rows


CASES = {
    "hard": hard_rows(),
    "few": [(i, v, 1) for i, v in enumerate(vectors(5, 16, 3))],
    "ties": [(i, [float(i % 2)] * 16, None) for i in range(80)],
    "one label": [(i, v, 7) for i, v in enumerate(vectors(70, 48, 4, 0.05))],
    "none whole": [(1, None, 1), (2, [1.0] * 15, 1)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_codes_equal_brute_force(spark, name):
    frame = spark.createDataFrame(CASES[name], SCHEMA).selectExpr("*", "'clash' as ints", "1 as coded", "2 as code", "3 as n")
    got = vector_codes.vector_codes(frame)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(CASES[name])


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, queries()["op13_vector_codes"](spark, folder).collect()), key=repr) == brute(rows)


def test_the_annulus_holds_the_nearest_entry_and_its_ties():
    rng = np.random.default_rng(6)
    for spread in (2, 50, 1 << 26):
        book = rng.integers(-spread, spread, (64, 4))
        book[10:20] = book[30:40]
        x = np.concatenate([rng.integers(-spread, spread, (500, 4)), book])
        every = ((x[:, None].astype(object) - book[None]) ** 2).sum(axis=2)
        codes, best = vector_codes.Annuli.of(book).nearest(x)
        assert codes.tolist() == [min(range(64), key=lambda i: (row[i], i)) for row in every] and best.tolist() == every.min(axis=1).tolist()
