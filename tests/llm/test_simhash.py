import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tessella.llm import simhash
from tessella.llm.simhash import fingerprint, fingerprint_groups, forest, keep_one, near_duplicates


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps):
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(sorted(set(fps)), 2):
        if bin(a ^ b).count("1") <= 4:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {f: top(f) for f in fps}


def test_pairs_meet_as_often_as_their_shared_bytes_say(spark):
    rng = random.Random(2)
    a = rng.getrandbits(63)
    for shared in range(9):
        other = a ^ sum(rng.randint(1, 255) << 8 * p for p in rng.sample(range(8), 8 - shared)) & ((1 << 63) - 1)
        same = sum((a ^ other) >> 8 * p & 255 == 0 for p in range(8))
        frame = spark.createDataFrame([(a,), (other,)] if a != other else [(a,)], "fp long")
        met = simhash._meetings(simhash._postings(frame, simhash.LISTED)).count()
        assert met == (simhash.comb(same, 3) if a != other else 0)
    assert simhash.LEAST_MEETINGS == 4


def test_fingerprints_equal_brute_force(sf_dir, spark):
    from conftest import HARD

    texts = [t for _, t in HARD] + ["One two", "a b c d", "a b c d e\x0bF\x1cg"]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(40).collect()]
    for t in texts:
        if len(t or "") < 100_000:
            assert fingerprint((t or "").encode()) == plain_fingerprint(t)
    many = " ".join(str(i) for i in range(70_000))
    assert fingerprint(many.encode()) == plain_fingerprint(many)


def test_forest_and_star_span_the_links(spark):
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 1 << 63, 6).astype(np.uint64)
    fps = np.unique(np.array([centre[rng.integers(6)] ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, 3))) for _ in range(60)]))
    star = simhash._star_links(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long"))
    want = plain_groups(fps.tolist())
    for edges in (forest(fps), [(r.u % (1 << 64), r.v % (1 << 64)) for r in star.collect()]):
        assert all(0 < bin(x ^ y).count("1") <= 4 for x, y in edges)
        root = {f: f for f in want}

        def top(f):
            while root[f] != f:
                f = root[f]
            return f

        for x, y in edges:
            lo, hi = sorted((top(x), top(y)))
            root[hi] = lo
        assert {f: top(f) for f in want} == want
    assert len(forest(fps)) == len(fps) - len(set(want.values()))


@pytest.mark.parametrize("short, block", [(32, 1024), (3, 16), (2, 4)])
def test_groups_equal_all_pairs(spark, monkeypatch, short, block):
    monkeypatch.setattr(simhash, "SHORT_LIST", short)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = set(centres)
    for c in centres[:6]:  # crowds and chains
        at = c
        for _ in range(25):
            at ^= 1 << rng.randrange(64) if rng.random() < 0.5 else (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            fps.add(at)
            fps.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r.fp % (1 << 64): r.root for r in fingerprint_groups(frame).collect()}
    want = plain_groups(list(fps))
    as_classes = lambda m: {frozenset(f for f in m if m[f] == r) for r in set(m.values())}
    assert as_classes(got) == {c for c in as_classes(want) if len(c) > 1}


def test_documents(spark, hard, clashing, empty, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id > 10").union(hard)
    rows = near_duplicates(docs).collect()
    source = docs.collect()
    assert len(rows) == len(source)
    fps = {}
    for r in source:
        fps.setdefault(fingerprint((r.text or "").encode()), []).append(r.doc_id)
    groups = plain_groups(list(fps))
    least = {}
    for f, root in groups.items():
        least.setdefault(root, []).extend(i for i in fps[f] if i is not None)
    want = sorted((str(i), f, min(least[groups[f]], default=None)) for f, ids in fps.items() for i in ids)
    assert sorted((str(r.doc_id), r.fingerprint % (1 << 64), r.component_id) for r in rows) == want
    kept = keep_one(docs).collect()
    assert sorted(groups[fingerprint((r.text or "").encode())] for r in kept) == sorted(set(groups.values()))
    assert keep_one(clashing).columns == clashing.columns
    assert keep_one(empty).count() == near_duplicates(empty).count() == 0
