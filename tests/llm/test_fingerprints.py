import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from conftest import HARD, SCHEMA
from tessella.llm import fingerprints
from tessella.llm.fingerprints import SAMPLES, Sampler, edited, likeness, terms_of, with_next
from tessella.llm.queries import queries

MASK = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_fingerprint(counts):
    """A second writing, sample by sample and term by term."""
    out = []
    for j in range(SAMPLES):
        best = None
        for term, w in counts.items():
            h = xxhash.xxh64_intdigest(term, 42)
            x = plain_mix(h + 0x9E3779B97F4A7C15 * (j + 1) & MASK)
            drawn = lambda shift, bits: -math.log(((x >> shift) % 2**bits + 0.5) / 2**bits)
            r, b, c = drawn(54, 10) + drawn(44, 10), ((x >> 32) % 4096 + 0.5) / 4096, drawn(16, 16) + drawn(0, 16)
            r = float(np.float32(r))
            t = math.floor(math.log(w) / r + b)
            a = np.float32(math.log(c) - r * (1 - b))
            a = np.float32(a - np.float64(r) * t)
            if best is None or a < best[0]:
                best = a, h, t
        out.append(0 if best is None else plain_mix(best[1] + best[2] * 0x9E3779B97F4A7C15 & MASK) % 65_535 + 1)
    return np.array(out)


def plain_terms(text):
    letters = "".join(c.lower() if c.isascii() and c.isalpha() else c if c.isalnum() or not c.isascii() else " " for c in text)
    out = Counter()
    for word in letters.split(" "):
        if len(word.encode()) > 48:
            out.update(word[i : i + 8].encode() for i in range(max(1, len(word) - 7)))
        elif word:
            out[word.encode()] += 1
    return out


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, np.int64(np.uint64(xxh(r[1])))), reverse=True)
    one = Sampler().of_text
    out = Counter()
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        new = edited(t, following)
        a, b, c = (one(x.encode()) for x in (t, new, following))
        hexed = [x.astype(">u2").tobytes().hex() for x in (a, b)]
        out[i, len(t), hashlib.sha256(new.encode()).hexdigest(), *hexed, likeness(a, b), likeness(a, c)] += 1
    return out


def xxh(text):
    return xxhash.xxh64_intdigest(text.encode(), 42)  # as Spark's xxhash64 of a string


@pytest.mark.parametrize("text", ["One two two THREE three three", "", "word " * 500, "Ünïcödé 日本語 🙂\x00end", "日本語のテキスト" * 40, "x" * 70 + " " + "y" * 48])
def test_fingerprint_equals_a_second_writing(text):
    assert terms_of(text.encode()) == plain_terms(text)
    counts = plain_terms(text)
    assert Sampler().samples(counts).tolist() == plain_fingerprint(counts).tolist()


def test_slices_end_between_words(monkeypatch):
    text = " ".join(random.Random(1).choices(["alpha", "beta", "Gamma", "é" * 30, "x"], k=500)).encode()
    whole = terms_of(text)
    monkeypatch.setattr(fingerprints, "SLICE", 64)
    assert terms_of(text) == whole


def test_blocks_and_a_small_memory_change_nothing(monkeypatch):
    texts = [" ".join(random.Random(k).choices([f"w{i}" for i in range(300)], k=400)).encode() for k in range(5)]
    want = [Sampler().of_text(t).tolist() for t in texts]
    monkeypatch.setattr(fingerprints, "BLOCK", 50)
    monkeypatch.setattr(fingerprints, "KEPT_TERMS", 120)
    one = Sampler()
    assert [one.of_text(t).tolist() for t in texts] == want


def test_collision_rate_is_the_generalised_jaccard_similarity():
    rng, errors, sampler = random.Random(9), [], Sampler()
    for k in range(60):
        a = Counter({f"{k}t{i}".encode(): rng.choice([1, 1, 2, 5, 30]) for i in range(40)})
        b = Counter({t: (w if rng.random() < k / 60 else rng.choice([1, 2, 9])) for t, w in a.items() if rng.random() < 0.9})
        true = sum(min(a[t], b[t]) for t in a) / sum(max(a[t], b[t]) for t in a)
        errors.append(likeness(sampler.samples(a), sampler.samples(b)) - true)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.08 and max(map(abs, errors)) < 0.25


@pytest.mark.parametrize("rows", [HARD, [(1, "only one")], [(i, f"word{i} and {i % 3} more words {'x ' * (i % 7)}") for i in range(60)], []], ids=["hard", "one", "many", "empty"])
def test_rows_equal_brute_force(spark, rows):
    rows = [(i, t) for i, t in rows if len(t or "") < 200_000]
    got = with_next(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as what", "2 as part", "'clash' as fingerprint", "3 as hash"))
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = queries()["op11_fingerprints"](spark, folder).collect()
    assert Counter(map(tuple, got)) == brute(rows)
    assert np.mean([r.near_edited for r in got]) > 0.5 > np.mean([r.near_next for r in got]) + 0.1


def test_columns_of_the_operator(spark):
    frame = spark.createDataFrame([(1, "a b c a", "kept"), (2, None, "kept")], SCHEMA + ", fingerprint string")
    got = fingerprints.add_fingerprint(frame, out_col="fp")
    assert got.columns == ["doc_id", "text", "fingerprint", "fp"]
    both = got.crossJoin(got.selectExpr("fp as other")).select(fingerprints.likeness_of(got["fp"], "other").alias("x")).collect()
    assert sorted(r.x for r in both) == [0.0, 0.0, 1.0, 1.0]
