"""Document fingerprints by consistent weighted sampling.

A text is a set of terms, its words, weighted by how often they occur. For each
of ``SAMPLES`` samples a term has three draws, made from its hash alone: r and c
from the gamma distribution with shape 2, b uniform in [0, 1). With weight w,

    t = floor(ln w / r + b),   ln y = r (t - b),   ln a = ln c - ln y - r,

and the sample is the pair (term, t) with the smallest a. Two texts have the same
pair with a probability equal to their generalised Jaccard similarity, the sum
of the smaller weights over the sum of the larger ones, so the share of equal
places in two fingerprints estimates it. A fingerprint keeps 16 bits a pair.

Texts next to each other in order of ids are paired by dealing them by range,
once, and streaming over each range; only the texts at the ends of ranges are
written and matched again.
"""

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bytes_udf
from tessella.sources.shared import materialise, owning

SAMPLES = 64
SEED = 42
#: Words of more bytes count as their overlapping pieces of so many characters, so
#: that scripts without spaces have terms, too.
LONG_WORD = 48
PIECE = 8
#: Terms whose draws a worker keeps at most, three numbers a sample.
KEPT_TERMS = 65_536
BLOCK = 1_024
#: Terms that are drawn for at once, so that what is worked on stays in a core's cache.
DRAWN = 128
SLICE = 1 << 20
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

# Fixed values of the SplitMix64 generator: step and multipliers.
STEP = np.uint64(0x9E3779B97F4A7C15)
MULTIPLIERS = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEPS = STEP * np.arange(1, SAMPLES + 1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finish, in place: 64 well mixed bits of 64 bits."""
    other = x >> np.uint64(30)
    for shift, by in ((27, MULTIPLIERS[0]), (31, MULTIPLIERS[1])):
        x ^= other
        x *= by
        np.right_shift(x, np.uint64(shift), out=other)
    x ^= other
    return x


def _exponential(bits: int) -> np.ndarray:
    """The exponential distribution's quantiles at the middles of 2^bits equal shares, downwards."""
    return np.round(-np.log((np.arange(1 << bits) + 0.5) / (1 << bits)), 12)


#: Draws come from tables, of bits that are cut from one mixed number: 10 and 10 for r, the
#: sum of two exponential draws, 12 for b, 16 and 16 for c.
TEN, SIXTEEN = _exponential(10), _exponential(16)


def draws(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, b and ln c - r (1 - b) of each term hash and sample, in single precision."""
    bits = mix(hashes[:, None] + STEPS[None, :])
    cut = lambda shift, n: ((bits >> np.uint64(shift)) & np.uint64((1 << n) - 1)).view(np.int64)
    r = TEN[cut(54, 10)]
    r += TEN[cut(44, 10)]
    b = cut(32, 12) * (1 / 4096) + 1 / 8192
    c = SIXTEEN[cut(16, 16)]
    c += SIXTEEN[cut(0, 16)]
    light = np.log(c, out=c)
    light -= r * (1 - b)
    return r, b, light


def terms_of(text: bytes) -> Counter:
    """The terms of a text and how often they occur, in slices that end between words."""
    counts: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and LOWER[text[end]] != 0x20:
            end += 1
        counts.update(text[at:end].translate(LOWER).split())
        at = end
    if max(map(len, counts), default=0) <= LONG_WORD:
        return counts
    for word in [w for w in counts if len(w) > LONG_WORD]:
        n, letters = counts.pop(word), word.decode()
        for i in range(max(1, len(letters) - PIECE + 1)):
            counts[letters[i : i + PIECE].encode()] += n
    return counts


class Sampler:
    """Fingerprints of weighted terms; keeps the draws of the terms that it meets most."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.met = np.zeros(KEPT_TERMS, np.int64)
        self.hashes = np.empty(KEPT_TERMS, np.uint64)
        self.r, self.b, self.light = (np.empty((KEPT_TERMS, SAMPLES), np.float32) for _ in range(3))

    def _make_room(self) -> None:
        """Forget half of the terms, those met least often; counts are halved, so that old ones fade."""
        n = len(self.place)
        keep = np.sort(np.argsort(-self.met[:n], kind="stable")[: KEPT_TERMS // 2])
        for kept in (self.hashes, self.r, self.b, self.light):
            kept[: len(keep)] = kept[keep]
        halved = self.met[keep] // 2
        self.met[:] = 0
        self.met[: len(keep)] = halved
        terms = list(self.place)  # in order of their places
        self.place = {terms[i]: at for at, i in enumerate(keep.tolist())}

    def _places(self, terms: list[bytes]) -> np.ndarray:
        place = self.place
        rows = np.array([place.get(t, -1) for t in terms])
        missing = np.flatnonzero(rows < 0)
        if len(missing) and len(place) + len(missing) > KEPT_TERMS:
            self._make_room()
            return self._places(terms)
        if len(missing):
            first, last = len(place), len(place) + len(missing)
            new = [terms[i] for i in missing.tolist()]
            place.update(zip(new, range(first, last)))
            rows[missing] = np.arange(first, last)
            self.hashes[first:last] = [xxhash.xxh64_intdigest(t, SEED) for t in new]
            for at in range(first, last, DRAWN):
                some = slice(at, min(at + DRAWN, last))
                self.r[some], self.b[some], self.light[some] = draws(self.hashes[some])
        self.met[rows] += 1
        return rows

    def samples(self, counts: Counter) -> np.ndarray:
        """The 16 bits of each sample, 1 to 65,535; all 0 without terms."""
        best, term, step = np.full(SAMPLES, np.inf), np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.int64)
        terms, often, samples = list(counts), np.array(list(counts.values()), np.float64), np.arange(SAMPLES)
        for at in range(0, len(terms), BLOCK):
            part = terms[at : at + BLOCK]
            rows, weights = self._places(part), often[at : at + BLOCK]
            a = self.light[rows]  # ln a of terms that occur once, where t is 0
            more = np.flatnonzero(weights > 1)
            if len(more):
                r = self.r[rows[more]].astype(np.float64)
                t = np.floor(np.log(weights[more])[:, None] / r + self.b[rows[more]])
                a[more] -= r * t
            least = a.argmin(axis=0)
            value = a[least, samples]
            better = np.flatnonzero(value < best)
            best[better], term[better], step[better] = value[better], self.hashes[rows[least[better]]], 0
            if len(more):
                at_more = np.full(len(part), -1)
                at_more[more] = np.arange(len(more))
                heavy = better[at_more[least[better]] >= 0]
                step[heavy] = t[at_more[least[heavy]], heavy].astype(np.int64)
        if not terms:
            return np.zeros(SAMPLES, np.uint16)
        return (mix(term + step.astype(np.uint64) * STEP) % np.uint64(65_535) + np.uint64(1)).astype(np.uint16)

    def of_text(self, text: bytes) -> np.ndarray:
        return self.samples(terms_of(text))


_SAMPLER: list[Sampler] = []


def sampler() -> Sampler:
    """The worker's sampler; what it keeps follows from the terms alone, so texts of any table may share it."""
    if not _SAMPLER:
        _SAMPLER.append(Sampler())
    return _SAMPLER[0]


def add_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text as hexadecimal digits; null counts as empty."""

    def batch(texts: list[bytes]) -> pa.Array:
        of = sampler().of_text
        return pa.array([of(t).astype(">u2").tobytes().hex() for t in texts], pa.string())

    return docs.withColumn(out_col, bytes_udf(batch, "string")(F.col(text_col)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal samples; 1 for two texts without terms."""
    return float((a == b).mean())


def likeness_of(a: Column, b: Column) -> Column:
    """``likeness`` of two columns of fingerprints."""
    pieces = lambda x: F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda i: F.substring(x, 4 * i + 1, F.lit(4)))
    same = F.zip_with(pieces(a), pieces(b), lambda x, y: (x == y).cast("double"))
    return F.aggregate(same, F.lit(0.0), lambda n, x: n + x) / SAMPLES


def edited(text: str, following: str) -> str:
    """``text``, its last third replaced by the beginning of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


PAIRED = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: 0: a row with its successor; 1: the last of its range, which has none there; 2: the first of its range.
FOUND, LAST, FIRST = 0, 1, 2


def paired(text: str, fp: np.ndarray, following: str, following_fp: np.ndarray) -> tuple:
    new = edited(text, following)
    new_fp = fp if new == text else sampler().of_text(new.encode())
    digits = lambda x: x.astype(">u2").tobytes().hex()
    return len(text), hashlib.sha256(new.encode()).hexdigest(), digits(fp), digits(new_fp), likeness(fp, new_fp), likeness(fp, following_fp)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document.

    The next document is that with the next smaller id, after the smallest that
    with the largest; null ids come last, and among equal ids texts go by their
    hashes, downwards. A null text is empty, an empty one is like another empty
    one. A single document is its own next. Repeated rows each get a row.
    """
    id_kind = dict(docs.dtypes)[id_col]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc_nulls_last("doc_id"), F.desc("hash")]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(partitions, *order).sortWithinPartitions(*order)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, of = TaskContext.get().partitionId(), sampler().of_text
        held = None
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fp = of(text.encode())
                if held is None:
                    out.append((i, FIRST, part, text, None))
                else:
                    out.append((held[0], FOUND, part, None, paired(held[1], held[2], text, fp)))
                held = i, text, fp
            yield table(out, kind)
        if held is not None:
            yield table([(held[0], LAST, part, held[1], None)], kind)

    def table(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        ids, what, part, text, pair = zip(*out) if out else ((),) * 5
        fields = [pa.field(n, k) for n, k in zip(("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"), (pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2))]
        columns = [pa.array([None if p is None else p[k] for p in pair], f.type) for k, f in enumerate(fields)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, kind), pa.array(what, pa.int32()), pa.array(part, pa.int32()), pa.array(text, pa.string()), *columns],
            schema=pa.schema([pa.field("doc_id", kind), pa.field("what", pa.int32()), pa.field("part", pa.int32()), pa.field("text", pa.string()), *fields]),
        )

    streamed = dealt.select("doc_id", "text").mapInArrow(stream, f"doc_id {id_kind}, what int, part int, text string, {PAIRED}")
    streamed = materialise(streamed, "paired")
    wanted = [c.split()[0] for c in PAIRED.split(", ")]
    found = streamed.where(F.col("what") == FOUND).select("doc_id", *wanted)

    # The last of a range goes with the first of the next range that has rows, two texts a range.
    parts = sorted(r.part for r in streamed.where(F.col("what") == FIRST).select("part").collect())  # at most one a range
    if not parts:
        return owning(found, streamed)
    after = dict(zip(parts, parts[1:] + parts[:1]))
    follows = docs.sparkSession.createDataFrame(list(after.items()), "part int, next_part int")
    firsts = streamed.where(F.col("what") == FIRST).select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    ends = streamed.where(F.col("what") == LAST).select("doc_id", "part", "text").join(F.broadcast(follows), "part").join(firsts, "next_part")

    @F.arrow_udf(f"struct<{','.join(f'{c.split()[0]}:{c.split()[1]}' for c in PAIRED.split(', '))}>")
    def pair(texts: pa.Array, following: pa.Array) -> pa.Array:
        of = sampler().of_text
        out = [paired(a, of(a.encode()), b, of(b.encode())) for a, b in zip(texts.to_pylist(), following.to_pylist())]
        kinds = (pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2)
        return pa.StructArray.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=wanted)

    closed = ends.select("doc_id", pair("text", "next_text").alias("p")).select("doc_id", "p.*")
    return owning(found.unionByName(closed), streamed)
