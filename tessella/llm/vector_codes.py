"""Codes of vectors: part by part the nearest entry of a codebook, in whole numbers.

A vector's components become integers and the vector is cut into equal parts.
Each part position has a codebook, which starts from the first vectors and is
improved in rounds: parts are assigned to their nearest entries, and each entry
becomes the floor of its parts' mean. Tasks send a count and a sum for each
(part, entry), whatever they have read, so nothing but codebooks is shuffled.

The nearest entry is found by annular norm pruning. Entries are sorted by norm;
by the triangle inequality, one at distance d or less from x has a norm between
|x| - d and |x| + d. The entries on either side of |x| in norm give a first d,
binary search the interval that d allows, both ends included, and only the
entries in it are measured, exactly.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.texts import fresh_name
from tessella.operators.skew import spread_join
from tessella.sources.shared import materialise, owning

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Components with integers of this size or more are left out: squared distances
#: between such vectors don't fit a long.
TOO_LARGE = 1 << 26
#: What floating point may be off in norms and distances, as a share of them.
SLACK = 1e-9
BLOCK = 4096


def part_norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=-1).astype(np.float64))


@dataclass
class Annuli:
    """One part position's codebook, sorted by norm."""

    entries: np.ndarray  # (entries, width), in norm order
    norms: np.ndarray
    index: np.ndarray  # place in the codebook of each

    @staticmethod
    def of(codebook: np.ndarray) -> "Annuli":
        norms = part_norms(codebook)
        order = np.argsort(norms, kind="stable")
        return Annuli(codebook[order], norms[order], order)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``x`` its nearest entry, ties to the lower index, and the squared distance."""
        norms = part_norms(x)
        above = np.minimum(np.searchsorted(self.norms, norms), len(self.norms) - 1)
        first = np.minimum(*(((x - self.entries[at]) ** 2).sum(axis=1) for at in (above, np.maximum(above - 1, 0))))
        reach = np.sqrt(first.astype(np.float64))
        slack = SLACK * (norms + reach + 1)
        low = np.searchsorted(self.norms, norms - reach - slack, "left")
        high = np.searchsorted(self.norms, norms + reach + slack, "right")
        widths = high - low
        starts = np.cumsum(widths) - widths
        entry = np.arange(widths.sum()) - np.repeat(starts - low, widths)
        distance = ((np.repeat(x, widths, axis=0) - self.entries[entry]) ** 2).sum(axis=1)
        best = np.minimum.reduceat(distance, starts)
        index = np.where(distance == np.repeat(best, widths), self.index[entry], len(self.index))
        return np.minimum.reduceat(index, starts), best


def assign(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, parts) codes and squared distances of integer vectors ``x`` (n, parts * width); codebooks: (parts, entries, width)."""
    parts, _, width = codebooks.shape
    cut = x.reshape(len(x), parts, width)
    codes, errors = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
    for p in range(parts):
        annuli = Annuli.of(codebooks[p])
        for at in range(0, len(x), BLOCK):
            rows = slice(at, at + BLOCK)
            codes[rows, p], errors[rows, p] = annuli.nearest(cut[rows, p])
    return codes, errors


def _integers(vector: Column) -> Column:
    """Components as integers; null where one is null, not finite or too large, or there is no vector."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    fits = F.forall(vector, lambda x: F.coalesce((F.abs(x.cast("double")) * SCALE < TOO_LARGE) & ~F.isnan(x), F.lit(False)))
    return F.when(vector.isNotNull() & fits, scaled)


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, out_col: str, parts: int) -> tuple[DataFrame, np.ndarray]:
    """``vectors`` with integers in ``out_col``, those that have them, and the first codebooks.

    Codebooks hold the vectors with the ``ENTRIES`` smallest ids, or as many as there are; equal ids
    go by their vectors, null ids come last.
    """
    sized = vectors.withColumn(out_col, _integers(F.col(vector_col))).where((F.size(out_col) > 0) & (F.size(out_col) % parts == 0))
    order = (F.col(id_col).asc_nulls_last(), out_col)
    first = sized.orderBy(*order).select(F.size(out_col)).first()
    width = first[0] if first else parts
    kept = sized.where(F.size(out_col) == width)
    start = kept.orderBy(*order).select(out_col).limit(ENTRIES).collect()
    books = np.array([r[0] for r in start], np.int64).reshape(len(start), parts, width // parts)
    return kept, np.ascontiguousarray(books.transpose(1, 0, 2))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def improved(kept: DataFrame, column: str, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round: entries become the floor of their parts' means, unused ones stay."""
    parts, entries, width = codebooks.shape
    shared = kept.sparkSession.sparkContext.broadcast(codebooks)  # parts x entries, whatever the table

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                codes, _ = assign(x, shared.value)
                for p in range(parts):
                    counts[p] += np.bincount(codes[:, p], minlength=entries)
                    np.add.at(sums[p], codes[:, p], x.reshape(len(x), parts, width)[:, p])
        used = np.argwhere(counts)
        yield pa.record_batch({"part": used[:, 0], "entry": used[:, 1], "n": counts[counts > 0], "sums": pa.array(list(sums[counts > 0]), pa.list_(pa.int64()))})

    sent = kept.select(column).mapInArrow(tally, "part bigint, entry bigint, n bigint, sums array<bigint>")
    exact = [_floor_mean(f"s{i}").alias(f"c{i}") for i in range(width)]
    grouped = sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(30,0)")).alias(f"s{i}") for i in range(width)])
    out = codebooks.copy()
    for r in grouped.select("part", "entry", *exact).collect():  # parts x entries
        out[r.part, r.entry] = r[2:]
    return out


def _floor_mean(total: str) -> Column:
    """floor(total / n) in whole numbers: ``div`` cuts towards zero."""
    return F.expr(f"CAST(({total} - pmod({total}, CAST(n AS DECIMAL(30,0)))) div n AS BIGINT)")


def codebooks_sha256(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def fit_codebooks(kept: DataFrame, column: str, codebooks: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after ``rounds`` rounds over all of ``kept``."""
    for _ in range(rounds if codebooks.size else 0):
        codebooks = improved(kept, column, codebooks)
    return codebooks


def add_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", out_col: str = "coded", parts: int = PARTS) -> tuple[DataFrame, np.ndarray]:
    """``vectors`` with a struct of code and error, and the codebooks.

    Left out are rows whose vector is null, empty or holds a component that is
    null, not finite or too large for exact distances (2^18 and more), and rows
    whose length isn't that of the vector with the smallest id, a multiple of
    ``parts``. Null ids come last in the order that codebooks start from; equal
    ids go by their vectors. Without vectors there are no codebooks and no rows.
    """
    ints = fresh_name(vectors, "ints")
    kept, codebooks = kept_vectors(vectors, id_col, vector_col, ints, parts)
    codebooks = fit_codebooks(kept, ints, codebooks)
    shared = kept.sparkSession.sparkContext.broadcast(codebooks)

    @F.arrow_udf("struct<code:string,error:bigint>")
    def code(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.StructArray.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64())], names=["code", "error"])
        codes, errors = assign(_matrix(column), shared.value)
        texts = [row.tobytes().hex() for row in codes.astype(np.uint8)]
        return pa.StructArray.from_arrays([pa.array(texts), pa.array(errors.sum(axis=1))], names=["code", "error"])

    return kept.withColumn(out_col, code.asNondeterministic()(ints)).drop(ints), codebooks


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that ``add_codes`` keeps.

    ``label_error`` is the error of all vectors of a label, null labels together;
    it is null where the sum doesn't fit a long.
    """
    coded, codebooks = add_codes(vectors.select("vec_id", "embedding", "label"))
    label = F.coalesce(F.concat(F.lit("l"), F.col("label").cast("string")), F.lit("none")).alias("label")
    rows = materialise(coded.select("vec_id", label, "coded.code", "coded.error"), "coded")
    labels = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error"), F.count(F.lit(1)).alias("n"))
    labels = materialise(labels, "labels")
    found = spread_join(rows, labels, "label", "n", rows.count())
    return owning(found.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(codebooks)).alias("codebooks_sha256")), rows, labels)
