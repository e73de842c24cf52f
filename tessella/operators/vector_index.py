"""An exact inverted-file index of views: cells around centres, and bounds that say which cells can be skipped.

Every sound view lies in the cell of its nearest centre, with its distance from
it. Centres are views themselves, those with the smallest hashes of their ids, a
bounded number. Cells are Parquet, packed in matrices; a cell with a large share
of the views is dealt over many rows. Beside them stands what is known of each
cell: its centre, and the least and greatest distance in it.

A search measures each query view against the centres, reads the nearest cells,
and so knows how good the last of its best objects is at least. By the triangle
inequality a view in a cell is no nearer than | d - r |, d the query's distance
from the centre and r any distance in the cell. Cells that can't hold anything as
good are skipped; all others are read. So the answer is that of a search over all
views, ties included.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.texts import ANGLES, canonical_angle
from tessella.operators.retrieval import _PACKED, _VIEW_SCORES, PACKED_BYTES, SLICE, Policy, _matrix, _scores, _unpacked, common_dimension, sound_views
from tessella.sources.shared import discard, materialise, new_path

#: Similarities are rounded to nine places, and distances near zero are right to eight; a bound must be worse by more than that.
SLACK = 1e-7


@dataclass(frozen=True)
class VectorIndex:
    """Where an index lies, and its dimension."""

    folder: str
    dimension: int

    def cells(self, spark) -> DataFrame:
        """cell, and packed views."""
        return spark.read.parquet(f"{self.folder}/cells")

    def centres(self, spark) -> DataFrame:
        """cell, centre, n, nearest, farthest: one row a cell that has views."""
        return spark.read.parquet(f"{self.folder}/centres")


def _dealt(rows: DataFrame, dimension: int, *order: str) -> DataFrame:
    """``rows`` (cell, object, view, vector, quality, code) as packed matrices of one cell each, about ``PACKED_BYTES`` large."""
    most = max(16, PACKED_BYTES // (8 * max(dimension, 1)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            cells = np.asarray(whole.column(0))
            ends = np.flatnonzero(np.append(cells[1:] != cells[:-1], True)) + 1
            for start, end in zip([0, *ends[:-1]], ends):
                for at in range(start, end, most):
                    batch = whole.slice(at, min(most, end - at))
                    objects, views, quality, code = (np.asarray(batch.column(i)) for i in (1, 2, 4, 5))
                    by = np.lexsort((views, objects))
                    parts = (objects.astype("<i8"), views.astype("<i8"), quality.astype("<f8"), code.astype("u1"), _matrix(batch.column(3)).astype("<f8"))
                    yield pa.RecordBatch.from_pydict({"cell": pa.array([cells[start]], pa.int32()), **{k: [p[by].tobytes()] for k, p in zip(_PACKED, parts)}})

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(pack, ", ".join(["cell int", *(f"{k} binary" for k in _PACKED)]))


def _measured(views: DataFrame, centres: np.ndarray, schema: str, measure) -> DataFrame:
    """``views`` with a column ``near``: what ``measure`` says of the distances of each view from every centre."""
    shared = views.sparkSession.sparkContext.broadcast(centres)  # bounded: a fixed number of centres

    @F.arrow_udf(schema)
    def near(column: pa.Array) -> pa.Array:
        if not len(column):
            return measure(np.empty((0, len(shared.value))))
        cosines = np.clip(_matrix(column) @ shared.value.T, -1.0, 1.0)
        return measure(np.sqrt(2 - 2 * cosines))

    return views.withColumn("near", near("vector"))


def _sides(views: DataFrame, object_col: str, dimension: int, *ids: str) -> DataFrame:
    """object, view, vector, quality, code of the sound views."""
    code = F.coalesce(F.array_position(F.array(*map(F.lit, ANGLES)), canonical_angle(F.col("angle"))), F.lit(0)).cast("int")
    return sound_views(views, dimension, *ids).select(
        F.col(object_col).cast("bigint").alias("object"), F.col("view_id").cast("bigint").alias("view"), "vector", F.col("quality").cast("double").alias("quality"), code.alias("code")
    )


def build_index(gallery: DataFrame, cells: int = 64, dimension: int | None = None) -> VectorIndex:
    """Index every sound view of ``gallery`` (object_id, view_id, vector, quality, angle) in at most ``cells`` cells."""
    spark, folder = gallery.sparkSession, new_path(gallery.sparkSession, "index")
    dimension = common_dimension(gallery) if dimension is None else dimension
    views = _sides(gallery, "object_id", dimension, "object_id")
    chosen = views.orderBy(F.xxhash64("view"), "view", "vector").limit(cells).select("vector").collect()
    centres = np.array([r[0] for r in chosen], np.float64).reshape(len(chosen), dimension)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True) if len(centres) else 1.0

    def nearest(distances: np.ndarray) -> pa.Array:
        cell = distances.argmin(axis=1) if distances.size else np.zeros(0, int)
        return pa.StructArray.from_arrays([pa.array(cell, pa.int32()), pa.array(distances[np.arange(len(cell)), cell], pa.float64())], names=["cell", "distance"])

    placed = _measured(views, centres, "struct<cell:int,distance:double>", nearest).select("near.*", "object", "view", "vector", "quality", "code")
    placed = materialise(placed, "placed")
    _dealt(placed.drop("distance"), dimension, "cell", "object", "view").write.parquet(f"{folder}/cells")
    known = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("nearest"), F.max("distance").alias("farthest"))
    vectors = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    known.join(F.broadcast(vectors), "cell").select("cell", "centre", "n", "nearest", "farthest").write.parquet(f"{folder}/centres")
    discard(placed)
    return VectorIndex(folder, dimension)


def _round(plan: DataFrame, queries: DataFrame, index: VectorIndex, policy: Policy, top: int) -> DataFrame:
    """(query_view, object_id, similarity, best_view) from the cells that ``plan`` (view, cell) names, written."""
    spark = plan.sparkSession
    blocks = _dealt(plan.join(queries, "view").select("cell", "object", "view", "vector", "quality", "code"), index.dimension, "cell", "view")
    met = index.cells(spark).hint("merge").join(blocks.withColumnsRenamed({k: f"q_{k}" for k in _PACKED}), "cell")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block, chunk = _unpacked(row, "q_"), _unpacked(row, "")
                for at in range(0, len(block[0]), SLICE):
                    yield from _scores([part[at : at + SLICE] for part in block], chunk, policy, top)

    best = F.max(F.struct("similarity", (-F.col("best_view")).alias("order"))).alias("best")
    found = met.mapInArrow(score, _VIEW_SCORES).groupBy("query_view", "object_id").agg(best)
    return materialise(found, "found")


def search(queries: DataFrame, index: VectorIndex, top: int, policy: Policy = Policy(), probes: int = 4) -> tuple[DataFrame, int, int]:
    """query_view, rank, object_id, best_view, similarity of the ``top`` objects of each query view, as ``retrieval.best_objects`` gives them.

    Also returned: how many pairs of a query view and a cell were read, of how
    many. ``probes`` cells are read first; their number changes the work only.
    """
    spark = queries.sparkSession
    rows = index.centres(spark).orderBy("cell").collect()  # one a cell, a bounded number
    own = materialise(_sides(queries, "view_id", index.dimension), "queries")
    cells = np.array([r.cell for r in rows], np.int32)
    centres = np.array([r.centre for r in rows], np.float64).reshape(len(rows), index.dimension)
    low, high = (np.array([r[k] for r in rows], np.float64) for k in ("nearest", "farthest"))

    def bounds(distances: np.ndarray) -> pa.Array:
        apart = np.maximum(0, np.maximum(low - distances, distances - high))
        order = np.argsort(np.argsort(distances, axis=1, kind="stable"), axis=1)
        n = np.arange(len(distances) + 1) * len(cells)
        fields = [pa.array(np.tile(cells, len(distances))), pa.array(order.ravel().astype(np.int32)), pa.array((1 - apart**2 / 2).ravel())]
        return pa.ListArray.from_arrays(pa.array(n, pa.int32()), pa.StructArray.from_arrays(fields, names=["cell", "place", "most"]))

    plan = _measured(own, centres, "array<struct<cell:int,place:int,most:double>>", bounds)
    plan = materialise(plan.select("view", F.explode("near").alias("p")).select("view", "p.*"), "plan")
    first = _round(plan.where(F.col("place") < probes).select("view", "cell"), own, index, policy, top)
    order = Window.partitionBy("query_view").orderBy(F.desc("best.similarity"), "object_id")
    enough = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == top).select(F.col("query_view").alias("view"), F.col("best.similarity").alias("reached"))
    rest = plan.where(F.col("place") >= probes).join(enough, "view", "left").where(F.col("reached").isNull() | (F.col("most") >= F.col("reached") - SLACK))
    rest = materialise(rest.select("view", "cell"), "rest")
    second = _round(rest, own, index, policy, top)
    every = first.unionByName(second).groupBy("query_view", "object_id").agg(F.max("best").alias("best"))
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    found = ranked.select("query_view", "rank", "object_id", (-F.col("best.order")).alias("best_view"), "best.similarity")
    total = plan.count()
    read = total - plan.where(F.col("place") >= probes).count() + rest.count()
    discard(plan, rest, own)
    return found, read, total


