"""Connected components of an edge table by alternating star contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.skew import spread_join
from tessella.sources.shared import discard, materialise, owning


def _with_least(edges: DataFrame, around: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """``edges`` with m, the smallest node in ``around`` at u or u itself; and the table of these."""
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    least = materialise(least.withColumn("m", F.least("u", "m")), "least")
    return spread_join(edges, least, "u", "n", total), least


def _large_star(edges: DataFrame, n_edges: int) -> tuple[DataFrame, DataFrame]:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined, least = _with_least(both.where("v > u"), both, 2 * n_edges)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")), least


def _small_star(edges: DataFrame, n_edges: int) -> tuple[DataFrame, DataFrame]:
    """Link a node and its smaller neighbours to the smallest of them (u > v in each edge)."""
    joined, least = _with_least(edges, edges, n_edges)
    moved = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))), least


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node in an edge, the smallest node it is linked to.

    ``edges`` has columns u and v of one type; null ends and loops are dropped,
    repeated edges count once. Rounds go on until the stars no longer change, a
    number of rounds that grows with the logarithm of the longest chain. Each
    round is written to the shared folder, so lineage stays short. The edges of
    a hub node don't go to one task (``spread_join``).
    """
    start = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, mark = materialise(start.distinct(), "edges"), None
    n_edges = now.count()
    while True:
        large, least = _large_star(now, n_edges)
        between = materialise(large.distinct(), "edges")
        discard(now, least)
        small, least = _small_star(between, between.count())
        now = materialise(small.distinct(), "edges")
        discard(between, least)
        n_edges, digest = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == (n_edges, digest):
            break
        mark = n_edges, digest
    roots = now.select(F.col("v").alias("node")).distinct()
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
    return owning(found, now)
