import pytest
from pyspark.sql import functions as F

from tessella.operators.components import connected_components
from tessella.operators.skew import spread_join


@pytest.mark.parametrize("hot", [0, 900])
def test_join_equals_a_plain_join(spark, hot):
    rows = spark.range(1000).select(F.when(F.col("id") < hot, 7).when(F.col("id") < 990, F.col("id") % 50).alias("k"), "id")
    lookup = rows.where("k < 40").groupBy("k").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
    got = spread_join(rows, lookup, "k", "n", 1000)
    want = rows.join(lookup.drop("n"), "k")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_nothing_joins_an_empty_lookup(spark):
    rows = spark.range(3).withColumnRenamed("id", "k")
    assert spread_join(rows, rows.withColumn("n", F.lit(1)).limit(0), "k", "n", 0).count() == 0


def test_components_of_hubs_chains_and_loops(spark):
    edges = [(1000, i) for i in range(300)] + [(i, i + 1) for i in range(2000, 2040)] + [(5, 5), (None, 4), (3001, 3000), (3000, 3001), (9999, 9999)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in [*range(300), 1000]} | {i: 2000 for i in range(2000, 2041)} | {3000: 3000, 3001: 3000}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
