"""Comparison queries over ``lineitem``: an order's lines 1 and 2 are two runs, a supplier's lines its ranked hits."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import comparison as C
from tessella.plans.common import table


def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line 1 is the baseline and line 2 the candidate; orders may lack or repeat either."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    runs = lines.withColumn("role", F.when(F.col("l_linenumber") == 1, "BASELINE").otherwise("CANDIDATE"))
    distinct = {"model": ["l_partkey"], "build": ["l_suppkey", "l_tax"]}
    found = C.promotion(runs, "l_orderkey", "role", ["l_linestatus", "l_returnflag"], distinct, F.col("l_quantity") >= 5)
    return found.select(F.col("pair").alias("l_orderkey"), F.array_join("reasons", ",").alias("reasons"), "decision")


def citation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's dearest lines, returned ones as counterfeit references."""
    hits = table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        F.when(F.col("l_returnflag") == "R", "counterfeit_reference").otherwise("catalog_candidate").alias("role"),
        F.col("l_partkey").alias("artifact_id"),
        F.when(F.col("l_partkey") % 7 != 0, F.col("l_linenumber")).alias("citation_id"),
        F.when(F.col("l_quantity") > 45, F.col("l_linestatus")).otherwise(" ").alias("institution"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_returnflag")).alias("review_id"),
        "l_extendedprice", "l_orderkey", "l_quantity",
    )
    order = [F.desc("l_extendedprice"), F.col("artifact_id"), F.col("l_orderkey"), F.col("citation_id")]
    cited = C.citations(hits, ["l_suppkey"], "role", order, ["institution"], "review_id")
    return cited.select("l_suppkey", "role", "position", "artifact_id", "citation_id", "source_status")


_ANY = ", ".join(f"any_value({c}) AS {c}" for c in ("l_linestatus", "l_returnflag", "l_partkey", "l_suppkey", "l_tax", "l_quantity"))
QUERIES = {f.__name__: f for f in (promotion_gate, citation_list)}
SQL = {
    "promotion_gate": f"""WITH b AS (
      SELECT l_orderkey, count(*) AS n, {_ANY}
      FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey
    ), k AS (
      SELECT l_orderkey, count(*) AS n, {_ANY}
      FROM lineitem WHERE l_linenumber = 2 GROUP BY l_orderkey
    ), reasons AS (
      SELECT coalesce(b.l_orderkey, k.l_orderkey) AS l_orderkey, concat_ws(',',
        CASE WHEN b.n IS NULL THEN 'BASELINE_MISSING' END, CASE WHEN k.n IS NULL THEN 'CANDIDATE_MISSING' END,
        CASE WHEN b.n > 1 THEN 'BASELINE_REPEATED' END, CASE WHEN k.n > 1 THEN 'CANDIDATE_REPEATED' END,
        CASE WHEN b.n = 1 AND k.n = 1 AND b.l_linestatus <> k.l_linestatus THEN 'l_linestatus_DIFFERS' END,
        CASE WHEN b.n = 1 AND k.n = 1 AND b.l_returnflag <> k.l_returnflag THEN 'l_returnflag_DIFFERS' END,
        CASE WHEN b.n = 1 AND k.n = 1 AND b.l_partkey = k.l_partkey THEN 'model_NOT_DISTINCT' END,
        CASE WHEN b.n = 1 AND k.n = 1 AND b.l_suppkey = k.l_suppkey AND b.l_tax = k.l_tax THEN 'build_NOT_DISTINCT' END,
        CASE WHEN b.n = 1 AND k.n = 1 AND k.l_quantity < 5 THEN 'CANDIDATE_INELIGIBLE' END) AS reasons
      FROM b FULL JOIN k ON b.l_orderkey = k.l_orderkey
    ) SELECT *, CASE WHEN reasons = '' THEN 'EXPERT_REVIEW_REQUIRED' ELSE 'HOLD' END AS decision FROM reasons""",
    "citation_list": """WITH hits AS (
      SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'counterfeit_reference' ELSE 'catalog_candidate' END AS role, l_partkey AS artifact_id,
        CASE WHEN l_partkey % 7 <> 0 THEN l_linenumber END AS citation_id, l_quantity > 45 AND l_partkey % 5 <> 0 AS recorded, l_extendedprice, l_orderkey
      FROM lineitem
    ), placed AS (
      SELECT *, row_number() OVER (PARTITION BY l_suppkey, role ORDER BY l_extendedprice DESC, artifact_id, l_orderkey, citation_id) AS position FROM hits
    ), kept AS (
      SELECT *, row_number() OVER (PARTITION BY l_suppkey, role, artifact_id, citation_id ORDER BY position) AS again FROM placed
      WHERE position <= 5 AND citation_id IS NOT NULL
    ) SELECT l_suppkey, role, position, artifact_id, citation_id,
        CASE WHEN recorded THEN 'SOURCE_AND_REVIEW_RECORDED' ELSE 'SOURCE_METADATA_INCOMPLETE' END AS source_status FROM kept WHERE again = 1""",
}
