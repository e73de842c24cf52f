"""Planning queries: parts are actions in regions with budgets of three channels, lines are settled executions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import planning as P
from tessella.plans.common import r6, table

UNCERTAINTY, BLOCKED = 0.85, ["k3", "k7"]
CHANNELS = ("light", "heat", "dose")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    channel = F.element_at(F.array(*map(F.lit, CHANNELS)), (p % 3 + 1).cast("int"))
    ready = {name: p % n != 0 for name, n in zip(P.PRECONDITIONS, (7, 11, 13))}
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("a"), p.cast("string")).alias("action_id"), p.alias("pos"), (F.col("p_size") % 6).cast("bigint").alias("region"),
        F.concat(F.lit("k"), (p % 20).cast("string")).alias("retry_key"), F.create_map(channel, (p % 10 / 10.0).cast("double")).alias("loads"),
        F.create_map(*[x for name, ok in ready.items() for x in (F.lit(name), ok)]).alias("preconditions"), (0.5 + p % 6 / 10.0).alias("pass_rate"),
        (p % 8 / 10.0).alias("expected_uncertainty"), (p % 9 / 20.0).alias("cost"),
    )


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget for each region and channel; the sixth region of parts has none."""
    r, i = F.col("r_regionkey").cast("bigint"), F.col("i")
    listed = F.posexplode(F.array(*map(F.lit, CHANNELS))).alias("i", "channel")
    return table(spark, sf_dir, "region").select("r_regionkey", listed).select(
        r.alias("region"), "channel", ((r + i) % 4 / 10.0).alias("used"), (r * i % 3 / 10.0).alias("reserved"), (1.0 - r % 2 * 0.3).alias("cap"), ((r == 2) & (i == 1)).alias("locked")
    )


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.evaluate_actions(actions(spark, sf_dir), budgets(spark, sf_dir), UNCERTAINTY, BLOCKED)


def action_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _evaluated(spark, sf_dir)
    numbers = [r6(c).alias(c) for c in ("gain", "risk", "utility")]
    return found.select("action_id", *numbers, F.array_join("reasons", ",").alias("reasons"), "qualifies")


def chosen_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best action of each region."""
    best = P.choose_action(_evaluated(spark, sf_dir), UNCERTAINTY, "region")
    return best.select("region", "action_id", r6("utility").alias("utility"))


def settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as executions: the quantity was predicted, flag R has no valid telemetry, one in eleven states no load. Suppliers are budgets."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("budget"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("execution_id"), F.col("l_linenumber").alias("seq"),
        F.col("l_quantity").cast("double").alias("predicted"), F.when(F.col("l_orderkey") % 11 != 5, (F.col("l_quantity") * (1 - F.col("l_discount"))).cast("double") - F.when(F.col("l_partkey") % 50 == 3, 60).otherwise(0)).alias("actual"),
        ((F.col("l_returnflag") != "R") | (F.col("l_suppkey") % 3 != 1)).alias("telemetry_valid"),
    )
    k = F.col("s_suppkey")
    budgets = table(spark, sf_dir, "supplier").select(
        k.alias("budget"), (k % 9 * 2500).cast("double").alias("cap"), (k % 4 * 10).cast("double").alias("used"), (k % 6 * 4000).cast("double").alias("reserved"), (k % 13 == 2).alias("locked")
    )
    return P.settlement(lines.where("budget % 17 <> 6"), budgets, "budget").withColumns({"used": r6("used"), "reserved": r6("reserved")})


_EVALUATED = f"""
WITH a AS (
  SELECT 'a' || p_partkey AS action_id, p_partkey AS pos, CAST(p_size % 6 AS BIGINT) AS region, 'k' || p_partkey % 20 AS retry_key, p_partkey % 3 AS i, p_partkey % 10 / 10.0 AS load,
    p_partkey % 7 <> 0 AS material, p_partkey % 11 <> 0 AS calibrated, p_partkey % 13 <> 0 AS ready, 0.5 + p_partkey % 6 / 10.0 AS pass_rate,
    p_partkey % 8 / 10.0 AS expected, p_partkey % 9 / 20.0 AS cost FROM part
), b AS (
  SELECT r_regionkey AS region, i, (r_regionkey + i) % 4 / 10.0 AS used, r_regionkey * i % 3 / 10.0 AS reserved, 1.0 - r_regionkey % 2 * 0.3 AS cap, r_regionkey = 2 AND i = 1 AS locked
  FROM region, range(3) r(i)
), e AS (
  SELECT *, pass_rate * greatest(0.0, {UNCERTAINTY} - expected) AS gain, coalesce(cap, 0) - (coalesce(used, 0) + coalesce(reserved, 0)) AS room FROM a LEFT JOIN b USING (region, i)
), u AS (
  SELECT *, least(1.0, load / greatest(1e-9, room)) AS risk, concat_ws(',', CASE WHEN retry_key IN ({", ".join(f"'{k}'" for k in BLOCKED)}) THEN 'RETRY_BLOCKED' END,
      CASE WHEN NOT material THEN 'NOT_MATERIAL_ALLOWED' END, CASE WHEN NOT calibrated THEN 'NOT_CALIBRATION_READY' END, CASE WHEN NOT ready THEN 'NOT_DEVICE_READY' END,
      CASE WHEN locked THEN 'CHANNEL_LOCKED' END, CASE WHEN load > room + 1e-9 THEN 'OVER_BUDGET' END) AS reasons FROM e
), v AS (
  SELECT *, 0.55 * gain - 0.2 * cost - 0.25 * risk AS utility FROM u
)
"""
QUERIES = {f.__name__: f for f in (action_utility, chosen_action, settlement)}
SQL = {
    "action_utility": _EVALUATED + """SELECT action_id, round(gain, 6) AS gain, round(risk, 6) AS risk, round(utility, 6) AS utility, reasons,
      reasons = '' AND utility >= 0.1 AND gain >= 0.25 AS qualifies FROM v""",
    "chosen_action": _EVALUATED + """SELECT region, action_id, round(utility, 6) AS utility FROM v WHERE reasons = '' AND utility >= 0.1 AND gain >= 0.25
      QUALIFY row_number() OVER (PARTITION BY region ORDER BY v.utility DESC, risk, pos) = 1""",
    "settlement": """WITH e AS (
      SELECT *, row_number() OVER (PARTITION BY budget, l_orderkey, l_linenumber ORDER BY predicted DESC, actual DESC, ok DESC) AS k
      FROM (SELECT l_suppkey AS budget, l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS predicted,
        CASE WHEN l_orderkey % 11 <> 5 THEN CAST(l_quantity * (1 - l_discount) AS DOUBLE) - CASE WHEN l_partkey % 50 = 3 THEN 60 ELSE 0 END END AS actual,
        l_returnflag <> 'R' OR l_suppkey % 3 <> 1 AS ok FROM lineitem WHERE l_suppkey % 17 <> 6)
    ), c AS (
      SELECT budget, sum(CASE WHEN ok THEN greatest(0.0, coalesce(actual, predicted)) ELSE predicted END) AS charge, sum(predicted) AS freed, bool_or(NOT ok) AS unknown, count(*) AS n
      FROM e WHERE k = 1 GROUP BY budget
    ), s AS (
      SELECT s_suppkey AS budget, round(s_suppkey % 4 * 10 + coalesce(charge, 0), 6) AS used, s_suppkey % 9 * 2500 AS cap, c.*
      FROM supplier LEFT JOIN c ON c.budget = s_suppkey
    ) SELECT budget, used, round(greatest(0.0, budget % 6 * 4000 - coalesce(freed, 0)), 6) AS reserved, budget % 13 = 2 OR coalesce(unknown, false) OR used > cap + 1e-9 AS locked,
      used > cap + 1e-9 AS over_limit, coalesce(n, 0) AS n_executions FROM s""",
}
