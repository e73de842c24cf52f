"""Evaluation queries over single-view runs: labels 6 and 7 are left out of the gallery (open set)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators import evaluation as E
from tessella.operators import retrieval as R
from tessella.plans.common import r6, table
from tessella.plans.retrieval import HITS_SQL, POLICY, views
from tessella.sources.shared import materialise

ACCEPT_SCORE, ACCEPT_MARGIN = 0.25, 0.01


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per query view: its best and next object, margin (2 without a next), quality.

    Runs of every third query view aren't eligible. The runs are written, as
    metrics and thresholds read them several times.
    """
    every = views(spark, sf_dir)
    queries, gallery = every.where("is_query and object_id < 8"), every.where("object_id < 6")
    scored = R.view_scores(queries, gallery, POLICY)
    coverage = scored.groupBy("query_view").agg(F.avg(F.col("matched").cast("double")).alias("coverage"))
    order = Window.partitionBy("query_view").orderBy(F.desc("similarity"), "object_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where("rank <= 5")
    listed = F.array_sort(F.collect_list(F.struct("rank", "object_id", "similarity")))  # five objects
    top = ranked.groupBy("query_view").agg(listed.alias("t")).join(coverage, "query_view")
    joined = top.join(queries.select(F.col("view_id").alias("query_view"), F.col("object_id").alias("label"), "quality", "angle"), "query_view")
    score, following = F.col("t")[0]["similarity"], F.try_element_at("t", F.lit(2))["similarity"]
    out = joined.select(
        "query_view",
        F.when(F.col("label") < 6, F.col("label")).alias("expected"),
        F.col("t")[0]["object_id"].alias("top1"),
        F.col("t")["object_id"].alias("top5"),
        F.round(score, 6).alias("score"),
        F.round(F.coalesce(score - following, F.lit(2.0)), 6).alias("margin"),
        F.round("coverage", 6).alias("coverage"),
        "quality",
        F.coalesce("angle", F.lit("none")).alias("angle"),
    )
    accepted = (F.col("score") >= ACCEPT_SCORE) & (F.col("margin") >= ACCEPT_MARGIN)
    right = F.coalesce(F.col("top1") == F.col("expected"), F.lit(False))
    return materialise(out.withColumns({"accepted": accepted, "correct": right, "eligible": F.col("query_view") % 3 != 1}), "runs")


def topk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.metrics(runs(spark, sf_dir))
    return m.select(*[r6(c).alias(c) for c in m.columns])


def per_view_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = runs(spark, sf_dir).where("expected is not null")
    return known.groupBy("angle").agg(F.count(F.lit(1)).alias("runs"), r6(F.avg(F.col("correct").cast("double"))).alias("recall"))


def outcome_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs(spark, sf_dir).select(E.outcome(F.col("expected"), F.col("top1"), F.col("accepted")).alias("outcome"))
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = E.threshold_grid(runs(spark, sf_dir), 0.1)
    return best.withColumns({c: r6(c) for c in ("score", "margin", "coverage", "quality", "far")})


def threshold_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    every = runs(spark, sf_dir)
    for name in E.GRID:
        part = E.candidates(every, name).select(F.lit(name).alias("name"), r6(name).alias("value"))
        found = part if found is None else found.union(part)
    return found


def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.latency_quantiles(table(spark, sf_dir, "events"), "value", "event_type")


def metric_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stated invariants the metrics record breaks; none for a sound one."""
    m = E.metrics(runs(spark, sf_dir))
    rules = {
        "rates_in_unit": F.greatest("top1", "top5", "far", "frr") <= 1,
        "top5_at_least_top1": F.col("top5") >= F.col("top1"),
        "rejection_is_complement": F.abs(F.col("open_set_rejection") - (1 - F.col("far"))) <= 1e-6,
    }
    checked = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(v, F.lit(True)).alias("holds")) for k, v in rules.items()]))
    return m.select(checked.alias("c")).select("c.*")


RUNS_SQL = HITS_SQL + f"""
, rp AS (
  SELECT q.view_id AS query_view, q.object_id AS label, q.quality, g.object_id, g.quality AS gq,
    round(list_inner_product(q.v, g.v), 9) AS sim
  FROM views q JOIN views g ON q.view_id <> g.view_id WHERE q.is_query AND q.object_id < 8 AND g.object_id < 6
), ro AS (
  SELECT query_view, label, quality, object_id, max(sim) AS s,
    bool_or(sim >= {POLICY.view_similarity} AND quality >= {POLICY.view_quality} AND gq >= {POLICY.view_quality}) AS m
  FROM rp GROUP BY 1, 2, 3, 4
), rl AS (
  SELECT query_view, label, quality, list(object_id ORDER BY s DESC, object_id) AS o, list(s ORDER BY s DESC, object_id) AS ss,
    avg(CAST(m AS INTEGER)) AS cov FROM ro GROUP BY 1, 2, 3
), runs AS (
  SELECT query_view, CASE WHEN label < 6 THEN label END AS expected, o[1] AS top1, o[1:5] AS top5, round(ss[1], 6) AS score,
    round(coalesce(ss[1] - ss[2], 2.0), 6) AS margin, round(cov, 6) AS coverage, rl.quality, coalesce(r.a, 'none') AS angle,
    round(ss[1], 6) >= {ACCEPT_SCORE} AND round(coalesce(ss[1] - ss[2], 2.0), 6) >= {ACCEPT_MARGIN} AS accepted,
    coalesce(label < 6 AND o[1] = label, false) AS correct, query_view % 3 <> 1 AS eligible
  FROM rl JOIN (SELECT vec_id, [ANGLES][vec_id % 14 + 1] AS a FROM embeddings) r ON r.vec_id = query_view
), met AS (
  SELECT avg(CAST(correct AS INTEGER)) FILTER (expected IS NOT NULL) AS top1,
    avg(CAST(list_contains(top5, expected) AS INTEGER)) FILTER (expected IS NOT NULL) AS top5,
    avg(CAST(accepted AS INTEGER)) FILTER (expected IS NULL) AS far,
    avg(CAST(NOT (accepted AND correct) AS INTEGER)) FILTER (expected IS NOT NULL) AS frr,
    avg(CAST(NOT accepted AS INTEGER)) FILTER (expected IS NULL) AS open_set_rejection FROM runs
)
""".replace("[ANGLES]", HITS_SQL.split("upper(trim(")[1].split("[vec_id")[0])


def _candidates_sql(name: str) -> str:
    limit, low, high, anchors = E.GRID[name]
    rows = ", ".join(f"({round(a, 6)})" for a in anchors)
    return f""", e_{name} AS (
  SELECT DISTINCT CAST(x AS DOUBLE) AS x FROM (SELECT round(c, 6) AS x FROM (SELECT least({high}, greatest({low}, {name})) AS c FROM runs)
    UNION ALL SELECT round(least({high}, c + 0.000001), 6) FROM (SELECT least({high}, greatest({low}, {name})) AS c FROM runs) WHERE c < {high}
    UNION ALL SELECT * FROM (VALUES {rows}))
), c_{name} AS (
  SELECT x FROM (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM e_{name})
  WHERE n <= {limit} OR i IN (SELECT floor(k * (n - 1) / {limit - 1}) FROM range({limit}) t(k), (SELECT count(*) AS n FROM e_{name}))
)"""


_CAND = "".join(map(_candidates_sql, E.GRID))
QUERIES = {
    f.__name__: f
    for f in (topk_metrics, per_view_recall, outcome_table, threshold_grid, threshold_candidates, latency_quantiles, metric_invariants)
}
SQL = {
    "topk_metrics": RUNS_SQL + """SELECT round(top1, 6) AS top1, round(top5, 6) AS top5, round(far, 6) AS far, round(frr, 6) AS frr,
      round(open_set_rejection, 6) AS open_set_rejection FROM met""",
    "per_view_recall": RUNS_SQL + """SELECT angle, count(*) AS runs, round(avg(CAST(correct AS INTEGER)), 6) AS recall FROM runs
      WHERE expected IS NOT NULL GROUP BY angle""",
    "outcome_table": RUNS_SQL + """SELECT CASE WHEN expected IS NULL AND accepted THEN 'FALSE_ACCEPT' WHEN expected IS NULL THEN 'CORRECT_REJECT'
      WHEN accepted AND correct THEN 'CORRECT_ACCEPT' WHEN accepted THEN 'WRONG_IDENTITY' ELSE 'FALSE_REJECT' END AS outcome, count(*) AS n
      FROM runs GROUP BY 1""",
    "threshold_candidates": RUNS_SQL + _CAND + " UNION ALL ".join(f"SELECT '{n}' AS name, round(x, 6) AS value FROM c_{n}" for n in E.GRID),
    "threshold_grid": RUNS_SQL + _CAND + """, cells AS (
      SELECT s.x AS score, m.x AS margin, c.x AS coverage, q.x AS quality,
        count(*) FILTER (ok AND expected IS NOT NULL AND correct) AS correct, count(*) FILTER (ok AND expected IS NULL) AS "false",
        count(*) FILTER (ok AND expected IS NOT NULL AND NOT correct) AS wrong
      FROM (SELECT s.x AS sx, m.x AS mx, c.x AS cx, q.x AS qx, r.*, eligible AND r.score >= s.x AND r.margin >= m.x AND r.coverage >= c.x
        AND r.quality >= q.x AS ok FROM c_score s, c_margin m, c_coverage c, c_quality q, runs r) t
      JOIN c_score s ON s.x = sx JOIN c_margin m ON m.x = mx JOIN c_coverage c ON c.x = cx JOIN c_quality q ON q.x = qx GROUP BY 1, 2, 3, 4
    ), rated AS (
      SELECT *, "false" / (SELECT count(*) FROM runs WHERE expected IS NULL) AS far FROM cells
    ) SELECT round(score, 6) AS score, round(margin, 6) AS margin, round(coverage, 6) AS coverage, round(quality, 6) AS quality, correct, "false",
        wrong, round(far, 6) AS far, far <= 0.1 + 1e-12 AS feasible, (SELECT count(*) FROM cells) AS cells FROM rated
      ORDER BY far <= 0.1 + 1e-12 DESC, CASE WHEN far <= 0.1 + 1e-12 THEN correct ELSE -"false" END DESC,
        CASE WHEN far <= 0.1 + 1e-12 THEN -"false" ELSE correct END DESC, rated.score DESC, rated.margin DESC, rated.coverage DESC, rated.quality DESC LIMIT 1""",
    "latency_quantiles": """SELECT event_type, min(value) AS min, median(value) AS median,
      max(value) FILTER (k = least(n, greatest(1, CAST(round_even(0.95 * n + 0.5, 0) AS BIGINT)))) AS p95, max(value) AS max
      FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
      GROUP BY event_type""",
    "metric_invariants": RUNS_SQL + """SELECT 'rates_in_unit' AS rule, greatest(top1, top5, far, frr) <= 1 AS holds FROM met
      UNION ALL SELECT 'top5_at_least_top1', top5 >= top1 FROM met
      UNION ALL SELECT 'rejection_is_complement', abs(open_set_rejection - (1 - far)) <= 1e-6 FROM met""",
}
