"""Queries of multi-view retrieval over ``embeddings``.

A label is an object, a vector a view. Every view whose id is divisible by 20 is
a query view; 200 ids in a row are one capture. All rows are the gallery.
Labels from 8 up are known negatives. Angle and quality follow from the id by
fixed rules. The driver's vectors are random, so the policy is looser than the
default.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.texts import ANGLE_ALIASES, ANGLES
from tessella.operators import retrieval as R
from tessella.operators import vector_index as X
from tessella.plans.common import r6, table, values

RAW_ANGLES = (
    "front", "Back", "left", "right-profile", "top", "underside", "interior", "FRONT LEFT 45",
    "front_right_45", "BACK-LEFT-45", "back  right 45", "detail", None, "reverse",
)
POLICY = R.Policy(
    same_score=0.15, same_margin=0.001, same_coverage=0.1, same_quality=0.4, same_angles=1, related_score=0.1,
    related_coverage=0.2, related_quality=0.3, view_similarity=0.2, negative_score=0.1, negative_coverage=0.2,
    negative_quality=0.3,
)
CONTROLS = "(8, 'verified', true, 1.0D), (9, 'provisional', true, 0.9D)"


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(*[F.lit(a) for a in RAW_ANGLES])
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("view_id"),
        F.col("label").cast("bigint").alias("object_id"),
        F.when(F.col("label") >= 8, "negative").otherwise("catalog").alias("kind"),
        F.col("embedding").alias("vector"),
        (F.pmod(F.col("vec_id") * 37, F.lit(101)) / 100.0).alias("quality"),
        F.element_at(raw, (F.col("vec_id") % len(RAW_ANGLES) + 1).cast("int")).alias("angle"),
        (F.col("vec_id") % 20 == 0).alias("is_query"),
        F.floor(F.col("vec_id") / 200).alias("capture_id"),
    )


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every = views(spark, sf_dir)
    return every.where("is_query"), every


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.object_hits(*_sides(spark, sf_dir), POLICY)


def _controls(spark: SparkSession) -> DataFrame:
    return values(spark, CONTROLS, "object_id, review_status, admissible, weight").withColumn("object_id", F.col("object_id").cast("bigint"))


def best_view_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best view of the five best objects of each query view."""
    return R.best_objects(*_sides(spark, sf_dir), 5, POLICY).withColumn("similarity", r6("similarity"))


def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through an index of all views, of which only cells that may matter are read."""
    queries, gallery = _sides(spark, sf_dir)
    found, _, _ = X.search(queries, X.build_index(gallery), 5, POLICY)
    return found.withColumn("similarity", r6("similarity"))


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The views with every kind of damage planted by fixed rules."""
    i = F.col("view_id")
    vector = (
        F.when(i % 41 == 1, F.lit(None)).when(i % 41 == 2, F.slice("vector", 1, 8)).when(i % 41 == 3, F.transform("vector", lambda x: x * 0))
        .when(i % 41 == 4, F.transform("vector", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("vector"))
    )
    quality = F.when(i % 41 == 5, F.lit(None)).when(i % 41 == 6, 1.5).otherwise(F.col("quality"))
    damaged = views(spark, sf_dir).withColumns({"vector": vector, "quality": quality})
    return damaged.withColumn("object_id", F.when(F.col("view_id") % 41 != 7, F.col("object_id")))


def view_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.view_violations(_dirty(spark, sf_dir), 64, "object_id")


def sound_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best objects of each sound query view among the sound views of the damaged gallery."""
    every = _dirty(spark, sf_dir)
    return R.best_objects(every.where("is_query"), every, 2, POLICY).withColumn("similarity", r6("similarity"))


def view_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All objects of each query view by falling similarity, ties by object."""
    scored = R.view_scores(*_sides(spark, sf_dir), POLICY)
    order = Window.partitionBy("query_view").orderBy(F.desc("similarity"), "object_id")
    return scored.select("query_view", F.row_number().over(order).alias("position"), "object_id")


def unit_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cs = R.centroids(views(spark, sf_dir), "object_id")
    return cs.select("object_id", F.posexplode("centroid").alias("dim", "x")).select("object_id", "dim", r6("x").alias("x"))


def object_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select(
        "capture_id", "object_id", "kind", *[r6(c).alias(c) for c in ("score", "view_score", "centroid_score", "quality_score")]
    )


def angle_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select(
        "capture_id", "object_id", F.array_join("angles", ",").alias("angles"), r6("coverage").alias("coverage"),
        r6("similarity_coverage").alias("similarity_coverage"),
    )


def runner_up_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = R.ranked(_hits(spark, sf_dir)).where("rank = 1")
    return top.select("capture_id", "kind", "object_id", r6("score").alias("score"), r6("margin").alias("margin"))


def counterfeit_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admissible negatives of each capture by weighted score."""
    weighted = _hits(spark, sf_dir).join(_controls(spark), "object_id").where("kind = 'negative' and admissible")
    weighted = weighted.withColumn("weighted", F.col("score") * F.col("weight"))
    order = Window.partitionBy("capture_id").orderBy(F.desc("weighted"), "object_id")
    return weighted.select("capture_id", F.row_number().over(order).alias("position"), "object_id", r6("weighted").alias("weighted"))


def negative_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as records of known negatives, disputed or not by their balance."""
    balance = F.col("s_acctbal")
    dispute = F.when(balance < 0, "ACTIVE").when(balance < 3000, "RESOLVED").when(balance < 8000, "NO_KNOWN_DISPUTE")
    status, admissible, weight = R.negative_control(dispute)
    return table(spark, sf_dir, "supplier").select("s_suppkey", status.alias("review_status"), admissible.alias("admissible"), weight.alias("weight"))


def _signal(hits: DataFrame, spark: SparkSession) -> DataFrame:
    return R.negative_signal(hits, _controls(spark), POLICY)


def _decision(hits: DataFrame, signal: DataFrame) -> DataFrame:
    return R.identity_decision(hits, signal, hits.select("capture_id").where("capture_id % 7 = 3"), POLICY)


def counterfeit_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signal(_hits(spark, sf_dir), spark).withColumns({c: r6(c) for c in ("weighted_score", "catalog_delta", "top_score")})


def identity_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    return _decision(hits, _signal(hits, spark)).withColumns({"score": r6("score"), "margin": r6("margin")})


def related_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.related_objects(_hits(spark, sf_dir), POLICY).withColumn("score", r6("score"))


def related_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.related_decision(_hits(spark, sf_dir), POLICY)


def recognition_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    signal = _signal(hits, spark)
    return R.recognition_status(_decision(hits, signal), R.related_decision(hits, POLICY), signal)


def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    signal = _signal(hits, spark)
    return R.explanations(hits, _decision(hits, signal), signal).select("capture_id", "section", "position", "code", "object_id")


def recapture_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard angles that a capture lacks or has only below the usable quality."""
    from tessella.functions.texts import canonical_angle

    queries, _ = _sides(spark, sf_dir)
    shot = queries.select("capture_id", canonical_angle(F.col("angle")).alias("angle"), "quality").where("angle is not null")
    best = shot.groupBy("capture_id", "angle").agg(F.max("quality").alias("quality"))
    wanted = queries.select("capture_id").distinct().withColumn("angle", F.explode(F.array(*map(F.lit, ANGLES))))
    joined = wanted.join(best, ["capture_id", "angle"], "left")
    reason = F.when(F.col("quality").isNull(), "MISSING_ANGLE").when(F.col("quality") < POLICY.view_quality, "LOW_QUALITY")
    return joined.withColumn("reason", reason).where("reason is not null").select("capture_id", "angle", "reason")


def strict_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many views of each object match a query view (theta join as an aggregate)."""
    return (
        R.view_scores(*_sides(spark, sf_dir), POLICY)
        .groupBy("object_id")
        .agg(F.count_if("matched").alias("matched"), F.count_if("angle_matched").alias("angle_matched"))
    )


_raw = ", ".join("NULL" if a is None else f"'{a}'" for a in RAW_ANGLES)
_alias = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ANGLE_ALIASES.items())
_known = ", ".join(f"'{a}'" for a in ANGLES)
HITS_SQL = f"""
WITH raw AS (
  SELECT vec_id AS view_id, CAST(label AS BIGINT) AS object_id, CASE WHEN label >= 8 THEN 'negative' ELSE 'catalog' END AS kind,
    list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v0, (vec_id * 37 % 101) / 100.0 AS quality,
    regexp_replace(regexp_replace(upper(trim([{_raw}][vec_id % {len(RAW_ANGLES)} + 1])), '[- ]', '_', 'g'), '_+', '_', 'g') AS a0,
    vec_id % 20 = 0 AS is_query, vec_id // 200 AS capture_id
  FROM embeddings
), aliased AS (
  SELECT *, CASE a0 {_alias} ELSE a0 END AS a1, sqrt(list_inner_product(v0, v0)) AS len FROM raw
), views AS (
  SELECT view_id, object_id, kind, list_transform(v0, lambda x: x / len) AS v, CAST(quality AS DOUBLE) AS quality,
    CASE WHEN a1 IN ({_known}) THEN a1 END AS angle, is_query, capture_id
  FROM aliased
), pairs AS (
  SELECT q.view_id AS query_view, q.capture_id, q.quality AS qq, q.angle AS qa, g.object_id, g.view_id, g.quality AS gq, g.angle AS ga,
    round(list_inner_product(q.v, g.v), 9) AS sim
  FROM views q JOIN views g ON q.view_id <> g.view_id WHERE q.is_query
), edges AS (
  SELECT *, sim >= {POLICY.view_similarity} AND qq >= {POLICY.view_quality} AND gq >= {POLICY.view_quality} AS m FROM pairs
), best AS (
  SELECT query_view, capture_id, object_id, any_value(qq) AS qq, any_value(qa) AS qa, max(sim) AS similarity,
    arg_max(view_id, (sim, -view_id)) AS best_view, arg_max(gq, (sim, -view_id)) AS gq,
    bool_or(m) AS matched, bool_or(m AND coalesce(qa = ga, false)) AS angle_matched
  FROM edges GROUP BY query_view, capture_id, object_id
), weighted AS (
  SELECT capture_id, object_id, sum(qq * similarity) / sum(qq) AS view_score,
    least(avg(qq), sum(qq * gq) / sum(qq)) AS quality_score, avg(CAST(matched AS INTEGER)) AS similarity_coverage,
    coalesce(list_sort(list_distinct(list(qa) FILTER (angle_matched))), []) AS angles
  FROM best GROUP BY capture_id, object_id
), qdecl AS (
  SELECT capture_id, count(DISTINCT angle) AS n FROM views WHERE is_query GROUP BY 1
), gdecl AS (
  SELECT object_id, any_value(kind) AS kind, count(DISTINCT angle) AS n FROM views GROUP BY 1
), dims AS (
  SELECT *, unnest(range(1, 65)) AS d FROM views
), qsum AS (
  SELECT capture_id, d, sum(quality * v[d]) / sum(quality) AS x FROM dims WHERE is_query GROUP BY 1, 2
), gsum AS (
  SELECT object_id, d, sum(quality * v[d]) / sum(quality) AS x FROM dims GROUP BY 1, 2
), qc AS (
  SELECT capture_id, d, x / sqrt(sum(x * x) OVER (PARTITION BY capture_id)) AS x FROM qsum
), gc AS (
  SELECT object_id, d, x / sqrt(sum(x * x) OVER (PARTITION BY object_id)) AS x FROM gsum
), cents AS (
  SELECT capture_id, object_id, sum(qc.x * gc.x) AS centroid_score FROM qc JOIN gc USING (d) GROUP BY 1, 2
), hits AS (
  SELECT w.capture_id, w.object_id, g.kind, {POLICY.view_weight} * view_score + (1 - {POLICY.view_weight}) * centroid_score AS score,
    view_score, centroid_score, quality_score, similarity_coverage, angles,
    least(CASE WHEN q.n > 0 THEN len(angles) / q.n ELSE 0 END, CASE WHEN g.n > 0 THEN len(angles) / g.n ELSE 0 END) AS coverage
  FROM weighted w JOIN qdecl q USING (capture_id) JOIN gdecl g USING (object_id) JOIN cents USING (capture_id, object_id)
), ranked AS (
  SELECT *, row_number() OVER w AS rank, score - lead(score) OVER w AS margin
  FROM hits WINDOW w AS (PARTITION BY capture_id, kind ORDER BY score DESC, object_id)
), controls(object_id, review_status, admissible, weight) AS (
  VALUES (8, 'verified', true, 1.0), (9, 'provisional', true, 0.9)
), negatives AS (
  SELECT h.*, review_status, CASE WHEN admissible THEN score * weight END AS weighted FROM hits h LEFT JOIN controls c USING (object_id)
  WHERE kind = 'negative'
), top_negative AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY weighted DESC NULLS LAST, object_id) AS k,
    count(*) FILTER (weighted IS NULL) OVER (PARTITION BY capture_id) AS excluded, max(score) OVER (PARTITION BY capture_id) AS top_score FROM negatives) WHERE k = 1
), gates AS (
  SELECT t.*, weighted >= {POLICY.negative_score} AS g1, similarity_coverage >= {POLICY.negative_coverage} AS g2,
    quality_score >= {POLICY.negative_quality} AS g3, (SELECT max(score) FROM hits h WHERE h.capture_id = t.capture_id AND kind = 'catalog') AS catalog
  FROM top_negative t
), signal AS (
  SELECT capture_id, object_id, weighted AS weighted_score, weighted - catalog AS catalog_delta, top_score, g1 AND g2 AND g3 AS triggered,
    CASE WHEN g1 AND g2 AND g3 AND review_status = 'verified' THEN 'STRONG' WHEN g1 AND g2 AND g3 THEN 'WEAK' ELSE 'NONE' END AS strength,
    g1 AND g2 AND g3 AND review_status = 'verified' AND weighted >= catalog - {POLICY.same_margin} AS competes, excluded,
    coalesce(nullif(concat_ws(',', CASE WHEN NOT g1 THEN 'NEGATIVE_REFERENCE_SCORE_BELOW_THRESHOLD' END, CASE WHEN NOT g2 THEN 'NEGATIVE_REFERENCE_COVERAGE_BELOW_THRESHOLD' END,
      CASE WHEN NOT g3 THEN 'NEGATIVE_REFERENCE_QUALITY_BELOW_THRESHOLD' END), ''), 'NEGATIVE_REFERENCE_SIGNAL_GATES_PASSED') AS reasons
  FROM gates
), related AS (
  SELECT capture_id, object_id, score, score >= {POLICY.related_score} AS r1, similarity_coverage >= {POLICY.related_coverage} AS r2,
    quality_score >= {POLICY.related_quality} AS r3, rank FROM ranked WHERE kind = 'catalog'
), relation AS (
  SELECT capture_id, count(*) FILTER (r1 AND r2 AND r3) AS n_related, any_value(concat_ws(',', CASE WHEN NOT r1 THEN 'SCORE_BELOW_RELATED_THRESHOLD' END,
    CASE WHEN NOT r2 THEN 'RELATED_VIEW_COVERAGE_BELOW_THRESHOLD' END, CASE WHEN NOT r3 THEN 'RELATED_IMAGE_QUALITY_BELOW_THRESHOLD' END)) FILTER (rank = 1) AS failed
  FROM related GROUP BY capture_id
), judged AS (
  SELECT r.*, r.score >= {POLICY.same_score} AS s1, coalesce(r.margin >= {POLICY.same_margin}, true) AS s2,
    r.coverage >= {POLICY.same_coverage} AS s3, len(angles) >= {POLICY.same_angles} AS s4, quality_score >= {POLICY.same_quality} AS s5,
    NOT coalesce(signal.competes, false) AS s7, r.capture_id % 7 <> 3 AS s8,
    r.score >= {POLICY.related_score} AND similarity_coverage >= {POLICY.related_coverage} AND quality_score >= {POLICY.related_quality} AS rel
  FROM ranked r LEFT JOIN signal USING (capture_id) WHERE rank = 1 AND kind = 'catalog'
), decided AS (
  SELECT *, s1 AND s2 AND s3 AND s4 AND s5 AND s7 AND s8 AS accepted,
    CASE WHEN NOT s8 THEN 'EXACT_MEDIA_REPLAY' WHEN s1 AND s2 AND s3 AND s4 AND s5 AND s7 THEN 'KNOWN_ARTIFACT_CANDIDATE'
      WHEN NOT (s5 AND s3 AND s4) THEN 'INSUFFICIENT_CAPTURE' WHEN rel THEN 'RELATED_REFERENCES_ONLY' ELSE 'OPEN_SET_NO_MATCH' END AS status FROM judged
)
"""

_SOUND = HITS_SQL + """, damaged AS (
  SELECT *, CASE view_id % 41 WHEN 1 THEN 'EMPTY_VECTOR' WHEN 2 THEN 'WRONG_DIMENSION' WHEN 3 THEN 'ZERO_LENGTH' WHEN 4 THEN 'NOT_FINITE'
    WHEN 5 THEN 'QUALITY_OUT_OF_RANGE' WHEN 6 THEN 'QUALITY_OUT_OF_RANGE' WHEN 7 THEN 'MISSING_OBJECT_ID' END AS reason FROM views
)
"""
QUERIES = {
    f.__name__: f
    for f in (
        best_view_topk, indexed_topk, view_violations, sound_topk, view_order, unit_centroid, object_score, angle_coverage, runner_up_margin, counterfeit_signal,
        counterfeit_ranking, negative_controls, identity_decision, related_objects, related_decision, recognition_status, explanations, recapture_hints, strict_matches,
    )
}
SQL = {
    "best_view_topk": HITS_SQL + """SELECT * FROM (SELECT query_view, row_number() OVER (PARTITION BY query_view ORDER BY similarity DESC, object_id) AS rank,
      object_id, best_view, round(similarity, 6) AS similarity FROM best) WHERE rank <= 5""",
    "indexed_topk": HITS_SQL + """SELECT * FROM (SELECT query_view, row_number() OVER (PARTITION BY query_view ORDER BY similarity DESC, object_id) AS rank,
      object_id, best_view, round(similarity, 6) AS similarity FROM best) WHERE rank <= 5""",
    "unit_centroid": HITS_SQL + "SELECT object_id, d - 1 AS dim, round(x, 6) AS x FROM gc",
    "object_score": HITS_SQL + """SELECT capture_id, object_id, kind, round(score, 6) AS score, round(view_score, 6) AS view_score,
      round(centroid_score, 6) AS centroid_score, round(quality_score, 6) AS quality_score FROM hits""",
    "angle_coverage": HITS_SQL + """SELECT capture_id, object_id, array_to_string(angles, ',') AS angles, round(coverage, 6) AS coverage,
      round(similarity_coverage, 6) AS similarity_coverage FROM hits""",
    "runner_up_margin": HITS_SQL + """SELECT capture_id, kind, object_id, round(score, 6) AS score, round(margin, 6) AS margin
      FROM ranked WHERE rank = 1""",
    "view_violations": _SOUND + "SELECT view_id, reason FROM damaged WHERE reason IS NOT NULL",
    "sound_topk": _SOUND + """SELECT * FROM (SELECT query_view, row_number() OVER (PARTITION BY query_view ORDER BY s DESC, object_id) AS rank, object_id, best_view,
      round(s, 6) AS similarity FROM (SELECT q.view_id AS query_view, g.object_id, max(round(list_inner_product(q.v, g.v), 9)) AS s,
      arg_max(g.view_id, (round(list_inner_product(q.v, g.v), 9), -g.view_id)) AS best_view FROM damaged q JOIN damaged g ON q.view_id <> g.view_id
      WHERE q.is_query AND coalesce(q.reason, 'MISSING_OBJECT_ID') = 'MISSING_OBJECT_ID' AND g.reason IS NULL GROUP BY 1, 2)) WHERE rank <= 2""",
    "view_order": HITS_SQL + "SELECT query_view, row_number() OVER (PARTITION BY query_view ORDER BY similarity DESC, object_id) AS position, object_id FROM best",
    "counterfeit_signal": HITS_SQL + """SELECT capture_id, object_id, round(weighted_score, 6) AS weighted_score, round(catalog_delta, 6) AS catalog_delta,
      round(top_score, 6) AS top_score, triggered, strength, competes, excluded, reasons FROM signal""",
    "counterfeit_ranking": HITS_SQL + """SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY weighted DESC, object_id) AS position, object_id,
      round(weighted, 6) AS weighted FROM negatives WHERE weighted IS NOT NULL""",
    "negative_controls": """SELECT s_suppkey, CASE WHEN ok THEN 'verified' ELSE 'disputed' END AS review_status, ok AS admissible, CASE WHEN ok THEN 1.0 ELSE 0.0 END AS weight
      FROM (SELECT s_suppkey, s_acctbal >= 0 AND s_acctbal < 8000 AS ok FROM supplier)""",
    "identity_decision": HITS_SQL + """SELECT capture_id, CASE WHEN accepted THEN object_id END AS object_id, round(score, 6) AS score, round(margin, 6) AS margin, accepted, status,
      coalesce(nullif(concat_ws(',', CASE WHEN NOT s1 THEN 'SCORE_BELOW_SAME_ARTIFACT_THRESHOLD' END, CASE WHEN NOT s2 THEN 'RUNNER_UP_MARGIN_BELOW_THRESHOLD' END,
        CASE WHEN NOT s3 THEN 'QUERY_VIEW_COVERAGE_BELOW_THRESHOLD' END, CASE WHEN NOT s4 THEN 'INSUFFICIENT_COMPLEMENTARY_DECLARED_ANGLES' END,
        CASE WHEN NOT s5 THEN 'IMAGE_QUALITY_BELOW_THRESHOLD' END, CASE WHEN NOT s7 THEN 'KNOWN_COUNTERFEIT_REFERENCE_CONFLICT' END,
        CASE WHEN NOT s8 THEN 'EXACT_MEDIA_REPLAY' END), ''), 'PASSED_ALL_IDENTITY_GATES') AS reasons FROM decided""",
    "related_objects": HITS_SQL + """SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY score DESC, object_id) AS position, object_id,
      round(score, 6) AS score FROM related WHERE r1 AND r2 AND r3""",
    "related_decision": HITS_SQL + """SELECT capture_id, n_related, n_related > 0 AS accepted, CASE WHEN n_related > 0 THEN 'related_candidates' ELSE 'no_reliable_related_candidate' END AS status,
      coalesce(nullif(failed, ''), 'RELATED_GATES_PASSED') AS reasons FROM relation""",
    "recognition_status": HITS_SQL + f"""SELECT capture_id, CASE WHEN NOT accepted AND n_related = 0 AND status NOT IN ('INSUFFICIENT_CAPTURE', 'CALIBRATION_REQUIRED', 'EXACT_MEDIA_REPLAY')
      THEN 'OPEN_SET_NO_MATCH' ELSE status END AS status, CASE WHEN triggered AND competes THEN 'CONFLICT_REVIEW' WHEN triggered THEN 'STRONG_SIGNAL'
      WHEN top_score >= {R.WEAK_SIGNAL_FROM} THEN 'WEAK_SIGNAL' WHEN top_score IS NOT NULL THEN 'NO_SIGNAL' ELSE 'NOT_RUN' END AS cross_check
      FROM decided JOIN relation USING (capture_id) JOIN signal USING (capture_id)""",
    "explanations": HITS_SQL + """SELECT capture_id, section, row_number() OVER (PARTITION BY capture_id, section ORDER BY k) AS position, code, object_id FROM (
      SELECT capture_id, 1 AS k, 'shared' AS section, 'TOP_CANDIDATE_RETRIEVAL_METRICS' AS code, object_id FROM decided
      UNION ALL SELECT capture_id, 4, 'uncertainties', 'IDENTITY_GATE_REASONS', NULL FROM decided WHERE NOT accepted
      UNION ALL SELECT capture_id, 5, 'uncertainties', CASE status WHEN 'INSUFFICIENT_CAPTURE' THEN 'CAPTURE_INSUFFICIENT' WHEN 'OPEN_SET_NO_MATCH' THEN 'OPEN_SET_LIMITATION'
        WHEN 'RELATED_REFERENCES_ONLY' THEN 'RELATED_ONLY_LIMITATION' ELSE 'EXACT_MEDIA_REPLAY_BLOCKED' END, NULL FROM decided WHERE status <> 'KNOWN_ARTIFACT_CANDIDATE'
      UNION ALL SELECT capture_id, 6, 'differences', 'COUNTERFEIT_REFERENCE_SIGNAL', object_id FROM signal WHERE triggered
      UNION ALL SELECT capture_id, 7, 'uncertainties', 'COUNTERFEIT_CROSS_CHECK_NOT_RUN', NULL FROM decided WHERE capture_id NOT IN (SELECT capture_id FROM signal)
      UNION ALL SELECT capture_id, 8, 'uncertainties', 'AUTHENTICITY_NOT_ASSESSED', NULL FROM decided)""",
    "recapture_hints": HITS_SQL + f""", shot AS (SELECT capture_id, angle, max(quality) AS q FROM views WHERE is_query AND angle IS NOT NULL GROUP BY ALL),
      wanted AS (SELECT capture_id, unnest([{_known}]) AS angle FROM (SELECT DISTINCT capture_id FROM views WHERE is_query))
      SELECT capture_id, angle, CASE WHEN q IS NULL THEN 'MISSING_ANGLE' ELSE 'LOW_QUALITY' END AS reason
      FROM wanted LEFT JOIN shot USING (capture_id, angle) WHERE q IS NULL OR q < {POLICY.view_quality}""",
    "strict_matches": HITS_SQL + """SELECT object_id, count(*) FILTER (matched) AS matched, count(*) FILTER (angle_matched) AS angle_matched
      FROM best GROUP BY 1""",
}
