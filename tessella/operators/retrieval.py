"""Multi-view retrieval: score every object against every capture, then decide.

Queries are captures of several views; the gallery holds objects of several
views. The query views are the stated set. Both sides are packed into rows of
about a megabyte, each a matrix of unit vectors: the query set in blocks, which
are written, and the gallery in chunks as it is read. Every chunk meets every
block, by broadcast where Spark finds the blocks small enough and else block by
block, and a task multiplies the two matrices and reports one row for each
(query view, object), or only the best objects of each query view; pairs of
views never leave a task.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.texts import ANGLES, canonical_angle, failed_names, first_reason
from tessella.functions.vectors import TINY, dot, norm
from tessella.sources.shared import materialise

#: Bytes of a packed matrix, about, and query views compared at a time.
PACKED_BYTES = 1 << 20
SLICE = 256


@dataclass(frozen=True)
class Policy:
    """Decision thresholds."""

    # The default thresholds.
    same_score: float = 0.86
    same_margin: float = 0.05
    same_coverage: float = 0.60
    same_quality: float = 0.55
    same_angles: int = 3
    related_score: float = 0.62
    related_coverage: float = 0.20
    related_quality: float = 0.30
    view_similarity: float = 0.76
    view_quality: float = 0.25
    negative_score: float = 0.80
    negative_coverage: float = 0.34
    negative_quality: float = 0.40
    view_weight: float = 0.80


def view_problem(dimension: int) -> Column:
    """Why a view can't be compared; null for a sound one.

    Columns: view_id, vector, quality. What the gallery rejects as a whole is
    rejected here row by row.
    """
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return first_reason(
        (F.col("view_id").isNull(), "MISSING_VIEW_ID"),
        (F.coalesce(F.size("vector"), F.lit(0)) <= 0, "EMPTY_VECTOR"),
        (F.size("vector") != dimension, "WRONG_DIMENSION"),
        (bad, "NOT_FINITE"),
        (norm(F.col("vector")) <= TINY, "ZERO_LENGTH"),
        (~F.coalesce(F.col("quality").between(0, 1), F.lit(False)), "QUALITY_OUT_OF_RANGE"),
    )


def common_dimension(views: DataFrame) -> int:
    """The length that most vectors have, the smaller of equally common ones; 0 without vectors."""
    sizes = views.where("size(vector) > 0").groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.orderBy(F.desc("n"), "d").first()
    return row.d if row else 0


def sound_views(views: DataFrame, dimension: int, *ids: str) -> DataFrame:
    """The views without a problem, none of whose ``ids`` is null."""
    good = views.where(view_problem(dimension).isNull())
    for name in ids:
        good = good.where(F.col(name).isNotNull())
    return good


def view_violations(views: DataFrame, dimension: int, *ids: str) -> DataFrame:
    """(view_id, reason) for the views that ``sound_views`` leaves out."""
    missing = [(F.col(name).isNull(), f"MISSING_{name.upper()}") for name in ids]
    reason = F.coalesce(view_problem(dimension), first_reason(*missing)) if missing else view_problem(dimension)
    return views.select("view_id", reason.alias("reason")).where("reason is not null")


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a list column without nulls, all of one length."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _packed(views: DataFrame, object_col: str, dimension: int) -> DataFrame:
    """``views`` as rows of packed matrices, each in order of object and view."""
    most = max(16, PACKED_BYTES // (8 * max(dimension, 1)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                batch = whole.slice(at, most)
                objects, views, quality, angle = (np.asarray(batch.column(i)) for i in (0, 1, 3, 4))
                order = np.lexsort((views, objects))
                parts = (objects.astype("<i8"), views.astype("<i8"), quality.astype("<f8"), angle.astype("u1"), _matrix(batch.column(2)).astype("<f8"))
                yield pa.RecordBatch.from_pydict({k: [p[order].tobytes()] for k, p in zip(_PACKED, parts)})

    code = F.coalesce(F.array_position(F.array(*map(F.lit, ANGLES)), canonical_angle(F.col("angle"))), F.lit(0)).cast("int")
    rows = views.select(F.col(object_col).cast("bigint"), F.col("view_id").cast("bigint").alias("v"), "vector", F.col("quality").cast("double"), code)
    return rows.mapInArrow(pack, ", ".join(f"{k} binary" for k in _PACKED))


_PACKED = ("objects", "views", "quality", "angle", "vectors")


def _unpacked(row: dict, prefix: str) -> list[np.ndarray]:
    kinds = ("<i8", "<i8", "<f8", "u1", "<f8")
    parts = [np.frombuffer(row[prefix + k], kind) for k, kind in zip(_PACKED, kinds)]
    return [*parts[:4], parts[4].reshape(len(parts[0]), -1)]


def _scores(queries: list[np.ndarray], gallery: list[np.ndarray], policy: Policy, top: int | None) -> Iterator[pa.RecordBatch]:
    """Best views of each object of a chunk for a slice of query views."""
    _, ids, own_quality, own_angle, vectors = queries
    objects, views, quality, angle, others = gallery
    starts = np.flatnonzero(np.concatenate([[True], objects[1:] != objects[:-1]]))
    sizes = np.diff(np.append(starts, len(objects)))
    sims = np.round(np.clip(vectors @ others.T, -1.0, 1.0), 9)
    sims[ids[:, None] == views[None, :]] = -2.0  # a view is no evidence for itself
    best = np.maximum.reduceat(sims, starts, axis=1)
    place = np.where(sims == np.repeat(best, sizes, axis=1), np.arange(len(views)), len(views))
    first = np.minimum.reduceat(place, starts, axis=1)
    match = (sims >= policy.view_similarity) & (own_quality >= policy.view_quality)[:, None] & (quality >= policy.view_quality)[None, :]
    same = match & (own_angle[:, None] == angle[None, :]) & (own_angle > 0)[:, None]
    some = best > -2.0
    if top is not None and best.shape[1] > top:
        order = np.argsort(-best, axis=1, kind="stable")[:, :top]  # objects stand in order, so ties go by id
        chosen = np.zeros_like(some)
        np.put_along_axis(chosen, order, True, axis=1)
        some &= chosen
    q, o = np.nonzero(some)
    at = first[q, o]
    yield pa.RecordBatch.from_pydict(
        {
            "query_view": ids[q],
            "object_id": objects[starts][o],
            "best_view": views[at],
            "similarity": best[q, o],
            "view_quality": quality[at],
            "matched": np.logical_or.reduceat(match, starts, axis=1)[q, o],
            "angle_matched": np.logical_or.reduceat(same, starts, axis=1)[q, o],
        }
    )


_VIEW_SCORES = (
    "query_view bigint, object_id bigint, best_view bigint, similarity double, view_quality double, "
    "matched boolean, angle_matched boolean"
)


def view_scores(queries: DataFrame, gallery: DataFrame, policy: Policy = Policy(), dimension: int | None = None, top: int | None = None) -> DataFrame:
    """Per query view and object: best similarity, its view (the first on ties), matches.

    Similarities are cosines rounded to 9 places, so that ties don't depend on
    the order of summation. A view is not compared with itself. Views that
    ``view_violations`` names, with ``dimension`` or else the gallery's commonest,
    take no part. With ``top`` only rows that may be among the best ``top``
    objects of a query view are sure to be there, and their matches are partial.
    """
    dimension = common_dimension(gallery) if dimension is None else dimension
    blocks = _packed(sound_views(queries, dimension), "view_id", dimension).withColumnsRenamed({k: f"q_{k}" for k in _PACKED})
    chunks = _packed(sound_views(gallery, dimension, "object_id"), "object_id", dimension)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block, chunk = _unpacked(row, "q_"), _unpacked(row, "")
                for at in range(0, len(block[0]), SLICE):
                    yield from _scores([part[at : at + SLICE] for part in block], chunk, policy, top)

    met = chunks.crossJoin(materialise(blocks, "blocks"))  # the query set in blocks against all rows
    best = F.struct("similarity", (-F.col("best_view")).alias("order"), "view_quality")
    return (
        met.mapInArrow(score, _VIEW_SCORES)
        .groupBy("query_view", "object_id")
        .agg(F.max(best).alias("best"), F.bool_or("matched").alias("matched"), F.bool_or("angle_matched").alias("angle_matched"))
        .select(
            "query_view", "object_id", (-F.col("best.order")).alias("best_view"), "best.similarity", "best.view_quality",
            "matched", "angle_matched",
        )
    )


def best_objects(queries: DataFrame, gallery: DataFrame, top: int, policy: Policy = Policy()) -> DataFrame:
    """query_view, rank, object_id, best_view, similarity of the ``top`` objects of each query view; ties go by object id."""
    order = Window.partitionBy("query_view").orderBy(F.desc("similarity"), "object_id")
    ranked = view_scores(queries, gallery, policy, top=top).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_view", "rank", "object_id", "best_view", "similarity")


def centroids(views: DataFrame, key: str) -> DataFrame:
    """(key, centroid): quality-weighted mean of unit vectors, scaled to length one.

    ``views`` are sound ones of one dimension. Weights that sum to nothing count
    as ones; a centroid of length 0 is null. Each task adds up its own vectors,
    so the shuffle has a row for each batch, key and dimension.
    """
    kind = dict(views.dtypes)[key]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            unit, w = _matrix(batch.column(1)), np.asarray(batch.column(2))
            n = len(coded.dictionary)
            codes = np.asarray(coded.indices)
            order = np.argsort(codes, kind="stable")
            starts = np.searchsorted(codes[order], np.arange(n))
            sums = [np.add.reduceat(x[order], starts, axis=0) for x in (unit * w[:, None], unit)]
            weights = np.add.reduceat(w[order], starts)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(weights), *[pa.array(list(x), pa.list_(pa.float64())) for x in sums]], names=["k", "w", "weighted", "plain"])

    rows = views.select(key, "vector", F.col("quality").cast("double"))
    parts = rows.mapInArrow(add, f"k {kind}, w double, weighted array<double>, plain array<double>")
    dims = parts.select("k", "w", F.posexplode(F.arrays_zip("weighted", "plain")).alias("dim", "x"))
    sums = dims.groupBy("k", "dim").agg(F.when(F.sum("w") > TINY, F.sum("x.weighted")).otherwise(F.sum("x.plain")).alias("x"))
    arrays = sums.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v")).select("k", F.col("v")["x"].alias("v"))  # one dimension each
    # divided by the weights first, the sum would only change by a factor
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return arrays.select(F.col("k").alias(key), F.when(size > TINY, F.transform("v", lambda x: x / size)).alias("centroid"))


def object_hits(queries: DataFrame, gallery: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One row per (capture, object): scores, coverage and quality.

    ``queries``: capture_id, view_id, vector, quality, angle. ``gallery``:
    object_id, kind, view_id, vector, quality, angle. Views that
    ``view_violations`` names take no part. Qualities are short decimals, whose
    means can lie on a gate: they are rounded to 12 places, so that gates don't
    depend on the order of summation. The rows are written, as decisions read
    them several times.
    """
    dimension = common_dimension(gallery)
    queries, gallery = sound_views(queries, dimension, "capture_id"), sound_views(gallery, dimension, "object_id")
    scored = view_scores(queries, gallery, policy, dimension)
    captures = queries.select("capture_id", F.col("view_id").alias("query_view"), "quality", canonical_angle(F.col("angle")).alias("angle"))
    w, s, q = F.col("quality"), F.col("similarity"), F.col("view_quality")
    heavy = F.sum(w) > TINY
    weighted = lambda x: F.when(heavy, F.sum(w * x) / F.sum(w)).otherwise(F.avg(x))
    hits = scored.join(captures, "query_view").groupBy("capture_id", "object_id").agg(
        weighted(s).alias("view_score"),
        F.round(F.least(F.avg(w), weighted(q)), 12).alias("quality_score"),
        F.avg(F.col("matched").cast("double")).alias("similarity_coverage"),
        F.array_sort(F.collect_set(F.when(F.col("angle_matched"), F.col("angle")))).alias("angles"),
    )
    angles = lambda angle: F.size(F.collect_set(angle))  # noqa: E731  # at most eleven
    declared = captures.groupBy("capture_id").agg(angles("angle").alias("query_angles"))
    objects = gallery.groupBy("object_id").agg(F.max("kind").alias("kind"), angles(canonical_angle(F.col("angle"))).alias("object_angles"))
    per_angle = lambda n: F.when(n > 0, F.size("angles") / n).otherwise(0.0)
    qc = centroids(queries, "capture_id").withColumnRenamed("centroid", "qc")
    gc = centroids(gallery, "object_id").withColumnRenamed("centroid", "gc")
    joined = hits.join(declared, "capture_id").join(objects, "object_id").join(qc, "capture_id").join(gc, "object_id")
    centroid = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("qc"), F.col("gc"))))
    centroid = F.when(F.col("qc").isNotNull() & F.col("gc").isNotNull(), centroid)
    mixed = policy.view_weight * F.col("view_score") + (1 - policy.view_weight) * F.col("centroid_score")
    hits = joined.withColumn("centroid_score", centroid).select(
        "capture_id",
        "object_id",
        "kind",
        F.coalesce(mixed, F.col("view_score")).alias("score"),
        "view_score",
        "centroid_score",
        F.least(per_angle(F.col("query_angles")), per_angle(F.col("object_angles"))).alias("coverage"),
        "similarity_coverage",
        "angles",
        "quality_score",
    )
    return materialise(hits, "hits")


def ranked(hits: DataFrame) -> DataFrame:
    """Hits of each capture by falling score, then object id; margin to the next."""
    order = Window.partitionBy("capture_id", "kind").orderBy(F.desc("score"), "object_id")
    return hits.withColumn("rank", F.row_number().over(order)).withColumn("margin", F.col("score") - F.lead("score").over(order))


# What a failed gate is called in a decision.
NEGATIVE_REASONS = {
    "score": "NEGATIVE_REFERENCE_SCORE_BELOW_THRESHOLD", "coverage": "NEGATIVE_REFERENCE_COVERAGE_BELOW_THRESHOLD",
    "quality": "NEGATIVE_REFERENCE_QUALITY_BELOW_THRESHOLD",
}
IDENTITY_REASONS = {
    "score": "SCORE_BELOW_SAME_ARTIFACT_THRESHOLD", "margin": "RUNNER_UP_MARGIN_BELOW_THRESHOLD",
    "coverage": "QUERY_VIEW_COVERAGE_BELOW_THRESHOLD", "angles": "INSUFFICIENT_COMPLEMENTARY_DECLARED_ANGLES",
    "quality": "IMAGE_QUALITY_BELOW_THRESHOLD", "calibration": "CALIBRATION_RECORD_REQUIRED",
    "no_negative": "KNOWN_COUNTERFEIT_REFERENCE_CONFLICT", "no_replay": "EXACT_MEDIA_REPLAY",
}
RELATED_REASONS = {
    "score": "SCORE_BELOW_RELATED_THRESHOLD", "coverage": "RELATED_VIEW_COVERAGE_BELOW_THRESHOLD",
    "quality": "RELATED_IMAGE_QUALITY_BELOW_THRESHOLD",
}
WEAK_SIGNAL_FROM = 0.50


def _reasons(gates: dict[str, Column], names: dict[str, str], passed: str) -> Column:
    """Names of the failed gates, comma-joined; ``passed`` if none failed."""
    failed = failed_names(**{names[k]: ok for k, ok in gates.items()})
    return F.when(F.size(failed) > 0, F.array_join(failed, ",")).otherwise(passed)


def _flags(hit_score, hit_coverage, hit_quality, score, coverage, quality) -> dict[str, Column]:
    return {"score": hit_score >= score, "coverage": hit_coverage >= coverage, "quality": hit_quality >= quality}


def negative_control(dispute: Column) -> tuple[Column, Column, Column]:
    """(review_status, admissible, weight) of a known negative, from the state of its disputes: settled ones count in full."""
    settled = F.coalesce(dispute.isin("NO_KNOWN_DISPUTE", "RESOLVED"), F.lit(False))
    return F.when(settled, "verified").otherwise("disputed"), settled, F.when(settled, 1.0).otherwise(0.0)


def negative_signal(hits: DataFrame, controls: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Per capture: does the best admissible known negative raise a signal?

    ``controls``: object_id, review_status, admissible, weight. Scores are
    weighted before ranking. Captures without negatives get a row too.
    """
    negatives = hits.where("kind = 'negative'").join(controls, "object_id", "left")
    negatives = negatives.withColumn("weighted", F.when(F.coalesce("admissible", F.lit(False)), F.col("score") * F.col("weight")))
    excluded = F.count_if(F.col("weighted").isNull())
    best = negatives.groupBy("capture_id").agg(
        F.max(F.struct("weighted", (-F.col("object_id")).alias("order"), "similarity_coverage", "quality_score", "review_status")).alias("top"),
        excluded.alias("excluded"),
        F.max("score").alias("top_score"),
        F.count(F.lit(1)).alias("n"),
    )
    catalog = hits.where("kind = 'catalog'").groupBy("capture_id").agg(F.max("score").alias("catalog_score"))
    captures = hits.select("capture_id").distinct()
    joined = captures.join(best, "capture_id", "left").join(catalog, "capture_id", "left")
    found = F.col("top.weighted").isNotNull()
    gates = _flags(
        F.col("top.weighted"), F.col("top.similarity_coverage"), F.col("top.quality_score"),
        policy.negative_score, policy.negative_coverage, policy.negative_quality,
    )
    triggered = found & gates["score"] & gates["coverage"] & gates["quality"]
    strength = F.when(triggered & (F.col("top.review_status") == "verified"), "STRONG").when(triggered, "WEAK").otherwise("NONE")
    close = F.coalesce(F.col("top.weighted") >= F.col("catalog_score") - policy.same_margin, F.lit(True))
    none = F.when(F.coalesce("n", F.lit(0)) > 0, "NO_ADMISSIBLE_NEGATIVE_REFERENCE").otherwise("NO_NEGATIVE_REFERENCE")
    return joined.select(
        "capture_id",
        F.when(found, -F.col("top.order")).alias("object_id"),
        F.col("top.weighted").alias("weighted_score"),
        (F.col("top.weighted") - F.col("catalog_score")).alias("catalog_delta"),
        "top_score",
        F.coalesce(triggered, F.lit(False)).alias("triggered"),
        F.coalesce(strength, F.lit("NONE")).alias("strength"),
        F.coalesce(triggered & (strength == "STRONG") & close, F.lit(False)).alias("competes"),
        F.coalesce("excluded", F.lit(0)).alias("excluded"),
        F.when(found, _reasons(gates, NEGATIVE_REASONS, "NEGATIVE_REFERENCE_SIGNAL_GATES_PASSED")).otherwise(none).alias("reasons"),
    )


def _related_gates(policy: Policy) -> dict[str, Column]:
    return _flags(F.col("score"), F.col("similarity_coverage"), F.col("quality_score"), policy.related_score, policy.related_coverage, policy.related_quality)


def identity_decision(hits: DataFrame, signal: DataFrame, replays: DataFrame, policy: Policy = Policy(), calibrated: bool = True) -> DataFrame:
    """One decision a capture, from the whole ranking of catalog objects.

    Eight gates: score, margin (a lone candidate passes), coverage, angles,
    quality, calibration, no competing negative, no exact copy (``replays`` has
    the capture_ids with one). Status takes the first that applies: exact copy,
    calibration missing, accepted, insufficient capture, related, no match. A
    capture without catalog objects has no candidate to fail the other gates.
    """
    top = ranked(hits.where("kind = 'catalog'")).where("rank = 1")
    base = hits.select("capture_id").distinct().join(top.drop("kind", "rank"), "capture_id", "left")
    base = base.join(signal.select("capture_id", "competes"), "capture_id", "left")
    base = base.join(replays.select("capture_id").distinct().withColumn("replay", F.lit(True)), "capture_id", "left")
    has = F.col("object_id").isNotNull()
    gates = {
        "score": F.col("score") >= policy.same_score,
        "margin": has & F.coalesce(F.col("margin") >= policy.same_margin, F.lit(True)),
        "coverage": F.col("coverage") >= policy.same_coverage,
        "angles": F.size("angles") >= policy.same_angles,
        "quality": F.col("quality_score") >= policy.same_quality,
        "calibration": F.lit(calibrated),
        "no_negative": ~F.coalesce("competes", F.lit(False)),
        "no_replay": F.col("replay").isNull(),
    }
    ok = {k: F.coalesce(v, F.lit(False)) for k, v in gates.items()}
    accepted = has
    for gate in ok.values():
        accepted = accepted & gate
    related = F.lit(True)
    for gate in _related_gates(policy).values():
        related = related & F.coalesce(gate, F.lit(False))
    status = (
        F.when(~ok["no_replay"], "EXACT_MEDIA_REPLAY")
        .when(~ok["calibration"], "CALIBRATION_REQUIRED")
        .when(accepted, "KNOWN_ARTIFACT_CANDIDATE")
        .when(has & ~(ok["quality"] & ok["coverage"] & ok["angles"]), "INSUFFICIENT_CAPTURE")
        .when(has & related, "RELATED_REFERENCES_ONLY")
        .otherwise("OPEN_SET_NO_MATCH")
    )
    empty = failed_names(NO_CATALOG_REFERENCES=F.lit(False), EXACT_MEDIA_REPLAY=ok["no_replay"], CALIBRATION_RECORD_REQUIRED=ok["calibration"])
    return base.select(
        "capture_id",
        F.when(accepted, F.col("object_id")).alias("object_id"),
        "score",
        "margin",
        accepted.alias("accepted"),
        status.alias("status"),
        F.when(has, _reasons(ok, IDENTITY_REASONS, "PASSED_ALL_IDENTITY_GATES")).otherwise(F.array_join(empty, ",")).alias("reasons"),
    )


def related_objects(hits: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(capture_id, position, object_id, score): the catalog objects that pass the three looser gates, best first."""
    passing = F.lit(True)
    for gate in _related_gates(policy).values():
        passing = passing & F.coalesce(gate, F.lit(False))
    order = Window.partitionBy("capture_id").orderBy(F.desc("score"), "object_id")
    rows = hits.where("kind = 'catalog'").where(passing)
    return rows.select("capture_id", F.row_number().over(order).alias("position"), "object_id", "score")


def related_decision(hits: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(capture_id, n_related, accepted, status, reasons): whether any catalog object passes, and the gates that the best one fails."""
    gates = _related_gates(policy)
    ok = F.coalesce(gates["score"] & gates["coverage"] & gates["quality"], F.lit(False))
    catalog = hits.where("kind = 'catalog'")
    top = F.max(F.struct("score", (-F.col("object_id")).alias("order"), _reasons(gates, RELATED_REASONS, "RELATED_GATES_PASSED").alias("reasons")))
    found = catalog.groupBy("capture_id").agg(F.count_if(ok).alias("n_related"), top.alias("top"))
    every = hits.select("capture_id").distinct().join(found, "capture_id", "left")
    n = F.coalesce("n_related", F.lit(0).cast("bigint"))
    return every.select(
        "capture_id", n.alias("n_related"), (n > 0).alias("accepted"),
        F.when(n > 0, "related_candidates").otherwise("no_reliable_related_candidate").alias("status"),
        F.coalesce("top.reasons", F.lit(",".join(RELATED_REASONS.values()))).alias("reasons"),
    )


# What is said of a capture for each status of its decision.
STATUS_NOTES = {
    "INSUFFICIENT_CAPTURE": "CAPTURE_INSUFFICIENT", "CALIBRATION_REQUIRED": "CALIBRATION_REQUIRED", "OPEN_SET_NO_MATCH": "OPEN_SET_LIMITATION",
    "RELATED_REFERENCES_ONLY": "RELATED_ONLY_LIMITATION", "EXACT_MEDIA_REPLAY": "EXACT_MEDIA_REPLAY_BLOCKED",
}


def explanations(hits: DataFrame, decisions: DataFrame, signal: DataFrame) -> DataFrame:
    """(capture_id, section, position, code, object_id, detail): what a report states about a capture, in codes.

    Sections are "shared", "differences" and "uncertainties". The best catalog
    object's numbers are stated as relations within the index only; without one,
    its absence is. Uncertainties name the failed gates, the status's own note, the
    known negative that raised a signal or that none was compared, and always that
    authenticity isn't judged.
    """
    top = ranked(hits.where("kind = 'catalog'")).where("rank = 1").select("capture_id", "object_id", "score", "coverage", "quality_score", "margin")
    base = decisions.select("capture_id", "status", "reasons").join(top, "capture_id", "left")
    base = base.join(signal.select("capture_id", F.col("object_id").alias("negative"), "triggered", "weighted_score", "top_score"), "capture_id", "left")
    has, r4 = F.col("object_id").isNotNull(), lambda c: F.round(c, 4)
    numbers = F.to_json(F.struct(r4("score").alias("score"), r4("coverage").alias("coverage"), r4("quality_score").alias("quality_score"), r4("margin").alias("runner_up_margin")))
    note = F.create_map(*[F.lit(x) for pair in STATUS_NOTES.items() for x in pair])
    said = lambda on, section, code, obj=None, detail=None: F.when(
        on, F.struct(F.lit(section).alias("section"), (code if isinstance(code, Column) else F.lit(code)).alias("code"), (F.lit(None) if obj is None else obj).cast("bigint").alias("object_id"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))
    )
    lines = [
        said(has, "shared", "TOP_CANDIDATE_RETRIEVAL_METRICS", F.col("object_id"), numbers),
        said(~has, "uncertainties", "NO_CATALOG_CANDIDATE"),
        said(~has, "differences", "NO_REFERENCE_FOR_DIRECT_COMPARISON"),
        said(F.col("reasons") != "PASSED_ALL_IDENTITY_GATES", "uncertainties", "IDENTITY_GATE_REASONS", None, F.col("reasons")),
        said(F.try_element_at(note, F.col("status")).isNotNull(), "uncertainties", F.try_element_at(note, F.col("status"))),
        said(F.col("triggered"), "differences", "COUNTERFEIT_REFERENCE_SIGNAL", F.col("negative"), r4("weighted_score")),
        said(F.col("top_score").isNull(), "uncertainties", "COUNTERFEIT_CROSS_CHECK_NOT_RUN"),
        said(F.lit(True), "uncertainties", "AUTHENTICITY_NOT_ASSESSED"),
    ]
    stated = base.select("capture_id", F.posexplode(F.array_compact(F.array(*lines))).alias("order", "s")).select("capture_id", "order", "s.*")
    place = F.row_number().over(Window.partitionBy("capture_id", "section").orderBy("order"))
    return stated.select("capture_id", "section", place.alias("position"), "code", "object_id", "detail")


def recognition_status(decisions: DataFrame, related: DataFrame, signal: DataFrame) -> DataFrame:
    """(capture_id, status, cross_check): the decision as a user sees it.

    Without an accepted or related object the status is an open-set miss, but
    for a capture problem, a missing calibration or an exact copy. The
    cross-check with known negatives is a conflict if the signal competes,
    strong if it was raised, weak from a top score of one half up.
    """
    kept = F.col("status").isin("INSUFFICIENT_CAPTURE", "CALIBRATION_REQUIRED", "EXACT_MEDIA_REPLAY")
    miss = ~F.col("accepted") & ~F.col("related") & ~kept
    cross = (
        F.when(F.col("triggered") & F.col("competes"), "CONFLICT_REVIEW")
        .when(F.col("triggered"), "STRONG_SIGNAL")
        .when(F.col("top_score") >= WEAK_SIGNAL_FROM, "WEAK_SIGNAL")
        .when(F.col("top_score").isNotNull(), "NO_SIGNAL")
        .otherwise("NOT_RUN")
    )
    joined = decisions.select("capture_id", "accepted", "status").join(related.select("capture_id", F.col("accepted").alias("related")), "capture_id")
    joined = joined.join(signal.select("capture_id", "triggered", "competes", "top_score"), "capture_id")
    return joined.select("capture_id", F.when(miss, "OPEN_SET_NO_MATCH").otherwise(F.col("status")).alias("status"), cross.alias("cross_check"))
