"""Retrieval against plain loops, and on damaged rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import evaluation, retrieval
from tessella.operators.retrieval import Policy

KIND = "capture_id bigint, object_id bigint, kind string, view_id bigint, vector array<float>, quality double, angle string"
LOOSE = Policy(view_similarity=0.2, view_quality=0.1)


def made(n=120, dimension=6, objects=9):
    rng = np.random.default_rng(5)
    angles = ["front", "Back", "detail", None]
    return [
        (i // 7, int(rng.integers(objects)), "catalog" if i % 3 else "negative", i, rng.normal(size=dimension).tolist(), float(rng.random()), angles[i % 4])
        for i in range(n)
    ]


def plain_scores(queries, gallery, policy):
    """(query view, object) -> best similarity, its view, matched, matched by angle; with loops."""
    unit = lambda v: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float))
    known = {"front": "FRONT", "Back": "BACK"}
    out = {}
    for q in queries:
        for g in gallery:
            if q[3] == g[3]:
                continue
            s = round(float(np.clip(unit(q[4]) @ unit(g[4]), -1, 1)), 9)
            match = s >= policy.view_similarity and q[5] >= policy.view_quality and g[5] >= policy.view_quality
            same = match and known.get(q[6]) is not None and known.get(q[6]) == known.get(g[6])
            best = out.setdefault((q[3], g[1]), [-2.0, None, False, False])
            if (s, -g[3]) > (best[0], -(best[1] if best[1] is not None else math.inf)):
                best[:2] = [s, g[3]]
            best[2] |= match
            best[3] |= same
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("packed", [1 << 20, 1])
def test_scores_equal_loops_whatever_the_blocks(spark, monkeypatch, packed):
    monkeypatch.setattr(retrieval, "PACKED_BYTES", packed)
    rows = made()
    gallery = spark.createDataFrame(rows, KIND).repartition(3)
    queries = gallery.where("view_id % 5 = 0")
    want = plain_scores([r for r in rows if r[3] % 5 == 0], rows, LOOSE)
    got = retrieval.view_scores(queries, gallery, LOOSE).collect()
    assert {(r.query_view, r.object_id): (r.similarity, r.best_view, r.matched, r.angle_matched) for r in got} == want
    top = retrieval.best_objects(queries, gallery, 3, LOOSE).collect()
    for q in {k[0] for k in want}:
        ranked = sorted(((-s[0], o, s[1]) for (v, o), s in want.items() if v == q))[:3]
        assert [(r.object_id, r.best_view) for r in sorted(top, key=lambda r: r["rank"]) if r.query_view == q] == [(o, v) for _, o, v in ranked]


def test_damaged_views_are_named_and_take_no_part(spark):
    good = made(30)
    bad = [
        (0, 1, "catalog", None, [1.0] * 6, 0.5, "front"), (0, 1, "catalog", 101, None, 0.5, None), (0, 1, "catalog", 102, [], 0.5, None),
        (0, 1, "catalog", 103, [1.0] * 5, 0.5, None), (0, 1, "catalog", 104, [1.0, None] + [0.0] * 4, 0.5, None), (0, 1, "catalog", 105, [float("nan")] + [0.0] * 5, 0.5, None),
        (0, 1, "catalog", 106, [0.0] * 6, 0.5, None), (0, 1, "catalog", 107, [1.0] * 6, None, None), (0, 1, "catalog", 108, [1.0] * 6, 1.5, None),
        (0, None, "catalog", 109, [1.0] * 6, 0.5, None), (None, 1, "catalog", 110, [float("inf")] + [0.0] * 5, 0.5, None),
    ]
    clean, dirty = (spark.createDataFrame(r, KIND) for r in (good, good + bad))
    named = {r.view_id: r.reason for r in retrieval.view_violations(dirty, 6, "object_id").collect()}
    assert named == {
        None: "MISSING_VIEW_ID", 101: "EMPTY_VECTOR", 102: "EMPTY_VECTOR", 103: "WRONG_DIMENSION", 104: "NOT_FINITE", 105: "NOT_FINITE", 106: "ZERO_LENGTH",
        107: "QUALITY_OUT_OF_RANGE", 108: "QUALITY_OUT_OF_RANGE", 109: "MISSING_OBJECT_ID", 110: "NOT_FINITE",
    }
    plain = lambda r: str([round(v, 9) if isinstance(v, float) else v for v in r])
    hits = lambda queries, gallery: sorted(map(plain, retrieval.object_hits(queries, gallery, LOOSE).collect()))
    queries = lambda df: df.where("view_id % 5 = 0 and view_id < 100")
    assert hits(queries(dirty), dirty) == hits(queries(clean), clean)
    assert hits(dirty, dirty)
    empty = clean.limit(0)
    assert retrieval.view_scores(empty, clean).count() == retrieval.view_scores(clean, empty).count() == retrieval.object_hits(empty, empty).count() == 0


def test_centroids_equal_plain_means(spark):
    axis = lambda at, x: [x if i == at else 0.0 for i in range(6)]
    rows = made(60) + [(0, 50, "catalog", 1000 + i, axis(i, 1.0), 0.0, None) for i in range(2)] + [(0, 51, "catalog", 1002 + i, axis(0, x), 0.5, None) for i, x in enumerate((1.0, -1.0))]
    got = {r.object_id: r.centroid for r in retrieval.centroids(spark.createDataFrame(rows, KIND).repartition(4), "object_id").collect()}
    for o in {r[1] for r in rows}:
        v = np.array([np.array(r[4]) / np.linalg.norm(r[4]) for r in rows if r[1] == o])
        w = np.array([r[5] for r in rows if r[1] == o])
        mean = (v * w[:, None]).sum(axis=0) / w.sum() if w.sum() > 1e-12 else v.mean(axis=0)
        size = np.linalg.norm(mean)
        assert got[o] is None if size <= 1e-9 else np.allclose(got[o], mean / size, atol=1e-6)


def test_a_mean_quality_on_the_gate_passes(spark):
    """(0.7 + 0.1) / 2 falls short of 0.4 by the last bit, whatever the order of summation."""
    axis = [1.0] + [0.0] * 5
    queries = spark.createDataFrame([(1, 0, "catalog", 1, axis, 0.7, "front"), (1, 0, "catalog", 2, axis, 0.1, "front")], KIND)
    gallery = spark.createDataFrame([(0, 5, "catalog", 3, axis, 0.9, "front")], KIND)
    policy = Policy(same_quality=0.4, same_angles=0, same_coverage=0.0)
    hits = retrieval.object_hits(queries, gallery, policy)
    controls = spark.createDataFrame([], "object_id bigint, review_status string, admissible boolean, weight double")
    decided = retrieval.identity_decision(hits, retrieval.negative_signal(hits, controls, policy), hits.select("capture_id").limit(0), policy).first()
    assert (decided.accepted, decided.reasons) == (True, "PASSED_ALL_IDENTITY_GATES")


def test_decisions_without_candidates(spark):
    hits = spark.createDataFrame(
        [(1, 5, "negative", 0.9, 0.9, None, 0.5, 0.9, ["FRONT"], 0.9)],
        "capture_id bigint, object_id bigint, kind string, score double, view_score double, centroid_score double, coverage double, similarity_coverage double, angles array<string>, quality_score double",
    )
    controls = spark.createDataFrame([(5, "verified", True, 1.0)], "object_id bigint, review_status string, admissible boolean, weight double")
    signal = retrieval.negative_signal(hits, controls)
    assert (signal.first().strength, signal.first().competes) == ("STRONG", True)
    none = spark.createDataFrame([], "capture_id bigint")
    decided = retrieval.identity_decision(hits, signal, none, calibrated=False)
    assert (decided.first().status, decided.first().reasons, decided.first().accepted) == ("CALIBRATION_REQUIRED", "NO_CATALOG_REFERENCES,CALIBRATION_RECORD_REQUIRED", False)
    related = retrieval.related_decision(hits)
    assert (related.first().n_related, related.first().status) == (0, "no_reliable_related_candidate")
    assert tuple(retrieval.recognition_status(decided, related, signal).first()) == (1, "CALIBRATION_REQUIRED", "CONFLICT_REVIEW")


@pytest.mark.parametrize("n", [1, 2, 3, 10, 19, 20, 21, 101])
def test_quantiles_equal_sorted_lists(spark, n):
    values = [(i * 7) % 13 for i in range(n)]
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "value double").withColumn("upto", F.lit("clash"))
    got = evaluation.latency_quantiles(frame, "value").first()
    ordered = sorted(values)
    at = min(n, max(1, round(0.95 * n + 0.5)))
    assert (got["min"], got["median"], got.p95, got["max"]) == (ordered[0], float(np.median(ordered)), ordered[at - 1], ordered[-1])
