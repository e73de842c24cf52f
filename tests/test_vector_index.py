import numpy as np
import pytest

from tessella.operators import retrieval, vector_index

SCHEMA = "object_id bigint, view_id bigint, vector array<double>, quality double, angle string"


def clustered(n, groups, dims, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return [(int(i % groups * 3 + i // groups % 3), i, (centres[i % groups] + spread * rng.normal(size=dims)).tolist(), 0.5, None) for i in range(n)]


def plain(rows):
    return sorted((r.query_view, r["rank"], r.object_id, r.best_view, r.similarity) for r in rows.collect())


@pytest.mark.parametrize("spread, most", [(0.05, 0.4), (2.0, 1.0)])
def test_index_answers_as_a_search_over_all_views(spark, spread, most):
    rows = clustered(900, 30, 16, 3, spread)
    gallery = spark.createDataFrame(rows, SCHEMA)
    queries = gallery.where("view_id % 20 = 0")
    index = vector_index.build_index(gallery, cells=24)
    assert index.centres(spark).groupBy().sum("n").first()[0] == 900
    found, read, total = vector_index.search(queries, index, 2, probes=2)
    assert plain(found) == plain(retrieval.best_objects(queries, gallery, 2))
    assert total == 45 * index.centres(spark).count() and read <= most * total


def test_hard_views(spark):
    v = [1.0] + [0.0] * 7
    rows = [(1, 1, v, 0.5, None), (1, 2, v, 0.5, "front"), (2, 3, v, 0.5, None), (2, 4, [-x for x in v], 0.5, None), (3, 5, None, 0.5, None), (None, 6, v, 0.5, None), (4, 7, [0.0] * 8, 0.5, None), (5, 8, v[:4], 0.5, None), (6, 9, [float("nan")] * 8, 0.5, None), (7, None, v, 0.5, None), (8, 10, [2e-9, *v[1:-1], 1.0], 0.5, None)]
    gallery = spark.createDataFrame(rows, SCHEMA)
    for cells, probes in ((1, 1), (2, 1), (64, 3)):
        found, _, _ = vector_index.search(gallery, vector_index.build_index(gallery, cells=cells), 3, probes=probes)
        assert plain(found) == plain(retrieval.best_objects(gallery, gallery, 3))


def test_one_vector_many_times_and_nothing(spark):
    rows = [(i % 5, i, [3.0, 4.0], 0.5, None) for i in range(200)]
    gallery = spark.createDataFrame(rows, SCHEMA)
    index = vector_index.build_index(gallery, cells=8)
    found, _, _ = vector_index.search(gallery.where("view_id < 3"), index, 2)
    assert plain(found) == plain(retrieval.best_objects(gallery.where("view_id < 3"), gallery, 2))
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_index.search(empty, index, 2)[0].count() == 0
    assert vector_index.search(gallery, vector_index.build_index(empty), 2)[0].count() == 0
