import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import quality, toxicity
from tessella.llm.linear import SparseRows, fit_logistic, fit_sparse, predict, predict_sparse
from tessella.llm.queries import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def halves(labels):
    first = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    return labels.where(first), labels.where(~first)


def test_newton_steps_reach_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = (rng.random(500) < predict(x, np.array([1.0, -2.0, 0.5, 0.3]))).astype(float)
    w = fit_logistic(x, y)
    gradient = np.column_stack([x, np.ones(500)]).T @ (y - predict(x, w)) - np.array([1, 1, 1, 1e-3]) * w
    assert np.abs(gradient).max() < 1e-4


def test_quality_on_held_out_labels(tables):
    docs, labels = tables
    train, test = halves(labels)
    got = quality.score_documents(docs, train).join(test, "doc_id").collect()
    assert len(got) > 100
    assert np.mean([r.keep == (r.quality == 1) for r in got]) >= 0.97
    assert np.mean([r.keep for r in got if r.quality == 1]) >= 0.98


def test_quality_filter_agrees_and_keeps_columns(tables):
    docs, labels = tables
    want = {r.doc_id for r in quality.score_documents(docs, labels).where("keep").collect()}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want


def test_sites_are_read_from_urls_and_names(spark):
    rows = ["https://www.Example.com/a/b?x=1", "http://example.com:80", "src7", "crawl/2024/week1", "x.org/?q", "", None]
    frame = quality.add_site(spark.createDataFrame([(r,) for r in rows], "source string"))
    want = [("example.com", "a"), ("example.com", ""), ("src7", ""), ("crawl", "2024"), ("x.org", ""), ("", ""), (None, None)]
    assert [(r.host, r.path) for r in frame.collect()] == want


def plain_strength(groups, mean_of):
    """Method of moments for (n, total) groups: between-group variance beyond that of sampling."""
    rows = sum(n for n, _ in groups.values())
    centre = sum(n * mean_of(g) for g, (n, _) in groups.items()) / rows
    within = centre * (1 - centre)
    spread = sum(n * (t / n - mean_of(g)) ** 2 for g, (n, t) in groups.items())
    between = (spread - (len(groups) - 1) * within) / max(rows - sum(n * n for n, _ in groups.values()) / rows, 1)
    return min(max(within / between - 1, 1), 1e6) if between > 0 else 1e6


def test_posteriors_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    for spread in (2.0, 0.0):
        hosts = {h: rng.normal() * spread for h in ["a", "b", "c", "d", None]}
        rows = []
        for h, lean in hosts.items():
            for p in ("x", "y", None)[: rng.integers(1, 4)]:
                own = lean + rng.normal() * spread
                rows += [(h, p, float(1 / (1 + np.exp(-own - rng.normal())))) for _ in range(int(rng.choice([1, 2, 40])))]
        got = quality.add_posteriors(
            frame := spark.createDataFrame(rows, "host string, path string, evidence double"), quality.site_sums(frame)
        ).collect()
        assert len(got) == len(rows)
        paths, hosts = {}, {}
        for h, p, e in rows:
            for sums, key in ((paths, (h, p)), (hosts, h)):
                n, t = sums.get(key, (0, 0.0))
                sums[key] = n + 1, t + e
        mean = sum(e for *_, e in rows) / len(rows)
        m = plain_strength(hosts, lambda h: mean)
        of_host = {h: (t + m * mean) / (n + m) for h, (n, t) in hosts.items()}
        k = plain_strength(paths, lambda hp: of_host[hp[0]])
        logit = lambda p: np.log(p / (1 - p))
        for r in got:
            (hn, ht), (pn, pt) = hosts[r.host], paths[r.host, r.path]
            host = (ht - r.evidence + m * mean) / (hn - 1 + m)
            path = (pt - r.evidence + k * host) / (pn - 1 + k)
            post = 1 / (1 + np.exp(-(logit(r.evidence) + logit(path) - logit(mean))))
            assert np.allclose([r.host_posterior, r.path_posterior, r.posterior], [host, path, post], atol=1e-9)


def test_sparse_sites_shrink_more_and_lone_documents_stay(spark):
    rows = [("big", "a", 1.0)] * 400 + [("big", "a", 0.0)] * 100 + [("low", "b", 0.0)] * 400 + [("low", "b", 1.0)] * 100
    rows += [("tiny", "c", 0.0)] * 2 + [(None, None, 0.7)]
    frame = spark.createDataFrame(rows, "host string, path string, evidence double")
    sites = quality.site_sums(frame)
    host, path = sites.posteriors()
    got = {r.host: r for r in sites.sums.select("host", "n", host.alias("hp"), path.alias("pp")).collect()}
    assert abs(sites.mean - 500.7 / 1003) < 1e-9 and set(got) == {"big", "low", "tiny", None}
    assert abs(got["big"].pp - 0.8) < 0.02 and abs(got["low"].pp - 0.2) < 0.02
    assert 0.0 < got["tiny"].hp < sites.mean and got[None].n == 1
    lone = quality.add_posteriors(frame, sites).where("host is null").first()
    assert abs(lone.posterior - 0.7) < 1e-9


def test_quality_of_hard_rows(spark, hard, clashing, empty):
    labels = spark.createDataFrame([(1, 0), (6, 1), (6, 0), (None, 1)], "doc_id long, quality int")
    sites = lambda df: df.withColumn("source", F.when(F.col("doc_id") > 3, "s/p"))
    for frame in map(sites, (hard, clashing, empty)):
        for some in (labels, labels.limit(0)):
            got = quality.score_documents(frame, some).collect()
            assert len(got) == frame.count() and all(0 <= r.posterior <= 1 for r in got)
            kept = quality.keep_good(frame, some)
            assert kept.columns == frame.columns and kept.count() == sum(r.keep for r in got)


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, test = halves(labels)
    got = toxicity.add_toxicity(docs, toxicity.fit(docs, train)).join(test, "doc_id").select("toxic", "toxicity").collect()
    said = np.array([r.toxicity.toxic >= 0.5 for r in got])
    true = np.array([r.toxic == 1 for r in got])
    assert (said == true).mean() >= 0.98 and (said & ~true).sum() <= 2


def sparse(x):
    return SparseRows.of([(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in x], x.shape[1])


def test_sparse_fit_equals_the_dense_one():
    rng = np.random.default_rng(5)
    for n, size in ((60, 3), (40, 90), (5, 1), (0, 4)):
        x = rng.normal(size=(n, size)) * (rng.random((n, size)) < 0.3)
        extra = rng.random((n, 2))
        y = (rng.random(n) < 0.4).astype(float)
        rows = sparse(x).beside(extra[:, 0]).beside(extra[:, 1]) if n else sparse(x).beside(np.empty(0)).beside(np.empty(0))
        dense = np.column_stack([x, extra])
        got, want = fit_sparse(rows, y, 0.3), fit_logistic(dense, y, 0.3)
        assert np.allclose(got, want, atol=1e-5)
        assert np.allclose(predict_sparse(rows, want), predict(dense, want))
        keep = rng.random(n) < 0.5
        assert np.allclose(predict_sparse(rows.where(keep), want), predict(dense, want)[keep])


def test_later_links_see_out_of_fold_predictions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    ys = np.column_stack([x[:, 0] > 0, rng.random(60) > 0.5]).astype(float)
    models = toxicity.fit_chain(sparse(x), ys, folds=3)
    unseen = np.zeros(60)
    for f in range(3):
        out = np.arange(60) % 3 == f
        unseen[out] = predict(x[out], fit_logistic(x[~out], ys[~out, 0], toxicity.RIDGE))
    assert np.allclose(models[1], fit_logistic(np.column_stack([x, unseen]), ys[:, 1], toxicity.RIDGE), atol=1e-5)
    chain = toxicity.ToxicityChain({"a": 0, "b": 1}, models)
    assert np.allclose(chain.probabilities(sparse(x))[:, 1], predict(np.column_stack([x, predict(x, models[0])]), models[1]), atol=1e-5)


def test_beginnings_go_on_without_end():
    assert list(toxicity.beginnings(3)) == [] and list(toxicity.beginnings(6)) == [3, 4, 5]
    assert list(toxicity.beginnings(100)) == [3, 4, 5, 6, 7, 8, 12, 16, 24, 32, 48, 64, 96]
    assert len(toxicity.terms_of("x" * 50_000)) < 40


def test_registered_query_recomputed(spark):
    """op10 over sf0.001 by a second writing: terms, their odds, the chain with dense models, the probabilities."""
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "text", "lang", "xxhash64(doc_id) AS h").collect()}
    labels = {r.doc_id: float(r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic IS NOT NULL").collect()}
    ids = sorted((i for i in labels if i in docs), key=lambda i: (docs[i].h, i))

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))

    def terms(word):
        return [word] + ["^" + word[:n] for n in (3, 4, 5, 6, 7, 8, 12, 16, 24, 32, 48, 64) if n < len(word)]

    y = np.array([labels[i] for i in ids])
    held = [{t for w in words(docs[i].text) for t in terms(w)} for i in ids]
    toxic, every = Counter(t for h, bad in zip(held, y) if bad for t in h), Counter(t for h in held for t in h)
    chosen = {}
    for t, k in toxic.items():
        c = every[t] - k
        odds = math.log((k + 0.5) / (y.sum() - k + 0.5)) - math.log((c + 0.5) / (len(y) - y.sum() - c + 0.5))
        z = round(odds / math.sqrt(1 / (k + 0.5) + 1 / (c + 0.5)), 9)
        if k >= 3 and z > 3:
            chosen[t] = z
    index = sorted(chosen, key=lambda t: (-chosen[t], t.encode()))

    def row(text):
        n = Counter(t for w in words(text) for t in terms(w))
        return np.log1p([n[t] for t in index])

    x = np.array([row(docs[i].text) for i in ids])
    ys = np.column_stack([toxicity.kinds(x[y > 0], y > 0, np.array([docs[i].lang or "" for i in ids], dtype=object)), y])
    everything = np.array([row(docs[i].text) for i in docs])
    for k in range(3):
        unseen = np.zeros(len(x))
        for f in range(5):
            out = np.arange(len(x)) % 5 == f
            unseen[out] = predict(x[out], fit_logistic(x[~out], ys[~out, k], 0.2))
        everything = np.column_stack([everything, predict(everything, fit_logistic(x, ys[:, k], 0.2))])
        x = np.column_stack([x, unseen])
    want = dict(zip(docs, everything[:, len(index) :]))
    got = queries()["op10_toxicity"](spark, folder).collect()
    assert index and len(got) == len(docs)
    for r in got:
        assert np.allclose([r.p_kind_1, r.p_kind_2, r.p_toxic], want[r.doc_id], atol=1e-4) and r.toxic == (r.p_toxic > 0.5)


def test_kinds_come_from_the_sample_in_every_language(spark):
    words = {"x": (["brugga", "zwelm"], ["oktari", "pinsu"]), "y": (["дурак", "мерзко"], ["хлам", "тупой"])}
    rows = []
    for lang, sets in words.items():
        for i in range(300):
            kind = [0, 0, 1, 2, 2, 2, 2, 2, 2, 2][i % 10]  # two kinds of toxic text, the second less common, and clean text
            bad = " ".join(sets[kind]) if kind < 2 else ""
            rows.append((len(rows), f"plain words {lang * 5} {bad} number {i}", lang, kind))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, kind int")
    labels = frame.selectExpr("doc_id", "int(kind < 2) AS toxic")
    got = toxicity.add_toxicity(frame, toxicity.fit(frame, labels)).collect()
    for lang in words:
        for kind in range(3):
            p = np.array([list(r.toxicity) for r in got if r.lang == lang and r.kind == kind])
            assert len(p) and ((p >= 0.5) == [kind == 0, kind == 1, kind < 2]).all()


def test_hard_rows_and_no_labels(spark, hard, clashing, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (4, 0, 1), (4, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        for frame in (hard, clashing, empty):
            site = frame.withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit("en"))
            assert quality.score_documents(site, some).count() == frame.count()
            assert quality.keep_good(site, some).columns == site.columns
            assert quality.keep_good(site, some).count() <= frame.count()
            assert toxicity.drop_toxic(frame, some).columns == frame.columns
            assert toxicity.add_toxicity(frame, toxicity.fit(frame, some)).count() == frame.count()
