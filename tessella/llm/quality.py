"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model, fitted on a bounded sample of labelled rows, gives each
document's evidence. Host and path are read from a site column: a URL, or a
name whose parts are divided by slashes; a name without slashes is a host with
one empty path. Grouped aggregation sums the evidence by path and by host. Prior
strengths come from the method of moments: a host's posterior is shrunk toward
the global mean, a path's toward its host's, the more the sparser it is. A
document's log-odds are those of its evidence, shifted by how far its path's
posterior lies from the global mean. Its own evidence is left out of the sums of
its path and host, so that it isn't counted twice: a document alone on its site
is moved by nothing.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bytes_udf
from tessella.llm.linear import fit_logistic, predict
from tessella.llm.sampling import labelled_sample
from tessella.sources.shared import discard, materialise

#: Labelled rows that the document classifier is fitted on, at most.
SAMPLE_ROWS = 6000
KEEP_FROM = 0.5
_UPPER, _LOWER, _DIGITS = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)), b"0123456789"
_SYMBOLS = b"%$&*#@^~<>{}[]=+_\\/"


def features(text: bytes) -> list[float]:
    """Eleven measures of a text: shares of capitals, marks, symbols, repeats, and sizes."""
    words = text.split()
    n, n_words = max(len(text), 1), max(len(words), 1)
    count = lambda marks: len(text) - len(text.translate(None, marks))
    upper, lower = count(_UPPER), count(_LOWER)
    lines = [line for line in text.split(b"\n") if line]
    shares = [
        upper / max(upper + lower, 1),
        text.count(b"!") / n_words,
        text.count(b"|") / n_words,
        count(_SYMBOLS) / n_words,
        sum(map(bytes.__eq__, words, words[1:])) / n_words,
        len(set(words)) / n_words,
        count(_DIGITS) / n,
        text.count(b"http") / n_words,
        len(set(lines)) / max(len(lines), 1),
    ]
    return [float(np.log1p(50 * s)) for s in shares] + [float(np.log1p(n_words)), n / n_words / 10]


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        return predict((x - self.mean) / self.scale, self.weights)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label_col: str = "quality") -> QualityModel:
    """Fit on at most ``rows`` labelled documents; without any, every document gets one half."""

    def batch(texts: list[bytes]) -> pa.Array:
        return pa.array([features(t) for t in texts], type=pa.list_(pa.float64()))

    sample = labelled_sample(docs, labels, label_col, rows)
    measured = bytes_udf(batch, "array<double>")
    got = sample.select("id", measured("text").alias("x"), "y").orderBy("id").collect()  # at most ``rows``
    discard(sample)
    x = np.array([r.x for r in got]).reshape(-1, len(features(b"")))
    y = np.array([r.y for r in got])
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    return QualityModel(mean, scale, fit_logistic((x - mean) / scale, y))


def add_evidence(docs: DataFrame, model: QualityModel, text_col: str = "text", out_col: str = "evidence") -> DataFrame:
    """``docs`` with the document classifier's probability of good quality."""

    def batch(texts: list[bytes]) -> pa.Array:
        return pa.array(model.probability(np.array([features(t) for t in texts]).reshape(len(texts), -1)))

    return docs.withColumn(out_col, bytes_udf(batch, "double")(F.col(text_col)))


def _strength(groups: DataFrame, mean: float | Column) -> tuple[float, float]:
    """Prior strength by the method of moments: how little group means vary
    beyond what their sizes explain. Between 1 and a million rows."""
    n, rate = F.col("n").cast("double"), F.col("total") / F.col("n")
    spread, n_groups, rows, squares, centre = groups.agg(
        F.sum(n * (rate - mean) ** 2), F.count(F.lit(1)), F.sum(n), F.sum(n * n), F.sum(n * mean)
    ).first()
    if not rows:
        return 1.0, 0.5
    centre = min(max(centre / rows, 1e-6), 1 - 1e-6)
    within = centre * (1 - centre)
    between = (spread - (n_groups - 1) * within) / max(rows - squares / rows, 1.0)
    return (min(max(within / between - 1, 1.0), 1e6) if between > 0 else 1e6), centre


def add_site(docs: DataFrame, site_col: str = "source", host_col: str = "host", path_col: str = "path") -> DataFrame:
    """``docs`` with the host of a URL or name, in lower case, and the first part of its path.

    A scheme, a port and a leading "www." are left out; without a path it is
    empty. A null site has null host and path.
    """
    bare = F.regexp_replace(F.lower(F.col(site_col)), r"^[a-z][a-z0-9+.\-]*://", "")
    host = F.regexp_extract(bare, r"^(?:www\.)?([^/?#:]*)", 1)
    return docs.withColumns({host_col: host, path_col: F.regexp_extract(bare, r"^[^/?#]*/([^/?#]*)", 1)})


@dataclass
class Sites:
    """Sums by path, with those of its host, and what shrinks them."""

    sums: DataFrame  # host, path, n, total, host_n, host_total
    mean: float
    host_strength: float
    path_strength: float

    def posteriors(self, own: Column | None = None) -> tuple[Column, Column]:
        """Posterior of the host and of the path, without a document whose evidence is ``own``."""
        rows, score = (F.lit(0), F.lit(0.0)) if own is None else (F.lit(1), own)
        host = (F.col("host_total") - score + self.host_strength * self.mean) / (F.col("host_n") - rows + self.host_strength)
        path = (F.col("total") - score + self.path_strength * host) / (F.col("n") - rows + self.path_strength)
        return host, path


def site_sums(evidence: DataFrame, score: str = "evidence") -> Sites:
    """The sums of ``score`` over the columns host and path, and the prior strengths.

    Paths are summed before the shuffle, so a site with a third of all rows is
    no burden. Null hosts and paths are sites of their own. Without rows the mean
    is one half.
    """
    paths = evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("total"))
    paths = materialise(paths, "paths")
    hosts = paths.groupBy(F.col("host").alias("h")).agg(F.sum("n").alias("host_n"), F.sum("total").alias("host_total"))
    rows, total = hosts.agg(F.sum("host_n"), F.sum("host_total")).first()
    mean = min(max(total / rows, 1e-6), 1 - 1e-6) if rows else 0.5
    host_strength, _ = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_total").alias("total")), F.lit(mean))
    sums = materialise(paths.join(hosts, paths["host"].eqNullSafe(hosts["h"])).drop("h"), "sites")
    discard(paths)
    whole = Sites(sums, mean, host_strength, 0.0)
    path_strength, _ = _strength(sums.withColumn("host_posterior", whole.posteriors()[0]), F.col("host_posterior"))
    return Sites(sums, mean, host_strength, path_strength)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def _posterior(evidence: Column, path_posterior: Column, mean: float) -> Column:
    odds = _logit(evidence) + _logit(path_posterior) - _logit(F.lit(mean))
    return F.round(1 / (1 + F.exp(-odds)), 9)


def add_posteriors(scored: DataFrame, sites: Sites) -> DataFrame:
    """``scored`` (host, path, evidence) with host_posterior, path_posterior and posterior (to nine places).

    Every path of ``scored`` is in ``sites``, which count each of its rows.
    """
    sums = sites.sums.withColumnsRenamed({"host": "h", "path": "p"})
    joined = scored.join(sums, scored["host"].eqNullSafe(sums["h"]) & scored["path"].eqNullSafe(sums["p"]))
    host, path = sites.posteriors(F.col("evidence"))
    joined = joined.withColumns({"host_posterior": host, "path_posterior": path}).drop(*sums.columns)
    return joined.withColumn("posterior", _posterior(F.col("evidence"), F.col("path_posterior"), sites.mean))


def score_documents(docs: DataFrame, labels: DataFrame, site_col: str = "source", rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, posterior and keep of each document.

    The posteriors of host and path are those without the document itself. A
    null text is empty; an empty table gives an empty result.
    """
    model = fit(docs, labels, rows)
    narrow = add_site(docs.select("doc_id", "text", F.col(site_col).alias("site")), "site").drop("site")
    scored = materialise(add_evidence(narrow, model).drop("text"), "evidence")
    judged = add_posteriors(scored, site_sums(scored))
    return judged.select(
        "doc_id", "evidence", "host_posterior", "path_posterior", "posterior", (F.col("posterior") >= KEEP_FROM).alias("keep")
    )


def keep_good(docs: DataFrame, labels: DataFrame, site_col: str = "source", rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents whose posterior is at least one half, columns unchanged.

    Texts are measured twice, once for the sites and once to decide, rather
    than written a second time. Whole documents meet their sites in a join,
    by broadcast where the sites are few.
    """
    model = fit(docs, labels, rows)
    narrow = add_site(docs.select("text", F.col(site_col).alias("site")), "site").drop("site")
    sites = site_sums(add_evidence(narrow, model).drop("text"))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"], docs[site_col].alias("site"))
    judged = add_posteriors(add_evidence(add_site(whole, "site").drop("site"), model).drop("text"), sites)
    return judged.where(F.col("posterior") >= KEEP_FROM).select("row.*")
