"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other: two kinds of toxic text, and
toxicity itself. Each model sees the document's features and the probabilities
of the categories before it. When the chain is fitted, these come from models
that have not seen the row (out-of-fold predictions), so that later links learn
how far to trust earlier ones. The kinds have no labels of their own: within
each language the toxic rows of the sample are split in two by the features they
hold (2-means from the principal direction), and the larger part is kind 1. So
every toxic row, in whatever words, is of one kind; the kinds are numbers and
not names, as nothing in the labels says what they mean.

Features are words and their beginnings, all those that toxic rows of the sample
have significantly more often; the model is sparse, so their number isn't bounded.
"""

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.texts import fresh_name
from tessella.llm.common import bytes_udf, struct_array, words_of
from tessella.llm.linear import SparseRows, fit_sparse, predict_sparse
from tessella.llm.sampling import labelled_sample
from tessella.llm.tokenizers import Memo
from tessella.sources.shared import discard

#: Labelled rows that the chain is fitted on, at most.
SAMPLE_ROWS = 6000
#: A feature is in at least so many toxic rows, and its log-odds are so many standard errors above those of clean rows.
LEAST_ROWS, LEAST_Z = 3, 3.0
FOLDS = 5
RIDGE = 0.2
TOXIC_ABOVE = 0.5
CATEGORIES = ("kind_1", "kind_2", "toxic")
MEANS_ROUNDS = 50


def letters_of(text: bytes) -> list[str]:
    """The words of a text as strings."""
    return b" ".join(words_of(text)).decode().split(" ")


def beginnings(n: int) -> Iterator[int]:
    """Lengths of a word's beginnings, shorter than ``n``: 3 to 8, then each half and whole power of two."""
    yield from range(3, min(n, 9))
    long = 12
    while long < n:
        yield long
        long = long * 4 // 3 if long & (long - 1) else long * 3 // 2


def terms_of(word: str) -> list[str]:
    """A word, and "^" with each of its ``beginnings``, a number that grows with the logarithm of a long word's length."""
    return [word, *("^" + word[:n] for n in beginnings(len(word)))]


class Places(Memo):
    """word -> the places of the chosen features that it has; most words have none."""

    def __init__(self, index: dict[str, int]):
        super().__init__(lambda word: [index[t] for t in terms_of(word) if t in index], limit=50_000, longest=64)
        self.size = len(index)


def features_of(text: bytes, places: Places) -> tuple[np.ndarray, np.ndarray]:
    """The chosen features that a text holds, in order, and log(1 + n) of how often."""
    counts: Counter = Counter()
    for word, n in Counter(letters_of(text)).items():
        for at in places[word]:
            counts[at] += n
    at = sorted(counts)
    return np.array(at, np.int64), np.log1p(np.array([counts[a] for a in at], np.float64))


@dataclass
class ToxicityChain:
    index: dict[str, int]
    models: list[np.ndarray]  # one a category
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def probabilities(self, x: SparseRows) -> np.ndarray:
        for w in self.models:
            x = x.beside(predict_sparse(x, w))
        return x.dense


def fit_chain(x: SparseRows, ys: np.ndarray, folds: int = FOLDS) -> list[np.ndarray]:
    """One model a column of ``ys``; row i is in fold i mod ``folds``."""
    fold = np.arange(len(x)) % folds
    models = []
    for y in ys.T:
        models.append(fit_sparse(x, y, RIDGE))
        unseen = np.zeros(len(x))
        for f in range(folds):
            out = fold == f
            unseen[out] = predict_sparse(x.where(out), fit_sparse(x.where(~out), y[~out], RIDGE))
        x = x.beside(unseen)
    return models


def larger_kind(x: np.ndarray) -> np.ndarray:
    """Splits rows in two by the features they hold; true for the larger part.

    The principal direction comes from the products of rows with each other, as
    rows are fewer than features.
    """
    held = (x > 0).astype(float)
    held /= np.maximum(np.sqrt(held.sum(axis=1, keepdims=True)), 1)
    products = held @ held.T
    products -= products.mean(axis=0)
    products -= products.mean(axis=1, keepdims=True)
    if np.abs(products).max(initial=0) < 1e-9:
        return np.ones(len(x), bool)
    side = np.linalg.eigh(products)[1][:, -1] > 0
    for _ in range(MEANS_ROUNDS):
        if side.all() or not side.any():
            break
        a, b = held[side].mean(axis=0), held[~side].mean(axis=0)
        nearer = held @ (a - b) > (a @ a - b @ b) / 2
        if (nearer == side).all() or nearer.all() or not nearer.any():
            break
        side = nearer
    n = 2 * side.sum()
    return side if n > len(x) or n == len(x) and side[0] else ~side


def kinds(x: np.ndarray, toxic: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """Two columns, 1 where a toxic row is of the larger or smaller kind of its language; ``x`` has the toxic rows' features, in their order."""
    places = np.cumsum(toxic) - 1
    out = np.zeros((len(toxic), 2))
    for lang in set(langs[toxic]):
        rows = np.flatnonzero(toxic & (langs == lang))
        larger = larger_kind(x[places[rows]])
        out[rows[larger], 0] = out[rows[~larger], 1] = 1
    return out


def _choose(sample: DataFrame) -> list[str]:
    """All features whose log-odds for toxic rows are significant, the most significant first."""

    def batch(texts: list[bytes]) -> pa.Array:
        terms = [{term for word in set(letters_of(t)) for term in terms_of(word)} for t in texts]
        return pa.array([sorted(t) for t in terms], type=pa.list_(pa.string()))

    toxic_rows, rows = sample.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.count(F.lit(1))).first()
    clean_rows = rows - toxic_rows
    t, c = F.col("toxic"), F.col("n") - F.col("toxic")
    odds = F.log((t + 0.5) / (toxic_rows - t + 0.5)) - F.log((c + 0.5) / (clean_rows - c + 0.5))
    counted = (
        sample.select("y", F.explode(bytes_udf(batch, "array<string>")("text")).alias("term"))
        .groupBy("term")
        .agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("n"))
        .where(t >= LEAST_ROWS)
        .withColumn("z", F.round(odds / F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)), 9))
    )
    best = counted.where(F.col("z") > LEAST_Z).select("z", "term").collect()  # of at most ``SAMPLE_ROWS`` texts
    return [r.term for r in sorted(best, key=lambda r: (-r.z, r.term.encode()))]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label_col: str = "toxic") -> ToxicityChain:
    """Fit the chain on at most ``rows`` labelled documents.

    Without labelled rows, or with one class only, no feature is chosen and the
    probabilities are the sample's rates.
    """
    sample = labelled_sample(docs, labels, label_col, rows)
    index = {term: i for i, term in enumerate(_choose(sample))}

    def batch(texts: list[bytes]) -> pa.Array:
        places = Places(index)
        found = [features_of(t, places) for t in texts]
        return struct_array([("at", pa.list_(pa.int32()), [a for a, _ in found]), ("value", pa.list_(pa.float64()), [v for _, v in found])])

    measured = bytes_udf(batch, "struct<at:array<int>,value:array<double>>")
    got = sample.select("id", "lang", "y", measured("text").alias("m")).orderBy(F.xxhash64("id"), "id").collect()  # at most ``rows``
    discard(sample)
    x = SparseRows.of([(np.array(r.m["at"], np.int64), np.array(r.m["value"], np.float64)) for r in got], len(index))
    y = np.array([r.y for r in got])
    langs = np.array([r.lang or "" for r in got], dtype=object)
    bad = x.where(y > 0) if len(got) else x
    dense = np.zeros((len(bad), len(index)))
    dense[bad.row, bad.at] = bad.value
    return ToxicityChain(index, fit_chain(x, np.column_stack([kinds(dense, y > 0, langs), y])))


_PLACES: dict[str, Places] = {}


def _places_of(chain: ToxicityChain) -> Places:
    """A worker's memo of words for the chain it works with; it outlives a batch."""
    if chain.key not in _PLACES:
        _PLACES.clear()
        _PLACES[chain.key] = Places(chain.index)
    return _PLACES[chain.key]


def add_toxicity(docs: DataFrame, chain: ToxicityChain, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with a struct of each category's probability; null and empty texts have no features."""
    kind = "struct<" + ",".join(f"{c}:double" for c in CATEGORIES) + ">"
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def batch(texts: list[bytes]) -> pa.Array:
        model, places = shared.value, _places_of(shared.value)
        p = model.probabilities(SparseRows.of([features_of(t, places) for t in texts], places.size))
        return pa.StructArray.from_arrays([pa.array(p[:, i]) for i in range(len(CATEGORIES))], names=list(CATEGORIES))

    return docs.withColumn(out_col, bytes_udf(batch, kind)(F.col(text_col)))


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents whose probability of toxicity is at most one half, columns unchanged; without labels all."""
    name = fresh_name(docs, "toxicity")
    scored = add_toxicity(docs, fit(docs, labels, rows), out_col=name)
    return scored.where(F.col(name)["toxic"] <= TOXIC_ABOVE).drop(name)

