"""Hybrid search: policy filter, then lexical, embedded, structured and visual scores.

Document frequencies are those of the eligible documents only, so the policy
filter stands before the statistics by meaning, not for speed.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.texts import (
    EMBEDDING_SIZE,
    HAN_RUN,
    LATIN_TOKEN,
    SCOPE_PARTS,
    active_on,
    first_reason,
    fresh_name,
    normal_text,
    scope_compatible,
    tokens,
    wanted_values,
)
from tessella.functions.vectors import l2_similarity, total
from tessella.sources.shared import materialise

# Weights of the modalities and of the two text scores.
MODALITIES = {"text": 0.45, "structured": 0.25, "visual": 0.30}
LEXICAL, EMBEDDED = 0.65, 0.35
IN_SCOPE, IN_TEXT = 1.0, 0.7
#: Tokens whose slot a worker remembers, and texts that it holds as strings at a time.
REMEMBERED = 50_000
AT_A_TIME = 64

_TOKEN = re.compile(f"(?P<latin>{LATIN_TOKEN})|{HAN_RUN}")


def python_tokens(text: str) -> list[str]:
    """The same tokens as ``functions.texts.tokens``, in order of the runs that they are cut from."""
    return [
        run[at : at + width]
        for match in _TOKEN.finditer(text.lower())
        for run in (match[0],)
        for width in ((len(run),) if match["latin"] else (1, 2))
        for at in range(len(run) - width + 1)
    ]


class _Slots(dict):
    """token -> its slot, or slot + EMBEDDING_SIZE for a minus sign."""

    def __missing__(self, token: str) -> int:
        digest = hashlib.sha256(token.encode()).digest()
        if len(self) >= REMEMBERED:
            self.clear()
        slot = int.from_bytes(digest[:4], "big") % EMBEDDING_SIZE
        self[token] = slot if digest[4] & 1 else slot + EMBEDDING_SIZE
        return self[token]


_SLOTS = _Slots()


def _vector_of(found: list[str]) -> np.ndarray:
    counts = np.bincount([_SLOTS[t] for t in found], minlength=2 * EMBEDDING_SIZE).astype(float)
    v = counts[:EMBEDDING_SIZE] - counts[EMBEDDING_SIZE:]
    length = np.linalg.norm(v)
    return v / length if length else v


def hashed_vector(text: str) -> np.ndarray:
    """Signed feature hashing of a text's tokens, scaled to length one; zero without tokens."""
    return _vector_of(python_tokens(text))


def embed(text: Column) -> Column:
    """Hashed embedding of each text; a narrow map, where SQL would shuffle every token.

    Beside a batch, a worker holds the vectors of its texts and few texts at a time.
    """

    def run(column: pa.Array) -> pa.Array:
        flat = np.empty((len(column), EMBEDDING_SIZE))
        for at in range(0, len(column), AT_A_TIME):
            for i, t in enumerate(column.slice(at, AT_A_TIME).to_pylist(), at):
                flat[i] = hashed_vector(t or "")
        ends = np.arange(len(column) + 1, dtype=np.int32) * EMBEDDING_SIZE
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.reshape(-1)))

    return F.arrow_udf(run, "array<double>")(text)


def policy_reason(space: str, access_scope: str, purpose: str, allowlist: list[str], day: str, attributes: dict) -> Column:
    """Why an entry is excluded, the first reason in order; null if it is eligible.

    Columns: space, access_scopes, purposes, license, valid_from, valid_until,
    scope (a map of lists). An empty allowlist admits every licence.
    """
    licensed = F.col("license").isin(*allowlist) if allowlist else F.lit(True)
    no = lambda ok: ~F.coalesce(ok, F.lit(False))
    return first_reason(
        (no(F.col("space") == space), "KNOWLEDGE_SPACE_MISMATCH"),
        (no(F.array_contains("access_scopes", access_scope)), "ACCESS_SCOPE_MISMATCH"),
        (no(F.array_contains("purposes", purpose)), "PURPOSE_NOT_LICENSED"),
        (no(licensed), "LICENSE_NOT_ALLOWLISTED"),
        (~active_on(F.col("valid_from"), F.col("valid_until"), F.lit(day).cast("date")), "LICENSE_NOT_ACTIVE"),
        (~scope_compatible(attributes, F.col("scope")), "APPLICABILITY_SCOPE_MISMATCH"),
    )


def inverse_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, df, idf) over the rows given: ln((n + 1) / (df + 1)) + 1."""
    n = docs.count()
    each = docs.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("token"))
    df = each.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1)


def _measured(docs: DataFrame, wanted: list[str], asked: np.ndarray, text: Column, out_col: str) -> DataFrame:
    """``docs`` with a struct: how often each wanted token stands in the text, and
    the cosine of the text's embedding with ``asked``, kept within 0 and 1. Each
    text is split into tokens once."""
    place = {t: i for i, t in enumerate(wanted)}

    def run(column: pa.Array) -> pa.Array:
        held, cosine = [], []
        for value in column.to_pylist():
            found = python_tokens(value or "")
            counts = [0] * len(place)
            for t in found:
                at = place.get(t)
                if at is not None:
                    counts[at] += 1
            held.append(counts)
            cosine.append(min(1.0, max(0.0, float(_vector_of(found) @ asked))))
        return pa.StructArray.from_arrays([pa.array(held, pa.list_(pa.int32())), pa.array(cosine, pa.float64())], names=["held", "cosine"])

    udf = F.arrow_udf(run, "struct<held:array<int>,cosine:double>").asNondeterministic()  # evaluated once a row
    return docs.withColumn(out_col, udf(text))


def _lexical(measured: DataFrame, wanted: dict[str, int], m: str) -> Column:
    """The share of the query's weight that a text covers.

    A query token weighs its count times its inverse frequency in ``measured``; a
    text covers it as often as it holds it, up to that count.
    """
    if not wanted:
        return F.lit(0.0)
    held = [F.col(m)["held"][i] for i in range(len(wanted))]
    n, *dfs = measured.agg(F.count(F.lit(1)), *[F.count_if(h > 0) for h in held]).first()
    idf = [float(np.log((max(n, 1) + 1) / (d + 1)) + 1) for d in dfs]
    weight = sum(c * i for c, i in zip(wanted.values(), idf))
    return sum((F.least(h, F.lit(c)) * F.lit(i) for h, c, i in zip(held, wanted.values(), idf)), F.lit(0.0)) / weight


def _wanted(query: str) -> dict[str, int]:
    wanted: dict[str, int] = {}
    for token in python_tokens(query):
        wanted[token] = wanted.get(token, 0) + 1
    return wanted


def lexical_scores(docs: DataFrame, query: str, text_col: str = "text", out_col: str = "lexical") -> DataFrame:
    """``docs`` with the share of the query's weight that each text covers.

    Only the query's tokens are counted: each text is read once, and the counts
    are written with the columns of ``docs``. Null texts hold nothing. An input
    column named ``out_col`` is replaced.
    """
    m, wanted = fresh_name(docs, "measured"), _wanted(query)
    measured = materialise(_measured(docs, list(wanted), hashed_vector(query), F.col(text_col), m), "measured")
    return measured.withColumn(out_col, _lexical(measured, wanted, m)).drop(m)


def structured_score(attributes: dict, scope: Column, text: Column) -> Column:
    """Mean over all values of the attributes: 1 in any part of the scope, 0.7 in the normal ``text``, else 0."""
    values = F.flatten(F.array(F.array().cast("array<string>"), *map(wanted_values, attributes.values())))
    parts = F.array(*[F.coalesce(scope[p], F.array().cast("array<string>")) for p in SCOPE_PARTS])
    known = F.transform(F.flatten(parts), normal_text)
    scores = F.transform(values, lambda v: F.when(F.array_contains(known, v), IN_SCOPE).when(F.contains(text, v), IN_TEXT).otherwise(0.0))
    return F.coalesce(total(scores) / F.nullif(F.size(values), F.lit(0)), F.lit(0.0))


def scored_entries(entries: DataFrame, query: str, attributes: dict, visual: list[float] | None) -> DataFrame:
    """Eligible ``entries`` (doc_id, title, text, scope, features) with their component scores and the fused score.

    Returns doc_id, lexical, embedded, text_score, structured, visual, score and
    matched_on, the modalities of the query with a positive score. Weights are
    shared out over the modalities that the query has. Titles are read before
    texts. Scores are rounded, the fused one to eight places.
    """
    present = {"text": bool(query), "structured": bool(attributes), "visual": visual is not None}
    if not any(present.values()):
        raise ValueError("a query needs text, attributes or a visual vector")
    whole = sum(MODALITIES[m] for m, on in present.items() if on)
    weights = {m: round(MODALITIES[m] / whole, 8) for m, on in present.items() if on}
    wanted = _wanted(query)
    titled = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    searched = normal_text(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("title", F.lit(""))))
    seen = l2_similarity(F.array(*[F.lit(float(v)) for v in visual]), F.col("features")) if visual is not None else F.lit(0.0)
    narrow = _measured(entries, list(wanted), hashed_vector(query), titled, "m").select(
        "doc_id", "m", F.round(structured_score(attributes, F.col("scope"), searched), 6).alias("structured"), F.round(seen, 6).alias("visual")
    )
    narrow = materialise(narrow, "measured")
    scored = narrow.withColumn("lexical", _lexical(narrow, wanted, "m")).withColumn("cosine", F.col("m.cosine"))
    scored = scored.withColumn("text_score", F.round(LEXICAL * F.col("lexical") + EMBEDDED * F.col("cosine"), 6))
    names = {"text": "text_score", "structured": "structured", "visual": "visual"}
    fused = sum((F.lit(w) * F.col(names[m]) for m, w in weights.items()), F.lit(0.0))
    matched = F.array_compact(F.array(*[F.when(F.col(names[m]) > 0, m) for m in weights]))
    return scored.select(
        "doc_id", F.round("lexical", 6).alias("lexical"), F.round("cosine", 6).alias("embedded"), "text_score", "structured", "visual",
        F.round(fused, 8).alias("score"), matched.alias("matched_on"),
    )


def best_entries(scored: DataFrame, minimum: float, limit: int) -> DataFrame:
    """``scored`` rows from ``minimum`` up, best first, at most ``limit``, with their rank; equal scores go by doc_id."""
    best = scored.where(F.col("score") >= minimum).orderBy(F.desc("score"), "doc_id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def below_minimum(scored: DataFrame, minimum: float, limit: int) -> DataFrame:
    """(doc_id, reason) of the entries that are refused for their score.

    The ranking is read until ``limit`` entries are kept, so there are refused
    ones only where fewer pass.
    """
    passing = scored.where(F.col("score") >= minimum).limit(limit).count()
    refused = scored.where(F.col("score") < minimum).select("doc_id", F.lit("BELOW_MINIMUM_SCORE").alias("reason"))
    return refused if passing < limit else refused.limit(0)


def citations(results: DataFrame, entries: DataFrame, version: str) -> DataFrame:
    """The citation of each result: doc_id, chunk_id, version, space and the digests of text and chunk."""
    cited = entries.select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("#0")).alias("chunk_id"), F.lit(version).alias("version"), "space",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha256"),
    )
    return cited.join(F.broadcast(results.select("doc_id")), "doc_id", "left_semi")  # results: at most the query's limit


def check_citations(stated: DataFrame, whitelist: DataFrame) -> DataFrame:
    """``stated`` citations with ``accepted``: whether the whole record, null equal to null, is in ``whitelist``."""
    columns = whitelist.columns
    known = whitelist.distinct().select(*[F.col(c).alias(f"known_{i}") for i, c in enumerate(columns)], F.lit(True).alias("known"))
    same = [stated[c].eqNullSafe(known[f"known_{i}"]) for i, c in enumerate(columns)]
    joined = stated.join(known, same, "left")
    return joined.select(*[stated[c] for c in stated.columns], F.coalesce("known", F.lit(False)).alias("accepted"))
