"""Models as row functions: embedders with a fallback, and calls that are checked before they count.

A model is a plain function that is passed in; it runs in the Python workers on
small batches. Nothing here opens a connection.
"""

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.texts import first_reason
from tessella.functions.vectors import norm
from tessella.operators.search import hashed_vector

#: Rows that a model gets at a time, at most.
MOST_ROWS = 8
#: How far the length of a unit vector may be from one.
NEAR_ONE = 0.005

Embed = Callable[[list[str]], list]


def hashed(texts: list[str]) -> list:
    """The embedder that needs no model: signed feature hashing."""
    return [hashed_vector(t) for t in texts]


def embed_texts(df: DataFrame, embed: Embed | None = None, text_col: str = "text", name: str = "model", networked: bool = False, offline: bool = True) -> DataFrame:
    """``df`` with a struct embedding: vector, provider, degraded_reason.

    ``embed`` gives a vector for each text, or None for one it can't do. Without
    it, and for every text where it would use a network while ``offline``, where a
    batch raises, or where it gives None, the hashed embedding stands in, and the
    reason says why: OFFLINE_POLICY, PROVIDER_FAILED or NO_VECTOR. Null texts are
    empty.
    """
    blocked = embed is not None and networked and offline

    def rows_of(texts: list[str]) -> list[dict]:
        found, reason = [None] * len(texts), None
        if embed is None or blocked:
            reason = "OFFLINE_POLICY" if blocked else None
        else:
            try:
                found, reason = list(embed(texts)), "NO_VECTOR"
            except Exception:  # whatever a model raises, the text still gets a vector
                found, reason = [None] * len(texts), "PROVIDER_FAILED"
        out = []
        for text, vector in zip(texts, found):
            own = vector is not None
            out.append({"vector": np.asarray(vector if own else hashed_vector(text), float).tolist(), "provider": name if own else "hashed", "degraded_reason": None if own else reason})
        return out

    kind = pa.struct([("vector", pa.list_(pa.float64())), ("provider", pa.string()), ("degraded_reason", pa.string())])

    def run(column: pa.Array) -> pa.Array:
        texts = [t or "" for t in column.to_pylist()]
        return pa.array([r for at in range(0, len(texts), MOST_ROWS) for r in rows_of(texts[at : at + MOST_ROWS])], kind)

    return df.withColumn("embedding", F.arrow_udf(run, "struct<vector:array<double>,provider:string,degraded_reason:string>").asNondeterministic()(text_col))


def unit_problem(vector: Column, dimension: int) -> Column:
    """Why a model's vector doesn't count; null for a sound one of unit length."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return first_reason(
        (vector.isNull(), "MISSING"),
        (F.size(vector) != dimension, "WRONG_DIMENSION"),
        (bad, "NOT_FINITE"),
        (~norm(vector).between(1 - NEAR_ONE, 1 + NEAR_ONE), "NOT_UNIT_LENGTH"),
    )


def call_model(df: DataFrame, call: Callable[[list[dict]], list[dict | None]], columns: list[str], schema: str, key: str) -> DataFrame:
    """(key, result, problem): what a model says of each row.

    ``call`` gets at most ``MOST_ROWS`` rows as dictionaries of ``columns`` and
    gives as many results of ``schema``, a struct, or None. A batch that raises or
    gives another number of results has the problem CALL_FAILED in every row, a
    None NO_RESULT; their result is null.
    """
    out = pa.schema([("key", pa.string()), ("result", pa.string()), ("problem", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), batch.drop_columns(["key"]).to_pylist()
            results = []
            for at in range(0, len(rows), MOST_ROWS):
                some = rows[at : at + MOST_ROWS]
                try:
                    given = list(call(some))
                    failed = len(given) != len(some)
                except Exception:  # a failed call is a result like any other
                    given, failed = [], True
                results += [(None, "CALL_FAILED")] * len(some) if failed else [(json.dumps(g), None) if g is not None else (None, "NO_RESULT") for g in given]
            yield pa.RecordBatch.from_pydict({"key": keys, "result": [r for r, _ in results], "problem": [p for _, p in results]}, out)

    kind = dict(df.dtypes)[key]
    called = df.select(F.col(key).cast("string").alias("key"), *columns).mapInArrow(run, "key string, result string, problem string")
    return called.select(F.col("key").cast(kind).alias(key), F.from_json("result", schema).alias("result"), "problem")
