"""SHA-256 of each key's values joined in order, however many a key has."""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.shared import discard, materialise, owning

#: Values that one piece of a key's list holds.
PIECE = 4096


def joined_sha256(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, sha256): the lower-case digest of each key's values in ascending order, as text with commas between.

    Rows are dealt by range of (key, value); a task turns each run of up to
    ``PIECE`` values of a key into one text, so a key with a large share of all
    rows is joined in many tasks. The pieces, thousands of times fewer, then go
    to their key's task, which streams over them and holds one hash state.
    """
    kind = dict(rows.dtypes)[key]
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(F.col(key).alias("key"), F.col(value).alias("value"), F.col(value).cast("string").alias("text"))
    dealt = dealt.repartitionByRange(partitions, "key", "value").sortWithinPartitions("key", "value").select("key", "value", "text")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, held = None, None, []

        def piece():
            return pa.record_batch({"key": pa.array([at], names_type), "value": pa.array([first], value_type), "text": [",".join(held)]})

        for batch in batches:
            names_type, value_type = batch.schema.field(0).type, batch.schema.field(1).type
            for k, v, t in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (k != at or len(held) == PIECE):
                    yield piece()
                    held = []
                if not held:
                    at, first = k, v
                held.append(t)
        if held:
            yield piece()

    pieces = materialise(dealt.mapInArrow(join, dealt.schema), "pieces")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            names, values = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if state is None or k != at:
                    if state is not None:
                        names.append(at)
                        values.append(state.hexdigest())
                    at, state = k, hashlib.sha256(t.encode())
                else:
                    state.update(b"," + t.encode())
            kind = batch.schema.field(0).type
            yield pa.record_batch({"key": pa.array(names, kind), "sha256": pa.array(values, pa.string())})
        if state is not None:
            yield pa.record_batch({"key": pa.array([at], kind), "sha256": [state.hexdigest()]})

    ordered = pieces.repartition(partitions, "key").sortWithinPartitions("key", "value").select("key", "value", "text")
    found = materialise(ordered.mapInArrow(digest, f"key {kind}, sha256 string"), "digests")
    discard(pieces)
    return owning(found.withColumnRenamed("key", key), found)
