"""Helpers that several operators share: word bytes, Arrow UDFs, batches."""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns every ASCII byte that is no digit or letter into a
#: space. Bytes from 0x80 up are parts of letters and stay.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, A-Z lower-cased."""
    return text.translate(WORD_TABLE).split()


def utf8_values(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string array; null counts as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def bytes_udf(batch: Callable[[list[bytes]], pa.Array], returns: str) -> Callable[..., Column]:
    """An Arrow UDF over the UTF-8 bytes of one string column.

    It is marked non-deterministic so that Spark evaluates it once a row, even
    where a filter and a projection both use its result. Spark bounds a batch by
    64 MB, so a worker's memory doesn't hang on the length of texts.
    """

    @F.arrow_udf(returns)
    def run(column: pa.Array) -> pa.Array:
        return batch(utf8_values(column))

    return run.asNondeterministic()


def struct_array(fields: list[tuple[str, pa.DataType, list]]) -> pa.StructArray:
    arrays = [pa.array(values, type=kind) for _, kind, values in fields]
    return pa.StructArray.from_arrays(arrays, names=[name for name, _, _ in fields])
