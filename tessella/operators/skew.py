"""Joins with a lookup table, whatever share of the rows one key holds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, count_col: str, total: int, exploded: bool = False) -> DataFrame:
    """Inner join of ``rows`` with ``lookup`` on ``key``, without ``count_col``.

    ``lookup`` has each key once, with the number of rows that have it, of
    ``total`` in all. Keys with more than their share, ``total`` divided by the
    number of shuffle partitions, are fewer than the partitions, so their part of
    the lookup is broadcast, a table of bounded size; all other rows are joined
    by a shuffle. Null keys join nothing. ``lookup`` is read three times: pass a
    table that is written. ``exploded`` rows are many more than the table they
    are made of, which is all that the planner knows of their size; they are
    merged, never broadcast.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = F.col(count_col) * F.lit(partitions) > F.lit(total)
    few = F.broadcast(lookup.where(heavy).drop(count_col))
    rest = rows.join(F.broadcast(lookup.where(heavy).select(key)), key, "left_anti")
    light = lookup.where(~heavy).drop(count_col)
    return rows.join(few, key).unionByName(rest.join(light.hint("merge") if exploded else light, key))
