"""Evaluation of labelled retrieval runs and the constrained search for thresholds."""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.texts import fresh_name

# How many candidates of each threshold, their bounds and anchors.
GRID = {
    "score": (24, -1.0, 1.0, (-1.0, 0.62, 0.86, 1.0)),
    "margin": (16, 0.0, 2.0, (0.0, 0.05, 2.0)),
    "coverage": (12, 0.0, 1.0, (0.0, 0.20, 0.60, 1.0)),
    "quality": (12, 0.0, 1.0, (0.0, 0.30, 0.55, 1.0)),
}
STEP = 0.000001


def _rate(condition: Column, among: Column) -> Column:
    """Share of the rows ``among`` that meet ``condition``; null if there are none."""
    return F.avg(F.when(among, condition.cast("double")))


def metrics(runs: DataFrame) -> DataFrame:
    """Top-1, top-5, false accepts and rejects of runs.

    ``runs``: expected (null: open set), top1, top5 (array), accepted.
    """
    known = F.col("expected").isNotNull()
    right = F.coalesce(F.col("top1") == F.col("expected"), F.lit(False))
    return runs.agg(
        _rate(right, known).alias("top1"),
        _rate(F.coalesce(F.array_contains("top5", F.col("expected")), F.lit(False)), known).alias("top5"),
        _rate(F.col("accepted"), ~known).alias("far"),
        _rate(~(F.col("accepted") & right), known).alias("frr"),
        _rate(~F.col("accepted"), ~known).alias("open_set_rejection"),
    )


def outcome(expected: Column, top1: Column, accepted: Column) -> Column:
    """One of five outcomes of a run."""
    return (
        F.when(expected.isNull() & accepted, "FALSE_ACCEPT")
        .when(expected.isNull(), "CORRECT_REJECT")
        .when(accepted & (top1 == expected), "CORRECT_ACCEPT")
        .when(accepted, "WRONG_IDENTITY")
        .otherwise("FALSE_REJECT")
    )


def candidates(runs: DataFrame, name: str) -> DataFrame:
    """(name): candidate thresholds, at most the grid's number.

    Every value, rounded to six places, the next step above it, and the anchors;
    if there are more, evenly spaced ones. Values lie within fixed bounds on a
    grid of millionths, so however many runs there are, they are few million.
    """
    limit, low, high, anchors = GRID[name]
    clipped = F.least(F.lit(high), F.greatest(F.lit(low), F.col(name)))
    above = F.when(clipped < high, F.round(F.least(F.lit(high), clipped + STEP), 6))
    every = runs.select(F.explode(F.array(F.round(clipped, 6), above)).alias(name)).where(F.col(name).isNotNull())
    anchor = runs.sparkSession.createDataFrame([(round(a, 6),) for a in anchors], f"{name} double")
    placed = every.union(anchor).distinct().withColumn("i", F.row_number().over(Window.orderBy(name)) - 1)
    n = placed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    # Position k of ``limit`` evenly spaced ones is floor(k * (n - 1) / (limit - 1)).
    k = F.ceil(F.col("i") * (limit - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    chosen = (F.col("n") <= limit) | (F.floor(k * (F.col("n") - 1) / (limit - 1)) == F.col("i"))
    return n.where(chosen).select(name)


def _best_cell(counts: np.ndarray, axes: list[list[float]], open_runs: int, target_far: float) -> tuple:
    """The best cell of a grid of counts (correct, false, wrong along the last axis), each run in the highest cell it meets."""
    totals = counts
    for axis in range(len(axes)):
        totals = np.flip(np.flip(totals, axis).cumsum(axis=axis), axis)
    correct, false, wrong = (totals[..., i].ravel() for i in range(3))
    far = false / max(open_runs, 1)
    feasible = far <= target_far + 1e-12
    values = [v.ravel() for v in np.meshgrid(*[np.array(a) for a in axes], indexing="ij")]
    first, second = np.where(feasible, correct, -false), np.where(feasible, -false, correct)
    at = np.lexsort((*reversed(values), second, first, feasible))[-1]
    return (*(float(v[at]) for v in values), int(correct[at]), int(false[at]), int(wrong[at]), float(far[at]), bool(feasible[at]), len(far))


def threshold_grid(runs: DataFrame, target_far: float) -> DataFrame:
    """The thresholds that accept most correct runs with at most ``target_far`` false accepts.

    ``runs``: score, margin, coverage, quality, expected, correct, eligible.
    Ties go to fewer false accepts, then to higher thresholds in the order named;
    if no cell keeps the rate, to the fewest false accepts. Each run is put into
    the highest cell whose thresholds it meets and cells are counted. The counts,
    at most 24 x 16 x 12 x 12 whatever the runs, go to one task, where sums from
    the far ends along the four axes turn them into accepted runs.
    """
    names = list(GRID)
    listed = reduce(DataFrame.union, [candidates(runs, n).select(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])
    opened = runs.agg(F.lit("").alias("name"), F.count_if(F.col("expected").isNull()).cast("double").alias("value"))
    known: dict[str, list[float]] = {}
    for row in listed.union(opened).collect():  # at most 64 values, and one count
        known.setdefault(row["name"], []).append(row["value"])
    open_runs, axes = int(known[""][0]), [sorted(known[n]) for n in names]
    place = lambda n, axis: sum(((F.col(n) >= v).cast("int") for v in axis), F.lit(0)) - 1
    placed = runs.where("eligible").select("expected", "correct", *[place(n, axis).alias(f"at_{n}") for n, axis in zip(names, axes)])
    at = [f"at_{n}" for n in names]
    placed = placed.where(F.least(*at) >= 0)
    labelled = F.col("expected").isNotNull()
    counts = placed.groupBy(*at).agg(
        F.count_if(labelled & F.col("correct")).alias("correct"), F.count_if(~labelled).alias("false"), F.count_if(labelled & ~F.col("correct")).alias("wrong")
    )

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = np.zeros((*map(len, axes), 3), np.int64)
        for batch in batches:
            columns = [np.asarray(c) for c in batch.columns]
            grid[tuple(columns[: len(at)])] += np.stack(columns[len(at) :], axis=-1)
        values = _best_cell(grid, axes, open_runs, target_far)
        kinds = (*[pa.float64()] * len(names), *[pa.int64()] * 3, pa.float64(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[*names, "correct", "false", "wrong", "far", "feasible", "cells"])

    schema = ", ".join([*(f"{n} double" for n in names), "correct bigint, false bigint, wrong bigint, far double, feasible boolean, cells bigint"])
    return counts.repartition(1).mapInArrow(best, schema)


def latency_quantiles(samples: DataFrame, value: str, *keys: str) -> DataFrame:
    """min, median, p95 (nearest rank: half-even round of 0.95 n + 0.5) and max.

    Equal values are counted before the shuffle, and ranks run over the counts.
    Null values don't count.
    """
    v, n, upto, whole, at = (fresh_name(samples, c) for c in ("value", "n", "upto", "whole", "at"))
    counted = samples.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias(v)).agg(F.count(F.lit(1)).alias(n))
    order = Window.partitionBy(*keys).orderBy(v)
    ranked = counted.withColumns({upto: F.sum(n).over(order), whole: F.sum(n).over(Window.partitionBy(*keys))})
    ranked = ranked.withColumn(at, F.least(F.col(whole), F.greatest(F.lit(1), F.bround(0.95 * F.col(whole) + 0.5, 0).cast("bigint"))))
    holds = lambda rank: (F.col(upto) >= rank) & (F.col(upto) - F.col(n) < rank)
    lower, upper = F.floor((F.col(whole) + 1) / 2), F.floor(F.col(whole) / 2) + 1
    pick = lambda rank: F.max(F.when(holds(rank), F.col(v)))
    return ranked.groupBy(*keys).agg(
        F.min(v).alias("min"), ((pick(lower) + pick(upper)) / 2).alias("median"), pick(F.col(at)).alias("p95"), F.max(v).alias("max")
    )
