"""Validation: rules give rows (rule, key, detail) for what breaks them.

A rule with null inputs counts as broken, unless its docstring says otherwise:
edges fail closed.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.texts import fresh_name
from tessella.operators.ranges import running

# Patterns of identifiers, hashes, dates; bytes that files begin with.
IDENTIFIER = "^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
SHA256 = "^[0-9a-f]{64}$"
DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
CONTROLS = r"[\p{Cc}\p{Cf}]"
MAGIC = (
    ("image/png", 1, "89504E470D0A1A0A"),
    ("image/jpeg", 1, "FFD8FF"),
    ("image/webp", 9, "57454250"),
    ("video/mp4", 5, "66747970"),
    ("application/zip", 1, "504B0304"),
    ("application/pdf", 1, "25504446"),
)


def violations(rows: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) for each row and rule that isn't true."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    return rows.select(key.alias("key"), F.explode(broken).alias("rule"))


def duplicate_keys(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(rule, value, n): values that occur more than once, for several keys in one pass; nulls don't count."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), c.cast("string").alias("value")) for name, c in keys.items()]))
    counted = rows.select(pairs.alias("p")).select("p.*").where("value is not null").groupBy("rule", "value")
    return counted.agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(children: DataFrame, child_key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Children whose parent doesn't exist; null references are orphans."""
    name = fresh_name(children, "parent")
    known = parents.select(F.col(parent_key).alias(name))
    return children.join(known, children[child_key] == known[name], "left_anti")


def joined_digest(chunks: DataFrame, key: str, position: str, text: str) -> DataFrame:
    """(key, n, chars, digest): the SHA-256 of each key's chunks joined in order.

    Keys are dealt to tasks, and a task streams over sorted chunks with one
    digest at a time, so a text is never put together, however long. Null chunks
    are empty; equal positions go by text; null keys are a key of their own.
    """
    rows = chunks.select(F.col(key).alias("k"), F.col(position).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    dealt = rows.repartition("k").sortWithinPartitions("k", "p", "t").select("k", "t")
    kind = dict(dealt.dtypes)["k"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, chars, digest, schema = object(), 0, 0, None, None
        done: list[tuple] = []
        for batch in batches:
            schema = batch.schema
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest is None or k != at:
                    if digest is not None:
                        done.append((at, n, chars, digest.hexdigest()))
                    at, n, chars, digest = k, 0, 0, hashlib.sha256()
                n, chars = n + 1, chars + len(t)
                digest.update(t.encode())
            if done:
                yield out(done, schema)
                done = []
        if digest is not None:
            yield out([(at, n, chars, digest.hexdigest())], schema)

    def out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        kinds = (schema.types[0], pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["k", "n", "chars", "digest"])

    return dealt.mapInArrow(fold, f"k {kind}, n bigint, chars bigint, digest string").withColumnRenamed("k", key)


def position_gaps(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Rows whose position isn't the number of rows before them: positions run from 0 without gaps."""
    found = running(rows, [key], [position], number="expected").withColumn("expected", F.col("expected") - 1)
    return found.where(~F.col(position).eqNullSafe(F.col("expected")))


# The status that records of each kind must have.
STATUS_OF_KIND = {"REFERENCE": "AUTHENTIC", "COUNTERFEIT": "COUNTERFEIT"}


def object_violations(objects: DataFrame, views: DataFrame, key: str, content: Column, countable: list[str], least: int) -> DataFrame:
    """(key, rule) for what is wrong with an object's record.

    ``objects``: key, kind, status, profile, record_sha256. ``views``: key, angle. The
    status must be that of the kind; a counterfeit has a profile and a reference has
    none; there are at least ``least`` views, and as many distinct countable angles;
    the digest is one, and that of ``content``. Objects without views have none.
    """
    seen = views.groupBy(F.col(key).alias("of")).agg(
        F.count(F.lit(1)).alias("n_views"), F.count_distinct(F.when(F.col("angle").isin(countable), F.col("angle"))).alias("n_angles")
    )
    held = objects.join(seen, objects[key] == seen["of"], "left").fillna(0, ["n_views", "n_angles"])
    kinds = F.create_map(*[F.lit(x) for pair in STATUS_OF_KIND.items() for x in pair])
    digest = F.col("record_sha256").rlike(SHA256)
    rules = {
        "kind": F.col("kind").isin(*STATUS_OF_KIND), "authenticity_status": F.col("status") == F.try_element_at(kinds, F.col("kind")),
        "counterfeit_profile": F.col("profile").isNotNull() == (F.col("kind") == "COUNTERFEIT"), "images": F.col("n_views") >= least, "angles": F.col("n_angles") >= least,
        "record_sha256": digest, "record_digest": ~F.coalesce(digest, F.lit(False)) | (F.col("record_sha256") == F.sha2(content, 256)),
    }
    return violations(held, F.col(key), rules).withColumnRenamed("key", key)


def required_angles(views: DataFrame, key: str, angle: str, countable: list[str], least: int) -> DataFrame:
    """Objects with fewer than ``least`` views or distinct countable angles."""
    angles = F.count_distinct(F.when(F.col(angle).isin(countable), F.col(angle)))
    out = views.groupBy(key).agg(F.count(F.lit(1)).alias("n_views"), angles.alias("n_angles"))
    return out.where((F.col("n_views") < least) | (F.col("n_angles") < least))


def detected_type(content: Column) -> Column:
    """Media type by the first bytes; null if unknown."""
    starts = [F.when(F.hex(F.substring(content, at, len(mark) // 2)) == mark, kind) for kind, at, mark in MAGIC]
    return F.coalesce(*starts)


def review_rules(reviewed: Column, issued: Column, uses: Column, required: str, opposite: str, disputed: Column) -> dict[str, Column]:
    """A review counts if made in time, for the required use alone, and undisputed."""
    return {
        "reviewed_in_time": reviewed <= issued,
        "required_use": F.array_contains(uses, required),
        "no_opposite_use": ~F.array_contains(uses, opposite),
        "undisputed": ~disputed,
    }


def within(at: Column, start: Column, end: Column) -> Column:
    """Whether a moment lies in an interval, both ends included."""
    return at.between(start, end)


def run_lengths(runs: DataFrame, key: str, n: str, delta: str, timescale: float) -> DataFrame:
    """Samples, duration and rate of a table of run lengths; rate 0 for no duration."""
    out = runs.groupBy(key).agg(F.sum(n).cast("bigint").alias("samples"), F.sum(F.col(n) * F.col(delta)).cast("bigint").alias("ticks"))
    seconds = F.col("ticks") / timescale
    return out.select(key, "samples", seconds.alias("seconds"), F.when(seconds > 0, F.col("samples") / seconds).otherwise(0.0).alias("rate"))


def agree(a: Column, b: Column, absolute: float, share: float) -> Column:
    """Whether two durations agree within the larger of a fixed and a relative tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.greatest(a, b) * share)


def fenced_json(text: Column) -> Column:
    """The JSON object in a model's answer: inside a fence if there is one, else from brace to brace; null if none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    found = F.when(fenced != "", fenced).otherwise(bare)
    return F.when(found != "", found)
