"""Frames of a capture: quality gates, near duplicates, selection, consistency.

Frames are never gathered in one row, so a capture may have any number of them.
"""

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.texts import fresh_name
from tessella.sources.shared import discard, materialise

# Gates, weights and distances.
NEAR_BITS = 4
QUALITY_WEIGHTS = {"checks": 0.65, "sharpness": 0.15, "range": 0.10, "clipping": 0.10}
FULL_SHARPNESS, FULL_RANGE = 120.0, 180.0
LEAST_USABLE, LEAST_SPAN, LEAST_DIVERSITY, LEAST_CHOSEN = 3, 0.55, 0.015, 2
STABLE_HASH, STABLE_FEATURES, COMPARABLE_HASH = 0.08, 0.10, 0.35
LEAST_CONSISTENCY = 0.65
REFERENCE_CHECKS = ("size", "brightness", "clipping", "sharpness", "range")


def server_checks(width: Column, height: Column, brightness: Column, black: Column, white: Column, sharpness: Column, spread: Column) -> dict[str, Column]:
    """The five checks of an uploaded image; black and white clipping each have a bound."""
    return {
        "size": (width >= 256) & (height >= 256),
        "brightness": brightness.between(30, 225),
        "clipping": (black <= 0.25) & (white <= 0.25),
        "sharpness": sharpness >= 8,
        "range": spread >= 35,
    }


def device_checks(width: Column, height: Column, brightness: Column, black: Column, white: Column, laplacian: Column) -> dict[str, Column]:
    """The stricter checks on the capturing device."""
    return {
        "size": (F.greatest(width, height) >= 1200) & (F.least(width, height) >= 900),
        "exposure": brightness.between(45, 215),
        "clipping": (black <= 0.12) & (white <= 0.12),
        "focus": laplacian >= 120,
    }


def instrument_checks(m: Column) -> dict[str, Column]:
    """Nine checks of an instrument's result, a map of numbers; what is missing fails."""
    flag = lambda name: F.coalesce(m[name] != 0, F.lit(False))
    number = lambda name, default: F.coalesce(m[name], F.lit(default))
    return {
        "device_ready": flag("device_ready"),
        "calibration": flag("calibration_valid"),
        "signal_to_noise": number("snr_db", 0.0) >= number("min_snr_db", 18.0),
        "not_saturated": number("saturation_ratio", 1.0) <= 0.02,
        "region_match": flag("region_match_valid"),
        "spatial_registration": flag("spatial_registration_valid"),
        "coverage": number("coverage_ratio", 0.0) >= number("min_coverage_ratio", 0.90),
        "integrity": flag("integrity_valid"),
        "reference_applicability": flag("reference_applicability"),
    }


def failed_checks(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail or have null inputs, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), name) for name, c in checks.items()]))


def frame_quality(passed_share: Column, sharpness: Column, spread: Column, clipped: Column) -> Column:
    """Weighted quality between 0 and 1, to four places; ``clipped`` is the black and the white share together.

    The parts are added as decimals of nine places, so that halves go up whatever
    binary fractions make of them.
    """
    parts = {
        "checks": passed_share,
        "sharpness": F.least(F.lit(1.0), sharpness / FULL_SHARPNESS),
        "range": F.least(F.lit(1.0), spread / FULL_RANGE),
        "clipping": F.greatest(F.lit(0.0), 1 - clipped),
    }
    exact = [(F.lit(QUALITY_WEIGHTS[name]) * part).cast("decimal(20,9)") for name, part in parts.items()]
    return F.round(reduce(Column.__add__, exact), 4).cast("double")


def device_quality(brightness: Column, black: Column, white: Column, sharpness: Column) -> Column:
    """Quality of a picture on the capturing device, from exposure, clipping and detail, between 0 and 1."""
    exposure = 1 - F.least(F.lit(1.0), F.abs(brightness - 130) / 130)
    clipping = 1 - F.least(F.lit(1.0), (black + white) / 0.24)
    detail = F.least(F.lit(1.0), sharpness / 320)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.35 * exposure + 0.25 * clipping + 0.40 * detail))


def reference_quality(checks: Column, failed: Column, passed: Column) -> tuple[Column, Column]:
    """(score, problem) of a stored quality record: the share of passed checks, null where the record contradicts itself.

    ``checks`` is a map of booleans, ``failed`` a list of names. The record must
    have exactly the known checks, none null, name the failed ones once each,
    and state whether all passed.
    """
    known = F.array(*map(F.lit, REFERENCE_CHECKS))
    names = F.array_sort(F.map_keys(checks))
    really = F.filter(known, lambda name: ~checks[name])
    problem = (
        F.when(~F.coalesce(names == F.array_sort(known), F.lit(False)), "CHECKS_DO_NOT_MATCH")
        .when(F.exists(F.map_values(checks), lambda ok: ok.isNull()), "CHECK_NOT_BOOLEAN")
        .when(~F.coalesce(F.array_sort(failed) == F.array_sort(really), F.lit(False)), "FAILED_CHECKS_INCONSISTENT")
        .when(~F.coalesce(passed == (F.size(really) == 0), F.lit(False)), "DECISION_INCONSISTENT")
    )
    score = F.round((len(REFERENCE_CHECKS) - F.size(really)) / float(len(REFERENCE_CHECKS)), 6)
    return F.when(problem.isNull(), score), problem


class KeptHashes:
    """Hashes of 64 bits by bands of their bits: two that differ in at most n bits share one of n + 1 bands."""

    def __init__(self, near_bits: int):
        self.near, n = near_bits, min(near_bits + 1, 64)
        edges = [64 * i // n for i in range(n + 1)] if near_bits < 64 else [0, 0]
        self.bands = [(low, (1 << high - low) - 1, {}) for low, high in zip(edges, edges[1:])]
        self.hashes: list[int] = []

    def add(self, own: int) -> None:
        for shift, mask, lists in self.bands:
            lists.setdefault(own >> shift & mask, []).append(len(self.hashes))
        self.hashes.append(own)

    def nearest(self, own: int) -> tuple[int, int] | None:
        """(distance, place) of the nearest kept hash that is near, the earliest of equally near ones."""
        met = {i for shift, mask, lists in self.bands for i in lists.get(own >> shift & mask, ())}
        best = min((((self.hashes[i] ^ own).bit_count(), i) for i in met), default=None)
        return best if best is not None and best[0] <= self.near else None


def mark_duplicates(frames: DataFrame, key: str, near_bits: int = NEAR_BITS) -> DataFrame:
    """key, frame_id, duplicate_of, distance for each frame.

    Frames go in order of time and id; each is compared with those kept so far
    and is a duplicate of the nearest (the earliest of equally near ones) if at
    most ``near_bits`` bits differ. The outcome hangs on the order, so it is a
    fold and no closure: captures are dealt to tasks, and a task streams over
    sorted frames and holds the kept hashes of one capture by bands of their bits,
    so that a frame meets only kept ones that share a band with it. Null
    keys are a capture of their own; a frame without a hash of 16 hex digits is
    never compared and no duplicate.
    """
    rows = frames.select(F.col(key).alias("k"), "frame_id", "ts", F.when(F.col("dhash").rlike("^[0-9a-fA-F]{16}$"), F.col("dhash")).alias("dhash"))
    dealt = rows.repartition("k").sortWithinPartitions("k", "ts", "frame_id").select("k", "frame_id", "dhash")
    kinds = dict(dealt.dtypes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, kept = object(), [], KeptHashes(near_bits)
        for batch in batches:
            original, distance = [], []
            for k, frame, digits in zip(*[c.to_pylist() for c in batch.columns]):
                if k != at:
                    at, ids, kept = k, [], KeptHashes(near_bits)
                found = kept.nearest(int(digits, 16)) if digits is not None else None
                original.append(ids[found[1]] if found else None)
                distance.append(found[0] if found else None)
                if digits is not None and not found:
                    kept.add(int(digits, 16))
                    ids.append(frame)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(original, pa.int64()), pa.array(distance, pa.int32())], names=["k", "frame_id", "duplicate_of", "distance"]
            )

    found = dealt.mapInArrow(fold, f"k {kinds['k']}, frame_id {kinds['frame_id']}, duplicate_of bigint, distance int")
    return found.withColumnRenamed("k", key)


def usable_frames(frames: DataFrame, key: str) -> DataFrame:
    """``frames`` that passed their gate and are no near duplicates of earlier ones.

    ``frames``: key, frame_id, ts, dhash, passed; a frame_id occurs once in a capture.
    """
    marks = mark_duplicates(frames, key).where("duplicate_of is null")
    k, f = fresh_name(frames, "k"), fresh_name(frames, "f")
    marks = marks.select(F.col(key).alias(k), F.col("frame_id").alias(f))
    return frames.where("passed").join(marks, frames[key].eqNullSafe(F.col(k)) & (frames["frame_id"] == F.col(f)), "left_semi")


def _bits(dhash: Column) -> list[Column]:
    """The 64 bits of a hash of 16 hex digits."""
    digit = [F.conv(F.substring(dhash, i, 1), 16, 10).cast("int") for i in range(1, 17)]
    return [F.shiftright(d, b).bitwiseAND(F.lit(1)) for d in digit for b in range(4)]


def pairwise_distance(frames: DataFrame, key: str) -> DataFrame:
    """Mean share of differing hash bits over a capture's pairs; 0 for fewer than two frames.

    A bit that c of n frames have differs in c (n - c) pairs, so no pairs are made.
    """
    n = F.count("dhash")
    ones = [F.sum(b) for b in _bits(F.col("dhash"))]
    differing = sum((c * (n - c) for c in ones[1:]), ones[0] * (n - ones[0]))
    mean = F.when(n > 1, differing / (n * (n - 1) / 2) / 64.0).otherwise(0.0)
    return frames.groupBy(key).agg(mean.alias("diversity"))


def capture_consistency(frames: DataFrame, key: str, vector: str) -> DataFrame:
    """1 minus three times the mean population deviation over dimensions, kept within 0 and 1; 1 for fewer than two frames."""
    n, d, x, s = (fresh_name(frames, c) for c in ("n_frames", "dimension", "value", "deviation"))
    counted = frames.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    spread = frames.select(key, F.posexplode(vector).alias(d, x)).groupBy(key, d).agg(F.stddev_pop(x).alias(s))
    mean = spread.groupBy(key).agg(F.avg(s).alias(s))
    score = F.when(F.col(n) < 2, 1.0).otherwise(1 - F.least(F.lit(1.0), F.coalesce(s, F.lit(0.0)) * 3))
    return counted.join(mean, key, "left").select(key, score.alias("consistency"))


def representatives(usable: DataFrame, key: str) -> DataFrame:
    """(key, position, frame_id): the first and last usable frames and the one nearest to the middle between them, in order of time.

    ``usable``: key, frame_id, ts, quality. Up to three frames are all chosen. Of
    equally near ones the better quality goes first, then the smaller id.
    """
    first, last, ts, frame, near = (fresh_name(usable, c) for c in ("first", "last", "at", "frame", "near"))
    w = Window.partitionBy(key)
    ends = F.struct(F.col("ts").alias(ts), F.col("frame_id").alias(frame))
    marked = usable.withColumns({first: F.min(ends).over(w), last: F.max(ends).over(w)})
    middle = (F.col(first)[ts] + F.col(last)[ts]) / 2
    inner = (F.col("frame_id") != F.col(first)[frame]) & (F.col("frame_id") != F.col(last)[frame])
    nearest = F.min(F.when(inner, F.struct(F.abs(F.col("ts") - middle).alias("d"), (-F.col("quality")).alias("q"), F.col("frame_id").alias(frame), F.col("ts").alias(ts))))
    out = marked.groupBy(key).agg(F.first(first).alias(first), F.first(last).alias(last), nearest.alias(near))
    chosen = F.array_sort(F.array_distinct(F.array_compact(F.array(F.col(first), F.col(last), F.when(F.col(near).isNotNull(), F.struct(F.col(near)[ts].alias(ts), F.col(near)[frame].alias(frame)))))))
    at, one = fresh_name(usable, "place"), fresh_name(usable, "chosen")
    listed = out.select(key, F.posexplode(chosen).alias(at, one))
    return listed.select(key, (F.col(at) + 1).alias("position"), F.col(one)[frame].alias("frame_id"))


def admission(frames: DataFrame, key: str, duration: Column, features: str = "features") -> DataFrame:
    """Counters of a capture, its span, diversity and consistency, and the checks it fails.

    ``frames``: key, frame_id, ts, dhash, quality, passed, features. A near
    duplicate is suppressed before quality is looked at; diversity and
    consistency are those of the accepted frames, to four places.
    """
    frames = materialise(frames, "frames")
    marked = frames.join(mark_duplicates(frames, key), [key, "frame_id"])
    status = F.when(F.col("duplicate_of").isNotNull(), "DUPLICATE").when(~F.coalesce("passed", F.lit(False)), "REJECTED").otherwise("ACCEPTED")
    marked = materialise(marked.withColumn("status", status), "marked")  # read four times
    discard(frames)
    counts = marked.groupBy(key).agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("ACCEPTED", "REJECTED", "DUPLICATE")],
        F.least(F.lit(1.0), (F.max("ts") - F.min("ts")) / F.greatest(F.max(duration), F.lit(1))).alias("span"),
    )
    usable = marked.where("status = 'ACCEPTED'")
    out = counts.join(pairwise_distance(usable, key), key, "left").join(capture_consistency(usable, key, features), key, "left")
    out = out.fillna({"diversity": 0.0, "consistency": 1.0}).withColumns({c: F.round(c, 4) for c in ("span", "diversity", "consistency")})
    checks = {
        "minimum_usable_frames": F.col("n_accepted") >= LEAST_USABLE,
        "temporal_coverage": F.col("span") >= LEAST_SPAN,
        "viewpoint_diversity": F.col("diversity") >= LEAST_DIVERSITY,
        "representative_frames": F.least("n_accepted", F.lit(3)) >= LEAST_CHOSEN,
    }
    return out.withColumn("failed", failed_checks(checks))


def next_observations(admitted: DataFrame, key: str) -> DataFrame:
    """(key, priority, observation): what to capture next, by what ``admission`` found.

    Pictures of better quality and a turn around the object are advised where a
    check failed, a calibration target where the capture is uneven; the two
    further kinds of observation always stand at the end.
    """
    lacks = lambda *names: F.arrays_overlap("failed", F.array(*map(F.lit, names)))
    advice = (
        (1, "OBS-RGB-QUALITY", lacks("minimum_usable_frames")), (2, "OBS-RGB-ROTATION", lacks("temporal_coverage", "viewpoint_diversity")),
        (3, "OBS-CALIBRATION", F.col("consistency") < LEAST_CONSISTENCY), (4, "OBS-UV-NIR", F.lit(True)), (5, "OBS-MATERIAL-SCIENCE", F.lit(True)),
    )
    listed = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(p).alias("priority"), F.lit(name).alias("observation"))) for p, name, on in advice]))
    one = fresh_name(admitted, "advice")
    return admitted.select(key, F.explode(listed).alias(one)).select(key, f"{one}.*")


def change_status(both_passed: Column, hash_share: Column, feature_distance: Column) -> Column:
    """What two images of one place say about a change."""
    return (
        F.when(~both_passed | (hash_share > COMPARABLE_HASH), "NOT_COMPARABLE")
        .when((hash_share <= STABLE_HASH) & (feature_distance <= STABLE_FEATURES), "STABLE")
        .otherwise("CHANGE_CANDIDATE")
    )


def sample_times(duration: Column, n: int) -> Column:
    """``n`` times spread evenly from 5 % to 95 % of a duration; one: the middle."""
    if n == 1:
        return F.array(duration * 0.5)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: duration * (0.05 + 0.9 * i / (n - 1)))
