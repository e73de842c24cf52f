"""Frame queries: twelve successive vectors are a capture's frames; metrics come from fixed arithmetic."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.vectors import hamming_hex, rms_similarity, total
from tessella.operators import frames as R
from tessella.operators import pixels as P
from tessella.operators.ranges import running
from tessella.plans.common import r6, table
from tessella.sources.shared import materialise

FRAMES = 12
DURATION = 480
# Names of an instrument's numbers, by place; which a result has, and their values, follow from its id.
INSTRUMENT_NUMBERS = (
    "device_ready", "calibration_valid", "snr_db", "min_snr_db", "saturation_ratio", "region_match_valid", "spatial_registration_valid",
    "coverage_ratio", "min_coverage_ratio", "integrity_valid", "reference_applicability",
)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capture, frame_id, ts, dhash (signs of 64 dimensions; every third frame nearly repeats the one before), features, metrics."""
    e = table(spark, sf_dir, "embeddings")
    base = F.col("vec_id") - F.when(F.col("vec_id") % 3 == 2, 1).otherwise(0)
    signs = e.select(F.col("vec_id").alias("base"), F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0)).alias("bits"))
    nibble = lambda i: F.element_at("bits", 4 * i + 1) * 8 + F.element_at("bits", 4 * i + 2) * 4 + F.element_at("bits", 4 * i + 3) * 2 + F.element_at("bits", 4 * i + 4)
    dhash = F.concat(*[F.lower(F.hex(nibble(i))) for i in range(16)])
    n = F.col("vec_id")
    rows = e.withColumn("base", base).join(signs.select("base", dhash.alias("h")), "base")
    last = F.when(n % 3 == 2, F.lower(F.hex(F.conv(F.substring("h", 16, 1), 16, 10).cast("int").bitwiseXOR(F.lit(3))))).otherwise(F.substring("h", 16, 1))
    return rows.select(
        F.floor(n / FRAMES).alias("capture"), n.alias("frame_id"), (n * 40).alias("ts"), F.concat(F.substring("h", 1, 15), last).alias("dhash"),
        F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("features"),
        (200 + n * 13 % 300).alias("width"), (240 + n * 7 % 200).alias("height"), (n * 17 % 256).cast("double").alias("brightness"),
        (n * 5 % 40 / 100.0).alias("black"), (n * 3 % 35 / 100.0).alias("white"), (n * 29 % 150).cast("double").alias("sharpness"), (n * 31 % 200).cast("double").alias("spread"),
    )


def _checks() -> dict:
    return R.server_checks(*map(F.col, ("width", "height", "brightness", "black", "white", "sharpness", "spread")))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = R.failed_checks(_checks())
    share = (5 - F.size(failed)) / 5.0
    quality = R.frame_quality(share, F.col("sharpness"), F.col("spread"), F.col("black") + F.col("white"))
    return frames(spark, sf_dir).withColumns({"quality": quality, "passed": F.size(failed) == 0, "failed": failed})


def frame_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("frame_id", F.array_join("failed", ",").alias("failed"), r6("quality").alias("quality"), "passed")


def device_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = R.device_checks(F.col("width") * 4, F.col("height") * 4, F.col("brightness"), F.col("black"), F.col("white"), F.col("sharpness") * 2)
    return frames(spark, sf_dir).select("frame_id", F.array_join(R.failed_checks(checks), ",").alias("failed"))


def instrument_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as instrument results: number k is missing for one key in seven, flags fail for one in five."""
    p = F.col("p_partkey")
    entries = []
    for k, name in enumerate(INSTRUMENT_NUMBERS):
        value = {"snr_db": p % 30, "min_snr_db": p % 25, "saturation_ratio": (p % 4) / 100.0, "coverage_ratio": (p % 20) / 20.0 + 0.04, "min_coverage_ratio": (p % 10) / 10.0}.get(name, F.when((p + k) % 5 == 0, 0).otherwise(1))
        entries.append(F.when((p + k) % 7 != 0, F.struct(F.lit(name).alias("key"), value.cast("double").alias("value"))))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.map_from_entries(F.array_compact(F.array(*entries))).alias("m"))
    return rows.select("p_partkey", F.array_join(R.failed_checks(R.instrument_checks(F.col("m"))), ",").alias("failed"))


def device_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = R.device_quality(F.col("brightness"), F.col("black"), F.col("white"), F.col("sharpness") * 2)
    return frames(spark, sf_dir).select("frame_id", r6(score).alias("quality"))


def reference_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames' gates as stored records, some made inconsistent by fixed rules."""
    f = F.col("frame_id")
    ok = {name: check for name, check in _checks().items()}
    entries = [F.struct(F.lit(n).alias("k"), F.when((f % 29 == 1) & F.lit(n == "range"), None).otherwise(c).alias("v")) for n, c in ok.items()]
    extra = F.array(F.struct(F.lit("extra").alias("k"), F.lit(True).alias("v")))
    checks = F.map_from_entries(F.when(f % 29 == 2, F.concat(F.array(*entries), extra)).when(f % 29 == 3, F.slice(F.array(*entries), 1, 4)).otherwise(F.array(*entries)))
    scored = _scored(spark, sf_dir).withColumn("checks", checks)
    failed = F.when(f % 29 == 4, F.concat("failed", F.array(F.lit("size")))).when(f % 29 == 5, F.reverse("failed")).otherwise(F.col("failed"))
    passed = F.when(f % 29 == 6, ~F.col("passed")).otherwise(F.col("passed"))
    score, problem = R.reference_quality(F.col("checks"), failed, passed)
    return scored.select("frame_id", r6(score).alias("score"), problem.alias("problem"))


def near_duplicate_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.mark_duplicates(frames(spark, sf_dir), "capture")
    return found.where("duplicate_of is not null").select("capture", "frame_id", "duplicate_of", F.col("distance").cast("bigint").alias("distance"))


def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pairwise_distance(frames(spark, sf_dir), "capture").withColumn("diversity", r6("diversity"))


def capture_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the usable frames of each capture."""
    usable = R.usable_frames(_scored(spark, sf_dir), "capture")
    return R.capture_consistency(usable, "capture", "features").withColumn("consistency", r6("consistency"))


def mean_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element-wise mean over a capture's frames."""
    rows = frames(spark, sf_dir).select("capture", F.posexplode("features").alias("dim", "x"))
    return rows.groupBy("capture", "dim").agg(r6(F.avg("x")).alias("mean"))


def midpoint_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames that stand for each capture."""
    return R.representatives(R.usable_frames(_scored(spark, sf_dir), "capture"), "capture")


def _admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.admission(_scored(spark, sf_dir), "capture", F.lit(DURATION))


def frame_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = [r6(c).alias(c) for c in ("span", "diversity", "consistency")]
    return _admitted(spark, sf_dir).select("capture", "n_accepted", "n_rejected", "n_duplicate", *numbers, F.array_join("failed", ",").alias("failed"))


def next_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.next_observations(_admitted(spark, sf_dir), "capture")


def salient_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two strongest tiles of each vector's picture: 12 x 9 grey pixels that repeat its components, every fifth picture flat."""
    byte = lambda x: F.pmod(F.floor(x.cast("double") * 4096), F.lit(256)).cast("int")
    pixel = lambda i: F.lpad(F.hex(F.when(F.col("vec_id") % 5 == 4, F.lit(77)).otherwise(byte(F.col("embedding")[i % 64]))), 2, "0")
    picture = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(107)), pixel), ""))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", P.measure(picture, F.lit(12), F.lit(9), F.lit(1)).alias("m"))
    tiles = rows.select("vec_id", F.posexplode("m.tiles").alias("rank", "t"))
    return tiles.select("vec_id", (F.col("rank") + 1).alias("rank"), r6("t.score").alias("score"), r6("t.left").alias("left"), r6("t.top").alias("top"))


def demo_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three views of lowest id per object as a small catalog; for each query view the three most similar by RMS distance."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 8).alias("v"))
    order = Window.partitionBy("label").orderBy("vec_id")
    catalog = e.withColumn("k", F.row_number().over(order)).where("k <= 3").select(F.col("vec_id").alias("reference_id"), F.col("v").alias("r"))
    near = e.where("vec_id % 20 = 0").crossJoin(F.broadcast(catalog))  # the query set against a catalog of three views an object
    near = near.select("vec_id", "reference_id", rms_similarity(F.col("v"), F.col("r")).alias("similarity"))
    best = Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "reference_id")
    return near.withColumn("rank", F.row_number().over(best)).where("rank <= 3").select("vec_id", "rank", "reference_id", r6("similarity").alias("similarity"))


def image_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame against the one before in its capture."""
    scored = materialise(_scored(spark, sf_dir).select("capture", "frame_id", "ts", "dhash", "features", "passed", "brightness"), "scored")
    rows = running(scored, ["capture"], ["ts", "frame_id"], lags={f"b_{c}": c for c in ("dhash", "features", "passed")}).where("b_dhash is not null")
    squares = total(F.zip_with("features", "b_features", lambda a, b: (a - b) ** 2))
    status = R.change_status(F.col("brightness") >= 100, hamming_hex(F.col("dhash"), F.col("b_dhash")) / 64.0, F.sqrt(squares / F.size("features")))
    return rows.select("frame_id", status.alias("status"))


def sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times at which to take twelve frames of each item's duration."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(R.sample_times(F.col("p_size").cast("double"), 12)).alias("k", "t"))
    return rows.select("p_partkey", "k", r6("t").alias("t"))


_NIBBLES = ", ".join(f"b[{4 * i + 1}] * 8 + b[{4 * i + 2}] * 4 + b[{4 * i + 3}] * 2 + b[{4 * i + 4}]" for i in range(16))
FRAMES_SQL = f"""
WITH signs AS (
  SELECT vec_id AS base, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings
), nibbles AS (
  SELECT base, [{_NIBBLES}] AS n FROM signs
), fr AS (
  SELECT e.vec_id // 12 AS capture, e.vec_id AS frame_id, e.vec_id * 40 AS ts,
    array_to_string(list_transform(n[1:15], lambda x: substr('0123456789abcdef', x + 1, 1)), '')
      || substr('0123456789abcdef', (CASE WHEN e.vec_id % 3 = 2 THEN xor(n[16], 3) ELSE n[16] END) + 1, 1) AS dhash,
    list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE)) AS features, 200 + e.vec_id * 13 % 300 AS width, 240 + e.vec_id * 7 % 200 AS height,
    CAST(e.vec_id * 17 % 256 AS DOUBLE) AS brightness, e.vec_id * 5 % 40 / 100.0 AS black, e.vec_id * 3 % 35 / 100.0 AS white, CAST(e.vec_id * 29 % 150 AS DOUBLE) AS sharpness,
    CAST(e.vec_id * 31 % 200 AS DOUBLE) AS spread
  FROM embeddings e JOIN nibbles ON base = e.vec_id - CASE WHEN e.vec_id % 3 = 2 THEN 1 ELSE 0 END
), checked AS (
  SELECT *, list_filter([CASE WHEN width < 256 OR height < 256 THEN 'size' END, CASE WHEN brightness < 30 OR brightness > 225 THEN 'brightness' END,
    CASE WHEN black > 0.25 OR white > 0.25 THEN 'clipping' END, CASE WHEN sharpness < 8 THEN 'sharpness' END, CASE WHEN spread < 35 THEN 'range' END], lambda x: x IS NOT NULL) AS f FROM fr
), scored AS (
  SELECT *, CAST(round(CAST(0.65::DOUBLE * ((5 - len(f)) / 5.0::DOUBLE) AS DECIMAL(20, 9)) + CAST(0.15::DOUBLE * least(1.0, sharpness / 120) AS DECIMAL(20, 9))
    + CAST(0.1::DOUBLE * least(1.0, spread / 180) AS DECIMAL(20, 9)) + CAST(0.1::DOUBLE * greatest(0.0, 1 - (black::DOUBLE + white::DOUBLE)) AS DECIMAL(20, 9)), 4) AS DOUBLE) AS quality,
    len(f) = 0 AS passed FROM checked
)
"""
_HAMMING = "bit_count(xor(CAST('0x' || substr({0}, 1, 8) AS BIGINT), CAST('0x' || substr({1}, 1, 8) AS BIGINT))) + bit_count(xor(CAST('0x' || substr({0}, 9, 8) AS BIGINT), CAST('0x' || substr({1}, 9, 8) AS BIGINT)))"
# The greedy order: frame by frame, with the kept ones in a list.
_GREEDY = FRAMES_SQL.replace("WITH signs", "WITH RECURSIVE signs", 1) + f"""
, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY capture ORDER BY ts, frame_id) AS k FROM scored
), walk AS (
  SELECT capture, k, frame_id, CAST(NULL AS BIGINT) AS duplicate_of, CAST(NULL AS BIGINT) AS distance, [{{'id': frame_id, 'h': dhash}}] AS kept FROM numbered WHERE k = 1
  UNION ALL
  SELECT capture, k, frame_id, CASE WHEN best.d <= 4 THEN best.id END, CASE WHEN best.d <= 4 THEN best.d END,
    CASE WHEN best.d <= 4 THEN kept ELSE list_append(kept, {{'id': frame_id, 'h': dhash}}) END
  FROM (SELECT n.capture, n.k, n.frame_id, n.dhash, w.kept,
      list_sort(list_transform(w.kept, lambda x: {{'d': CAST({_HAMMING.format('x.h', 'n.dhash')} AS BIGINT), 'id': x.id}}))[1] AS best
    FROM walk w JOIN numbered n ON n.capture = w.capture AND n.k = w.k + 1)
), marked AS (
  SELECT s.*, duplicate_of, distance, CASE WHEN duplicate_of IS NOT NULL THEN 'DUPLICATE' WHEN NOT passed THEN 'REJECTED' ELSE 'ACCEPTED' END AS status
  FROM scored s JOIN walk USING (capture, frame_id)
), usable AS (
  SELECT * FROM marked WHERE status = 'ACCEPTED'
), pairs AS (
  SELECT a.capture, avg(({_HAMMING.format('a.dhash', 'b.dhash')}) / 64.0) AS diversity FROM usable a JOIN usable b ON a.capture = b.capture AND a.frame_id < b.frame_id GROUP BY 1
), steady AS (
  SELECT capture, CASE WHEN max(n) < 2 THEN 1.0 ELSE 1 - least(1.0, avg(s) * 3) END AS consistency
  FROM (SELECT capture, d, stddev_pop(features[d]) AS s, count(*) AS n FROM usable, range(1, 9) r(d) GROUP BY 1, 2) GROUP BY 1
), admitted AS (
  SELECT capture, count(*) FILTER (status = 'ACCEPTED') AS n_accepted, count(*) FILTER (status = 'REJECTED') AS n_rejected, count(*) FILTER (status = 'DUPLICATE') AS n_duplicate,
    round(least(1.0, (max(ts) - min(ts)) / {DURATION}), 4) AS span, round(coalesce(any_value(diversity), 0), 4) AS diversity, round(coalesce(any_value(consistency), 1), 4) AS consistency
  FROM marked LEFT JOIN pairs USING (capture) LEFT JOIN steady USING (capture) GROUP BY capture
), gated AS (
  SELECT *, list_filter([CASE WHEN n_accepted < 3 THEN 'minimum_usable_frames' END, CASE WHEN span < 0.55 THEN 'temporal_coverage' END,
    CASE WHEN diversity < 0.015 THEN 'viewpoint_diversity' END, CASE WHEN n_accepted < 2 THEN 'representative_frames' END], lambda x: x IS NOT NULL) AS failed FROM admitted
), ends AS (
  SELECT capture, arg_min(frame_id, (ts, frame_id)) AS a, arg_max(frame_id, (ts, frame_id)) AS z, (min(ts) + max(ts)) / 2 AS mid FROM usable GROUP BY 1
)
"""
_INSTRUMENT_VALUES = {
    "snr_db": "p % 30", "min_snr_db": "p % 25", "saturation_ratio": "(p % 4) / 100.0", "coverage_ratio": "(p % 20) / 20.0 + 0.04", "min_coverage_ratio": "(p % 10) / 10.0",
}
_INSTRUMENT = ", ".join(
    f"CASE WHEN (p + {k}) % 7 <> 0 THEN CAST({_INSTRUMENT_VALUES.get(n, f'CASE WHEN (p + {k}) % 5 = 0 THEN 0 ELSE 1 END')} AS DOUBLE) END AS {n}" for k, n in enumerate(INSTRUMENT_NUMBERS)
)
QUERIES = {
    f.__name__: f
    for f in (
        frame_gate, device_gate, device_quality, reference_quality, instrument_gate, near_duplicate_frames, hamming_pairs, capture_consistency,
        mean_features, midpoint_frame, frame_admission, next_observations, salient_tiles, demo_references, image_changes, sample_times,
    )
}
SQL = {
    "frame_gate": FRAMES_SQL + "SELECT frame_id, array_to_string(f, ',') AS failed, round(quality, 6) AS quality, passed FROM scored",
    "device_gate": FRAMES_SQL + """SELECT frame_id, concat_ws(',', CASE WHEN greatest(width, height) * 4 < 1200 OR least(width, height) * 4 < 900 THEN 'size' END,
      CASE WHEN brightness < 45 OR brightness > 215 THEN 'exposure' END, CASE WHEN black > 0.12 OR white > 0.12 THEN 'clipping' END, CASE WHEN sharpness * 2 < 120 THEN 'focus' END) AS failed FROM fr""",
    "instrument_gate": f"""WITH m AS (SELECT p AS p_partkey, {_INSTRUMENT} FROM (SELECT p_partkey AS p FROM part))
      SELECT p_partkey, concat_ws(',', CASE WHEN coalesce(device_ready, 0) = 0 THEN 'device_ready' END, CASE WHEN coalesce(calibration_valid, 0) = 0 THEN 'calibration' END,
      CASE WHEN coalesce(snr_db, 0) < coalesce(min_snr_db, 18) THEN 'signal_to_noise' END, CASE WHEN coalesce(saturation_ratio, 1) > 0.02 THEN 'not_saturated' END,
      CASE WHEN coalesce(region_match_valid, 0) = 0 THEN 'region_match' END, CASE WHEN coalesce(spatial_registration_valid, 0) = 0 THEN 'spatial_registration' END,
      CASE WHEN coalesce(coverage_ratio, 0) < coalesce(min_coverage_ratio, 0.9) THEN 'coverage' END, CASE WHEN coalesce(integrity_valid, 0) = 0 THEN 'integrity' END,
      CASE WHEN coalesce(reference_applicability, 0) = 0 THEN 'reference_applicability' END) AS failed FROM m""",
    "device_quality": FRAMES_SQL + """SELECT frame_id, round(greatest(0.0, least(1.0, 0.35::DOUBLE * (1 - least(1.0, abs(brightness - 130) / 130))
      + 0.25::DOUBLE * (1 - least(1.0, (black::DOUBLE + white::DOUBLE) / 0.24::DOUBLE)) + 0.40::DOUBLE * least(1.0, sharpness * 2 / 320))), 6) AS quality FROM fr""",
    "reference_quality": FRAMES_SQL + """SELECT frame_id, CASE WHEN problem IS NULL THEN round((5 - len(f)) / 5.0, 6) END AS score, problem FROM (
      SELECT *, CASE WHEN frame_id % 29 IN (2, 3) THEN 'CHECKS_DO_NOT_MATCH' WHEN frame_id % 29 = 1 THEN 'CHECK_NOT_BOOLEAN'
        WHEN frame_id % 29 = 4 THEN 'FAILED_CHECKS_INCONSISTENT' WHEN frame_id % 29 = 6 THEN 'DECISION_INCONSISTENT' END AS problem FROM scored)""",
    "near_duplicate_frames": _GREEDY + "SELECT capture, frame_id, duplicate_of, distance FROM walk WHERE duplicate_of IS NOT NULL",
    "hamming_pairs": FRAMES_SQL + f"""SELECT c.capture, round(coalesce(avg(d), 0), 6) AS diversity FROM (SELECT DISTINCT capture FROM fr) c LEFT JOIN
      (SELECT a.capture, ({_HAMMING.format('a.dhash', 'b.dhash')}) / 64.0 AS d FROM fr a JOIN fr b ON a.capture = b.capture AND a.frame_id < b.frame_id) p ON p.capture = c.capture GROUP BY 1""",
    "capture_consistency": _GREEDY + "SELECT capture, round(consistency, 6) AS consistency FROM steady",
    "mean_features": FRAMES_SQL + "SELECT capture, d - 1 AS dim, round(avg(features[d]), 6) AS mean FROM fr, range(1, 9) r(d) GROUP BY 1, 2",
    "midpoint_frame": _GREEDY + """SELECT capture, row_number() OVER (PARTITION BY capture ORDER BY ts, frame_id) AS position, frame_id FROM (
      SELECT capture, frame_id, ts FROM usable JOIN ends USING (capture) WHERE frame_id IN (a, z) UNION ALL SELECT capture, frame_id, ts FROM (
      SELECT capture, frame_id, ts, row_number() OVER (PARTITION BY capture ORDER BY abs(ts - mid), -quality, frame_id) AS k FROM usable JOIN ends USING (capture)
      WHERE frame_id NOT IN (a, z)) WHERE k = 1)""",
    "frame_admission": _GREEDY + "SELECT capture, n_accepted, n_rejected, n_duplicate, span, diversity, consistency, array_to_string(failed, ',') AS failed FROM gated",
    "next_observations": _GREEDY + """SELECT capture, o.p AS priority, o.n AS observation FROM (SELECT capture, unnest(list_filter([
      CASE WHEN n_accepted < 3 THEN {'p': 1, 'n': 'OBS-RGB-QUALITY'} END, CASE WHEN span < 0.55 OR diversity < 0.015 THEN {'p': 2, 'n': 'OBS-RGB-ROTATION'} END,
      CASE WHEN consistency < 0.65 THEN {'p': 3, 'n': 'OBS-CALIBRATION'} END, {'p': 4, 'n': 'OBS-UV-NIR'}, {'p': 5, 'n': 'OBS-MATERIAL-SCIENCE'}],
      lambda x: x IS NOT NULL)) AS o FROM gated)""",
    "salient_tiles": """WITH p AS (
      SELECT vec_id, i // 12 AS y, i % 12 AS x, CASE WHEN vec_id % 5 = 4 THEN 77 ELSE CAST(floor(embedding[i % 64 + 1]::DOUBLE * 4096) AS BIGINT) END AS v
      FROM embeddings, range(108) r(i)
    ), g AS (
      SELECT vec_id, y, x, (((v % 256) + 256) % 256) / 255.0::DOUBLE AS v FROM p
    ), e AS (
      SELECT vec_id, y // 3 AS row, x // 4 AS col, sqrt(pow(v - coalesce(lag(v) OVER (PARTITION BY vec_id, y ORDER BY x), v), 2)
        + pow(v - coalesce(lag(v) OVER (PARTITION BY vec_id, x ORDER BY y), v), 2)) AS s FROM g
    ), t AS (
      SELECT vec_id, row, col, round(avg(s), 9) AS mean FROM e GROUP BY ALL
    ) SELECT vec_id, CAST(row_number() OVER w AS INTEGER) AS rank, round(mean, 4) AS score, round(col / 3.0, 4)::DOUBLE AS left, round(row / 3.0, 4)::DOUBLE AS top
      FROM t WINDOW w AS (PARTITION BY vec_id ORDER BY mean DESC, row, col) QUALIFY row_number() OVER w <= 2""",
    "demo_references": """WITH e AS (SELECT vec_id, label, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
      c AS (SELECT vec_id AS reference_id, v AS r FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 3)
      SELECT * FROM (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, reference_id) AS rank, reference_id, similarity FROM (
      SELECT vec_id, reference_id, round(greatest(0, 1 - sqrt(list_sum(list_transform(list_zip(v, r), lambda x: pow(x[1] - x[2], 2))) / 8)), 4) AS similarity
      FROM e, c WHERE vec_id % 20 = 0)) WHERE rank <= 3""",
    "image_changes": FRAMES_SQL + f""", p AS (
      SELECT *, lag(dhash) OVER w AS bh, lag(features) OVER w AS bf FROM scored WINDOW w AS (PARTITION BY capture ORDER BY ts)
    ), q AS (
      SELECT *, ({_HAMMING.format('dhash', 'bh')}) / 64.0 AS h, sqrt(list_sum(list_transform(list_zip(features, bf), lambda x: pow(x[1] - x[2], 2))) / 8) AS d FROM p WHERE bh IS NOT NULL
    ) SELECT frame_id, CASE WHEN brightness < 100 OR h > 0.35 THEN 'NOT_COMPARABLE' WHEN h <= 0.08 AND d <= 0.1 THEN 'STABLE' ELSE 'CHANGE_CANDIDATE' END AS status FROM q""",
    "sample_times": "SELECT p_partkey, k, round(p_size * (0.05 + 0.9 * k / 11), 6) AS t FROM part, range(12) r(k)",
}
