"""Hand-computed values and hard rows for the operators outside SQL's reach or with fine points."""

import hashlib
import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.operators import audit, comparison, frames, graph, jobs, planning, validation
from tessella.sources import files
from tessella.streaming import jobs as streams


def test_chain_append_and_verify(spark):
    rows = spark.createDataFrame([("a", 0, "x"), ("a", 1, None), ("b", 0, "y"), (None, 0, "z")], "k string, i int, t string")
    chain = audit.chain_append(rows, "k", "i", F.col("t"))
    got = {(r.k, r.i): r for r in chain.collect()}
    first = hashlib.sha256(b"GENESIS|x").hexdigest()
    assert got["a", 0].event_hash == first and got["a", 1].prev_hash == first
    assert got["a", 1].event_hash == hashlib.sha256(f"{first}|".encode()).hexdigest()
    assert got[None, 0].prev_hash == "GENESIS"
    recomputed = F.sha2(F.concat_ws("|", "prev_hash", "body"), 256)
    assert all(r.valid for r in audit.chain_verify(chain, "k", "i", recomputed).collect())
    broken = chain.withColumn("event_hash", F.when(F.col("i") == 0, "bad").otherwise(F.col("event_hash")))
    found = {r.k: (r.failure_seq, r.reason) for r in audit.chain_verify(broken, "k", "i", recomputed).collect()}
    assert found["a"] == (0, "event hash mismatch")


def test_set_digest_ignores_order_but_not_repeats(spark):
    digest = lambda rows: audit.set_digest(spark.createDataFrame(rows, "x string"), F.sha2("x", 256)).first().digest
    assert digest([("a",), ("b",)]) == digest([("b",), ("a",)])
    assert digest([("a",), ("b",)]) != digest([("a",), ("b",), ("b",)]) != digest([("a",), ("c",)])


def test_mark_duplicates_is_greedy(spark):
    rows = [(1, 10, 0, "0" * 16), (1, 11, 1, "0" * 15 + "7"), (1, 12, 2, "0" * 14 + "3f"), (1, 13, 3, "f" * 16), (2, 20, 0, "0" * 16)]
    got = frames.mark_duplicates(spark.createDataFrame(rows, "c int, frame_id bigint, ts bigint, dhash string"), "c").collect()
    # 12 is near 11, but 11 is itself a duplicate and not kept.
    assert {r.frame_id: r.duplicate_of for r in got} == {10: None, 11: 10, 12: None, 13: None, 20: None}


def test_backoff_and_intake(spark):
    got = spark.range(-1, 9).select(jobs.backoff_seconds(F.col("id"))).collect()
    assert [r[0] for r in got][:4] == [5.0, 5.0, 5.0, 10.0] and got[-1][0] == 300.0
    rows = [("a", 1, "x"), ("a", 2, "x"), ("b", 3, "x"), ("b", 4, "y"), ("c", 5, None), ("c", 6, None)]
    found = jobs.idempotent_intake(spark.createDataFrame(rows, "k string, seq int, d string"), ["k"], "d").collect()
    assert {r.k: (r.first_seq, r.conflict) for r in found} == {"a": (1, False), "b": (3, True), "c": (5, False)}


def test_planning_forbids_and_settles(spark):
    rows = [("a", 1, "R", "k", {"x": 0.5}, {"material_allowed": True, "calibration_ready": True, "device_ready": True}, 1.0, 0.1, 0.1)]
    kind = "action_id string, pos int, region string, retry_key string, loads map<string,double>, preconditions map<string,boolean>, pass_rate double, expected_uncertainty double, cost double"
    budget = spark.createDataFrame([("R", "x", 0.0, 0.0, 1.0, False)], "region string, channel string, used double, reserved double, cap double, locked boolean")
    got = planning.evaluate_actions(spark.createDataFrame(rows, kind), budget, 0.9, []).first()
    assert got.reasons == [] and got.utility == pytest.approx(0.55 * 0.8 - 0.02 - 0.125) and got.qualifies
    none = planning.evaluate_actions(spark.createDataFrame(rows, kind), budget.limit(0), 0.9, ["k"]).first()
    assert none.reasons == ["RETRY_BLOCKED", "OVER_BUDGET"] and not none.qualifies
    runs = [("b", "e1", 1, 2.0, None, True), ("b", "e2", 1, 2.0, 1.5, True), ("b", "e2", 2, 2.0, 1.0, True)]
    settled = planning.settlement(spark.createDataFrame(runs, "b string, execution_id string, seq int, predicted double, actual double, telemetry_valid boolean"), spark.createDataFrame([("b", 100.0, 0.0, 50.0, False)], "b string, cap double, used double, reserved double, locked boolean"), "b").first()
    assert (settled.used, settled.reserved, settled.locked, settled.over_limit, settled.n_executions) == (3.0, 46.0, False, False, 2)
    many = [("over", "e", 1, 9.0, 11.0, True), ("unknown", "e", 1, 9.0, 1.0, False), ("below", "e", 1, 9.0, -5.0, True), ("none", "e", 1, 9.0, 1.0, True)]
    budgets = spark.createDataFrame([(b, 10.0, 0.5, 1.0, b == "shut") for b in ("over", "unknown", "below", "shut")], "b string, cap double, used double, reserved double, locked boolean")
    runs = spark.createDataFrame(many, "b string, execution_id string, seq int, predicted double, actual double, telemetry_valid boolean")
    got = {r.b: (r.used, r.reserved, r.locked, r.over_limit, r.n_executions) for r in planning.settlement(runs, budgets, "b").collect()}
    assert got == {"over": (11.5, 0.0, True, True, 1), "unknown": (9.5, 0.0, True, False, 1), "below": (0.5, 0.0, False, False, 1), "shut": (0.5, 1.0, True, False, 0)}


def test_graph_upsert_and_status(spark):
    rows = [("n", 1, "old"), ("n", 2, "new"), (None, 3, "x")]
    got = {r.id: (r.label, r.first_seen) for r in graph.upsert(spark.createDataFrame(rows, "id string, seq int, label string"), ["id"], ["seq"]).collect()}
    assert got == {"n": ("new", 1), None: ("x", 3)}
    parts = spark.createDataFrame([("a", "down", 1.0), ("b", "up", 2.0), ("b", "limited", 3.0), ("c", None, 1.0)], "k string, state string, latency double")
    assert {r.k: r.state for r in graph.component_status(parts, "k").collect()} == {"a": "offline", "b": "degraded", "c": "unknown"}


def test_empty_tables(spark):
    log = spark.createDataFrame([], "job bigint, ts timestamp, seq bigint, status string")
    assert jobs.last_status(log, "job").count() == 0
    assert jobs.attempts(log, "job", "RUNNING", ("DONE",)).count() == 0
    assert frames.mark_duplicates(spark.createDataFrame([], "c int, frame_id bigint, ts bigint, dhash string"), "c").count() == 0
    assert validation.duplicate_keys(log, {"seq": F.col("seq")}).count() == 0


def test_detected_types(spark):
    rows = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\nxx"),), (bytearray(b"....ftypisom"),), (bytearray(b""),), (None,)], "c binary")
    assert [r[0] for r in rows.select(validation.detected_type(F.col("c"))).collect()] == ["image/png", "video/mp4", None, None]


def test_files(spark, tmp_path):
    (tmp_path / "env").write_text("# note\nA=1\nB = x=y\n\nA=2\n")
    pairs = files.read_pairs(spark, str(tmp_path / "env"))
    assert {r.name: r.value for r in files.last_assignments(pairs).collect()} == {"A": "2", "B": "x=y"}
    assert {r.name: r.n for r in files.once_only(pairs).collect()} == {"A": 2, "B": 1}
    (tmp_path / "m.json").write_text('{"a": 1, "odd": 2}')
    assert files.read_manifest(spark, str(tmp_path / "m.json"), "a int").first().a == 1
    assert [r.field for r in files.unknown_fields(spark, str(tmp_path / "m.json"), ["a"]).collect()] == ["odd"]
    (tmp_path / "sums").write_text("a" * 64 + "  ok.png\n" + "b" * 64 + "  ../up\nnothing\n")
    assert {r.path: r.problem for r in files.read_checksums(spark, str(tmp_path / "sums")).collect()} == {"ok.png": None, "../up": "UNSAFE_PATH", "": "BAD_LINE"}


def test_archives_and_movies(spark, tmp_path):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/one.txt", "x" * 1000)
        z.writestr("two.txt", "y")
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "a.zip").write_bytes(made.getvalue())
    (tmp_path / "z" / "b.zip").write_bytes(b"no archive")
    entries = files.zip_entries(spark, str(tmp_path / "z"))
    totals = {r.archive.rsplit("/", 1)[1]: (r.n_files, r.bytes, r.n_problems) for r in files.archive_totals(entries).collect()}
    assert totals == {"a.zip": (2, 1001, 0), "b.zip": (0, 0, 1)}
    box = lambda kind, body=b"": (len(body) + 8).to_bytes(4, "big") + kind + body
    (tmp_path / "m.mp4").write_bytes(box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"tkhd"))) + b"\x00\x00\xff\xffmdat")
    boxes = files.movie_boxes(spark, str(tmp_path / "m.mp4")).collect()
    assert [(r.level, r.box, r.problem) for r in boxes] == [(0, "ftyp", None), (0, "moov", None), (1, "trak", None), (2, "tkhd", None), (0, "mdat", "BAD_SIZE")]


def test_view_archive_binds_rows_and_identity(spark, tmp_path):
    views = spark.createDataFrame([(1, [0.5, 0.25]), (2, [1.0, 0.0])], "view_id bigint, vector array<float>")
    identity = {"library": "L1", "model": "m", "revision": "r"}
    files.write_view_archive(views, str(tmp_path / "v"), identity, "vector", "view_id")
    read = lambda expected: files.read_view_archive(spark, str(tmp_path / "v"), expected, "vector", "view_id")
    good, bad, wrong = read(identity)
    assert (good.count(), bad.count(), wrong) == (2, 0, [])
    assert read({**identity, "model": "other"})[2] == ["model"]
    spark.read.parquet(str(tmp_path / "v/views")).limit(1).withColumn("vector", F.array(F.lit(0.1).cast("float"), F.lit(0.2).cast("float"))).write.mode("append").parquet(str(tmp_path / "v/views"))
    good, bad, wrong = read(identity)
    assert (good.count(), bad.count(), wrong) == (2, 1, ["rows", "rows_sha256"])
    ragged = spark.createDataFrame([(1, [0.5]), (2, [1.0, 0.0])], "view_id bigint, vector array<float>")
    with pytest.raises(ValueError):
        files.write_view_archive(ragged, str(tmp_path / "w"), identity, "vector", "view_id")
    assert files.read_view_archive(spark, str(tmp_path / "w"), identity, "vector", "view_id")[2] == ["manifest"]


def test_publish_swaps_a_pointer(spark, tmp_path):
    views = spark.createDataFrame([(1,), (2,)], "view_id bigint")
    with pytest.raises(ValueError):
        files.publish(views, F.col("view_id") > 1, str(tmp_path / "p"))
    with pytest.raises(ValueError):
        files.read_published(spark, str(tmp_path / "p"))
    files.publish(views, F.col("view_id") > 0, str(tmp_path / "p"))
    files.publish(views.limit(1), F.col("view_id") > 0, str(tmp_path / "p"))
    assert files.read_published(spark, str(tmp_path / "p")).count() == 1
    with pytest.raises(ValueError):
        files.publish(views, F.col("view_id") > 1, str(tmp_path / "p"))
    assert files.read_published(spark, str(tmp_path / "p")).count() == 1
    files.write_document(views.limit(1), str(tmp_path / "d.json"))
    files.write_document(views.where("view_id = 2"), str(tmp_path / "d.json"))
    assert (tmp_path / "d.json").read_text() == '{"view_id":2}'
    with pytest.raises(ValueError):
        files.write_document(views, str(tmp_path / "d.json"))
    store = spark.createDataFrame([(hashlib.sha256(b"a").hexdigest(),)], "sha256 string")
    blobs = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"b"),), (bytearray(b"b"),), (None,)], "content binary")
    assert [bytes(r.content) for r in files.new_blobs(blobs, store).collect()] == [b"b"]
    files.write_review_sheet(views, str(tmp_path / "sheet"))
    assert spark.read.option("header", True).csv(str(tmp_path / "sheet")).count() == 2
    (tmp_path / "big.json").write_text('{"a": 1}')
    with pytest.raises(ValueError):
        files.read_manifest(spark, str(tmp_path / "big.json"), "a int", most_bytes=3)


def test_archive_rules(spark, tmp_path):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("a/one.jpg", "x" * 50), ("A/ONE.jpg", "y"), ("../up.png", "z"), ("bomb.mp4", "0" * 1_000_000), ("fine.txt", "ok")):
            z.writestr(name, text)
    (tmp_path / "a.zip").write_bytes(made.getvalue())
    found = files.archive_problems(files.zip_entries(spark, str(tmp_path / "a.zip")))
    assert {r.name: r.problem for r in found.collect()} == {"A/ONE.jpg": None, "a/one.jpg": "REPEATED_PATH", "../up.png": "UNSAFE_PATH", "bomb.mp4": "COMPRESSION_RATIO", "fine.txt": None}
    total = files.archive_totals(found).first()
    assert (total.n_files, total.n_images, total.n_videos, total.n_problems) == (5, 3, 1, 3)


def test_movie_tracks(spark, tmp_path):
    box = lambda kind, body=b"": (len(body) + 8).to_bytes(4, "big") + kind + body
    n = lambda *values: b"".join(v.to_bytes(4, "big") for v in values)
    stbl = box(b"stbl", box(b"stsd", n(0, 1, 86) + b"avc1" + bytes(78)) + box(b"stts", n(0, 2, 10, 100, 5, 200)))
    mdia = box(b"mdia", box(b"mdhd", n(0, 0, 0, 1000, 2000, 0)) + box(b"hdlr", n(0, 0) + b"vide" + bytes(13)) + box(b"minf", stbl))
    tkhd = box(b"tkhd", bytes(76) + n(640 << 16, 480 << 16))
    (tmp_path / "m.mp4").write_bytes(box(b"ftyp", b"isom") + box(b"moov", box(b"trak", tkhd + mdia)))
    (tmp_path / "n.mp4").write_bytes(b"\x00\x00\x00\x09free")
    row = files.movie_tracks(spark, str(tmp_path)).collect()
    assert len(row) == 1
    r = row[0]
    assert (r.handler, r.codec, r.width, r.height, r.timescale, r.ticks, r.samples, r.run_ticks, r.seconds, r.agrees) == ("vide", "avc1", 640, 480, 1000, 2000, 15, 2000, 2.0, True)


def _png(pixels):
    """A colour PNG of a height x width x 3 array."""
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\x00" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_pictures(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(3)
    pixels = rng.integers(0, 256, (24, 36, 3), dtype=np.uint8)
    ramp = np.repeat(np.arange(0, 252, 7, dtype=np.uint8)[None, :, None], 24, axis=0).repeat(3, axis=2)
    for name, p in (("noise.png", pixels), ("ramp.png", ramp), ("flat.png", np.full((8, 9, 3), 200, np.uint8))):
        (tmp_path / name).write_bytes(_png(p))
    (tmp_path / "broken.png").write_bytes(b"no picture")
    got = {r.file.rsplit("/", 1)[1]: r for r in files.read_pictures(spark, str(tmp_path)).collect()}
    assert set(got) == {"noise.png", "ramp.png", "flat.png"}
    m = got["noise.png"].measured
    grey = np.floor(pixels @ np.array([0.299, 0.587, 0.114]) + 0.5)
    assert abs(m.brightness - grey.mean()) < 0.1 and abs(m.range - np.subtract(*np.percentile(grey, [99, 1]))) <= 1 and m.entropy > 0.9
    most, least = pixels.max(axis=2) / 1.0, pixels.min(axis=2) / 1.0
    assert abs(m.saturation - ((most - least) / np.maximum(most, 1)).mean()) < 1e-3
    assert got["ramp.png"].measured.dhash == "f" * 16 and got["ramp.png"].measured.symmetry < 0.6
    flat = got["flat.png"].measured
    assert (flat.dhash, flat.entropy, flat.sharpness, flat.edge_density, flat.symmetry, flat.laplacian) == ("0" * 16, 0.0, 0.0, 0.0, 1.0, 0.0)
    assert [t.score for t in m.tiles] == sorted([t.score for t in m.tiles], reverse=True) and len(m.tiles) == 2
    digest = hashlib.sha256((tmp_path / "flat.png").read_bytes()).hexdigest()
    index = spark.createDataFrame([(digest, "image/png"), (digest, "image/jpeg"), ("0" * 64, "image/png")], "sha256 string, media_type string")
    assert {(r.media_type, r.problem, r.content is None) for r in files.indexed_files(spark, str(tmp_path), index).collect()} == {
        ("image/png", None, False), ("image/jpeg", "TYPE_DIFFERS", True), ("image/png", "MISSING", True),
    }


def test_streams_equal_batch_replay(spark, sf_dir, tmp_path):
    from tessella.plans.jobs import log

    batch = log(spark, sf_dir).select("job", F.col("ts").cast("timestamp").alias("ts"), "seq", "status")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    query = (
        streams.last_status(source).writeStream.outputMode("update").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda df, _: seen.append(df.collect())).start()
    )
    query.awaitTermination()
    final = {r.job: (r.status, r.seq, r.n_entries) for rows in seen for r in rows}
    assert len(seen) > 1
    assert final == {r.job: (r.status, r.seq, r.n_entries) for r in jobs.last_status(batch, "job").collect()}


def _streamed(spark, stream, tmp_path, mode="append"):
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).format("parquet").option("checkpointLocation", str(tmp_path / "check")).start(str(tmp_path / "out"))
    query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_stream_intake(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 4, None), ("b", 6, ""), ("b", 7, None), (None, 5, "z")], "request_key string, seq bigint, digest string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = {r.seq: r.verdict for r in _streamed(spark, streams.intake(source), tmp_path)}
    assert got == {1: "ACCEPTED", 2: "REPLAYED", 3: "CONFLICT", 4: "ACCEPTED", 6: "CONFLICT", 7: "REPLAYED"}
    found = jobs.idempotent_intake(rows.where("request_key = 'b'"), ["request_key"], "digest").first()
    assert (found.first_seq, found.conflict) == (4, True)


def test_stream_of_actions_equals_replay(spark, tmp_path):
    import random

    from tessella.operators import records

    rng = random.Random(6)
    kind = "session bigint, seq bigint, kind string, run string, load double, valid boolean"
    rows = [(s, i, rng.choice(["reserve", "claim", "settle"]), rng.choice(["r1", "r2", "r3"]), rng.choice([None, 0.5, 2.0]), rng.random() < 0.8) for s in range(6) for i in range(30)]
    frame = spark.createDataFrame(rows, kind)
    for at in range(3):  # three micro-batches, in order
        frame.where(f"seq >= {at * 10} and seq < {at * 10 + 10}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = _streamed(spark, streams.actions(source, 3.0), tmp_path)
    assert sorted(map(tuple, got)) == sorted(map(tuple, records.replay_actions(frame, 3.0).collect()))
    streams.append_log(source, str(tmp_path / "log"), str(tmp_path / "log_check")).awaitTermination()
    streams.append_log(source, str(tmp_path / "log"), str(tmp_path / "log_check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == len(rows)


def test_stream_of_retries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "BASE_DELAY", 0.05)
    (tmp_path / "in").mkdir()
    put = lambda name, *rows: (tmp_path / "in" / name).write_text("\n".join(f'{{"job": {j}, "status": "{s}"}}' for j, s in rows))
    source = spark.readStream.schema("job bigint, status string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = []
    put("0.json", (1, "RETRY_WAIT"), (2, "RETRY_WAIT"), (3, "RUNNING"))
    query = streams.retries(source).writeStream.outputMode("append").trigger(processingTime="200 milliseconds").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda df, _: got.extend(df.collect())).start()
    try:
        for i in range(1, 60):
            if {(1, 1, "QUEUED"), (2, 1, "QUEUED")} <= set(map(tuple, got)):
                break
            time.sleep(1)
            put(f"{i}.json", (9, "RUNNING"))  # timers are looked at when a micro-batch runs
    finally:
        query.stop()
    assert {(1, 1, "WAITING"), (2, 1, "WAITING"), (1, 1, "QUEUED"), (2, 1, "QUEUED")} <= set(map(tuple, got)) and not [r for r in got if r.job == 3]


def test_promotion_holds_what_it_cannot_compare(spark):
    rows = [
        ("ok", "BASELINE", "i", "m1", "r", True), ("ok", "CANDIDATE", "i", "m2", "r", True), ("ok", "OTHER", "x", "m3", "r", True),
        ("input", "BASELINE", "i", "m1", "r", True), ("input", "CANDIDATE", "j", "m1", "r", None),
        ("blank", "BASELINE", " ", "m1", "r", True), ("blank", "CANDIDATE", " ", None, "q", True),
        ("alone", "CANDIDATE", "i", "m2", "r", False),
        ("twice", "BASELINE", "i", "m1", "r", True), ("twice", "CANDIDATE", "i", "m2", "r", True), ("twice", "CANDIDATE", "i", "m2", "r", True),
        (None, "BASELINE", None, None, None, None),
    ]
    runs = spark.createDataFrame(rows, "pair string, role string, input string, model string, revision string, good boolean")
    compare = lambda df: comparison.promotion(df, "pair", "role", ["input"], {"model": ["model"], "build": ["model", "revision"]}, F.col("good"))
    got = {r.pair: (r.reasons, r.decision) for r in compare(runs).collect()}
    assert got["ok"] == ([], "EXPERT_REVIEW_REQUIRED")
    assert got["input"][0] == ["input_DIFFERS", "model_NOT_DISTINCT", "build_NOT_DISTINCT", "CANDIDATE_INELIGIBLE"]
    assert got["blank"][0] == ["input_DIFFERS", "model_NOT_DISTINCT"]
    assert got["alone"][0] == ["BASELINE_MISSING"] and got["twice"][0] == ["CANDIDATE_REPEATED"] and got[None][0] == ["CANDIDATE_MISSING"]
    assert {d for k, (_, d) in got.items() if k != "ok"} == {"HOLD"} and compare(runs.limit(0)).count() == 0


def test_citations_look_at_the_first_hits_only(spark):
    rows = [("q", "a", i, *x) for i, x in enumerate([("o1", "c1", None, "r"), ("o1", "c1", "museum", "r"), ("o2", None, "museum", "r"), ("o2", "c1", "museum", "r"), ("o3", "c1", "museum", " "), ("o4", "c1", "museum", "r")])]
    hits = spark.createDataFrame(rows, "q string, role string, i int, artifact_id string, citation_id string, institution string, review_id string")
    cite = lambda df: comparison.citations(df, ["q"], "role", [F.col("i")], ["institution"], "review_id")
    got = sorted((r.position, r.artifact_id, r.source_status) for r in cite(hits).collect())
    incomplete = "SOURCE_METADATA_INCOMPLETE"
    assert got == [(1, "o1", incomplete), (4, "o2", "SOURCE_AND_REVIEW_RECORDED"), (5, "o3", incomplete)]
    assert cite(hits.limit(0)).count() == 0


def test_resampling_and_tiles_equal_plain_writings():
    import math

    import numpy as np

    from tessella.operators import pixels

    def weights(n, size, at):
        scale = n / size
        wide = max(scale, 1.0)
        centre = (at + 0.5) * scale
        first, last = max(0, int(centre - 3 * wide + 0.5)), min(n, int(centre + 3 * wide + 0.5))
        sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
        raw = [sinc(x) * sinc(x / 3) if abs(x) < 3 else 0.0 for x in ((i - centre + 0.5) / wide for i in range(first, last))]
        return first, [int(w / sum(raw) * 2**22 + (0.5 if w >= 0 else -0.5)) for w in raw]

    def plain(rows, width, height):
        cut = lambda total: min(255, max(0, (total + 2**21) >> 22))
        line = lambda values, size: [cut(sum(v * w for v, w in zip(values[f:], ws))) for f, ws in (weights(len(values), size, i) for i in range(size))]
        across = [line(r, width) for r in rows]
        return list(zip(*[line(list(c), height) for c in zip(*across)]))

    rng = np.random.default_rng(8)
    for shape in ((24, 36), (8, 9), (5, 7), (200, 3), (1, 1), (31, 250)):
        grey = rng.integers(0, 256, shape).astype(np.uint8)
        small = pixels.resampled(grey, 9, 8)
        assert [tuple(r) for r in small.tolist()] == [tuple(r) for r in plain(grey.tolist(), 9, 8)]
        bits = "".join("1" if r[i + 1] > r[i] else "0" for r in small.tolist() for i in range(8))
        assert pixels.difference_hash(grey) == f"{int(bits, 2):016x}"
    grey = rng.integers(0, 256, (20, 31)).astype(np.uint8)
    bright = grey / 255
    edge = lambda y, x: math.hypot(bright[y, x] - bright[y, max(x - 1, 0)], bright[y, x] - bright[max(y - 1, 0), x])
    means = {}
    for i in range(9):
        ys, xs = range(i // 3 * 20 // 3, (i // 3 + 1) * 20 // 3), range(i % 3 * 31 // 3, (i % 3 + 1) * 31 // 3)
        means[i] = np.mean([edge(y, x) for y in ys for x in xs])
    best = sorted(means, key=lambda i: (-means[i], i))[:2]
    got = pixels.salient_tiles_of(grey)
    assert [t[1:3] for t in got] == [(round(i % 3 * 31 // 3 / 31, 4), round(i // 3 * 20 // 3 / 20, 4)) for i in best]
    assert [t[0] for t in got] == pytest.approx([means[i] for i in best], abs=1e-4)
    assert [t[1:3] for t in pixels.salient_tiles_of(np.full((9, 9), 5, np.uint8))] == [(0.0, 0.0), (0.3333, 0.0)]
    n = np.bincount(grey.ravel(), minlength=256) / grey.size
    assert pixels.entropy(grey) == pytest.approx(-sum(p * math.log2(p) for p in n if p) / 8)
    assert pixels.symmetry(grey) == pytest.approx(1 - np.mean([abs(int(r[x]) - int(r[30 - x])) for r in grey for x in range(15)]) / 255)


def test_recovery_looks_at_the_last_outcome(spark):
    states = [("after success", "RUNNING", 0), ("after failure", "RUNNING", 0), ("unknown", "RUNNING", 0), ("spent", "RUNNING", 0), ("new cycle", "RUNNING", 2), ("none", "RUNNING", 0), ("done", "COMPLETED", 0), ("lost", "RETRY_WAIT", 0), (None, "RUNNING", None)]
    tried = [("after success", 1, 1, True), ("after failure", 1, 1, False), ("unknown", 1, 0, None), ("spent", 2, 0, None), ("new cycle", 3, 1, False), ("done", 1, 1, True), ("lost", 1, 1, False), (None, 1, 1, False)]
    frame = spark.createDataFrame(states, "job string, status string, attempt_base int").withColumn("next_attempt_at", F.lit(None).cast("timestamp"))
    frame = frame.union(spark.sql("SELECT 'waits', 'RETRY_WAIT', 0, TIMESTAMP '2024-01-01 00:00:00'"))
    attempts = spark.createDataFrame(tried, "job string, attempt int, n_outcomes int, available boolean")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    got = {r.job: (r.status, r.outcome, r.delay) for r in jobs.recover(frame, attempts, "job", now, 2, base=5.0).withColumn("delay", F.unix_seconds("next_attempt_at") - F.unix_seconds(now)).collect()}
    assert got == {
        "after success": ("QUEUED", None, None), "after failure": ("RETRY_WAIT", None, 5), "unknown": ("RETRY_WAIT", "UNKNOWN_AFTER_RESTART", 5), "spent": ("QUEUED", "UNKNOWN_AFTER_RESTART", None),
        "new cycle": ("RETRY_WAIT", None, 5), "none": ("QUEUED", None, None), "lost": ("QUEUED", None, None), None: ("RETRY_WAIT", None, 5),
    }
    assert {r.status for r in jobs.recover(frame, attempts, "job", now, 2).collect()} == {"QUEUED"}


def test_endings(spark):
    ok = dict(n_succeeded=1, last_available=True, recapture=False, n_views=3, least_views=3, n_visible=1, n_issues=0, risk="LOW")
    cases = [({}, "SUCCEEDED"), ({"n_succeeded": 0}, "MODEL_UNAVAILABLE"), ({"last_available": False, "recapture": True}, "MODEL_UNAVAILABLE"), ({"last_available": None}, "MODEL_UNAVAILABLE"), ({"recapture": True}, "PARTIAL"), ({"n_views": 2}, "PARTIAL"), ({"n_visible": 0}, "PARTIAL"), ({"n_issues": 1}, "PARTIAL"), ({"risk": "HIGH"}, "PARTIAL"), ({"risk": None}, "SUCCEEDED")]
    rows = [tuple((ok | change).values()) for change, _ in cases]
    frame = spark.createDataFrame(rows, "n_succeeded int, last_available boolean, recapture boolean, n_views int, least_views int, n_visible int, n_issues int, risk string")
    assert [r[0] for r in frame.select(jobs.terminal_status(*map(F.col, ok))).collect()] == [want for _, want in cases]
