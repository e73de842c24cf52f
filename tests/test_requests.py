from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.operators import jobs
from tessella.plans.jobs import REQUEST_COOLDOWN_S, requests_log
from tessella.streaming import jobs as streams

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "device bigint, job bigint, ts timestamp, seq bigint, kind string, digest string"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield spark
    spark.conf.set(name, before)


def verdicts(spark, kinds, **rules):
    rows = spark.createDataFrame([(1, j, k, d, i) for i, (j, k, d) in enumerate(kinds)], "device int, job int, kind string, digest string, seq int")
    rows = rows.withColumn("ts", F.timestamp_seconds(F.col("seq") * 10))
    return [(r.verdict, r.status, r.outstanding) for r in sorted(jobs.replay_requests(rows, **rules).collect(), key=lambda r: r.seq)]


def test_guards(spark):
    assert verdicts(spark, [(1, "CLAIM", ""), (1, "CREATE", "a"), (1, "CREATE", "a"), (1, "CREATE", "b"), (1, "DEFER", None), (1, "CLAIM", None), (1, "CLAIM", None), (1, "SUCCEED", None), (1, "RETRY", None), (1, "odd", None), (1, None, None)]) == [
        ("NOT_FOUND", None, 0), ("ACCEPTED", "QUEUED", 1), ("REPLAYED", "QUEUED", 1), ("CONFLICT", "QUEUED", 1), ("CONFLICT", "QUEUED", 1), ("ACCEPTED", "RUNNING", 1),
        ("CONFLICT", "RUNNING", 1), ("ACCEPTED", "SUCCEEDED", 0), ("CONFLICT", "SUCCEEDED", 0), ("CONFLICT", "SUCCEEDED", 0), ("CONFLICT", "SUCCEEDED", 0),
    ]
    ended = [(j, k, "") for j in (1, 2) for k in ("CREATE", "CLAIM", "GIVE_UP")]
    assert [v[0] for v in verdicts(spark, [*ended, (1, "RETRY", ""), (2, "RETRY", ""), (1, "CLAIM", ""), (1, "GIVE_UP", ""), (2, "RETRY", "")], quota=1, cooldown_s=35)][6:] == ["ACCEPTED", "CAPACITY", "ACCEPTED", "ACCEPTED", "ACCEPTED"]
    assert [v[0] for v in verdicts(spark, [*ended, (1, "RETRY", ""), (2, "RETRY", "")], cooldown_s=11)][6:] == ["ACCEPTED", "COOLDOWN"]
    assert verdicts(spark, []) == []


def test_the_stream_equals_the_replay_over_micro_batches_and_a_restart(rocks, sf_dir, tmp_path):
    log = requests_log(rocks, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).select("device", "job", "ts", "seq", "kind", "digest")
    rows = log.orderBy("ts", "seq").toPandas()
    want = Counter(map(tuple, jobs.replay_requests(log, 2, REQUEST_COOLDOWN_S).collect()))

    def run():
        source = rocks.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream = streams.requests(source, 2, REQUEST_COOLDOWN_S)
        query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()

    step = len(rows) // 4 + 1
    for k in range(4):  # the query ends and starts again between the second and the third file
        rocks.createDataFrame(rows[k * step : (k + 1) * step], log.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k in (1, 3):
            run()
    got = Counter(map(tuple, rocks.read.parquet(str(tmp_path / "out")).select("device", "seq", "job", "verdict", "status", "outstanding").collect()))
    assert got == want
    assert len({v[3] for v in want}) >= 5


def test_client_commands_need_their_state(spark):
    own = spark.createDataFrame([(1, "UPLOADING", None, None, None, "e", 0), (2, "MODEL_UNAVAILABLE", None, None, "r", None, 0), (3, "MODEL_UNAVAILABLE", "s", "x", "r", None, 0)], "id int, state string, server_id string, server_status string, result string, error string, updated int")
    asked = [
        (1, 1, "COMPLETE_POLLING", None, "COMPLETED", None, "t", "r", None, 5), (1, 2, "COMPLETE_UPLOAD", None, None, "s1", "accepted", None, None, 6), (1, 3, "UPDATE_POLLING", None, None, None, "busy", None, "slow", 7),
        (1, 4, "COMPLETE_POLLING", None, "COMPLETED", None, "done", "r", None, 8), (1, 5, "COMPARE_AND_SET", "READY", "FAILED", None, None, None, None, 9), (1, 6, "COMPARE_AND_SET", "COMPLETED", "FAILED", None, None, None, "why", 10),
        (2, 1, "REQUEST_MODEL_RETRY", None, None, None, None, None, None, 5), (3, 1, "REQUEST_MODEL_RETRY", None, None, None, None, None, None, 5), (3, 2, "COMPLETE_MODEL_RETRY", None, None, None, "again", None, None, 6), (4, 1, "COMPARE_AND_SET", None, "READY", None, None, None, None, 1), (3, 3, "ODD", None, None, None, None, None, None, 7),
    ]
    commands = spark.createDataFrame(asked, "id int, seq int, op string, expected string, new_state string, server_id string, server_status string, result string, error string, at int")
    got = {(r.id, r.seq): tuple(r)[2:] for r in jobs.client_updates(own, commands).collect()}
    assert [got[1, k][0] for k in range(7)] == [None, False, True, True, True, False, True]
    assert got[1, 3][1:] == ("POLLING", "s1", "busy", None, "slow", 7) and got[1, 4][1:] == ("COMPLETED", "s1", "done", "r", None, 8) and got[1, 6][1:] == ("FAILED", "s1", "done", "r", "why", 10)
    assert got[2, 1] == (False, "MODEL_UNAVAILABLE", None, None, "r", None, 0)
    assert got[3, 1][1:] == ("RETRY_REQUESTED", "s", "x", None, None, 5) and got[3, 2] == (True, "POLLING", "s", "again", None, None, 6) and got[3, 3][0] is False
    assert got[4, 1] == (False, *[None] * 6)
