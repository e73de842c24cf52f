"""Job queries over ``events``: a user is a job, types are transitions, a user's last digit group a device."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import jobs as J
from tessella.operators.ranges import running
from tessella.plans.common import r6, table

# Which event type stands for which transition; views are only looks.
STATUS = {"signup": "QUEUED", "click": "RUNNING", "error": "RETRY_WAIT", "purchase": "COMPLETED"}
DEVICES = 20
NOW = "2024-01-30 12:00:00"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job, device, ts, seq, status (null for a look), value, props."""
    kind = F.col("event_type")
    status = F.coalesce(*[F.when(kind == k, v) for k, v in STATUS.items()])
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job"), (F.col("user_id") % DEVICES).alias("device"), "ts",
        F.col("event_id").alias("seq"), status.alias("status"), "value", "props",
    )


def last_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.last_status(log(spark, sf_dir), "job")


def outstanding_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.outstanding(J.last_status(log(spark, sf_dir), "device", "job"), "device", quota=6)


def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's delay after its failures so far."""
    failed = log(spark, sf_dir).where("status = 'RETRY_WAIT'").groupBy("job").agg(F.count(F.lit(1)).alias("failures"))
    return failed.withColumn("delay_s", J.backoff_seconds(F.col("failures")))


def due_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that wait; failures so far set the delay."""
    found = J.due_retries(J.last_status(log(spark, sf_dir), "job"), "n_entries", F.lit(NOW).cast("timestamp"))
    return found.select("job", J.micros_of("next_attempt_at").alias("next_us"), "due")


def attempt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.attempts(log(spark, sf_dir), "job", "RUNNING", ("RETRY_WAIT", "COMPLETED"))
    return found.groupBy("job", "verdict").agg(F.count(F.lit(1)).alias("n"))


def unrecorded_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.attempts(log(spark, sf_dir), "job", "RUNNING", ("RETRY_WAIT", "COMPLETED")).where("verdict = 'UNKNOWN'")
    return found.select("job", "attempt", J.micros_of("started_at").alias("started_us"))


def idempotency_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a job under one client key (from the JSON column) must be equal."""
    client = F.get_json_object("props", "$.k").cast("bigint")
    requests = log(spark, sf_dir).select("job", client.alias("client_key"), "seq", F.sha2(F.col("status"), 256).alias("digest"))
    return J.idempotent_intake(requests, ["job", "client_key"], "digest")


def cooldown_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.cooldown_violations(log(spark, sf_dir).where("status = 'RETRY_WAIT'"), "device", 3600.0)
    return found.select("device", "seq", r6("gap_s").alias("gap_s"))


def fifo_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queued job that has waited longest."""
    queued = J.last_status(log(spark, sf_dir), "job").where("status = 'QUEUED'")
    return J.recent(queued, 1, F.asc("ts"), F.asc("seq")).select("job", "seq")


def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.recent(J.last_status(log(spark, sf_dir), "job"), 500, F.desc("ts"), F.desc("seq"))
    return rows.select("job", "status", "seq")


def last_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest failure of each device, across its jobs."""
    newest = F.max(F.struct("ts", "seq", "job", "value"))
    rows = log(spark, sf_dir).where("status = 'RETRY_WAIT'").groupBy("device").agg(newest.alias("m"))
    return rows.select("device", "m.seq", "m.job", "m.value")


def crash_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unfinished jobs after a crash. A job's cycle begins with its newest enqueuing; of waiting jobs every third lost its time.

    A purchase is a success, an error a failure. The crash comes after a job's last
    entry, so running jobs lack the outcome of their last attempt; every second one is
    taken to have crashed after an earlier outcome, its last start left out.
    """
    whole = log(spark, sf_dir)
    state = J.last_status(whole, "job")
    final = state.where("status = 'RUNNING' AND job % 2 = 1").select("job", "seq")
    known = whole.join(final, ["job", "seq"], "left_anti")
    numbered = running(known.withColumn("began", (F.col("status") == "RUNNING").cast("int")), ["job"], ["ts", "seq"], totals={"attempt": "began"})
    base = numbered.where("status = 'QUEUED'").groupBy("job").agg(F.max("attempt").alias("attempt_base"))
    time = F.when(F.col("seq") % 3 != 0, F.col("ts"))
    states = state.join(base, "job", "left").select("job", "status", "attempt_base", time.alias("next_attempt_at"))
    tried = J.attempts(known, "job", "RUNNING", ("RETRY_WAIT", "COMPLETED"), ("COMPLETED",))
    found = J.recover(states, tried, "job", F.lit(NOW).cast("timestamp"), 2, base=5.0)
    return found.select("job", "attempt", "outcome", "status", J.micros_of("next_attempt_at").alias("next_us"))


def requests_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of devices: a user has three jobs; errors and views stand for two kinds each."""
    n, kind = F.col("event_id"), F.col("event_type")
    asked = (
        F.when(kind == "signup", "CREATE").when(kind == "click", "CLAIM").when(kind == "purchase", F.when(n % 4 == 0, "END_PARTLY").otherwise("SUCCEED"))
        .when(kind == "error", F.when(n % 2 == 0, "DEFER").otherwise("GIVE_UP")).otherwise(F.when(n % 3 == 0, "READY").otherwise("RETRY"))
    )
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % DEVICES).alias("device"), (F.col("user_id") * 3 + n % 3).alias("job"), "ts", n.alias("seq"), asked.alias("kind"),
        F.when(n % 5 == 0, F.lit("other")).when(n % 7 != 0, "content").alias("digest"),
    )


REQUEST_QUOTA, REQUEST_COOLDOWN_S = 6, 400_000.0


def request_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.replay_requests(requests_log(spark, sf_dir), REQUEST_QUOTA, REQUEST_COOLDOWN_S)


def _client_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(*map(F.lit, (*J.OPEN, "COMPLETED", "CANCELLED")))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.element_at(states, (F.col("o_orderkey") % 9 + 1).cast("int")).alias("state"))


def client_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a client's jobs, lines as commands, whose kind follows from the keys; the jobs after every command."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    states, ops = F.array(*map(F.lit, (*J.OPEN, "COMPLETED", "CANCELLED"))), F.array(*map(F.lit, (*J.CLIENT_COMMANDS, "OTHER")))
    k = F.col("o_orderkey")
    own = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.element_at(states, (k % 9 + 1).cast("int")).alias("state"), F.when(k % 4 != 0, F.concat(F.lit("s"), k)).alias("server_id"), F.lit("old").alias("server_status"),
        F.lit("r").alias("result"), F.lit("e").alias("error"), F.lit(0).alias("updated"),
    )
    asked = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"), F.max("l_suppkey").alias("supp")).select(
        o.alias("id"), n.alias("seq"), F.element_at(ops, (F.col("part") % 7 + 1).cast("int")).alias("op"), F.element_at(states, (F.col("supp") % 9 + 1).cast("int")).alias("expected"),
        F.element_at(states, (F.col("part") % 9 + 1).cast("int")).alias("new_state"), F.concat(F.lit("n"), n).alias("server_id"), F.concat(F.lit("t"), n).alias("server_status"),
        F.when(n % 2 == 0, F.concat(F.lit("r"), n)).alias("result"), F.when(n % 3 == 0, "failed").alias("error"), (n * 10).alias("at"),
    )
    return J.client_updates(own, asked)


def latest_open_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = _client_jobs(spark, sf_dir).where(F.col("state").isin(*J.OPEN))
    return J.recent(open_, 1, F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", "state")


def recoverable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that a client takes up again, all of them."""
    return _client_jobs(spark, sf_dir).where(F.col("state").isin(*J.RECOVERABLE)).select("o_orderkey", "state")


def latest_client_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.recent(_client_jobs(spark, sf_dir), 20, F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", "state")


def correlated_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of every customer, 0 included."""
    found = J.with_counts(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "n_orders")
    return found.select("c_custkey", "n_orders")


def owned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per customer, reached only through the order that owns them."""
    owner = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey")
    joined = lines.join(owner, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_lines"))


def job_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts are model runs, jobs of every seventh key have none; what the runs saw follows from the job's entries and number."""
    whole = log(spark, sf_dir)
    tried = J.attempts(whole.where("job % 7 <> 0"), "job", "RUNNING", ("RETRY_WAIT", "COMPLETED"), ("COMPLETED",))
    runs = tried.groupBy("job").agg(F.count_if("available").alias("n_succeeded"), F.max_by("available", "attempt").alias("last_available"))
    seen = whole.groupBy("job").agg(F.count_if(F.col("status").isNull()).alias("looks"), F.count_if(F.col("value") > 150).alias("large"), F.max("value").alias("top"))
    j = F.col("job")
    ending = J.terminal_status(
        F.col("n_succeeded"), F.col("last_available"), j % 5 == 1, F.col("looks") % 6, F.lit(2), F.when(j % 11 == 3, 0).otherwise(F.col("looks")),
        F.when(j % 3 == 0, F.col("large")), F.when(F.col("top") > 230, "HIGH").otherwise("LOW"),
    )
    return seen.join(runs, "job", "left").select("job", ending.alias("ending"))


_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items())
LOG_SQL = f"""
WITH log AS (
  SELECT user_id AS job, user_id % {DEVICES} AS device, ts, event_id AS seq, CASE event_type {_CASE} END AS status, value, props FROM events
), last AS (
  SELECT job, device, status, ts, seq, n AS n_entries FROM (
    SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts DESC, seq DESC) AS k, count(*) OVER (PARTITION BY job) AS n
    FROM log WHERE status IS NOT NULL) WHERE k = 1
), numbered AS (
  SELECT *, sum(CASE WHEN status = 'RUNNING' THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS attempt FROM log
), tried AS (
  SELECT job, CAST(attempt AS BIGINT) AS attempt, min(ts) AS started_at, count(*) FILTER (status IN ('RETRY_WAIT', 'COMPLETED')) AS n
  FROM numbered WHERE attempt > 0 GROUP BY 1, 2
)
"""
QUERIES = {
    f.__name__: f
    for f in (
        last_status, outstanding_quota, backoff_schedule, due_retries, attempt_outcomes, unrecorded_attempts, idempotency_conflicts,
        cooldown_violations, fifo_head, recent_jobs, last_of_type, crash_recovery, request_verdicts, client_updates, latest_open_job, recoverable_jobs, latest_client_jobs,
        correlated_count, owned_lines, job_endings,
    )
}
_CLIENT = f"""WITH j AS (
  SELECT o_orderkey, o_orderdate, [{", ".join(f"'{s}'" for s in (*J.OPEN, "COMPLETED", "CANCELLED"))}][o_orderkey % 9 + 1] AS state FROM orders
)
"""
_STATES = lambda states: ", ".join(f"'{s}'" for s in states)
SQL = {
    "crash_recovery": LOG_SQL + f"""
    , known AS (
      SELECT log.*, sum(CASE WHEN log.status = 'RUNNING' THEN 1 ELSE 0 END) OVER (PARTITION BY log.job ORDER BY log.ts, log.seq ROWS UNBOUNDED PRECEDING) AS attempt
      FROM log ANTI JOIN (SELECT job, seq FROM last WHERE status = 'RUNNING' AND job % 2 = 1) f ON log.job = f.job AND log.seq = f.seq
    ), bases AS (
      SELECT job, max(attempt) AS attempt_base FROM known WHERE status = 'QUEUED' GROUP BY job
    ), newest AS (
      SELECT job, attempt, count(*) FILTER (status IN ('RETRY_WAIT', 'COMPLETED')) AS n,
        arg_max(status, (ts, seq)) FILTER (status IN ('RETRY_WAIT', 'COMPLETED')) = 'COMPLETED' AS available
      FROM known WHERE attempt > 0 GROUP BY job, attempt QUALIFY row_number() OVER (PARTITION BY job ORDER BY attempt DESC) = 1
    ), judged AS (
      SELECT last.job, last.status, CAST(attempt AS BIGINT) AS attempt, n, attempt - coalesce(attempt_base, 0) AS cycle,
        last.status = 'RUNNING' AND attempt IS NOT NULL AND NOT coalesce(available, false) AND attempt - coalesce(attempt_base, 0) < 2 AS waits
      FROM last LEFT JOIN bases USING (job) LEFT JOIN newest USING (job) WHERE last.status = 'RUNNING' OR (last.status = 'RETRY_WAIT' AND last.seq % 3 = 0)
    ) SELECT job, attempt, CASE WHEN status = 'RUNNING' AND n = 0 THEN 'UNKNOWN_AFTER_RESTART' END AS outcome, CASE WHEN waits THEN 'RETRY_WAIT' ELSE 'QUEUED' END AS status,
      CASE WHEN waits THEN epoch_us(TIMESTAMP '{NOW}') + CAST(greatest(0.05, least(300.0, 5.0 * pow(2, greatest(cycle - 1, 0)))) * 1000000 AS BIGINT) END AS next_us FROM judged""",
    "request_verdicts": f"""
    WITH RECURSIVE asked AS (
      SELECT user_id % {DEVICES} AS device, user_id * 3 + event_id % 3 AS job, epoch_us(ts) AS us, event_id AS seq,
        CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'click' THEN 'CLAIM' WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'END_PARTLY' ELSE 'SUCCEED' END
          WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'DEFER' ELSE 'GIVE_UP' END ELSE CASE WHEN event_id % 3 = 0 THEN 'READY' ELSE 'RETRY' END END AS kind,
        CASE WHEN event_id % 5 = 0 THEN 'other' WHEN event_id % 7 <> 0 THEN 'content' ELSE '' END AS digest FROM events
    ), rules(kind, held, goes) AS (VALUES {", ".join(f"('{k}', '{s}', '{t}')" for (k, s), t in J.TRANSITIONS.items())}
    ), placed AS (
      SELECT *, row_number() OVER (PARTITION BY device ORDER BY us, seq) AS k FROM asked
    ), walk AS (
      SELECT DISTINCT device, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS job, CAST(NULL AS VARCHAR) AS verdict, CAST(NULL AS VARCHAR) AS status,
        CAST(MAP {{}} AS MAP(BIGINT, STRUCT(s VARCHAR, d VARCHAR))) AS jobs, CAST(0 AS BIGINT) AS outstanding, CAST(NULL AS BIGINT) AS last FROM asked
      UNION ALL
      SELECT device, k, seq, job, verdict, CASE WHEN verdict = 'ACCEPTED' THEN goes ELSE was END,
        CASE WHEN verdict = 'ACCEPTED' THEN map_concat(jobs, MAP {{job: {{'s': goes, 'd': coalesce(first, digest)}}}}) ELSE jobs END,
        outstanding + CASE WHEN verdict = 'ACCEPTED' THEN (CASE WHEN goes IN ('QUEUED', 'RUNNING', 'RETRY_WAIT') THEN 1 ELSE 0 END)
          - (CASE WHEN was IN ('QUEUED', 'RUNNING', 'RETRY_WAIT') THEN 1 ELSE 0 END) ELSE 0 END,
        CASE WHEN verdict = 'ACCEPTED' AND kind = 'RETRY' THEN us ELSE last END
      FROM (SELECT *, CASE WHEN kind = 'CREATE' AND was IS NOT NULL THEN CASE WHEN first = digest THEN 'REPLAYED' ELSE 'CONFLICT' END
          WHEN was IS NULL AND kind <> 'CREATE' THEN 'NOT_FOUND' WHEN goes IS NULL THEN 'CONFLICT'
          WHEN kind IN ('CREATE', 'RETRY') AND outstanding >= {REQUEST_QUOTA} THEN 'CAPACITY'
          WHEN kind = 'RETRY' AND us - last < {int(REQUEST_COOLDOWN_S * 1e6)} THEN 'COOLDOWN' ELSE 'ACCEPTED' END AS verdict
        FROM (SELECT w.device, p.k, p.seq, p.job, p.kind, p.us, p.digest, w.jobs, w.outstanding, w.last, w.jobs[p.job].s AS was, w.jobs[p.job].d AS first,
            CASE WHEN p.kind = 'CREATE' THEN 'QUEUED' ELSE r.goes END AS goes
          FROM walk w JOIN placed p ON p.device = w.device AND p.k = w.k + 1 LEFT JOIN rules r ON r.kind = p.kind AND r.held = w.jobs[p.job].s))
    ) SELECT device, seq, job, verdict, status, outstanding FROM walk WHERE k > 0""",
    "client_updates": f"""
    WITH RECURSIVE names AS (
      SELECT [{_STATES((*J.OPEN, "COMPLETED", "CANCELLED"))}] AS st, [{_STATES((*J.CLIENT_COMMANDS, "OTHER"))}] AS op
    ), asked AS (
      SELECT l_orderkey AS id, CAST(n AS BIGINT) AS seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS k, op[part % 7 + 1] AS op, st[supp % 9 + 1] AS expected, st[part % 9 + 1] AS goes,
        CASE WHEN n % 2 = 0 THEN 'r' || n END AS res, CASE WHEN n % 3 = 0 THEN 'failed' END AS err
      FROM (SELECT l_orderkey, l_linenumber AS n, max(l_partkey) AS part, max(l_suppkey) AS supp FROM lineitem GROUP BY ALL), names
    ), walk AS (
      SELECT o_orderkey AS id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS k, CAST(NULL AS BOOLEAN) AS affected, st[o_orderkey % 9 + 1] AS state, CASE WHEN o_orderkey % 4 <> 0 THEN 's' || o_orderkey END AS server_id,
        'old' AS server_status, 'r' AS result, 'e' AS error, CAST(0 AS BIGINT) AS updated FROM orders, names
      UNION ALL
      SELECT id, nseq, nk, ok, CASE WHEN NOT ok OR op = 'UPDATE_POLLING' THEN state WHEN op = 'REQUEST_MODEL_RETRY' THEN 'RETRY_REQUESTED'
          WHEN op IN ('COMPLETE_MODEL_RETRY', 'COMPLETE_UPLOAD') THEN 'POLLING' ELSE goes END,
        CASE WHEN ok AND op = 'COMPLETE_UPLOAD' THEN 'n' || nseq ELSE server_id END,
        CASE WHEN ok AND op IN ('COMPLETE_MODEL_RETRY', 'COMPLETE_UPLOAD', 'UPDATE_POLLING', 'COMPLETE_POLLING') THEN 't' || nseq ELSE server_status END,
        CASE WHEN ok AND op = 'REQUEST_MODEL_RETRY' THEN NULL WHEN ok AND op = 'COMPLETE_POLLING' THEN res ELSE result END,
        CASE WHEN NOT ok THEN error WHEN op IN ('UPDATE_POLLING', 'COMPLETE_POLLING', 'COMPARE_AND_SET') THEN err END,
        CASE WHEN ok THEN nseq * 10 ELSE updated END
      FROM (SELECT w.*, a.seq AS nseq, a.k AS nk, a.op, a.goes, a.res, a.err,
          coalesce(w.state = CASE a.op WHEN 'REQUEST_MODEL_RETRY' THEN 'MODEL_UNAVAILABLE' WHEN 'COMPLETE_MODEL_RETRY' THEN 'RETRY_REQUESTED' WHEN 'COMPLETE_UPLOAD' THEN 'UPLOADING'
            WHEN 'COMPARE_AND_SET' THEN a.expected WHEN 'OTHER' THEN NULL ELSE 'POLLING' END AND (a.op <> 'REQUEST_MODEL_RETRY' OR w.server_id IS NOT NULL), false) AS ok
        FROM walk w JOIN asked a ON a.id = w.id AND a.k = w.k + 1)
    ) SELECT id, seq, affected, state, server_id, server_status, result, error, updated FROM walk""",
    "latest_open_job": _CLIENT + f"SELECT o_orderkey, state FROM j WHERE state IN ({_STATES(J.OPEN)}) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1",
    "recoverable_jobs": _CLIENT + f"SELECT o_orderkey, state FROM j WHERE state IN ({_STATES(J.RECOVERABLE)})",
    "latest_client_jobs": _CLIENT + "SELECT o_orderkey, state FROM j ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20",
    "last_status": LOG_SQL + "SELECT job, status, ts, seq, n_entries FROM last",
    "outstanding_quota": LOG_SQL + """SELECT device, count(*) FILTER (status IN ('QUEUED', 'RUNNING', 'RETRY_WAIT')) AS outstanding,
      count(*) FILTER (status IN ('QUEUED', 'RUNNING', 'RETRY_WAIT')) < 6 AS admits FROM last GROUP BY device""",
    "backoff_schedule": LOG_SQL + """SELECT job, count(*) AS failures, greatest(0.05, least(5.0 * pow(2.0, least(count(*) - 1, 60)), 300.0)) AS delay_s
      FROM log WHERE status = 'RETRY_WAIT' GROUP BY job""",
    "due_retries": LOG_SQL + f"""SELECT job, next_us, next_us <= epoch_us(TIMESTAMP '{NOW}') AS due FROM (SELECT job, epoch_us(ts)
      + CAST(greatest(0.05, least(5.0 * pow(2.0, least(n_entries - 1, 60)), 300.0)) * 1000000 AS BIGINT) AS next_us FROM last WHERE status = 'RETRY_WAIT')""",
    "attempt_outcomes": LOG_SQL + """SELECT job, verdict, count(*) AS n FROM (SELECT job, CASE WHEN n = 0 THEN 'UNKNOWN' WHEN n = 1 THEN 'RECORDED'
      ELSE 'CONFLICT' END AS verdict FROM tried) GROUP BY ALL""",
    "unrecorded_attempts": LOG_SQL + "SELECT job, attempt, epoch_us(started_at) AS started_us FROM tried WHERE n = 0",
    "idempotency_conflicts": LOG_SQL + """SELECT job, CAST(props ->> '$.k' AS BIGINT) AS client_key, min(seq) AS first_seq, count(*) AS n_requests,
      count(DISTINCT coalesce(status, '')) > 1 AS conflict FROM log GROUP BY 1, 2""",
    "cooldown_violations": LOG_SQL + """SELECT device, seq, round(gap_s, 6) AS gap_s FROM (SELECT device, seq, (epoch_us(ts) - epoch_us(lag(ts) OVER
      (PARTITION BY device ORDER BY ts, seq))) / 1000000 AS gap_s FROM log WHERE status = 'RETRY_WAIT') WHERE gap_s < 3600""",
    "fifo_head": LOG_SQL + "SELECT job, seq FROM last WHERE status = 'QUEUED' ORDER BY ts, seq LIMIT 1",
    "recent_jobs": LOG_SQL + "SELECT job, status, seq FROM last ORDER BY ts DESC, seq DESC LIMIT 100",
    "last_of_type": LOG_SQL + """SELECT device, seq, job, value FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY ts DESC, seq DESC) AS k
      FROM log WHERE status = 'RETRY_WAIT') WHERE k = 1""",
    "correlated_count": "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer",
    "owned_lines": "SELECT o_custkey, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey",
    "job_endings": LOG_SQL + """
    , outcomes AS (
      SELECT job, attempt, arg_max(status, (ts, seq)) FILTER (status IN ('RETRY_WAIT', 'COMPLETED')) = 'COMPLETED' AS available
      FROM numbered WHERE attempt > 0 AND job % 7 <> 0 GROUP BY ALL
    ), runs AS (
      SELECT job, count(*) FILTER (available) AS n_succeeded, first(available ORDER BY attempt DESC) AS last_available FROM outcomes GROUP BY job
    ), seen AS (
      SELECT job, count(*) FILTER (status IS NULL) AS looks, count(*) FILTER (value > 150) AS large, max(value) AS top FROM log GROUP BY job
    ) SELECT job, CASE WHEN coalesce(n_succeeded, 0) = 0 OR NOT coalesce(last_available, false) THEN 'MODEL_UNAVAILABLE'
      WHEN job % 5 = 1 OR looks % 6 < 2 OR job % 11 = 3 OR looks = 0 OR (job % 3 = 0 AND large > 0) OR top > 230 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS ending
      FROM seen LEFT JOIN runs USING (job)""",
}
