"""Job logs: replayed states, attempts, quotas, cooldowns, idempotent intake.

A log has a key (the job), an order (time and number) and a status or type.
Nothing here reads a clock: ``now`` is a parameter. Null keys are a job of
their own; an empty log gives no rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.texts import fresh_name
from tessella.operators.ranges import running

# The states that hold a place in a device's queue, and limits.
OUTSTANDING = ("QUEUED", "RUNNING", "RETRY_WAIT")
OPEN = ("DRAFT", "READY", "UPLOADING", "POLLING", "RETRY_REQUESTED", "MODEL_UNAVAILABLE", "FAILED")
RECOVERABLE = ("READY", "UPLOADING", "POLLING", "RETRY_REQUESTED")
QUOTA, BASE_DELAY, MOST_DELAY, LEAST_DELAY = 20, 5.0, 300.0, 0.05
MOST_RECENT = 100
# What leads from which state to which; CREATE makes a job, all else is refused.
TRANSITIONS = {
    ("CLAIM", "QUEUED"): "RUNNING", ("DEFER", "RUNNING"): "RETRY_WAIT", ("READY", "RETRY_WAIT"): "QUEUED", ("SUCCEED", "RUNNING"): "SUCCEEDED",
    ("END_PARTLY", "RUNNING"): "PARTIAL", ("GIVE_UP", "RUNNING"): "MODEL_UNAVAILABLE", ("FAIL", "RUNNING"): "FAILED", ("RETRY", "MODEL_UNAVAILABLE"): "QUEUED",
}


def micros_of(ts: str) -> Column:
    """Microseconds since 1970; times without zone are read in the session's."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def last_status(log: DataFrame, *keys: str) -> DataFrame:
    """The newest status of each key, with how many entries it has had.

    ``log``: keys, ts, seq, status. Entries with null status don't count. The
    aggregate combines before the shuffle, so a busy key is no burden.
    """
    newest = F.max(F.struct("ts", "seq", "status"))
    rows = log.where("status is not null").groupBy(*keys).agg(newest.alias("m"), F.count(F.lit(1)).alias("n_entries"))
    return rows.select(*keys, F.col("m.status").alias("status"), F.col("m.ts").alias("ts"), F.col("m.seq").alias("seq"), "n_entries")


def outstanding(states: DataFrame, *keys: str, quota: int = QUOTA) -> DataFrame:
    """How many jobs of each key hold a place, and whether another would be admitted."""
    held = F.count_if(F.col("status").isin(*OUTSTANDING))
    return states.groupBy(*keys).agg(held.alias("outstanding")).withColumn("admits", F.col("outstanding") < quota)


def backoff_seconds(attempts: Column, base: float = BASE_DELAY, most: float = MOST_DELAY) -> Column:
    """Exponential delay after the n-th attempt, between ``LEAST_DELAY`` and ``most``."""
    power = F.pow(F.lit(2.0), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(60)))
    return F.greatest(F.lit(LEAST_DELAY), F.least(F.lit(base) * power, F.lit(most)))


def due_retries(states: DataFrame, attempts: str, now: Column) -> DataFrame:
    """Waiting jobs with the time of their next attempt, and whether it has come."""
    micros = (backoff_seconds(F.col(attempts)) * 1_000_000).cast("bigint")
    at = F.timestamp_micros(micros_of("ts") + micros)
    waiting = states.where(F.col("status") == "RETRY_WAIT").withColumn("next_attempt_at", at)
    return waiting.withColumn("due", F.col("next_attempt_at") <= now)


def attempts(log: DataFrame, key: str, started: str, recorded: tuple[str, ...], succeeded: tuple[str, ...] = ()) -> DataFrame:
    """(key, attempt, started_at, n_outcomes, verdict, available) of every attempt.

    An attempt runs from its start to the next start of the same job. It must
    have exactly one outcome: none is UNKNOWN, several are CONFLICT. ``available``
    says whether the newest outcome is one of ``succeeded``; null without one. A
    job with most of the log's entries is numbered by ranges of them. ``log`` is
    read three times.
    """
    began, n = fresh_name(log, "began"), fresh_name(log, "attempt")
    flagged = log.withColumn(began, (F.col("status") == started).cast("int"))
    numbered = running(flagged, [key], ["ts", "seq"], totals={n: began})
    outcome = F.col("status").isin(*recorded)
    found = numbered.where(F.col(n) > 0).groupBy(key, F.col(n).alias("attempt"))
    out = found.agg(
        F.min("ts").alias("started_at"), F.count_if(outcome).alias("n_outcomes"),
        F.max(F.when(outcome, F.struct("ts", "seq", F.col("status").isin(*succeeded).alias("available")))).alias("newest"),
    )
    verdict = F.when(F.col("n_outcomes") == 0, "UNKNOWN").when(F.col("n_outcomes") == 1, "RECORDED").otherwise("CONFLICT")
    return out.select(key, "attempt", "started_at", "n_outcomes", verdict.alias("verdict"), F.col("newest.available").alias("available"))


def recover(states: DataFrame, tried: DataFrame, key: str, now: Column, most: int, base: float = 0.0) -> DataFrame:
    """What becomes of unfinished jobs when the process starts again: (key, attempt, outcome, status, next_attempt_at).

    ``states``: key, status, attempt_base (attempts made before the present
    cycle), next_attempt_at. ``tried``: key, attempt, n_outcomes, available, as
    ``attempts`` gives them.

    A job that was running gets the outcome UNKNOWN_AFTER_RESTART, which is not
    available, where its last attempt has none. It waits for another attempt only if
    the last outcome isn't available, its cycle has had fewer than ``most``
    attempts and there is a ``base`` delay; so a job that ended after a success is
    queued at once and its result used again. Other running jobs, those without an
    attempt among them, are queued. Jobs that wait without a time are queued, too;
    those with one stay and aren't returned.
    """
    last = tried.groupBy(F.col(key).alias("k")).agg(F.max(F.struct("attempt", "n_outcomes", "available")).alias("a"))
    left = states.where((F.col("status") == "RUNNING") | ((F.col("status") == "RETRY_WAIT") & F.col("next_attempt_at").isNull()))
    left = left.select(F.col(key).alias("job_key"), "status", "attempt_base").join(last, F.col("job_key").eqNullSafe(F.col("k")), "left")
    ran, attempt = F.col("status") == "RUNNING", F.col("a.attempt")
    cycle = attempt - F.coalesce("attempt_base", F.lit(0))
    waits = F.coalesce(ran & attempt.isNotNull() & ~F.coalesce("a.available", F.lit(False)) & (cycle < most) & F.lit(base > 0), F.lit(False))
    at = F.timestamp_micros(F.unix_micros(now) + (backoff_seconds(cycle, base) * 1_000_000).cast("bigint"))
    return left.select(
        F.col("job_key").alias(key), attempt.alias("attempt"), F.when(ran & (F.col("a.n_outcomes") == 0), "UNKNOWN_AFTER_RESTART").alias("outcome"),
        F.when(waits, "RETRY_WAIT").otherwise("QUEUED").alias("status"), F.when(waits, at).alias("next_attempt_at"),
    )


@dataclass
class DeviceDesk:
    """What is known of a device besides its jobs, and the rules by which its requests are judged."""

    quota: int
    cooldown_us: int
    outstanding: int = 0
    last_retry: int | None = None

    def judge(self, kind: str | None, status: str | None, same: bool, us: int) -> tuple[str, str | None]:
        """(verdict, new status) of a request about a job in ``status``, null if there is none; a null status changes nothing.

        CREATE of a known job is REPLAYED if its content is the same, else a
        CONFLICT. Other requests about unknown jobs are NOT_FOUND, and those that
        lead nowhere from the job's state a CONFLICT. New and repeated jobs need a
        place below the quota (CAPACITY), repeated ones also the cooldown since the
        device's last (COOLDOWN).
        """
        if kind == "CREATE":
            if status is not None:
                return ("REPLAYED" if same else "CONFLICT"), None
            target = "QUEUED"
        elif status is None:
            return "NOT_FOUND", None
        else:
            target = TRANSITIONS.get((kind, status))
            if target is None:
                return "CONFLICT", None
        if kind in ("CREATE", "RETRY") and self.outstanding >= self.quota:
            return "CAPACITY", None
        if kind == "RETRY":
            if self.last_retry is not None and us - self.last_retry < self.cooldown_us:
                return "COOLDOWN", None
            self.last_retry = us
        self.outstanding += (target in OUTSTANDING) - (status in OUTSTANDING)
        return "ACCEPTED", target


_REQUESTS = "device bigint, seq bigint, job bigint, verdict string, status string, outstanding bigint"


def replay_requests(log: DataFrame, quota: int = QUOTA, cooldown_s: float = 0.0) -> DataFrame:
    """(device, seq, job, verdict, status, outstanding) of every request, in the order that they came.

    ``log``: device, job, ts, seq, kind, digest. ``status`` is the job's after
    the request (null: there is none), ``outstanding`` the device's. Requests are
    dealt by device and streamed in order of (ts, seq); a task holds the states of one
    device's jobs. Quota and cooldown make a device's requests a sequence, so a
    device with most of them is one long task. Null devices and jobs are left out.
    """
    rows = log.where("device IS NOT NULL AND job IS NOT NULL").select("device", "seq", "job", micros_of("ts").alias("us"), "kind", F.coalesce("digest", F.lit("")).alias("digest"))
    rows = rows.select(*[F.col(c).cast("bigint").alias(c) for c in ("device", "seq", "job", "us")], "kind", "digest").repartition("device").sortWithinPartitions("device", "us", "seq")
    cooldown_us = int(cooldown_s * 1_000_000)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, desk, known = None, DeviceDesk(quota, cooldown_us), {}
        for batch in batches:
            out = []
            for device, seq, job, us, kind, digest in zip(*(c.to_pylist() for c in batch.columns)):
                if device != at:
                    at, desk, known = device, DeviceDesk(quota, cooldown_us), {}
                status, first = known.get(job, (None, digest))
                verdict, new = desk.judge(kind, status, digest == first, us)
                if new is not None:
                    known[job] = new, first
                out.append((device, seq, job, verdict, new or status, desk.outstanding))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], names=[c.split()[0] for c in _REQUESTS.split(", ")])

    return rows.mapInArrow(replay, _REQUESTS)


def idempotent_intake(requests: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """The first request of each key, and whether a later one differs.

    ``requests``: keys, seq, ``digest``. Equal digests are replays of the first;
    different ones are conflicts. Null digests are a value of their own.
    """
    d = F.struct(F.col(digest).isNotNull().alias("known"), F.coalesce(F.col(digest), F.lit("")).alias("value"))
    first, a, z = (fresh_name(requests, c) for c in ("first", "a", "z"))
    out = requests.groupBy(*keys).agg(F.min("seq").alias(first), F.count(F.lit(1)).alias("n_requests"), F.min(d).alias(a), F.max(d).alias(z))
    return out.select(*keys, F.col(first).alias("first_seq"), "n_requests", (F.col(a) != F.col(z)).alias("conflict"))


def cooldown_violations(log: DataFrame, key: str, seconds: float) -> DataFrame:
    """Entries that come sooner than ``seconds`` after the one before of the same key, however many a key has."""
    at, before = fresh_name(log, "at"), fresh_name(log, "before")
    found = running(log.withColumn(at, micros_of("ts")), [key], ["ts", "seq"], lags={before: at})
    return found.withColumn("gap_s", (F.col(at) - F.col(before)) / 1_000_000).drop(at, before).where(F.col("gap_s") < seconds)


def recent(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows in an order: at least 1 and at most ``MOST_RECENT``."""
    return rows.orderBy(*order).limit(min(max(limit, 1), MOST_RECENT))


def with_counts(parents: DataFrame, children: DataFrame, key: str, child_key: str, out_col: str) -> DataFrame:
    """``parents`` with how many children each has; 0 for none."""
    k, n = fresh_name(parents, "child_key"), fresh_name(parents, "n_children")
    counts = children.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias(k)).agg(F.count(F.lit(1)).alias(n))
    joined = parents.join(counts, parents[key] == counts[k], "left")
    return joined.withColumn(out_col, F.coalesce(n, F.lit(0).cast("bigint"))).drop(*{k, n} - {out_col})


def terminal_status(
    n_succeeded: Column, last_available: Column, recapture: Column, n_views: Column, least_views: Column, n_visible: Column, n_issues: Column, risk: Column
) -> Column:
    """How a job ends, from its model runs and what they saw.

    MODEL_UNAVAILABLE if no run succeeded or the last one didn't. PARTIAL if a
    capture must be repeated, distinct views are fewer than the least, nothing was
    seen, captures have issues, or the risk is HIGH. Otherwise SUCCEEDED. Nulls
    count as none, false and no risk.
    """
    number = lambda c: F.coalesce(c, F.lit(0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    partial = yes(recapture) | (number(n_views) < number(least_views)) | (number(n_visible) == 0) | (number(n_issues) > 0) | yes(risk == "HIGH")
    return F.when((number(n_succeeded) == 0) | ~yes(last_available), "MODEL_UNAVAILABLE").when(partial, "PARTIAL").otherwise("SUCCEEDED")


# What a client's command asks of a job's state, and the state that it leads to; null keeps the state.
CLIENT_COMMANDS = {
    "REQUEST_MODEL_RETRY": ("MODEL_UNAVAILABLE", "RETRY_REQUESTED"), "COMPLETE_MODEL_RETRY": ("RETRY_REQUESTED", "POLLING"),
    "COMPLETE_UPLOAD": ("UPLOADING", "POLLING"), "UPDATE_POLLING": ("POLLING", None), "COMPLETE_POLLING": ("POLLING", "given"), "COMPARE_AND_SET": ("given", "given"),
}
_CLIENT_JOB = ("state", "server_id", "server_status", "result", "error", "updated")


def _commanded(job: dict, command: dict) -> bool:
    """Change a client's job as a command says, if its state allows it."""
    op = command["op"]
    if op not in CLIENT_COMMANDS:
        return False
    asked, leads = CLIENT_COMMANDS[op]
    if job["state"] is None or job["state"] != (command["expected"] if asked == "given" else asked):
        return False
    if op == "REQUEST_MODEL_RETRY" and job["server_id"] is None:
        return False
    job["state"] = command["new_state"] if leads == "given" else leads or job["state"]
    job["error"] = command["error"] if op in ("UPDATE_POLLING", "COMPLETE_POLLING", "COMPARE_AND_SET") else None
    if op == "COMPLETE_UPLOAD":
        job["server_id"] = command["server_id"]
    if op in ("COMPLETE_MODEL_RETRY", "COMPLETE_UPLOAD", "UPDATE_POLLING", "COMPLETE_POLLING"):
        job["server_status"] = command["server_status"]
    if op in ("REQUEST_MODEL_RETRY", "COMPLETE_POLLING"):
        job["result"] = None if op == "REQUEST_MODEL_RETRY" else command["result"]
    job["updated"] = command["at"]
    return True


def client_updates(jobs: DataFrame, commands: DataFrame) -> DataFrame:
    """(id, seq, affected, state, server_id, server_status, result, error, updated): each job as it is after each command, and before the first (seq 0).

    ``jobs``: a bigint id and the columns of the result from ``state`` on, at most
    one row an id. ``commands``: id, seq (from 1), op, expected, new_state,
    server_id, server_status, result, error, at. A command changes its job only
    in the state that it asks for (compare and set), and ``affected`` says whether it
    did; a retry also needs a job that the server knows. Commands for unknown jobs
    and unknown commands affect nothing and give rows without state. Jobs and their
    commands are dealt by id and streamed in order; a task holds one job.
    """
    text = lambda names: [F.col(n).cast("string").alias(n) for n in names]
    none = lambda names: [F.lit(None).cast("string").alias(n) for n in names]
    own = jobs.select(F.col("id").cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("seq"), *text(_CLIENT_JOB[:-1]), F.col("updated").cast("bigint").alias("updated"), F.lit(None).cast("string").alias("op"), *none(("expected", "new_state")))
    asked = commands.select(
        F.col("id").cast("bigint").alias("id"), F.col("seq").cast("bigint").alias("seq"), F.lit(None).cast("string").alias("state"), *text(("server_id", "server_status", "result", "error")),
        F.col("at").cast("bigint").alias("updated"), *text(("op", "expected", "new_state")),
    )
    rows = own.unionByName(asked).where("id IS NOT NULL").repartition("id").sortWithinPartitions("id", "seq", "op")
    schema = "id bigint, seq bigint, affected boolean, state string, server_id string, server_status string, result string, error string, updated bigint"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, job = None, dict.fromkeys(_CLIENT_JOB)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["id"] != at:
                    at, job = row["id"], dict.fromkeys(_CLIENT_JOB)
                if row["seq"] == 0:
                    job, affected = {c: row[c] for c in _CLIENT_JOB}, None
                else:
                    affected = _commanded(job, row | {"at": row["updated"]})
                out.append((at, row["seq"], affected, *(job[c] for c in _CLIENT_JOB)))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), *[pa.string()] * 5, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 9, kinds)], names=["id", "seq", "affected", *_CLIENT_JOB])

    return rows.mapInArrow(fold, schema)
