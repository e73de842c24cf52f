"""Job and action logs as streams; each operator has a batch twin in ``operators``.

Processing time only, as the log needs no windows: the state of a key is a few
values, kept in the state store and so safe from lost executors. The rows of one
key in one micro-batch are put in order together; limit a micro-batch by the
source's options.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessella.operators.jobs import _REQUESTS, BASE_DELAY, LEAST_DELAY, MOST_DELAY, OUTSTANDING, QUOTA, DeviceDesk
from tessella.operators.records import ActionState


def append_log(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every new entry of ``log`` to a Parquet log, each exactly once, until no more are there."""
    writer = log.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)


def last_status(log: DataFrame, key: str = "job") -> DataFrame:
    """A row for each key that a micro-batch touches: its newest status so far.

    ``log``: a bigint key, ts, bigint seq, status. Entries may come in any order
    of (ts, seq); null keys and statuses are left out.
    """

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, seq, status, n = state.get if state.exists else (-(1 << 62), -1, "", 0)
        for rows in batches:
            n += len(rows)
            newest = rows.sort_values(["us", "seq"]).iloc[-1]
            if (newest.us, newest.seq) > (ts, seq):
                ts, seq, status = int(newest.us), int(newest.seq), newest.status
        state.update((ts, seq, status, n))
        yield pd.DataFrame({key: [keys[0]], "status": [status], "us": [ts], "seq": [seq], "n_entries": [n]})

    rows = log.where(f"status is not null and {key} is not null").selectExpr(key, "unix_micros(cast(ts as timestamp)) as us", "seq", "status")
    return rows.groupBy(key).applyInPandasWithState(
        update, f"{key} bigint, status string, us bigint, seq bigint, n_entries bigint", "us bigint, seq bigint, status string, n bigint",
        "update", GroupStateTimeout.NoTimeout,
    )


def intake(requests: DataFrame, key: str = "request_key") -> DataFrame:
    """Each request's verdict: ACCEPTED the first time, then REPLAYED, or CONFLICT if its digest differs.

    ``requests``: a string key, bigint seq, digest. Within a micro-batch the
    smallest seq goes first. A null digest is a value of its own.
    """

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = tuple(state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        verdicts = []
        for known, digest in zip(rows["known"], rows["digest"]):
            own = (bool(known), digest)
            verdicts.append("ACCEPTED" if first is None else "REPLAYED" if own == first else "CONFLICT")
            first = own if first is None else first
        state.update(first)
        yield pd.DataFrame({key: keys[0], "seq": rows["seq"].astype("int64"), "verdict": verdicts})

    rows = requests.selectExpr(key, "seq", "digest is not null as known", "coalesce(digest, '') as digest").where(f"{key} is not null")
    return rows.groupBy(key).applyInPandasWithState(
        update, f"{key} string, seq bigint, verdict string", "known boolean, digest string", "append", GroupStateTimeout.NoTimeout
    )


def actions(log: DataFrame, limit: float) -> DataFrame:
    """Every entry's verdict and the session's budget after it, as ``operators.records.replay_actions`` gives them.

    ``log``: session, seq, kind, run, load, valid, as there. A reservation, claim
    or settlement counts once, whichever micro-batch it comes in; entries must
    come in order of seq from one micro-batch to the next. Null sessions are left out.
    """

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            used, reserved, locked, run, claimed, settled = state.get
            now = ActionState(limit, used, reserved, locked, run or None, claimed, set(settled))
        else:
            now = ActionState(limit)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for row in rows.itertuples():
            load = None if pd.isna(row.load) else float(row.load)
            out.append((keys[0], int(row.seq), now.apply(row.kind, row.run, load, bool(row.valid)), now.used, now.reserved, now.locked))
        state.update((now.used, now.reserved, now.locked, now.run or "", now.claimed, sorted(now.settled)))
        yield pd.DataFrame(out, columns=["session", "seq", "verdict", "used", "reserved", "locked"])

    rows = log.selectExpr("session", "seq", "kind", "run", "cast(load as double) as load", "coalesce(valid, false) as valid").where("session is not null")
    return rows.groupBy("session").applyInPandasWithState(
        update, "session bigint, seq bigint, verdict string, used double, reserved double, locked boolean",
        "used double, reserved double, locked boolean, run string, claimed boolean, settled array<string>", "append", GroupStateTimeout.NoTimeout,
    )


class _Requests(StatefulProcessor):
    """A device's desk: its open jobs, its closed ones for as long as repeats are recognised, and its counters."""

    def __init__(self, quota: int, cooldown_us: int, closed_for_ms: int | None):
        self.quota, self.cooldown_us, self.closed_for_ms = quota, cooldown_us, closed_for_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        key, value = "job bigint", "status string, digest string"
        self.open = handle.getMapState("open", key, value)
        self.closed = handle.getMapState("closed", key, value, self.closed_for_ms)
        self.device = handle.getValueState("device", "outstanding bigint, last_retry bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        outstanding, last_retry = self.device.get() if self.device.exists() else (0, None)
        desk = DeviceDesk(self.quota, self.cooldown_us, outstanding, last_retry)
        out = []
        for row in pd.concat(list(rows)).sort_values(["us", "seq"]).itertuples():
            job = (int(row.job),)
            held = next((m for m in (self.open, self.closed) if m.containsKey(job)), None)
            status, first = held.getValue(job) if held else (None, row.digest)
            verdict, new = desk.judge(row.kind, status, row.digest == first, int(row.us))
            if new is not None:
                goes = self.open if new in OUTSTANDING else self.closed
                if held is not None and held is not goes:
                    held.removeKey(job)
                goes.updateValue(job, (new, first))
            out.append((int(key[0]), int(row.seq), job[0], verdict, new or status, desk.outstanding))
        self.device.update((desk.outstanding, desk.last_retry))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _REQUESTS.split(", ")])

    def close(self) -> None:
        pass


def requests(log: DataFrame, quota: int = QUOTA, cooldown_s: float = 0.0, closed_for_s: float | None = None) -> DataFrame:
    """Every request's verdict, as ``operators.jobs.replay_requests`` gives it.

    ``log``: device, job, ts, seq, kind, digest, as there. A device's open jobs are
    kept until they end, its ended ones for ``closed_for_s`` seconds since they ended
    (None: for ever); after that a job's name is free again. Requests must come in
    order of (ts, seq) from one micro-batch to the next. The query needs the RocksDB
    state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = log.where("device IS NOT NULL AND job IS NOT NULL").selectExpr(
        "cast(device AS bigint) AS device", "cast(seq AS bigint) AS seq", "cast(job AS bigint) AS job", "unix_micros(cast(ts AS timestamp)) AS us", "kind", "coalesce(digest, '') AS digest"
    )
    desk = _Requests(quota, int(cooldown_s * 1_000_000), None if closed_for_s is None else int(closed_for_s * 1000))
    mode = "None" if closed_for_s is None else "ProcessingTime"
    return rows.groupBy("device").transformWithStateInPandas(desk, _REQUESTS, "append", mode)


def retries(log: DataFrame, key: str = "job") -> DataFrame:
    """Waiting jobs that are put back in the queue when their delay is over.

    ``log``: a bigint key and status, in order of arrival. Each RETRY_WAIT starts a
    timer of processing time, doubled with every wait of the job between fixed
    bounds; any other status stops it. A row is (key, attempt, status), WAITING when a
    timer starts and QUEUED when it has run out; timers are looked at when a
    micro-batch runs.
    """

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waits, waiting = state.get if state.exists else (0, False)
        status = None
        if state.hasTimedOut:
            state.update((waits, False))
            status = "QUEUED" if waiting else None
        else:
            for rows in batches:
                for entry in rows["status"]:
                    waiting = entry == "RETRY_WAIT"
                    waits += waiting
            state.update((waits, waiting))
            if waiting:
                delay = max(LEAST_DELAY, min(BASE_DELAY * 2.0 ** min(max(waits - 1, 0), 60), MOST_DELAY))
                state.setTimeoutDuration(int(delay * 1000))
                status = "WAITING"
        yield pd.DataFrame({key: [keys[0]], "attempt": [waits], "status": [status]} if status else {key: [], "attempt": [], "status": []})

    rows = log.select(key, "status").where(f"{key} is not null and status is not null")
    return rows.groupBy(key).applyInPandasWithState(
        update, f"{key} bigint, attempt bigint, status string", "waits bigint, waiting boolean", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
