"""Job states over time: creation once, lawful transitions, leases that run out. The same columns serve batches and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: States that may follow each state.
NEXT = {"queued": ("running", "failed"), "running": ("queued", "completed", "failed"), "completed": (), "failed": ()}
LEASE_SECONDS, KEEP_SECONDS = 60, 7 * 24 * 3600


def allowed(before: Column, after: Column) -> Column:
    """May a job go from one state to another? A new job is queued."""
    out = before.isNull() & (after == "queued")
    for state, then in NEXT.items():
        if then:
            out = out | ((before == state) & after.isin(*then))
    return F.coalesce(out, F.lit(False))


def transitions(events: DataFrame) -> DataFrame:
    """events (job_id, ts, status, ...) with `before`, the job's last state, and whether the step is `lawful`."""
    line = Window.partitionBy("job_id").orderBy("ts", "status")
    return events.withColumn("before", F.lag("status").over(line)).withColumn("lawful", allowed(F.col("before"), F.col("status")))


def latest(events: DataFrame) -> DataFrame:
    """(job_id, status, ts) of each job's last event; ties go to the later name. Partial results are merged before the shuffle."""
    return events.groupBy("job_id").agg(F.max(F.struct("ts", "status")).alias("x")).select("job_id", "x.status", "x.ts")


def claimable(jobs: DataFrame, n: int) -> DataFrame:
    """The n oldest queued jobs."""
    return jobs.where("status = 'queued'").orderBy("created_at", "job_id").limit(n)


def expired(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease has run out; they are queued again."""
    return jobs.where((F.col("status") == "running") & (F.col("lease_expires_at") <= now)).withColumns({"status": F.lit("queued"), "worker_id": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast("timestamp")})


def finished(jobs: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs after reports (job_id, worker, outcome), and the reports that conflict: no such job, not running, or of another worker."""
    met = reports.join(jobs.select("job_id", "status", "worker_id"), "job_id", "left")
    reason = F.when(F.col("status").isNull(), "missing").when(F.col("status") != "running", "state").when(~F.col("worker_id").eqNullSafe(F.col("worker")), "worker")
    met = met.withColumn("conflict", reason)
    good = met.where("conflict IS NULL").select("job_id", "outcome")
    return jobs.join(good, "job_id", "left").withColumn("status", F.coalesce("outcome", "status")).drop("outcome"), met.where("conflict IS NOT NULL").select("job_id", "worker", "outcome", "conflict")


def created_once(stream: DataFrame, ts: str = "ts", within: str = "7 days") -> DataFrame:
    """The first event of each job id, for as long as `within`; later ones are dropped."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(["job_id"])


def windowed(stream: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events (status, value) per window and status."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), "status").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "status", "n", "total")


def lifecycle(stream: DataFrame, lease_seconds: int = LEASE_SECONDS, late: str = "10 minutes", keep_seconds: int = KEEP_SECONDS) -> DataFrame:
    """(job_id, status, lawful, ts) of a stream (job_id, ts, status): every step against the state kept per job.

    A running job that says again that it runs has its lease extended. One without news for its lease is queued again, by event
    time, and goes on from there, no matter in which batch its next event comes. A waiting job is never forgotten; a finished
    one is for keep_seconds after its end, so that late events don't make it a new job.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        now, since = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            if now == "running":
                now, since = "queued", since + lease_seconds * 1000
                out.append((key[0], now, True, pd.Timestamp(since, unit="ms")))
            else:
                now = None
        else:
            rows = pd.concat(batches).sort_values(["ts", "status"])
            for status, ts in zip(rows["status"], rows["ts"], strict=True):
                at = int(ts.timestamp() * 1000)
                if now == "running" and since + lease_seconds * 1000 < at:
                    now, since = "queued", since + lease_seconds * 1000
                    out.append((key[0], now, True, pd.Timestamp(since, unit="ms")))
                lawful = status == "queued" if now is None else status in NEXT.get(now, ()) or status == now == "running"
                out.append((key[0], status, lawful, ts))
                if lawful:
                    now, since = status, max(since, at)
        if now is None:
            if state.exists:
                state.remove()
        else:
            state.update((now, since))
            if now != "queued":
                wait = lease_seconds if now == "running" else keep_seconds
                state.setTimeoutTimestamp(max(since + wait * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job_id", "status", "lawful", "ts"])

    return stream.withWatermark("ts", late).groupBy("job_id").applyInPandasWithState(step, "job_id string, status string, lawful boolean, ts timestamp", "status string, since long", "append", GroupStateTimeout.EventTimeTimeout)


class Leases(StatefulProcessor):
    """What is known of each job: its status, its worker, when its lease runs out, and when it is forgotten."""

    def __init__(self, lease_seconds: int = LEASE_SECONDS, keep_seconds: int = KEEP_SECONDS):
        self.lease_ms, self.keep_ms = lease_seconds * 1000, keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, worker string, until long")

    def _put(self, status: str, worker: str | None, until: int, timers: set[int]) -> None:
        """Keeps a job's state; until is when its one timer goes off, 0 for none."""
        for t in timers - {until}:
            self.handle.deleteTimer(t)
        if until and until not in timers:
            self.handle.registerTimer(until)
        self.job.update((status, worker, until))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        out = []
        status, worker, until = self.job.get() if self.job.exists() else (None, None, 0)
        # Of events at one time, a job's creation comes first, then news of a run, then its end.
        frame = pd.concat(list(rows))
        frame = frame.assign(rank=frame["event"].map(EVENTS)).sort_values(["ts", "rank", "worker"], na_position="first")
        for event, by, ts in zip(frame["event"], frame["worker"], frame["ts"], strict=True):
            at, by = int(ts.timestamp() * 1000), by if isinstance(by, str) else None
            if status == "running" and until <= at:
                out.append(_row(key[0], "lease_expired", until, "queued", None, None, None))
                status, worker, until = "queued", None, 0
            problem = None
            if event == "create":
                if status is None:
                    status = "queued"
                else:
                    problem = "exists"
            elif status is None:
                problem = "missing"
            elif event == "claim":
                if status != "queued":
                    problem = "state"
                else:
                    status, worker, until = "running", by, at + self.lease_ms
            elif status != "running":
                problem = "state"
            elif worker != by:
                problem = "worker"
            elif event == "heartbeat":
                until = max(until, at + self.lease_ms)
            elif event == "release":
                status, worker, until = "queued", None, 0
            elif event in ("complete", "fail"):
                status, until = {"complete": "completed", "fail": "failed"}[event], at + self.keep_ms
            else:
                problem = "event"
            out.append(_row(key[0], event, at, status, worker, until if status == "running" else None, problem))
        timers = set(self.handle.listTimers())
        if status is not None:
            # A timer never lies behind the watermark, else it would not go off.
            self._put(status, worker, until, timers)
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        out = []
        if self.job.exists():
            status, worker, until = self.job.get()
            if until and until <= expiredTimerInfo.getExpiryTimeInMs():
                if status == "running":
                    out.append(_row(key[0], "lease_expired", until, "queued", None, None, None))
                    self.job.update(("queued", None, 0))
                else:
                    self.job.clear()
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


#: Events of jobs, in the order in which those of one time count.
EVENTS = {"create": 0, "claim": 1, "heartbeat": 2, "release": 3, "complete": 4, "fail": 5}
COLUMNS = ["job_id", "event", "ts", "status", "worker", "lease_until", "problem"]


def _row(job: str, event: str, at: int, status: str | None, worker: str | None, until: int | None, problem: str | None) -> tuple:
    stamp = lambda ms: pd.Timestamp(ms, unit="ms") if ms is not None else pd.NaT
    return job, event, stamp(at), status, worker, stamp(until), problem


def leases(stream: DataFrame, lease_seconds: int = LEASE_SECONDS, late: str = "10 minutes", keep_seconds: int = KEEP_SECONDS) -> DataFrame:
    """A row for each event of a stream (job_id, ts, event, worker), and for each lease that runs out.

    Rows (job_id, event, ts, status, worker, lease_until, problem) show the job after the event. `problem` says why an event changed nothing: the job
    exists already, is missing, is in another state, or belongs to another worker. A claim makes a queued job its worker's until
    a lease ends, each heartbeat of that worker extends it, and where it runs out, by event time, the job is queued again
    without a worker. A finished job is forgotten keep_seconds after its end, a waiting one never. Needs the state store on
    RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    schema = "job_id string, event string, ts timestamp, status string, worker string, lease_until timestamp, problem string"
    return stream.withWatermark("ts", late).groupBy("job_id").transformWithStateInPandas(Leases(lease_seconds, keep_seconds), schema, "Append", "EventTime")
