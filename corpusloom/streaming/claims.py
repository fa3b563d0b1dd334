"""The job queue as a stateful stream: workers ask for jobs, the oldest due ones are theirs.

A stream has events (queue, kind, job, at, seq, message). Events of a queue wait in its state until the watermark has
passed them and are then taken in the order of (at, seq), so that the order of arrival, and where a stream stops and
starts again, changes nothing. Kinds:

- enqueue: a new job; message may be the time from which on it may run.
- turn: a worker (message) asks; the `per_turn` oldest queued jobs that are due become its own, one attempt more each.
- complete: the job is done. fail: queued again after a backoff, or failed from its max_retries-th attempt on.
- pause: queued again, to run at the time that is the message.
- recover: all running jobs of the queue are queued again at once, as after the loss of all workers.

A job that its worker holds for longer than the lease is queued again by a timer, though nothing else may happen.
A queue's open jobs are what one task holds while it takes a batch of its events; queues are independent.
"""

from __future__ import annotations

import datetime as dt
import heapq
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusloom.streaming.jobs import LIMITED

CHANGES = "queue string, job string, at timestamp, status string, attempts int, run_after timestamp, worker string, error string"
_EVENT = "kind string, job string, at long, seq long, message string"
_JOB = "status string, created long, seq long, attempts int, run_after long, worker string, until long"
#: Events of a queue that are one entry of its state, read and written at once.
EVENTS_AT_ONCE = 1000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def backoff(message: str | None, attempts: int) -> int:
    """Microseconds to wait: a minute where a limit was met, else a second, doubled by every attempt after the first."""
    return (60 if re.search(LIMITED, message or "") else 1) * 1_000_000 << max(attempts - 1, 0)


def _moment(text: str | None) -> int | None:
    try:
        at = dt.datetime.fromisoformat(text or "")
    except ValueError:
        return None
    return round((at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)).timestamp() * 1e6)


class Queue:
    """The open jobs of a queue while events are taken in order. Times are microseconds."""

    def __init__(self, jobs: dict[str, list], per_turn: int, max_retries: int, lease: int | None):
        self.jobs, self.per_turn, self.max_retries, self.lease = jobs, per_turn, max_retries, lease
        self.touched: set[str] = set()
        self.changes: list[tuple] = []
        # Queued jobs that may run, oldest first, those that wait for a time, and leases by their end; entries that a job
        # has left behind are passed over.
        self.due: list[tuple] = []
        self.later: list[tuple] = []
        self.leases: list[tuple] = []
        for job, x in jobs.items():
            self._listed(job, x)

    def _listed(self, job: str, x: list) -> None:
        status, created, seq, _, run_after, _, until = x
        if status == "running":
            if until is not None:
                heapq.heappush(self.leases, (until, created, seq, job))
        elif run_after is None:
            heapq.heappush(self.due, (created, seq, job))
        else:
            heapq.heappush(self.later, (run_after, created, seq, job))

    def _set(self, job: str, at: int, status: str, run_after: int | None = None, worker: str | None = None, error: str | None = None) -> None:
        x = self.jobs[job]
        self.touched.add(job)
        self.changes.append((job, at, status, x[3], run_after, worker, error))
        if status in ("done", "failed"):
            del self.jobs[job]
            return
        x[0], x[4], x[5] = status, run_after, worker
        x[6] = at + self.lease if status == "running" and self.lease is not None else None
        self._listed(job, x)

    def expire(self, until: int) -> None:
        """Leases that end by then."""
        while self.leases and self.leases[0][0] <= until:
            end, created, order, job = heapq.heappop(self.leases)
            x = self.jobs.get(job)
            if x and x[:3] == ["running", created, order] and x[6] == end:
                self._set(job, end, "queued", error="lease")

    def take(self, kind: str, job: str | None, at: int, seq: int, message: str | None) -> None:
        self.expire(at)
        x = self.jobs.get(job)
        if kind == "enqueue" and job is not None and not x:
            self.jobs[job] = ["queued", at, seq, 0, None, None, None]
            self._set(job, at, "queued", _moment(message))
        elif kind == "turn":
            while self.later and self.later[0][0] <= at:
                run_after, created, order, name = heapq.heappop(self.later)
                y = self.jobs.get(name)
                if y and y[:3] == ["queued", created, order] and y[4] == run_after:
                    heapq.heappush(self.due, (created, order, name))
            taken = 0
            while self.due and taken < self.per_turn:
                created, order, name = heapq.heappop(self.due)
                y = self.jobs.get(name)
                if y and y[:3] == ["queued", created, order] and (y[4] is None or y[4] <= at):
                    y[3] += 1
                    self._set(name, at, "running", worker=message)
                    taken += 1
        elif kind == "recover":
            for name in sorted(n for n, y in self.jobs.items() if y[0] == "running"):
                self._set(name, at, "queued", error="recovered")
        elif x and kind == "complete":
            self._set(job, at, "done")
        elif x and kind == "pause":
            self._set(job, at, "queued", _moment(message))
        elif x and kind == "fail" and x[0] == "running":
            if x[3] >= self.max_retries:
                self._set(job, at, "failed", error=message)
            else:
                self._set(job, at, "queued", at + backoff(message, x[3]), error=message)


class Claims(StatefulProcessor):
    """Events of a queue wait for the watermark; the timer of the first of them, or of a lease, sets it going."""

    def __init__(self, per_turn: int, max_retries: int, lease: int | None):
        self.per_turn, self.max_retries, self.lease = per_turn, max_retries, lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "block long", f"events array<struct<{_EVENT}>>")
        self.blocks = handle.getValueState("blocks", "n long")
        self.jobs = handle.getMapState("jobs", "job string", _JOB)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, events = None, []
        for r in rows:
            at = r["at_us"]
            events.append((r["kind"], r["job"], at, r["seq"], r["message"]))
            first = at if first is None else min(first, at)
            if len(events) == EVENTS_AT_ONCE:
                self._wait(events)
                events = []
        self._wait(events)
        if first is not None:
            self.handle.registerTimer(max(first // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def _wait(self, events: list[tuple]) -> None:
        """Blocks have numbers in the order of arrival: of events that are told twice the later one counts."""
        if events:
            n = self.blocks.get()[0] if self.blocks.exists() else 0
            self.waiting.updateValue((n,), (events,))
            self.blocks.update((n + 1,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        told = {}
        for _, (block,) in sorted((name[0], tuple(value)) for name, value in self.waiting.iterator()):
            for event in map(tuple, block):
                kind, job, at, seq, _ = event
                told[at, seq, kind, job or ""] = event
        events = sorted(name for name, event in told.items() if event[2] // 1000 <= passed)
        later = [event for event in told.values() if event[2] // 1000 > passed]
        ahead = min((event[2] for event in later), default=None)
        q = Queue({name[0]: list(value) for name, value in self.jobs.iterator()}, self.per_turn, self.max_retries, self.lease)
        for name in events:
            q.take(*told[name])
        if events:
            self.waiting.clear()
            self.blocks.clear()
            for at in range(0, len(later), EVENTS_AT_ONCE):
                self._wait(later[at : at + EVENTS_AT_ONCE])
        q.expire(passed * 1000 + 999)
        for job in q.touched:
            if job in q.jobs:
                self.jobs.updateValue((job,), tuple(q.jobs[job]))
            elif self.jobs.containsKey((job,)):
                self.jobs.removeKey((job,))
        leases = [x[6] for x in q.jobs.values() if x[0] == "running" and x[6] is not None]
        for at in ([ahead] if ahead is not None else []) + ([min(leases)] if leases else []):
            self.handle.registerTimer(max(at // 1000, passed + 1))
        for job, at, status, attempts, run_after, worker, error in q.changes:
            yield Row(queue=key[0], job=job, at=_timestamp(at), status=status, attempts=attempts, run_after=_timestamp(run_after), worker=worker, error=error)

    def close(self) -> None:
        pass


def _timestamp(us: int | None) -> dt.datetime | None:
    return None if us is None else dt.datetime.fromtimestamp(us // 1_000_000, dt.timezone.utc).replace(microsecond=us % 1_000_000)


def changes(events: DataFrame, per_turn: int = 1, max_retries: int = 3, lease_seconds: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """A stream of all changes of jobs: queue, job, at, status, attempts, run_after, worker, error.

    events is a stream; those without queue, kind or time are left out, a null seq comes first. delay is how far behind the
    latest time of all queues an event may still come; what is later than that is dropped by the watermark."""
    rows = events.filter("queue IS NOT NULL AND kind IS NOT NULL AND at IS NOT NULL").withWatermark("at", delay)
    rows = rows.select("queue", "at", F.unix_micros("at").alias("at_us"), F.coalesce("seq", F.lit(-1)).cast("long").alias("seq"), "kind", F.col("job").cast("string").alias("job"), "message")
    processor = Claims(per_turn, max_retries, None if lease_seconds is None else lease_seconds * 1_000_000)
    return rows.groupBy("queue").transformWithState(processor, CHANGES, "Append", "EventTime")


def run(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Takes what is there, appends the rows to folder, each once whatever fails and starts again, and gives all of them."""
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKSDB)  # state of this kind lies in RocksDB; a query keeps the setting that it began with
    try:
        query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.unset(_PROVIDER) if before is None else conf.set(_PROVIDER, before)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)
