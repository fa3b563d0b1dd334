"""The job queue and the keyed tables as streams.

A queue is a log of events (job, kind, at, seq, message); a job's state is an aggregate of its events that does not depend
on the order in which they arrive, so that late, repeated batches and lost executors give the same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.snapshots import Change, Snapshots

LIMITED = r"(?i)429|rate.?limit|token.?limit|enqueued.+limit"
KINDS = ("enqueue", "claim", "complete", "fail", "pause", "recover")


def backoff_seconds(message: Column, attempts: Column) -> Column:
    """Sixty seconds where a limit was met, else one, doubled by every attempt after the first."""
    base = F.when(F.coalesce(message, F.lit("")).rlike(LIMITED), 60).otherwise(1)
    return (base * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0)))).cast("long")


def job_states(log: DataFrame, max_retries: int = 3) -> DataFrame:
    """job, status, attempts, run_after, error of a batch or a stream of events; a kind that is none of KINDS is left out.

    complete -> done; fail -> queued again after the backoff, or failed from the max_retries-th attempt on; claim -> running;
    enqueue, recover -> queued at once; pause -> queued, to run at the time that is the event's message."""
    last = F.max_by(F.struct("kind", "message", "at"), F.struct("at", "seq"))
    jobs = log.filter(F.col("kind").isin(*KINDS)).groupBy("job").agg(last.alias("last"), F.count_if(F.col("kind") == "claim").alias("attempts"))
    kind, spent = F.col("last.kind"), F.col("attempts") >= max_retries
    status = F.when(kind == "complete", "done").when(kind == "claim", "running").when((kind == "fail") & spent, "failed").otherwise("queued")
    again = F.timestamp_seconds(F.unix_timestamp("last.at") + backoff_seconds(F.col("last.message"), F.col("attempts")))
    run_after = F.when((kind == "fail") & ~spent, again).when(kind == "pause", F.col("last.message").try_cast("timestamp"))
    return jobs.select("job", status.alias("status"), "attempts", run_after.alias("run_after"), F.when(kind == "fail", F.col("last.message")).alias("error"))


def claimable(states: DataFrame, now: Column) -> DataFrame:
    return states.filter((F.col("status") == "queued") & (F.col("run_after").isNull() | (F.col("run_after") <= now)))


def kept_states(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Runs an update-mode stream over what is there; each batch is a folder of its own, written over if it is run again."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/part={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()


def current(kept: DataFrame, key: str) -> DataFrame:
    """The row of the highest version of each key."""
    rest = [c for c in kept.columns if c not in (key, "version", "part")]
    return kept.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("last")).select(key, "last.*")


def latest(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write wins: of each key the change that is last by `order`; for batches and, in update mode, streams."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(*keys, "last.*")


def kept_in(stream: DataFrame, store: Snapshots, name: str, key: str, checkpoint: str, every: int = 10) -> None:
    """Runs an update-mode stream over what is there into a table of a store: each batch is a version, and each `every`-th
    one puts all rows of a key together, so that what current() reads stays near one row per key.

    A version says which batch it ends with; a batch that is run again after its commit is left out."""

    def save(batch: DataFrame, number: int) -> None:
        at = store.open()
        if at.note.isdigit() and int(at.note) >= number:
            return
        rows, there = batch.withColumn("version", F.lit(number).cast("long")), name in at.tables()
        together = there and number % every == every - 1
        if together:
            rows = at.table(name).unionByName(rows)
            rest = [c for c in rows.columns if c != key]
            rows = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("last")).select(key, "last.*")
        store.commit(at, {name: Change(store.stage(name, rows), more=there and not together)}, str(number))

    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
