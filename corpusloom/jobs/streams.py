"""Queries that run as streams over the files of `events` until all of them are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.jobs.base import oracle_sql, query
from corpusloom.sources.snapshots import Snapshots
from corpusloom.sources.tables import shared_folder, table
from corpusloom.streaming import claims, jobs

_KIND = {"signup": "enqueue", "click": "claim", "purchase": "complete", "error": "fail", "view": "recover"}


def _events(spark, sf_dir):
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")  # a pattern: the path of one file is none to a stream


def _run(stream, key, name):
    """The stream's final rows, by way of versions in the shared folder."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, name)
    jobs.kept_states(stream, f"{folder}/rows", f"{folder}/progress")
    return jobs.current(spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/part=*"), key)


@query("""WITH s AS (SELECT user_id AS job, max_by(event_type, (ts, event_id)) AS k, max_by(props, (ts, event_id)) AS m, max(ts) AS t_at, count(*) FILTER (WHERE event_type = 'click') AS attempts FROM events GROUP BY 1)
SELECT job, CASE WHEN k = 'purchase' THEN 'done' WHEN k = 'click' THEN 'running' WHEN k = 'error' AND attempts >= 3 THEN 'failed' ELSE 'queued' END AS status, attempts,
CASE WHEN k = 'error' AND attempts < 3 THEN floor(epoch(t_at))::BIGINT + (CASE WHEN regexp_matches(m, '429') THEN 60 ELSE 1 END * pow(2, greatest(attempts - 1, 0)))::BIGINT END AS run_after, CASE WHEN k = 'error' THEN m END AS error FROM s""")
def stream_job_states(spark, sf_dir):
    e = _events(spark, sf_dir)
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _KIND.items()])
    log = e.select(F.col("user_id").alias("job"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.col("props").alias("message"))
    states = _run(jobs.job_states(log), "job", "job-states")
    return states.withColumn("run_after", F.unix_timestamp("run_after"))


@query("SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def stream_upsert(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_id", "ts", "event_type", "value")
    return _run(jobs.latest(e, ["user_id"], ["ts", "event_id"]), "user_id", "upsert")


@query("""WITH e AS (SELECT (user_id % 16)::VARCHAR AS queue, event_id, ts, event_type = 'click' AS turn FROM events WHERE event_type IN ('signup', 'view', 'click')),
o AS (SELECT *, sum(turn::INT) OVER (PARTITION BY queue ORDER BY ts, event_id) - turn::INT AS before FROM e),
j AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY ts, event_id) - 1 AS k FROM o WHERE NOT turn),
w AS (SELECT *, k // 2 + max(before - k // 2) OVER (PARTITION BY queue, k % 2 ORDER BY k) AS at FROM j)
SELECT w.queue, w.event_id::VARCHAR AS job, o.ts AS claimed, 1 AS attempts FROM w JOIN o ON o.turn AND o.queue = w.queue AND o.before = w.at""")
def stream_claims(spark, sf_dir):
    """Each turn of a queue claims its two oldest jobs; without failures, the k-th job of a queue goes to a turn that SQL can tell."""
    kind = F.when(F.col("event_type") == "click", "turn").when(F.col("event_type").isin("signup", "view"), "enqueue")
    log = _events(spark, sf_dir).select((F.col("user_id") % 16).cast("string").alias("queue"), kind.alias("kind"), F.col("event_id").cast("string").alias("job"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.lit(None).cast("string").alias("message"))
    folder = shared_folder(spark, "claims")
    rows = claims.run(claims.changes(log, per_turn=2), f"{folder}/rows", f"{folder}/progress")
    return rows.filter("status = 'running'").select("queue", "job", F.col("at").cast("timestamp_ntz").alias("claimed"), "attempts")


@query(oracle_sql()["stream_upsert"])
def stream_upsert_in_versions(spark, sf_dir):
    """The upsert stream into a store of versions, where rows of a key are put together from time to time."""
    e = _events(spark, sf_dir).select("user_id", "event_id", "ts", "event_type", "value")
    folder = shared_folder(spark, "versions")
    store = Snapshots(spark, f"{folder}/store")
    jobs.kept_in(jobs.latest(e, ["user_id"], ["ts", "event_id"]), store, "latest", "user_id", f"{folder}/progress")
    return jobs.current(store.open().table("latest"), "user_id")
