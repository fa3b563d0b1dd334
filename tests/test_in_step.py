"""Exports in step, timelines, copies, features, counts in passing, chunks of one long key."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunks, copies, features, knn
from corpusloom.sources import sinks
from corpusloom.sources.snapshots import Snapshots
from corpusloom.sources.timeline import Timeline


def test_export_writes_skips_and_removes(spark, tmp_path):
    path, df = f"file://{tmp_path}/x", spark.createDataFrame([(i, i % 5) for i in range(40)], "v long, scan long")
    assert sinks.exported_in_step(df, path, "scan") == {"written": 5, "skipped": 0, "removed": 0}
    files = sorted(tmp_path.glob("x/*/*.json"))
    assert sinks.exported_in_step(df, path, "scan") == {"written": 0, "skipped": 5, "removed": 0}
    assert sorted(tmp_path.glob("x/*/*.json")) == files
    assert sinks.exported_in_step(df.filter("scan > 1").union(spark.createDataFrame([(1, 9), (2, None)], df.schema)), path, "scan") == {"written": 1, "skipped": 3, "removed": 2}
    assert sorted(p.name for p in (tmp_path / "x").glob("scan=*")) == ["scan=2", "scan=3", "scan=4", "scan=9"]
    assert sinks.exported_in_step(df.filter("scan = 2"), path, "scan", refresh=True) == {"written": 1, "skipped": 0, "removed": 3}
    assert sinks.exported_in_step(df.limit(0), path, "scan") == {"written": 0, "skipped": 0, "removed": 1}


def test_timeline_opens_fewer_files(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(minutes=i)) for i in range(1000)]
    df = spark.createDataFrame(random.Random(1).sample(rows, 1000), "i long, ts timestamp")
    log = Timeline(spark, f"file://{tmp_path}/t", "ts", rows_per_file=100)
    assert log.mark("r") is None and log.files() == []
    log.append(df.filter("i < 600"))
    seen, read = log.unread("r")
    assert seen.count() == 600
    log.append(df.filter("i >= 600").union(spark.createDataFrame([(5000, None)], df.schema)))
    log.advanced("r", read)
    assert log.mark("r") == rows[599][1]
    n_all, since = len(log.files()), F.lit(rows[880][1])
    assert n_all >= 9 and len(log.files(since)) <= 3 and {r["i"] for r in log.since(since).collect()} == set(range(880, 1000))
    again, read = log.unread("r")
    assert {r["i"] for r in again.collect()} == set(range(599, 1000))
    log.advanced("r", read)
    assert log.mark("r") == rows[999][1] and log.mark("other") is None
    assert log.since(F.lit(t + dt.timedelta(days=9))).count() == 0


def test_copies_equal_the_join_over_all_rows(spark, monkeypatch):
    monkeypatch.setattr(copies, "MEMBERS_AT_ONCE", 7)
    rng = random.Random(4)
    base = [[float(rng.randrange(-2, 3)) for _ in range(4)] for _ in range(60)]
    rows = [(i, base[rng.randrange(60)] if i % 3 else base[0]) for i in range(200)] + [(300, [0.0] * 4), (301, None), (302, [2.0, 4.0, 0.0, 2.0]), (303, [1.0, 2.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    want, got = ({(r["q_id"], r["m_id"], round(r["score"], 9)) for r in f(df, 6, 0.7).collect()} for f in (knn.knn_join, copies.knn_by_class))
    assert got == want != set()
    assert copies.knn_by_class(df.limit(0)).count() == 0


def test_features_are_computed_once(spark, tmp_path):
    store, asked = Snapshots(spark, f"file://{tmp_path}/f"), []

    def compute(missing):
        asked.append(sorted(r["id"] for r in missing.collect()))
        return missing.filter("id != 3").select("id", F.upper("hash").alias("big"))

    def run(rows):
        return sorted(tuple(r) for r in features.computed(spark.createDataFrame(rows, "id long, hash string"), store, "big", compute, "big string", 4)[0].collect())

    rows = [(1, "a"), (2, "b"), (3, "c")]
    assert run(rows) == [(1, "a", "A"), (2, "b", "B")]
    assert run(rows) == [(1, "a", "A"), (2, "b", "B")]
    assert run([(1, "x"), (4, "d")]) == [(1, "x", "X"), (4, "d", "D")]
    assert run([]) == [] and asked == [[1, 2, 3], [3], [1, 4], []]
    assert sorted(tuple(r) for r in store.open().table("big").collect()) == [(1, "x", "X"), (2, "b", "B"), (4, "d", "D")]


def test_counts_in_passing_need_one_pass(spark, tmp_path):
    df = spark.range(100).withColumn("x", F.col("id") % 3)
    got = sinks.written_with_counts(df, lambda rows: rows.write.parquet(f"file://{tmp_path}/c"), n=F.count(F.lit(1)), zeros=F.count_if(F.col("x") == 0))
    assert got == {"n": 100, "zeros": 34} and spark.read.parquet(f"file://{tmp_path}/c").count() == 100


def _fold(rows, budget, most):
    out = []
    for key in sorted({r[0] for r in rows}, key=str):
        n = filled = chunk = 0
        for size in (max(r[2] or 0, 0) for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2] or 0))):
            if n and (filled + size > budget or n == most):
                out.append((key, chunk, n, filled))
                chunk, n, filled = chunk + 1, 0, 0
            n, filled = n + 1, filled + size
        out.append((key, chunk, n, filled))
    return sorted(out, key=str)


@pytest.mark.parametrize(("most", "segment"), [(4, 4), (5, 64), (50, 100)])
def test_chunks_over_segments_equal_the_fold(spark, most, segment):
    rng = random.Random(most)
    rows = [(1, i, rng.randrange(0, 60)) for i in range(1500)] + [(2, i, 1) for i in range(segment)] + [(3, i, 500) for i in range(segment + 1)] + [(None, i // 2, rng.randrange(90)) for i in range(300)]
    rows += [(4, 0, None), (4, 1, -5), (4, 2, 100), (5, 0, 0)]
    items = spark.createDataFrame(rows, "key long, at long, size long").repartition(5)
    assert sorted((tuple(r) for r in chunks.chunked(items, 100, most, segment).collect()), key=str) == _fold(rows, 100, most)


def test_chunks_of_one_key_of_a_million_rows(spark):
    size = F.pmod(F.xxhash64("id"), F.lit(400)).cast("long")
    items = spark.range(1_000_000).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("at"), size.alias("size"))
    rows = [(7, r["at"], r["size"]) for r in items.toLocalIterator()]
    got = sorted((tuple(r) for r in chunks.chunked(items, 5000).collect()), key=lambda r: r[1])
    n = filled = chunk = 0
    want = []
    for _, _, s in rows:
        if n and (filled + s > 5000 or n == 2048):
            want.append((7, chunk, n, filled))
            chunk, n, filled = chunk + 1, 0, 0
        n, filled = n + 1, filled + s
    assert got == [*want, (7, chunk, n, filled)]
