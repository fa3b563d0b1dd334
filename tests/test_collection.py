"""Snapshots and the vector collection on top of them."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from corpusloom.operators import knn
from corpusloom.sources.snapshots import Change, Snapshots
from corpusloom.sources.vectors import VectorCollection


def _set(df):
    return sorted(tuple(r) for r in df.collect())


def test_two_tables_in_one_version(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/s")
    assert store.versions() == [] and store.open().tables() == []
    groups, members = spark.createDataFrame([(1, "a")], "id long, scan string"), spark.createDataFrame([(1, 10), (1, 11)], "id long, record long")
    first = store.commit(store.open(), {"groups": Change(store.stage("groups", groups)), "members": Change(store.stage("members", members))}, "scan a")
    assert first.version == 1 and first.note == "scan a"
    # A job that dies between its two writes: nothing of it is seen.
    store.stage("groups", groups.withColumn("scan", F.lit("b")))
    seen = store.open()
    assert seen.version == 1 and _set(seen.table("groups")) == [(1, "a")] and _set(seen.table("members")) == [(1, 10), (1, 11)]
    second = store.commit(seen, {"groups": Change(store.stage("groups", groups.withColumn("scan", F.lit("b")))), "members": Change(store.stage("members", members.limit(1)), more=True)})
    assert _set(second.table("groups")) == [(1, "b")] and second.table("members").count() == 3
    assert _set(seen.table("groups")) == [(1, "a")] and seen.table("members").count() == 2  # its reader stays where it was
    with pytest.raises(AnalysisException):  # the other writer that began at version 1
        store.commit(first, {"groups": Change()})
    third = store.commit(second, {"groups": Change()})
    assert third.tables() == ["members"]
    assert len(store.compacted("members").files) == 1 and store.open().table("members").count() == 3
    assert store.forget(keep=1) > 0 and store.versions() == [4] and store.open().table("members").count() == 3
    with pytest.raises(ValueError, match="no version"):
        store.open(2)


def test_parts_that_change(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([(i, i % 4) for i in range(20)], "x long, p long")
    at = store.commit(store.open(), {"t": Change(store.stage("t", rows, "p"))})
    old = at.folders("t")
    at = store.commit(at, {"t": Change(store.stage("t", rows.filter("p = 1").limit(2), "p"), parts=[1, 2])})
    assert sorted(at.folders("t")) == [0, 1, 3] and at.folders("t")[0] == old[0] and at.folders("t")[1] != old[1]
    assert at.table("t").count() == 12 and _set(at.table("t", [1], by="p").select("p").distinct()) == [(1,)]


def _points(rng, n, d=5, first=0):
    return [(first + i, [rng.gauss(0, 1) + 4 * ((first + i) % 3 == k) for k in range(d)], f"p{i % 2}") for i in range(n)]


def _exact(spark, points, queries, k, threshold):
    both = spark.createDataFrame(points, "id long, vector array<double>, kind string")
    asked = F.col("id").isin(queries)
    hits = knn.knn_join(both, k, threshold, 10**6, asked)
    return {(r["q_id"], r["m_id"]) for r in hits.collect()}


def test_collection_stays_exact_and_rewrites_what_it_touches(spark, tmp_path):
    rng = random.Random(7)
    schema = "id long, vector array<double>, kind string"
    points = _points(rng, 600) + [(5000, [0.0] * 5, "zero"), (5001, None, "null")]
    c = VectorCollection(spark, f"file://{tmp_path}/c", per_cell=40, place_parts=4)
    c.upsert(spark.createDataFrame(points, schema))
    before = c.store.open().folders("cells")
    assert len(before) > 8
    queries = [p[0] for p in points[::20]]
    asked = spark.createDataFrame([p for p in points if p[0] in queries], schema)

    def found():
        return {(r["q_id"], r["m_id"]) for r in c.search(asked, 10, 0.65).collect() if r["q_id"] != r["m_id"]}

    assert found() == _exact(spark, points, queries, 10, 0.65) != set()
    # One per cent of new points near one place: few cells are written again.
    near = [(10_000 + i, [x + rng.gauss(0, 0.01) for x in points[3][1]], "new") for i in range(6)]
    near[0] = (points[3][0], near[0][1], "moved")
    c.upsert(spark.createDataFrame(near, schema))
    after = c.store.open().folders("cells")
    assert 1 <= sum(after[p] != before.get(p) for p in after) <= 4
    points = [p for p in points if p[0] != points[3][0]] + near
    assert found() == _exact(spark, points, queries, 10, 0.65)
    assert _set(c.points(spark.createDataFrame([(points[0][0],), (10_001,), (5001,), (77_777,)], "id long")).select("id", "kind")) == sorted([(0, "p0"), (10_001, "new"), (5001, "null")])
    # What was there is read from the version that was opened.
    pinned = c.store.open()
    c.delete(spark.createDataFrame([(10_001,), (123_456,)], "id long"))
    c.delete_where(F.col("kind") == "p1")
    assert c.points().filter("kind = 'p1'").count() == 0 < pinned.table("cells").filter("kind = 'p1'").count()
    points = [p for p in points if p[2] != "p1" and p[0] != 10_001]
    queries = [p[0] for p in points[::20]]
    asked = spark.createDataFrame([p for p in points if p[0] in queries], schema)
    assert found() == _exact(spark, points, queries, 10, 0.65)
    c.rebuild()
    assert found() == _exact(spark, points, queries, 10, 0.65)
    only = [p for p in points if p[2] == "new" or p[0] in queries]
    hits = {(r["q_id"], r["m_id"]) for r in c.search(asked, 10, 0.65, F.col("kind") == "new").collect()}
    assert hits and {m for _, m in hits} <= {p[0] for p in only if p[2] == "new"}


def test_dimension_change_empties_the_collection(spark, tmp_path):
    c = VectorCollection(spark, f"file://{tmp_path}/c", per_cell=10)
    assert c.dimension() is None and not c.ensure(3) and c.ensure(3)
    c.upsert(spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "id long, vector array<double>"))
    with pytest.raises(ValueError, match="3 dimensions"):
        c.upsert(spark.createDataFrame([(2, [1.0, 0.0])], "id long, vector array<double>"))
    assert c.points().count() == 1
    assert not c.ensure(2) and c.dimension() == 2 and c.search(spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<double>")).count() == 0
    c.upsert(spark.createDataFrame([(7, [1.0, 1.0]), (8, [1.0, 1.0])], "id long, vector array<double>"))
    assert {(r["q_id"], r["m_id"]) for r in c.search(spark.createDataFrame([(9, [2.0, 2.0])], "id long, vector array<double>")).collect()} == {(9, 7), (9, 8)}
    c.upsert(spark.createDataFrame([], "id long, vector array<double>"))
    assert c.points().count() == 2
