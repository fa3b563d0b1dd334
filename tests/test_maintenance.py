"""Groups after changes are those of a run over everything, and the work goes with the change."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import knn
from corpusloom.operators.maintenance import Neighbours
from corpusloom.sources.vectors import VectorCollection

SCHEMA = "id long, vector array<double>"


def _all(spark, points):
    df = spark.createDataFrame(points, SCHEMA)
    pairs = knn.candidate_pairs(knn.knn_join(df, 10, 0.8, 10**6)).withColumn("score", F.round("score", 12))
    groups = {(r["group_id"], r["member"], round(r["avg_confidence"], 9)) for r in knn.clique_cover(pairs).collect()}
    return {(r["a"], r["b"], round(r["score"], 9)) for r in pairs.collect()}, groups


def test_changes_equal_a_run_over_everything(spark, tmp_path):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(25)]

    def near(i):
        return [x + rng.gauss(0, 0.22) for x in centres[i % 25]]

    points = {i: near(i) for i in range(240)}
    n = Neighbours(VectorCollection(spark, f"file://{tmp_path}/c", per_cell=30, place_parts=4), 10, 0.8)

    def check():
        pairs, groups = _all(spark, list(points.items()))
        assert {(r["a"], r["b"], round(r["score"], 9)) for r in n.store.open().table("edges").collect()} == pairs
        assert {(r["group_id"], r["member"], round(r["avg_confidence"], 9)) for r in n.groups().collect()} == groups

    n.changed(spark.createDataFrame(list(points.items()), SCHEMA))
    check()
    change = {3: near(4), 240: near(3), 241: near(7)}
    points |= change
    gone = [8, 33]
    for i in gone:
        points.pop(i)
    did = n.changed(spark.createDataFrame(list(change.items()), SCHEMA), spark.createDataFrame([(i,) for i in gone], "id long"))
    check()
    assert did["searched"] < 120 and did["covered"] < 120
    n.changed(deleted=spark.createDataFrame([(999,)], "id long"))
    check()
    assert n.changed() == {"searched": 0, "looked_at": 0, "covered": 0}
