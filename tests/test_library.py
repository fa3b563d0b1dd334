import itertools
import os
import random

import duckdb
import pytest

from corpusloom.jobs import registry
from corpusloom.operators import knn

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name, tmp_path):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    registry.queries()[name](spark, SF).write.parquet(str(tmp_path / "out"))
    cols = ", ".join(sorted(c[0] for c in con.execute(f"describe {registry.oracle_sql()[name]}").fetchall()))
    want, got = (f"(select {cols} from ({q}))" for q in (registry.oracle_sql()[name], f"select * from '{tmp_path}/out/*.parquet'"))
    for x, y in ((want, got), (got, want)):
        assert con.execute(f"select count(*) from ({x} except all {y})").fetchall() == [(0,)]


@pytest.mark.parametrize(
    ("edges", "groups"),
    [
        ([(5, 7, 0.61), (7, 9, 0.72), (5, 9, 0.55)], [[5, 7, 9]]),
        ([(5, 7, 0.61), (7, 9, 0.72)], [[7, 9]]),
        ([(2, 4, 0.4), (4, 6, 0.7), (6, 8, 0.5), (8, 10, 0.6)], [[4, 6], [8, 10]]),
        ([(30, 31, 0.2), (12, 14, 0.3), (14, 31, 0.1)], [[12, 14], [30, 31]]),
        ([(1, 5, 0.77), (1, 6, 0.7), (5, 6, 0.71), (5, 9, 0.69), (6, 9, 0.68), (1, 8, 0.66)], [[1, 5, 6]]),
        ([(1, 2, 0.5), (3, 4, 0.5), (1, 3, 0.5), (2, 3, 0.5)], [[1, 2, 3]]),
        ([], []),
    ],
)
def test_greedy_groups(edges, groups):
    assert knn.greedy_groups(edges) == groups


def test_cover_has_disjoint_cliques(spark):
    rng = random.Random(5)
    edges = [(a, b, rng.random()) for a, b in itertools.combinations(range(30), 2) if rng.random() < 0.12]
    df = spark.createDataFrame(edges, "a long, b long, score double")
    rows = knn.clique_cover(df).collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["group_id"], []).append(r["member"])
    known = {(a, b) for a, b, _ in edges}
    assert all(p in known for g in groups.values() for p in itertools.combinations(sorted(g), 2))
    assert len(rows) == len({r["member"] for r in rows})
    assert sorted(map(sorted, groups.values())) == sorted(knn.greedy_groups(edges))


def test_knn_in_blocks_and_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    assert {(r["q_id"], r["m_id"]) for r in knn.knn_join(df, 10, 0.65, rows_per_block=1).collect()} == {(1, 2), (2, 1)}
    assert knn.knn_join(df.limit(0)).count() == 0


def test_entry(spark):
    import __spark_entry__

    assert os.path.isdir(SF)
    assert __spark_entry__.entry(spark).count() > 0
