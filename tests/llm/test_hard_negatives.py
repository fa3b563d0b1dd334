"""Hard negatives against a walk over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import hard_negatives

SCHEMA = "id long, label int, vector array<long>, rank string, bucket int"


def _plain(rows, is_anchor, n_pos, n_neg, low, high):
    rows = [(i, r[0], r[1], r[2]) for i, r in enumerate(rows) if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    out = []
    for i, a, label, v in rows:
        if not is_anchor(a):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), b, j, other) for j, b, other, w in rows if j != i))
        for s, p, *_ in [x for x in scored if x[3] == label][:n_pos]:
            fits = [x for x in scored if x[3] != label and low * -s <= 100 * -x[0] <= high * -s][:n_neg]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, *_) in enumerate(fits)]
    return sorted(out)


def _rows(seed, n=400, d=6, spread=40):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3), [round(rng.gauss(0, spread)) for _ in range(d)]) for i in range(n)]
    rows += [(n + i, i % 3, [30, -20, 10, 5, 0, 1]) for i in range(150)]  # one vector holds a quarter of all rows
    rows += [(900 + i, i % 2, [x * 9 for x in rows[i][2]]) for i in range(20)]
    rows += [(20, 1, [1, 2, 3]), (20, 1, [1, 2, 3]), (None, 1, [1]), (40, None, [1]), (60, 1, None), (80, 1, [1, None]), (100, 2, []), (120, 0, [0] * d), (-20, 0, [50] * d), (5, 7, [40] * d)]
    return rows


@pytest.mark.parametrize(("seed", "per_bucket", "per_block", "focus"), [(1, 16, 3, 3), (2, 50, 512, 1), (3, 4096, 5, 6)])
def test_equal_to_a_walk(spark, seed, per_bucket, per_block, focus):
    rows = _rows(seed)
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA).repartition(3)
    got = hard_negatives.mined(df, F.col("id") % 20 == 0, 5, 7, 30, 90, per_bucket, per_block, focus)
    assert sorted(map(tuple, got.collect())) == _plain(rows, lambda a: a % 20 == 0, 5, 7, 30, 90)


def test_scores_past_53_bits(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, [rng.randrange(-(2**29), 2**29) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    got = hard_negatives.mined(df, F.col("id") % 5 == 0, rows_per_bucket=8, anchors_per_block=4)
    assert sorted(map(tuple, got.collect())) == _plain(rows, lambda a: a % 5 == 0, 5, 10, 30, 90)
    with pytest.raises(ValueError, match="63 bits"):
        hard_negatives.mined(spark.createDataFrame([(1, 1, [2**40], None, None)], SCHEMA), F.lit(True))


def test_pruning_leaves_rows_out(spark):
    """On vectors with structure, most rows of a bucket are no candidates."""
    import numpy as np

    rng = np.random.default_rng(1)
    v = np.round(rng.normal(0, 10, (2000, 8)) + np.repeat(np.eye(8) * 300, 250, axis=0)).astype(np.int64)
    norm = np.linalg.norm(v, axis=1)
    lists = np.argsort(v / norm[:, None], axis=0, kind="stable").T.astype(np.uint16)
    b = hard_negatives.Bucket(hard_negatives._saved(row=np.arange(2000), vec_id=np.arange(2000), label=np.zeros(2000, int), norm=norm, lists=lists, v=v), np.float64)
    mask = b.candidates(v[0].astype(float), norm[0], 80_000.0, 3)
    assert mask.sum() < 400 and mask[(v @ v[0]) >= 80_000].all() and ((v @ v[0]) >= 80_000).sum() > 100
    assert b.candidates(v[0].astype(float), norm[0], 10.0**7, 3) is None


def test_no_rows_and_no_anchors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mined(empty, F.col("id") % 2 == 0).count() == 0
    one = spark.createDataFrame([(1, 1, [1], None, None)], SCHEMA)
    assert hard_negatives.mined(one, F.col("id") % 2 == 0).count() == 0
    assert hard_negatives.mined(one, F.col("id") % 2 == 1).count() == 0


def test_query_equals_sql(spark, tmp_path):
    import duckdb

    hard_negatives.op13_hard_negatives(spark, "/root/testdata/sf0.01").write.parquet(str(tmp_path / "out"))
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    cols = "anchor_id, negative_id, negative_score, positive_id, positive_score, rank"
    want, got = f"(select {cols} from ({hard_negatives.ORACLE_SQL}))", f"(select {cols} from '{tmp_path}/out/*.parquet')"
    assert con.execute(f"select count(*) from {want}").fetchone()[0] > 100
    for x, y in ((want, got), (got, want)):
        assert con.execute(f"select count(*) from ({x} except all {y})").fetchall() == [(0,)]
