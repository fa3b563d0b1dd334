"""Searches in blocks: what a task holds goes with the block, not with the number of cells or rows."""

import numpy as np
import pandas as pd
import pytest

from corpusloom.operators import cells, knn


def test_a_query_is_told_once_however_many_cells_it_reaches():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(400, 6))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    known = pd.DataFrame({"cell": np.arange(400), "n": np.full(400, 5)})
    bins, parts = cells._bins(known, centres, 100)
    assert len(parts) == 20 and sorted(set(bins.tolist())) == list(range(20))
    queries = pd.DataFrame({"id": np.arange(50), "v": list(rng.normal(size=(50, 6))), "least": -1.0})
    out = pd.concat(cells._reached(centres, np.full(400, 3.0), bins, False)(iter([queries])))
    assert len(out) == 50 and all(len(b) == 19 for b in out.bins)
    near = pd.concat(cells._reached(centres, np.full(400, 3.0), bins, True)(iter([queries])))
    assert all(set(a) | set(b) == set(range(20)) for a, b in zip(out.bins, near.bins, strict=True))


def test_a_large_cell_is_a_bin_in_parts():
    known = pd.DataFrame({"cell": [0, 2, 3], "n": [950, 40, 50]})
    bins, parts = cells._bins(known, np.eye(4), 100)
    assert bins[1] == -1 and bins[2] == bins[3] != bins[0] and sorted(parts) == [1, 10]


def test_single_precision_leaves_out_no_neighbour(spark):
    """Scores that differ in the ninth digit only, and equal ones, in more blocks than one."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 16)).repeat(30, axis=0) + rng.normal(size=(360, 16)) * 1e-5
    x[:40] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = (u @ u.T).round(12)
    want = {i: [j for j in np.lexsort((np.arange(len(x)), -s[i]))[:7].tolist() if s[i, j] >= 0.5 and j != i] for i in range(0, 360, 9)}
    got: dict[int, list[int]] = {}
    for r in knn.knn_join(df, 7, 0.5, 25).filter("q_id % 9 = 0").collect():
        got.setdefault(r["q_id"], []).append(r["m_id"])
    for i, own in want.items():
        # Rounded scores next to a rounding step may fall either way.
        assert len(got[i]) == len(own) and np.allclose(np.sort(s[i, got[i]]), np.sort(s[i, own]), rtol=0, atol=2e-12)


@pytest.mark.parametrize("held", [1_000_000, 40])
def test_tiles_give_the_best_of_the_block_whatever_is_held_at_once(monkeypatch, held):
    monkeypatch.setattr(cells, "TILE", 7)
    monkeypatch.setattr(cells, "CELLS_AT_ONCE", held)
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(20, 6)), rng.normal(size=(90, 6))
    y[40:70] = y[3]  # ties, across tiles
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    least = np.where(np.arange(20) % 2, -1.0, 0.6)
    q, m, value = cells._nearest(x.astype(np.float32), y.astype(np.float32), x, y, least, 4)
    want = []
    for i, s in enumerate(x @ y.T):
        best = sorted((j for j in range(90) if s[j] >= least[i]), key=lambda j: (-round(s[j], 12), j))[:4]
        want += [(i, j) for j in best]
    assert list(zip(q.tolist(), m.tolist(), strict=True)) == want
    assert np.allclose(value, (x @ y.T)[q, m])


def test_a_block_has_no_more_rows_for_shorter_vectors(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(cells, "BLOCK_ROWS", 30)
    monkeypatch.setattr(cells, "_bins", lambda known, centres, per_block, f=cells._bins: sizes.append(per_block) or f(known, centres, per_block))
    x = np.random.default_rng(6).normal(size=(200, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    got = {(r["q_id"], r["m_id"]) for r in knn.knn_join(df, 3, 0.5, 50).collect()}
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    assert got == {(i, j) for i in range(200) for j in sorted(range(200), key=lambda j: (-round(s[i, j], 12), j))[:3] if i != j and s[i, j] >= 0.5}
    assert sizes == [30]


def test_the_norm_is_summed_once_a_vector(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id long, vector array<double>")
    units = cells.unit(df)
    assert [(r["id"], r["v"]) for r in units.collect()] == [(1, [0.6, 0.8])]
    plan = units._jdf.queryExecution().optimizedPlan().toString()
    at = plan.index("transform(array(SQRT(aggregate(")
    assert plan.count("aggregate(", at) == 1
