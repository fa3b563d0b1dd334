"""Exact cosine search over cells: vectors lie around centres, and a search leaves out the cells that can't hold a hit.

The angle between a query and a vector of a cell is at least that between query and centre less the cell's radius, so that
a cell whose bound lies below what the query already has is not met. Centres are fitted on a bounded sample; every vector
is in a cell, and results are exact whatever the centres are.

Cells that lie side by side share a bin, a large cell is several parts of one: what meets a query at once, so that a query
is sent as often as the rows fill such blocks, however many cells there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.sources.tables import handed_over

#: Numbers in the vectors that centres are fitted on (32 MB), the most centres, scores that a task holds at once, numbers in
#: the vectors of either side of a block (32 MB), blocks that the rows fill at least, if they have the size for that, and the
#: most rows of a block, however short its vectors are.
FIT_VALUES, MOST_CELLS, CELLS_AT_ONCE, BLOCK_VALUES, LEAST_BLOCKS, BLOCK_ROWS = 4_000_000, 4096, 1_000_000, 4_000_000, 6, 62_500
#: Queries and rows of a tile: its product and what is compared there stay in a core's cache.
TILE = 512
#: Slack of a bound against rounding; of a product of single precision, for each dimension.
SLACK, SINGLE = 1e-6, 6e-8


def unit(vectors: DataFrame) -> DataFrame:
    """vectors with v, of length one, instead of vector; rows without an id, and null and zero vectors, are left out."""
    rows = vectors.withColumn("v", F.col("vector").cast("array<double>")).drop("vector").filter("id IS NOT NULL AND v IS NOT NULL AND exists(v, x -> x != 0)")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    # Inside a lambda over v, norm would be summed anew for each component.
    return rows.withColumn("v", F.transform(F.array(norm), lambda n: F.transform("v", lambda x: x / n))[0])


def fitted(units: DataFrame, n: int, dim: int, per_cell: int) -> np.ndarray:
    """Centres for n vectors, about per_cell in each, by a few rounds of spherical k-means on FIT_VALUES / dim of them, by
    the hash of their ids."""
    cells, rows = int(min(MOST_CELLS, max(1, -(-n // per_cell)))), max(1, FIT_VALUES // max(dim, 1))
    share = min(1.0, 1.2 * rows / max(n, 1))
    sample = units if share == 1.0 else units.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < max(1, int(share * (1 << 20))))
    x = sample.orderBy(F.xxhash64("id")).limit(rows).select("v").toArrow().column("v")
    if not len(x):
        return np.zeros((0, 0))
    x = np.unique(x.combine_chunks().flatten().to_numpy().reshape(len(x), -1), axis=0)
    centres = x[np.random.default_rng(0).permutation(len(x))[:cells]]
    for _ in range(5 if len(centres) > 1 else 0):
        own = np.concatenate([np.argmax(x[i : i + 1000] @ centres.T, axis=1) for i in range(0, len(x), 1000)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where(norm[:, None] > 0, sums / np.where(norm > 0, norm, 1)[:, None], centres)
    return centres


def placed(units: DataFrame, centres: np.ndarray) -> DataFrame:
    """units with `cell`, the nearest centre, and `angle` to it."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                s = np.stack(frame.v.to_numpy()) @ centres.T
                cell = np.argmax(s, axis=1)
                yield frame.assign(cell=cell.astype(np.int64), angle=np.arccos(np.clip(s[np.arange(len(s)), cell], -1, 1)))

    return units.mapInPandas(place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema) + ", cell long, angle double")


def extents(cells: DataFrame) -> DataFrame:
    """cell, n and radius."""
    return cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))


def _bins(known: pd.DataFrame, centres: np.ndarray, per_block: int) -> tuple[np.ndarray, list[int]]:
    """The bin of each centre (-1: its cell has no rows), and how many parts each bin has. Cells are walked from one to the
    nearest that is left; a bin has up to per_block rows, or is one cell in parts of about as many."""
    cell, n = known.cell.to_numpy(), known.n.to_numpy()
    at, left, here = centres[cell], np.ones(len(cell), bool), 0
    bins, parts, filled = np.full(len(centres), -1), [], 0
    while True:
        left[here] = False
        if not parts or filled + n[here] > per_block:
            parts.append(-(-int(n[here]) // per_block))
            filled = 0
        filled += n[here]
        bins[cell[here]] = len(parts) - 1
        if not left.any():
            return bins, parts
        here = int(np.argmax(np.where(left, at @ at[here], -np.inf)))


def _reached(centres: np.ndarray, radius: np.ndarray, bins: np.ndarray, nearest: bool):
    """Queries (id, v, least) -> id, v, least, bins: that of the cell around a query, or all others that may hold a score of
    least. A list for each query: its vector is told once, and goes to the bins one by one later on."""

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there = np.flatnonzero(radius >= 0)
        there = there[np.argsort(bins[there], kind="stable")]
        own = bins[there]
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        for frame in frames:
            for at in range(0, len(frame), step := max(1, CELLS_AT_ONCE // len(centres))):
                part = frame.iloc[at : at + step]
                angle = np.arccos(np.clip(np.stack(part.v.to_numpy()) @ centres[there].T, -1, 1))
                first = own[np.argmin(angle, axis=1)]
                if nearest:
                    yield part.assign(bins=list(first[:, None]))
                    continue
                best = np.cos(np.maximum(0, angle - radius[there]).clip(0, np.pi))
                may = np.logical_or.reduceat(best >= part.least.to_numpy()[:, None] - SLACK, start, axis=1)
                may[np.arange(len(part)), first] = False
                q, met = np.nonzero(may)
                yield part.assign(bins=np.split(met, np.cumsum(np.bincount(q, minlength=len(part)))[:-1]))

    return reach


def _scored(k: int):
    """A block of queries and a block of rows -> the k best of the block for each query that reach its least score.

    Products of single precision say which pairs may be among them, sums of double precision which ones are."""

    def score(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q_id": asked.id.iloc[:0], "m_id": rows.rid.iloc[:0], "score": pd.Series(dtype="float64")})]
        if not len(asked) or not len(rows):
            return out[0]
        rows = rows.sort_values("rid", kind="stable")
        x, y = np.stack(asked.v.to_numpy()), np.stack(rows.rv.to_numpy())
        least, q_ids, m_ids = asked.least.to_numpy(), asked.id.to_numpy(), rows.rid.to_numpy()
        few, many = x.astype(np.float32), y.astype(np.float32)
        for at in range(0, len(x), TILE):
            q, m, value = _nearest(few[at : at + TILE], many, x[at : at + TILE], y, least[at : at + TILE], k)
            out.append(pd.DataFrame({"q_id": q_ids[q + at], "m_id": m_ids[m], "score": value}))
        return pd.concat(out)

    return score


def _nearest(few: np.ndarray, many: np.ndarray, x: np.ndarray, y: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows y of each query x that reach its least score; few and many are x and y in single
    precision. Rows are met tile by tile; the score from which on a row may be among the k best rises with what is found."""
    slack = SLACK + (y.shape[1] + 8) * SINGLE
    floor = (least - slack).astype(np.float32)
    none = np.zeros(0, np.int64)
    best, new, n = (none, none, np.zeros(0)), [], 0
    for at in range(0, len(y), TILE):
        s = few @ many[at : at + TILE].T
        may = s >= floor[:, None]
        hit = np.flatnonzero(may)
        if len(hit) > 4 * k * len(x) and k < s.shape[1]:
            floor = np.maximum(floor, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - np.float32(2 * slack))
            hit = np.flatnonzero(s >= floor[:, None])
        if len(hit):
            new.append((hit // s.shape[1], hit % s.shape[1] + at))
            n += len(hit)
        if n > CELLS_AT_ONCE // 4:
            best, new, n = _kept(best, new, x, y, least, k), [], 0
            full = np.flatnonzero(np.bincount(best[0], minlength=len(x)) == k)
            worst = np.full(len(x), np.inf)
            np.minimum.at(worst, best[0], best[2])
            floor[full] = np.maximum(floor[full], (worst[full] - slack).astype(np.float32))
    return _kept(best, new, x, y, least, k)


def _kept(best: tuple[np.ndarray, np.ndarray, np.ndarray], new: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, y: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best of each query, in order, among `best` and the pairs `new`."""
    if not new:
        return best
    q, m = (np.concatenate(c) for c in zip(*new, strict=True))
    value = _products(x, y, q, m)
    fits = value >= least[q] - SLACK
    q, m, value = (np.concatenate([old, c[fits]]) for old, c in zip(best, (q, m, value), strict=True))
    order = np.lexsort((m, -value.round(12), q))
    q, m, value = q[order], m[order], value[order]
    n = np.bincount(q, minlength=len(x))
    top = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) < k
    return q[top], m[top], value[top]


def _products(x: np.ndarray, y: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The products x[q] and y[m], pair by pair."""
    out = np.empty(len(q))
    for at in range(0, len(q), step := max(1, CELLS_AT_ONCE // x.shape[1])):
        out[at : at + step] = np.einsum("ij,ij->i", x[q[at : at + step]], y[m[at : at + step]])
    return out


def _met(asked: DataFrame, cells: DataFrame, bins: np.ndarray, parts: list[int], k: int, per_block: int) -> DataFrame:
    """Queries (id, v, least, bins) meet the rows of their bins, block by block on either side."""
    spark = asked.sparkSession
    guests = asked.select("id", "v", "least", F.explode("bins").alias("bin"))
    many = guests.groupBy("bin").agg(F.ceil(F.count("*") / per_block).cast("int").alias("guest_blocks"))
    sizes = spark.createDataFrame(list(enumerate(parts)), "bin int, parts int")
    about = F.broadcast(handed_over(sizes.join(many, "bin").select("bin", "parts", "guest_blocks"), "blocks"))
    own = F.broadcast(spark.createDataFrame([(i, int(b)) for i, b in enumerate(bins) if b >= 0], "cell long, bin int"))
    salt = F.xxhash64("id")
    left = guests.join(about, "bin").withColumn("j", F.pmod(salt, F.col("guest_blocks")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = cells.join(own, "cell").join(about, "bin").withColumn("i", F.pmod(salt, F.col("parts")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("guest_blocks") - 1)))
    left = left.select("bin", "i", "j", "id", "v", "least")
    right = right.select(*[F.col(c).alias(f"r{c}") for c in ("bin", "i", "j", "id", "v")])
    return left.groupBy("bin", "i", "j").cogroup(right.groupBy("rbin", "ri", "rj")).applyInPandas(_scored(k), f"q_id {_kind(asked)}, m_id {_kind(cells)}, score double")


def _kind(rows: DataFrame) -> str:
    return rows.schema["id"].dataType.simpleString()


def _best(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc(F.round("score", 12)), "m_id"))
    return hits.withColumn("r", rank).filter(F.col("r") <= k).drop("r")


def searched(queries: DataFrame, cells: DataFrame, about: DataFrame, centres: np.ndarray, k: int, threshold: float, per_block: int = 4000) -> DataFrame:
    """q_id, m_id, score: the k best rows of cells (id, v, cell) for each query (id, v), the query's own row among them, of
    those with a score of threshold or more. Of equal scores (to 12 digits) the lesser m_id comes first.

    about is extents(cells). First each query meets the bin of the cell around it, then those that may hold better than its
    k-th. Blocks have up to per_block rows; more where there are many rows, up to BLOCK_VALUES numbers."""
    known = about.select("cell", "n", "radius").toPandas()  # a row for each of at most MOST_CELLS cells
    if not len(known):
        return queries.sparkSession.createDataFrame([], f"q_id {_kind(queries)}, m_id {_kind(cells)}, score double")
    per_block = min(BLOCK_ROWS, max(1, BLOCK_VALUES // centres.shape[1]), max(per_block, -(-int(known.n.sum()) // LEAST_BLOCKS)))
    radius = np.full(len(centres), -1.0)
    radius[known.cell.to_numpy()] = known.radius.to_numpy()
    bins, parts = _bins(known, centres, per_block)
    asked = queries.select("id", "v", F.lit(float(threshold)).alias("least"))
    if len(parts) == 1:
        return _best(_met(asked.withColumn("bins", F.array(F.lit(0))), cells, bins, parts, k, per_block), k).filter(F.col("score") >= threshold)
    columns = f"id {_kind(queries)}, v array<double>, least double, bins array<int>"
    near = handed_over(_best(_met(asked.mapInPandas(_reached(centres, radius, bins, True), columns), cells, bins, parts, k, per_block), k), "cell-nearest")
    full = near.groupBy("q_id").agg(F.count("*").alias("n"), F.min("score").alias("worst")).filter(F.col("n") >= k)
    asked = queries.join(full, queries["id"] == full["q_id"], "left").select("id", "v", F.greatest(F.lit(float(threshold)), F.coalesce("worst", F.lit(float(threshold)))).alias("least"))
    far = _met(asked.mapInPandas(_reached(centres, radius, bins, False), columns), cells, bins, parts, k, per_block)
    return _best(near.unionByName(far), k).filter(F.col("score") >= threshold)
