"""Hard negatives by coordinate pruning in buckets of like length.

Rows are ordered by length, longest first, and cut into buckets of `rows_per_bucket`. A bucket holds, for each coordinate,
its rows in the order of that coordinate of their unit vectors. An anchor that needs scores of at least t meets a bucket
only if its length times the bucket's longest reaches t. There the angle that t allows gives, for each of the anchor's
`focus` largest coordinates, the range of values a row must have; the rows inside all ranges are candidates, and their
inner products are computed exactly. Buckets are met in rounds, each four times as many as before: after a round an
anchor's t is the score of its k-th best so far, so that later rounds give little.

Positives are searched in buckets by (label, length), negatives in buckets by length. An anchor meets all rows, in blocks
of `anchors_per_block` anchors and rows_per_bucket rows; each pair of blocks is one row of a join, of a few hundred
kilobytes. No cut on partners or candidates: only what can't be among the best is left out.

Defined results: rows with a null id, label, vector or component take no part; a shorter vector counts as followed by
zeros; rows that repeat are rows of their own, and an anchor that repeats is searched for each time; of equal scores the
smaller id comes first; an anchor without positives, or a positive without negatives, gives no rows; an empty table gives
no rows; other columns are ignored. Scores that may pass 63 bits are an error.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm import common
from corpusloom.sources import sinks

HIT = "anchor long, slot int, row long, vec_id long, score long"


# --- packed blocks ---------------------------------------------------------------------------------


def _saved(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Lists as rows of the least integers that hold them, padded with zeros."""
    n = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out.astype(np.result_type(np.min_scalar_type(out.min(initial=0)), np.min_scalar_type(-out.max(initial=0) - 1)))


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Consecutive rows of one key, whatever batches they lie in."""
    held, own = [], None
    for batch in batches:
        keys = batch.column(key).to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if keys[a] != own and held:
                yield own, pa.Table.from_batches(held).combine_chunks()
                held = []
            own = int(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield own, pa.Table.from_batches(held).combine_chunks()


def _unit(v: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return v / np.where(norm > 0, norm, 1.0)[:, None]


def _columns(t: pa.Table, *names: str) -> dict[str, np.ndarray]:
    return {c: t.column(c).to_numpy() for c in names}


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, t in _runs(batches, "bucket"):
        v = _matrix(t.column("v").combine_chunks())
        cols = _columns(t, "row", "vec_id", "label", "norm")
        lists = np.argsort(_unit(v, cols["norm"]), axis=0, kind="stable").T.astype(np.uint16 if len(v) <= 1 << 16 else np.uint32)
        body = _saved(v=v, lists=lists, **cols)
        yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([cols["norm"].max()]), pa.array([body], pa.binary())], names=["bucket", "longest", "bucket_body"])


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, t in _runs(batches, "block"):
        v = _matrix(t.column("v").combine_chunks())
        cols = _columns(t, "anchor", "row", "label", "norm")
        n, limits = len(v), t.column("limits").combine_chunks()
        slots = limits.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        place = (np.repeat(np.arange(n), slots), np.arange(slots.sum()) - np.repeat(np.cumsum(slots) - slots, slots))
        flat = limits.flatten()
        low, high, slot = (np.full((n, int(slots.max(initial=1))), x, np.int64) for x in (1, 0, 0))  # low over high: nothing is asked
        low[place], high[place], slot[place] = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("low", "high", "slot"))
        least = np.where(low <= high, low.astype(np.float64), np.inf).min()
        body = _saved(v=v, low=low, high=high, slot=slot, **cols)
        firsts, lasts = t.column("first").to_numpy().min(), t.column("last").to_numpy().max()
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([cols["norm"].max()]), pa.array([least]), pa.array([firsts]), pa.array([lasts]), pa.array([body], pa.binary())], names=["block", "reach", "least", "first", "last", "block_body"])


# --- an anchor in a bucket -------------------------------------------------------------------------


class Bucket:
    """Rows of like length with sorted lists of their coordinates."""

    def __init__(self, body: bytes, exact: type):
        with np.load(io.BytesIO(body)) as z:
            self.row, self.vec_id, self.label, self.norm, self.lists, v = (z[c] for c in ("row", "vec_id", "label", "norm", "lists", "v"))
        self.v, self.longest = v.astype(exact), self.norm.max()
        self._values: dict[int, np.ndarray] = {}

    def values(self, f: int) -> np.ndarray:
        if f not in self._values:
            own = self.lists[f]
            self._values[f] = self.v[own, f] / np.where(self.norm[own] > 0, self.norm[own], 1.0)
        return self._values[f]

    def candidates(self, q: np.ndarray, norm: float, least: float, focus: int) -> np.ndarray | None:
        """Rows whose score with q may reach `least`, as a mask; all rows if least can't be a bound."""
        if least <= 0:
            return np.ones(len(self.row), bool)
        reach = norm * self.longest
        if least > reach * (1 + 1e-9):
            return None
        spread = np.arccos(min(1.0, least / reach))
        unit = q[: self.v.shape[1]] / norm
        inside = None
        for f in np.argsort(-np.abs(unit), kind="stable")[:focus]:
            angle = np.arccos(np.clip(unit[f], -1, 1))
            lo, hi = np.cos(min(np.pi, angle + spread)) - 1e-7, np.cos(max(0.0, angle - spread)) + 1e-7
            a, b = np.searchsorted(self.values(f), [lo, hi], "left")
            mask = np.zeros(len(self.row), bool)
            mask[self.lists[f][a:b]] = True
            inside = mask if inside is None else inside & mask
        return inside

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        d = min(len(q), self.v.shape[1])
        if 2 * len(rows) > len(self.row):
            return (self.v[:, :d] @ q[:d])[rows]
        return self.v[rows, :d] @ q[:d]


def _met(k: int, focus: int, exact: type, same_label: bool):
    """Rows of (block, bucket) pairs -> the k best rows of each slot of each anchor within the slot's limits."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, bucket in zip(batch.column("block_body"), batch.column("bucket_body"), strict=True):
                b = Bucket(bucket.as_py(), exact)
                with np.load(io.BytesIO(block.as_py())) as z:
                    a = {c: z[c] for c in z.files}
                out: list[tuple] = []
                for i in range(len(a["row"])):
                    low, high = a["low"][i], a["high"][i]
                    asks = np.flatnonzero(low <= high)
                    if not len(asks):
                        continue
                    least, most, q = low[asks].min(), high[asks].max(), a["v"][i].astype(exact)
                    inside = b.candidates(q, a["norm"][i], least, focus)
                    if inside is None:
                        continue
                    inside &= (b.label == a["label"][i]) == same_label
                    rows = np.flatnonzero(inside & (b.row != a["row"][i]))
                    s = b.scores(q, rows)
                    fits = (s >= least) & (s <= most)
                    rows, s = rows[fits], s[fits]
                    order = np.lexsort((b.row[rows], b.vec_id[rows], -s))
                    rows, s = rows[order], s[order]
                    for j in asks:
                        at, to = np.searchsorted(-s, -high[j], "left"), np.searchsorted(-s, -low[j], "right")
                        best = slice(at, min(to, at + k))
                        n = best.stop - at
                        if n > 0:
                            out.append((np.full(n, a["anchor"][i]), np.full(n, a["slot"][i][j]), b.row[rows[best]], b.vec_id[rows[best]], s[best]))
                if out:
                    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64), pa.int64()).cast(t) for c, t in zip(cols, kinds, strict=True)], names=["anchor", "slot", "row", "vec_id", "score"])

    return meet


# --- rounds ----------------------------------------------------------------------------------------


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _rounds(anchors: DataFrame, slots: DataFrame, buckets: DataFrame, k: int, meet: Callable, name: str) -> DataFrame:
    """anchor, slot, row, vec_id, score, rank: the k best rows of each slot (anchor, slot, low, high), over all buckets
    that the anchor's block may meet (first to last)."""
    spark = anchors.sparkSession
    most = anchors.groupBy("block").agg((F.max("last") - F.min("first")).alias("reach")).agg(F.max("reach")).first()[0]
    found, lo, size = None, 0, 1
    while most is not None and lo <= most:
        limits = slots
        if found is not None:
            full = found.groupBy("anchor", "slot").agg(F.count("*").alias("n"), F.min("score").alias("worst")).filter(F.col("n") >= k)
            limits = slots.join(full, ["anchor", "slot"], "left").select("anchor", "slot", F.greatest("low", F.coalesce("worst", "low")).alias("low"), "high")
        limits = limits.groupBy("anchor").agg(F.collect_list(F.struct("slot", "low", "high")).alias("limits"))
        packed = anchors.join(limits, "anchor").select("block", "anchor", "row", "label", "norm", "v", "first", "last", "limits")
        blocks = packed.repartition("block").sortWithinPartitions("block", "anchor").mapInArrow(_block, "block long, reach double, least double, first long, last long, block_body binary")
        near = blocks.filter(F.col("first") + lo <= F.col("last")).withColumn("bucket", F.explode(F.sequence(F.col("first") + lo, F.least(F.col("last"), F.col("first") + (lo + size - 1)))))
        pairs = near.join(buckets, "bucket").filter(F.col("reach") * F.col("longest") * (1 + 1e-9) >= F.col("least")).select("block_body", "bucket_body")
        hits = pairs.mapInArrow(meet, HIT)
        found = common.handed_over(_best(hits if found is None else found.select(*hits.columns).unionByName(hits), k), f"{name}-hits")
        lo, size = lo + size, size * 4
    return spark.createDataFrame([], HIT + ", rank int") if found is None else found


def mined(vectors: DataFrame, asks: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, rows_per_bucket: int = 4096, anchors_per_block: int = 512, focus: int = 3) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors has id, label (whole numbers) and vector (an array of whole numbers); asks, over id, says which rows are
    anchors. A positive is one of an anchor's n_positives best other rows of its label; its negatives are the n_negatives
    best rows of other labels whose score is from `low` to `high` per cent of the positive's. low < high; a positive of
    negative score has none."""
    rows = vectors.select(F.col("id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("v"), asks.alias("asks"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL)")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = common.handed_over(rows.select("*", norm.alias("norm"), F.monotonically_increasing_id().alias("row"), (-norm).alias("shorter")), "negatives-rows")
    longest = rows.agg(F.max("norm")).first()[0] or 0.0
    if longest * longest * (1 + 1e-6) >= 2.0**63:
        raise ValueError("scores may pass 63 bits")
    exact = np.float64 if longest * longest * (1 + 1e-6) < 2.0**53 else np.int64

    def bucketed(order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
        placed = common.handed_over(sinks.numbered(rows, order, 0).withColumn("bucket", F.expr(f"id div {rows_per_bucket}")), f"{name}-placed")
        packed = placed.select("bucket", "id", "row", "vec_id", "label", "norm", "v").repartition("bucket").sortWithinPartitions("bucket", "id")
        return placed, common.handed_over(packed.mapInArrow(_bucket, "bucket long, longest double, bucket_body binary"), f"{name}-buckets")

    by_label, label_buckets = bucketed(["label", "shorter", "row"], "negatives-label")
    _, length_buckets = bucketed(["shorter", "row"], "negatives-length")
    reach = by_label.groupBy("label").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    asked = sinks.numbered(by_label.filter("asks").withColumnRenamed("id", "place"), ["place"], 0).withColumnRenamed("id", "anchor")
    asked = asked.join(reach, "label").withColumn("block", F.expr(f"anchor div {anchors_per_block}"))
    asked = common.handed_over(asked.select("anchor", "block", "row", "vec_id", "label", "norm", "v", "first", "last"), "negatives-anchors")

    bound = F.lit(2**62).cast("long")
    any_score = asked.select("anchor", F.lit(0).alias("slot"), (-bound).alias("low"), bound.alias("high"))
    positives = _rounds(asked, any_score, label_buckets, n_positives, _met(n_positives, focus, exact, True), "positives")
    s = F.col("score")
    slots = positives.filter("score >= 0").select("anchor", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), s.alias("positive_score"), F.expr(f"(cast(score AS decimal(20,0)) * {low} + 99) div 100").alias("low"), F.expr(f"(cast(score AS decimal(20,0)) * {high}) div 100").alias("high"))
    slots = common.handed_over(slots.filter("low <= high"), "negatives-slots")
    last = length_buckets.agg(F.max("bucket")).first()[0]
    everywhere = asked.withColumns({"first": F.lit(0).cast("long"), "last": F.lit(last).cast("long")})
    negatives = _rounds(everywhere, slots.select("anchor", "slot", "low", "high"), length_buckets, n_negatives, _met(n_negatives, focus, exact, False), "negatives")
    out = negatives.join(slots.select("anchor", "slot", "positive_id", "positive_score"), ["anchor", "slot"]).join(asked.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    e = common.table(spark, sf_dir, "embeddings")
    whole = e.filter("embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('infinity'))")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = whole.select(F.col("vec_id").alias("id"), label.alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vector"))
    return mined(rows, F.col("id") % 100 == 0)


ORACLE_SQL = """
WITH q AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.rid AS arid, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score FROM q a JOIN q b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0
), p AS (
  SELECT arid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id) AS j FROM s WHERE same QUALIFY j <= 5
), n AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.arid, p.j ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.arid = p.arid AND NOT s.same WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score QUALIFY rank <= 10
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n
"""
