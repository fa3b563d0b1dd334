"""Greedy chunks in order: an item that would pass the budget, or be one too many, opens the next chunk.

Where the chunk that begins at an item ends depends on the sizes behind it alone, at most `most_items` of them. A key is
cut into segments; each segment sees the first items of the next one and says, for each place where a chunk from before
may first begin in it, where it hands over to the next. These small functions are composed by doubling, a join for each
power of two, so that each segment learns its own first chunk, and walks its chunks by itself. No key passes through one
task, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.sources.tables import handed_over

KEY = ["nokey", "k"]
_CHUNKS = "nokey boolean, k long, seg long, chunk long, n long, filled long"
_SCANNED = _CHUNKS + ", steps binary, hops binary, sums binary"


def chunked(items: DataFrame, budget: int, most_items: int = 2048, segment: int = 1 << 16) -> DataFrame:
    """key, chunk (from 0), n, filled; items has key (long), at (order in the key; ties by size) and size (long).

    Null keys are one key; a null or negative size counts as 0. segment, at least most_items, is how many items of a key a
    task holds at once."""
    if segment < most_items:
        raise ValueError("a segment must hold as many items as a chunk may")
    size = F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0)), F.lit(0)).cast("long")
    rows = items.select(F.col("key").isNull().alias("nokey"), F.coalesce(F.col("key").cast("long"), F.lit(0)).alias("k"), "at", size.alias("size"))
    placed = _placed(rows).withColumn("seg", F.expr(f"place div {segment}")).withColumn("off", F.col("place") % segment)
    #: The first items of a segment are seen by the one before, too.
    seen = F.when((F.col("seg") > 0) & (F.col("off") < most_items), F.array(F.col("seg"), F.col("seg") - 1)).otherwise(F.array("seg"))
    dealt = placed.select(*KEY, F.explode(seen).alias("seg"), "place", "size").repartition(*KEY, "seg").sortWithinPartitions(*KEY, "seg", "place")
    scanned = handed_over(dealt.mapInArrow(_scan(budget, most_items, segment), _SCANNED), "chunks-scanned")
    whole = scanned.filter("chunk >= 0").select(*KEY, "chunk", "n", "filled")
    parts = scanned.filter("chunk < 0").select(*KEY, "seg", "steps", "hops", "sums")
    walked = parts.join(_entries(parts), [*KEY, "seg"]).select(*KEY, "seg", "entry", "hops", "sums").mapInArrow(_walk(segment), _CHUNKS)
    walked = handed_over(walked, "chunks-walked")
    counts = walked.groupBy(*KEY, "seg").agg(F.count("*").alias("m"))
    before = counts.withColumn("before", F.sum("m").over(Window.partitionBy(*KEY).orderBy("seg")) - F.col("m")).select(*KEY, "seg", "before")
    rest = walked.join(before, [*KEY, "seg"]).select(*KEY, (F.col("chunk") + F.col("before")).alias("chunk"), "n", "filled")
    return whole.unionByName(rest).select(F.when(~F.col("nokey"), F.col("k")).alias("key"), "chunk", "n", "filled")


def _placed(rows: DataFrame) -> DataFrame:
    """rows with `place`, from 0 along each key: numbered inside ranges of (key, at), behind what the ranges before hold."""
    ranged = handed_over(rows.repartitionByRange(*KEY, "at", "size").withColumn("part", F.spark_partition_id()), "chunks-ranged")
    counts = ranged.groupBy(*KEY, "part").agg(F.count("*").alias("m"))
    before = counts.withColumn("before", F.sum("m").over(Window.partitionBy(*KEY).orderBy("part")) - F.col("m")).filter("before > 0").drop("m")
    place = F.row_number().over(Window.partitionBy("part", *KEY).orderBy("at", "size"))
    own = ranged.withColumn("own", place).join(before, [*KEY, "part"], "left")
    return own.select(*KEY, (F.col("own") - 1 + F.coalesce("before", F.lit(0))).cast("long").alias("place"), "size")


def _nexts(size: np.ndarray, budget: int, most_items: int) -> tuple[np.ndarray, np.ndarray]:
    """For each item where the chunk that begins with it ends, and the running sums."""
    sums = np.concatenate([[0], np.cumsum(size)])
    here = np.arange(len(size))
    fits = np.searchsorted(sums, sums[:-1] + budget, "right") - 1
    return np.clip(fits, here + 1, np.minimum(here + most_items, len(size))), sums


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray]]:
    """The sizes of each segment, in order, whatever batches they lie in."""
    own, held = None, []
    for batch in batches:
        nokey, k, seg, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("nokey", "k", "seg", "size"))
        if not len(k):
            continue
        edge = np.flatnonzero(np.concatenate([[True], (nokey[1:] != nokey[:-1]) | (k[1:] != k[:-1]) | (seg[1:] != seg[:-1]), [True]]))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            name = (bool(nokey[a]), int(k[a]), int(seg[a]))
            if name != own and held:
                yield own, np.concatenate(held)
                held = []
            own = name
            held.append(size[a:b])
    if held:
        yield own, np.concatenate(held)


def _scan(budget: int, most_items: int, segment: int):
    """Segments -> the chunks of a key that has but one; else steps (first chunk of the next segment by that of this one),
    hops (items of the chunk that begins at each item) and the running sums."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for (nokey, k, seg), size in _segments(batches):
            nexts, sums = _nexts(size, budget, most_items)
            if seg == 0 and len(size) <= segment:
                at, chunk, to = 0, 0, nexts.tolist()
                while at < len(size):
                    done.append((nokey, k, seg, chunk, to[at] - at, int(sums[to[at]] - sums[at]), None, None, None))
                    at, chunk = to[at], chunk + 1
            else:
                n = min(segment, len(size))
                ends, to = [0] * n, nexts[:n].tolist()
                for i in range(n - 1, -1, -1):
                    ends[i] = to[i] - segment if to[i] >= n else ends[to[i]]
                steps = np.maximum(np.array(ends[:most_items], np.int64), 0).astype("<i4")
                hops = (nexts[:n] - np.arange(n)).astype("<i4")
                done.append((nokey, k, seg, -1, 0, 0, steps.tobytes(), hops.tobytes(), sums.astype("<i8").tobytes()))
            if len(done) >= 4096 or done[-1][6] is not None:
                yield _batch(done)
                done = []
        if done:
            yield _batch(done)

    return scan


_TYPES = {"nokey": pa.bool_(), **{c: pa.int64() for c in ("k", "seg", "chunk", "n", "filled", "entry")}, **{c: pa.binary() for c in ("steps", "hops", "sums")}}


def _batch(rows: list[tuple], names=("nokey", "k", "seg", "chunk", "n", "filled", "steps", "hops", "sums")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[n]) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=list(names))


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for own, other in zip(batch.column("steps").to_pylist(), batch.column("far").to_pylist(), strict=True):
            out.append(own if other is None else np.frombuffer(own, "<i4")[np.minimum(np.frombuffer(other, "<i4"), len(own) // 4 - 1)].tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("nokey", "k", "seg")), pa.array(out, pa.binary())], names=["nokey", "k", "seg", "steps"])


def _entries(parts: DataFrame) -> DataFrame:
    """nokey, k, seg, entry: the first item of each segment that begins a chunk."""
    steps = parts.select(*KEY, "seg", "steps")
    most, reach = parts.agg(F.max("seg")).first()[0] or 0, 1
    while reach <= most:
        far = steps.select(*KEY, (F.col("seg") + reach).alias("seg"), F.col("steps").alias("far"))
        steps = handed_over(steps.join(far, [*KEY, "seg"], "left").mapInArrow(_composed, "nokey boolean, k long, seg long, steps binary"), "chunks-steps")
        reach *= 2
    ahead = steps.mapInArrow(_first, "nokey boolean, k long, seg long, entry long")
    return parts.select(*KEY, "seg").join(ahead, [*KEY, "seg"], "left").select(*KEY, "seg", F.coalesce("entry", F.lit(0)).cast("long").alias("entry"))


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where a chunk first begins in the segment behind, if the key's first item begins one."""
    for batch in batches:
        entry = pa.array([int(np.frombuffer(x, "<i4", 1)[0]) for x in batch.column("steps").to_pylist()], pa.int64())
        seg = pa.array(batch.column("seg").to_numpy() + 1, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("nokey"), batch.column("k"), seg, entry], names=["nokey", "k", "seg", "entry"])


def _walk(segment: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("nokey", "k", "seg", "chunk", "n", "filled")
        for batch in batches:
            done: list[tuple] = []
            for nokey, k, seg, entry, hops, sums in zip(*(batch.column(c).to_pylist() for c in ("nokey", "k", "seg", "entry", "hops", "sums")), strict=True):
                hop, at, chunk, total = np.frombuffer(hops, "<i4").tolist(), entry, 0, np.frombuffer(sums, "<i8")
                while at < len(hop):
                    done.append((nokey, k, seg, chunk, hop[at], int(total[at + hop[at]] - total[at])))
                    at, chunk = at + hop[at], chunk + 1
            if done:
                yield _batch(done, names)

    return walk
