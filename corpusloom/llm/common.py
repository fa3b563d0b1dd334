"""Shared folder, hand-over tables and vectorised text scans used by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 19

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset and all runs on one machine, as in tests."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    return _own_dir[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corpusloom-{name}-{uuid.uuid4().hex}"


def handed_over(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends here, lost executors don't matter."""
    return Scratch(df.sparkSession).handed_over(df, name)


class Scratch:
    """Hand-over tables that go with the end of a `with` block: what is made of them must be written or collected by then."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def handed_over(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        while self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.drop()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key() -> list[Column]:
    """96 bits that stand for a text (null: empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.crc32(text).alias("t2")]


# --- vectorised scans over the texts of an Arrow batch -----------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20240501).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 2 * STEP_BYTES)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x)
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    up, _ = power(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each pair, from prefix_hash(data)."""
    _, down = power(len(prefix))
    return mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive rows with limit bytes of text or so; a null text is empty."""
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    buffers = texts.buffers()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield slice(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of each word [^\\x20\\x09-\\x0D]+; no word crosses texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


# --- counting 64-bit values of which there are as many as words --------------------------------


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length(F.col("text")))).first()[0] or 0


def _planes(values: np.ndarray) -> bytes:
    """Rising values as the bytes of their differences, all first bytes first: most of the last planes are zeros."""
    return np.diff(values, prepend=values.dtype.type(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(raw: pa.Buffer) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def census(df: DataFrame, values_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], expected: int, bits: int, least: int, flagged: bool = False, at_once: int = 1 << 20) -> DataFrame:
    """value, n: the leading `bits` bits of the 64-bit values that occur `least` times or more, and how often.

    Values meet in ranges of their leading bits, 64 or more and so many that 4 million of the expected values fall into
    one; they move as sorted runs, a few bytes each, in which what a task meets again and again is one entry with a count. If flagged, the last bit kept is a mark and not part of the value, and
    only values that are marked once or more count."""
    range_bits = max(6, (expected >> 22).bit_length())
    down, last = np.uint64(64 - bits), np.uint64(1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(held: list[np.ndarray]) -> pa.RecordBatch:
            values = np.sort(np.concatenate(held) >> down)
            first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            times, values = np.diff(np.append(first, len(values))), values[first]
            part = (values >> np.uint64(bits - range_bits)).astype(np.int64)
            edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            runs = [slice(a, b) for a, b in zip(edge, np.append(edge[1:], len(values)), strict=True)]
            often = [np.flatnonzero(times[x] > 1) for x in runs]
            cols = [[_planes(values[x]) for x in runs], [x.astype("<i4").tobytes() for x in often], [times[x][y].astype("<i8").tobytes() for x, y in zip(runs, often, strict=True)]]
            return pa.RecordBatch.from_arrays([pa.array(part[edge]), *(pa.array(c, pa.binary()) for c in cols)], names=["part", "values", "often", "times"])

        held, n = [], 0
        for batch in batches:
            for values in values_of(batch):
                if len(values):
                    held.append(values)
                    n += len(values)
                if n >= at_once:
                    yield run(held)
                    held, n = [], 0
        if held:
            yield run(held)

    def counted(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        values, times = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(values)
        values, times = values[order], times[order]
        marks = (values & last).astype(np.int64) if flagged else None
        values = values >> last if flagged else values
        edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        n = np.add.reduceat(times, edge)
        keep = n >= least
        if flagged:
            keep &= np.add.reduceat(marks, edge) > 0
        return pa.RecordBatch.from_arrays([pa.array(values[edge][keep].view(np.int64)), pa.array(n[keep])], names=["value", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [], None
        for batch in batches:
            for part, *row in zip(batch.column("part").to_pylist(), *(batch.column(c) for c in ("values", "often", "times")), strict=True):
                if part != own and held:
                    yield counted(held)
                    held = []
                own = part
                values = _from_planes(row[0].as_buffer())
                times = np.ones(len(values), np.int64)
                times[np.frombuffer(row[1].as_buffer(), "<i4")] = np.frombuffer(row[2].as_buffer(), "<i8")
                held.append((values, times))
        if held:
            yield counted(held)

    dealt = df.mapInArrow(deal, "part long, values binary, often binary, times binary")
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(count, "value long, n long")


def bitmap_of(df: DataFrame, column: str, n: int) -> np.ndarray:
    """Which values of the leading bits of a 64-bit column occur, for n values: 16 places a value, 2**26 to 2**29 in all.

    A filter that lets everything in df pass and a few others; callers join or count exactly afterwards. Spark ships it to
    each executor once, as it does any function that is large."""
    bits = min(29, max(26, (16 * n).bit_length()))
    rows = (
        df.select(F.shiftrightunsigned(F.col(column), 64 - bits).alias("place"))
        .selectExpr("shiftright(place, 6) AS at", "shiftleft(1L, cast(place % 64 AS int)) AS bit")
        .groupBy("at")
        .agg(F.bit_or("bit").alias("word"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("word").to_numpy().view(np.uint64)
    del rows
    pa.default_memory_pool().release_unused()
    return out


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    bits = (len(bitmap) * 64).bit_length() - 1
    place = values.astype(np.uint64, copy=False) >> np.uint64(64 - bits)
    return (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
