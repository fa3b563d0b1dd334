"""Best-fit packing: hierarchical residual packing of token pieces into fixed-length sequences.

Each partition packs its own pieces best-fit (largest first), nearly full bins are done, and the underfull bins meet as
items in ever fewer partitions for further best-fit rounds. What a task holds is bounded by `items_per_task` small rows;
a bin carries at most `capacity` pieces.

Defined results: a null or empty text is one piece that holds only the end mark; repeated rows are packed once each;
ties fall to the earlier item; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common, tokens

MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BIN = pa.schema([("sequence_id", pa.int64()), ("fill", pa.int32()), ("members", pa.list_(MEMBER))])
BIN_DDL = "sequence_id long, fill int, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items of each bin: largest first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what they still take
    free = 0  # bit r: some bin still takes r
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = free >> size
        if fits:
            room = (fits & -fits).bit_length() - 1 + size
            at = open_at[room].pop()
            if not open_at[room]:
                free ^= 1 << room
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        room -= size
        if room:
            open_at[room].append(at)
            free |= 1 << room
    return bins


def _rows(bins: list[list[int]], sizes: np.ndarray, counts: np.ndarray, members: pa.StructArray, first_id: int) -> Iterator[pa.RecordBatch]:
    """Bins as rows; item i has counts[i] consecutive members and takes sizes[i]."""
    starts = np.concatenate([[0], np.cumsum(counts)])
    offset = members.field("offset").to_numpy(zero_copy_only=False)
    for lo in range(0, len(bins), 4096):
        part = bins[lo : lo + 4096]
        order = np.concatenate([np.asarray(b) for b in part])
        n_items = np.array([len(b) for b in part])
        ends = np.cumsum(sizes[order])
        fill = np.add.reduceat(sizes[order], np.concatenate([[0], np.cumsum(n_items)[:-1]]))
        base = ends - sizes[order] - np.repeat(np.cumsum(fill) - fill, n_items)
        take = np.repeat(starts[order] - np.concatenate([[0], np.cumsum(counts[order])[:-1]]), counts[order]) + np.arange(counts[order].sum())
        moved = pa.array(offset[take] + np.repeat(base, counts[order]), pa.int64())
        rows = members.take(pa.array(take))
        rows = pa.StructArray.from_arrays([*(rows.field(i) for i in range(5)), moved], fields=list(MEMBER))
        per_bin = np.add.reduceat(counts[order], np.concatenate([[0], np.cumsum(n_items)[:-1]]))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_bin)]), pa.int32()), rows)
        yield pa.RecordBatch.from_arrays([pa.array(first_id + lo + np.arange(len(part)), pa.int64()), pa.array(fill, pa.int32()), lists.cast(BIN.field("members").type)], schema=BIN)


def _first_id(level: int) -> int:
    return (level << 58) | (TaskContext.get().partitionId() << 34)


def _tokenised(files: tuple[str, str], capacity: int, end_id: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(files)
        end = np.array([end_id], np.uint32)
        cols: list[list] = [[], [], [], [], []]
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end]).astype("<u4", copy=False)
                cut = len(ids) % capacity or capacity
                edges = [0, *range(cut, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    for c, v in zip(cols, (doc_id, piece, a, b - a, zlib.crc32(ids[a:b])), strict=True):
                        c.append(v)
        if cols[0]:
            sizes = np.array(cols[3], np.int64)
            arrays = [pa.array(c, f.type) for c, f in zip([*cols, np.zeros(len(sizes), np.int64)], MEMBER, strict=True)]
            yield from _rows(best_fit(sizes, capacity), sizes, np.ones(len(sizes), np.int64), pa.StructArray.from_arrays(arrays, fields=list(MEMBER)), _first_id(0))

    return pack


def _merged(level: int, capacity: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            bins = pa.Table.from_batches(held).combine_chunks()
            sizes = bins.column("fill").to_numpy().astype(np.int64)
            lists = bins.column("members").chunk(0)
            yield from _rows(best_fit(sizes, capacity), sizes, lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().cast(MEMBER), _first_id(level))

    return pack


def packed(docs: DataFrame, capacity: int = 2048, end_id: int = 0, files: tuple[str, str] | None = None, nearly_full: float = 0.99, items_per_task: int = 50_000, fan_in: int = 8) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs needs doc_id and text. Only documents over `capacity` tokens are cut; the first piece is the short one."""
    files = files or tokens.public_files()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tasks = max(1, slim.rdd.getNumPartitions())
    bins = common.handed_over(slim.mapInArrow(_tokenised(files, capacity, end_id), BIN_DDL), "packing-0")
    done: list[DataFrame] = []
    least = int(capacity * nearly_full)
    for level in range(1, 16):
        rest = bins.filter(F.col("fill") < least)
        n = rest.count()
        if not n or tasks == 1:
            break
        fewer = max(-(-tasks // fan_in), -(-n // items_per_task))
        if fewer >= tasks:
            break
        done.append(bins.filter(F.col("fill") >= least))
        tasks = fewer
        bins = common.handed_over(rest.repartition(tasks, "sequence_id").mapInArrow(_merged(level, capacity), BIN_DDL), f"packing-{level}")
    for part in done:
        bins = bins.unionByName(part)
    return bins.selectExpr("sequence_id", "inline(members)").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents"))
