"""Token counts: separator scan over flat token files without an index.

A file is a run of little-endian unsigned ids of 2 or 4 bytes (`width`; 2 holds vocabularies of up to 65,535) in which 0
ends a document; ids of a vocabulary are stored plus one, so that 0 is free. Files of any size are read in ranges: Spark's
text reader splits them wherever a byte 0x0A stands, which says nothing about ids but lets any task start there. Each
block of such lines is searched for separators as vectors, at every alignment, since where a block begins is not known
yet. A prefix scan over the blocks of a file, one small row each, gives where they begin, which alignment holds, how
many documents lie before them and where the document began that crosses into them.

Defined results: an empty document counts 0 tokens; ids after the last separator are a document that isn't closed;
a null text is empty; repeated rows count once each; empty tables and files give no rows; other columns are ignored; an id
that `width` bytes can't hold is an error. A bare file names no documents: they are told by file and number. Files that
`write_flat` numbers begin each document with its doc_id, in 12 bytes that are neither 0 nor a line's end; a null id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from corpusloom.llm import common, tokens


HEAD = 12


def _head(doc_id: int | None) -> bytes:
    value = (doc_id or 0) % 2**64
    return bytes([0x80 | value >> 7 * k & 0x7F for k in range(10)] + [0x80 | (doc_id is None), 0x80])


def _named(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The doc_id that begins at each place; null where it is null or none begins."""
    fits = at + HEAD <= len(data)
    digits = data[np.where(fits, at, 0)[:, None] + np.arange(HEAD)] if len(data) >= HEAD else np.zeros((len(at), HEAD), np.uint8)
    value = np.bitwise_or.reduce((digits[:, :10] & 0x7F).astype(np.uint64) << np.arange(0, 70, 7, dtype=np.uint64), axis=1)
    return pa.array(value.view(np.int64), mask=~fits | (digits < 0x80).any(axis=1) | (digits[:, 10] == 0x81))


def _ids(files: tuple[str, str], width: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = tokens.encoder(files)
        for batch in batches:
            named = batch.column("doc_id").to_pylist() if "doc_id" in batch.schema.names else None
            out = []
            for i, text in enumerate(batch.column("text")):
                ids = to_ids(text.as_py() or "").astype(np.uint64) + np.uint64(1)
                if len(ids) and int(ids.max()) >= 1 << 8 * width:
                    raise ValueError(f"id {int(ids.max()) - 1} doesn't fit into {width} bytes")
                out.append((_head(named[i]) if named else b"") + ids.astype(f"<u{width}").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    return encode


def write_flat(docs: DataFrame, path: str, files: tuple[str, str] | None = None, width: int = 2, rows_per_file: int = 20_000, numbered: bool = False) -> None:
    """The texts of docs as flat token files, with their doc_id if numbered; the line separator of the text writer is the end mark."""
    slim = docs.select(*([F.col("doc_id").cast("long").alias("doc_id")] if numbered else []), F.col("text").cast("string").alias("text"))
    ids = slim.mapInArrow(_ids(files or tokens.public_files(), width), "ids binary")
    ids.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", "\0" * width).option("maxRecordsPerFile", rows_per_file).text(path)


def _separators(width: int, block_bytes: int):
    """Blocks of lines of one range: bytes with their line ends, where `width` zeros stand, from the block's first byte, and
    the doc_id that follows each, or that the block itself begins with."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seq = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            path, start, size = (batch.column(c) for c in ("path", "start", "file_size"))
            lines = batch.column("line")
            wide = pa.types.is_large_binary(lines.type)
            edge = np.frombuffer(lines.buffers()[1], np.int64 if wide else np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
            data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]]
            edge = edge - edge[0]
            zero = data == 0
            at = np.flatnonzero(np.logical_and.reduce([zero[k : len(zero) - width + 1 + k] for k in range(width)])) if len(zero) >= width else np.zeros(0, np.int64)
            line = np.searchsorted(edge, at, "right") - 1
            whole = at + width <= edge[line + 1] if len(at) else np.zeros(0, bool)
            at, line = at[whole], line[whole]
            code, begin = path.dictionary_encode().indices.to_numpy(), start.to_numpy()
            block = (edge[:-1] + np.arange(len(lines))) // block_bytes
            cut = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (begin[1:] != begin[:-1]) | (block[1:] != block[:-1])]))
            after, head = _named(data, at + width), _named(data, edge[cut])
            rows = []
            for k, (lo, hi) in enumerate(zip(cut.tolist(), [*cut[1:].tolist(), len(lines)], strict=True)):
                key = (path[lo].as_py(), int(begin[lo]))
                seq = seq + 1 if key == own else 0
                own = key
                a, b = np.searchsorted(line, [lo, hi])
                rows.append((*key, seq, size[lo].as_py(), int(edge[hi] - edge[lo] + hi - lo), (at[a:b] - edge[lo] + line[a:b] - lo).tolist(), after[a:b].to_pylist(), head[k].as_py()))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "start", "seq", "file_size", "n_bytes", "zeros", "next", "head"])

    return scan


def token_counts(spark: SparkSession, path: str, block_ids: int = 1 << 20, width: int = 2, numbered: bool = False) -> DataFrame:
    """file, doc_no (from 0 in each file), start (ids before it), n_tokens, closed, and doc_id of numbered files; one row per document."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("file_size"), F.col("value").cast("binary").alias("line")
    )
    found = lines.mapInArrow(_separators(width, block_ids * width), "path string, start long, seq long, file_size long, n_bytes long, zeros array<long>, next array<long>, head long")
    found = found.withColumn("zeros", F.expr("transform(arrays_zip(zeros, next), x -> named_struct('at', x.zeros, 'doc_id', x.next))")).drop("next")
    found = common.handed_over(found, "separators")
    # The scan: of each block its length, and for each alignment how many separators and which is the last.
    in_file = W.Window.partitionBy("path").orderBy("start", "seq")
    before = in_file.rowsBetween(W.Window.unboundedPreceding, -1)
    aligned = [F.expr(f"filter(zeros, z -> z.at % {width} = {r})") for r in range(width)]
    slim = found.select("path", "start", "seq", "file_size", "n_bytes", "head", F.array(*[F.size(z) for z in aligned]).alias("n"), F.array(*[F.try_element_at(z, F.lit(-1)) for z in aligned]).alias("last"))
    slim = slim.withColumn("offset", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)))
    r = F.pmod(-F.col("offset"), F.lit(width)).cast("int")
    # Where the document begins that follows the last separator, and its id.
    following = F.struct(((F.col("offset") + F.get("last", r)["at"]) / width + 1).cast("long").alias("start"), F.get("last", r)["doc_id"].alias("doc_id"))
    slim = slim.withColumn("ends", F.get("n", r)).withColumn("following", F.when(F.col("ends") > 0, following))
    opening = F.struct(F.lit(0).cast("long").alias("start"), F.first("head").over(in_file.rowsBetween(W.Window.unboundedPreceding, 0)).alias("doc_id"))
    slim = slim.withColumn("doc_no", F.coalesce(F.sum("ends").over(before), F.lit(0))).withColumn("carried", F.coalesce(F.last("following", ignorenulls=True).over(before), opening))
    slim = common.handed_over(slim.select("path", "start", "seq", "file_size", "offset", "ends", "following", "doc_no", "carried"), "blocks")
    stitched = found.select("path", "start", "seq", "zeros").join(slim.filter("ends > 0"), ["path", "start", "seq"])
    ends = F.transform(F.filter("zeros", lambda z: (F.col("offset") + z["at"]) % width == 0), lambda z: F.struct(((F.col("offset") + z["at"]) / width + 1).cast("long").alias("start"), z["doc_id"].alias("doc_id")))
    stitched = stitched.select("path", "doc_no", "carried", ends.alias("ends")).select("path", "doc_no", F.concat(F.array("carried"), "ends").alias("starts"), F.posexplode("ends").alias("i", "end"))
    own = F.get("starts", F.col("i"))
    closed = stitched.select("path", (F.col("doc_no") + F.col("i")).alias("doc_no"), own["start"].alias("start"), (F.col("end.start") - 1 - own["start"]).alias("n_tokens"), F.lit(True).alias("closed"), own["doc_id"].alias("doc_id"))
    last = F.max_by(F.coalesce("following", "carried"), F.struct("start", "seq"))
    total = slim.groupBy("path").agg(F.sum("ends").alias("doc_no"), last.alias("last"), (F.max("file_size") / width).cast("long").alias("ids")).select("path", "doc_no", "last.start", "last.doc_id", "ids")
    rest = total.filter("start < ids").select("path", "doc_no", "start", (F.col("ids") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"), "doc_id")
    head = HEAD // width if numbered else 0
    return closed.unionByName(rest).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "doc_no", (F.col("start") + head).alias("start"), (F.col("n_tokens") - head).alias("n_tokens"), "closed", *(["doc_id"] if numbered else [])
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "tokens")
    write_flat(common.table(spark, sf_dir, "documents"), path, numbered=True)
    return token_counts(spark, path, numbered=True)
