"""Byte-level BPE encoding and decoding with overlapping chunks.

A text over `chunk_bytes` is cut into chunks that overlap. Each chunk is pre-tokenised by itself, wherever it begins, in
any task; two neighbours are stitched at the first pre-token boundary that both have in their overlap, from which on they
agree. Neighbours that agree nowhere (a pre-token longer than the overlap) become one chunk and are pre-tokenised again,
until all agree. Then each chunk's pre-tokens between its two seams are encoded. Shorter texts are one chunk and need no
seam. Decoding concatenates the raw bytes of the ids, part by part.

Ids are those of tiktoken without special tokens: the strings of special tokens are ordinary text.
Defined results: a null or empty text has no ids; repeated rows and rows with one id or none are encoded once each; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm import common

#: The longest pre-token of the pattern that more text could still turn into another, "'re": a boundary nearer than this
#: to the end of a chunk that goes on is not final.
LOOKS_AHEAD = 3
#: Distinct pre-tokens whose ids a worker remembers.
REMEMBERED = 1 << 17
CHUNK = "row long, doc_id long, part long, start long, behind long, last boolean, body binary, ends binary, heads array<long>, tails array<long>"
PARTS = "row long, doc_id long, part long, ids binary"

_loaded: dict[tuple[str, str], Codec] = {}


def public_files() -> tuple[str, str]:
    """The ranks of a public vocabulary and the pattern of its pre-tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Codec(dict):
    """The ids of a pre-token as little-endian unsigned 32-bit integers; what was met is remembered."""

    def __init__(self, ranks: str, pattern: str):
        import regex
        import tiktoken

        super().__init__()
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.split = regex.compile(pattern).findall
        self.merge = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        size = max(table.values()) + 1
        raw = [b""] * size
        for token, rank in table.items():
            raw[rank] = token
        self.raw = np.array(raw, object)

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.merge.encode_ordinary(piece), "<u4").tobytes()  # a pre-token by itself is split no further
        if len(piece) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, pieces))

    def bytes(self, ids: bytes) -> bytes:
        return b"".join(self.raw[np.frombuffer(ids, "<u4")].tolist())


def codec(files: tuple[str, str]) -> Codec:
    """One codec for each Python worker."""
    if files not in _loaded:
        _loaded[files] = Codec(*files)
    return _loaded[files]


def _whole(files: tuple[str, str]):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(files)
        for whole in batches:
            for rows, _, _ in common.steps(whole):  # a worker holds the pre-tokens of half a megabyte, not of a batch
                batch = whole.slice(rows.start, rows.stop - rows.start)
                ids = [c.ids(c.split(t)) if t else b"" for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.nulls(len(ids), pa.int64()).fill_null(0), pa.array(ids, pa.binary())], names=["row", "doc_id", "part", "ids"])

    return encode


def _cut(chunk_bytes: int, overlap: int):
    """A row for each chunk: bytes [part * chunk_bytes, (part + 1) * chunk_bytes + overlap) or so, at whole characters."""

    def edge(raw: memoryview, at: int) -> int:
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        return min(at, len(raw))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "part", "start", "behind", "last", "body"]
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
        for batch in batches:
            held, size = [], 0
            for row, doc_id, text in zip(*(batch.column(c) for c in ("row", "doc_id", "text")), strict=True):
                raw = memoryview(text.as_buffer())
                n = -(-len(raw) // chunk_bytes)
                for part in range(n):
                    start, behind = edge(raw, part * chunk_bytes), edge(raw, (part + 1) * chunk_bytes + overlap)
                    last = behind == len(raw)
                    held.append((row.as_py(), doc_id.as_py(), part, start, behind, last, raw[start:behind].tobytes()))
                    size += behind - start
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                        held, size = [], 0
                    if last:
                        break
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return cut


def _pretokenised(files: tuple[str, str], overlap: int):
    """ends: where the pre-tokens of the chunk end, from its start; heads, tails: boundaries of the text in either overlap."""
    zone = overlap + 8  # edges move by less than a character

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(files)
        for batch in batches:
            ends, heads, tails = [], [], []
            for start, behind, last, body in zip(*(batch.column(x).to_pylist() for x in ("start", "behind", "last", "body")), strict=True):
                text = body.decode()
                pieces = c.split(text)
                sizes = map(len, pieces) if text.isascii() else (len(p.encode()) for p in pieces)
                at = np.cumsum(np.fromiter(sizes, np.int64, len(pieces)))
                ends.append(at.astype("<i8").tobytes())
                bounds = np.concatenate([[0], at]) + start
                heads.append(bounds[bounds <= start + zone])
                final = bounds[bounds <= behind - (0 if last else LOOKS_AHEAD)]
                tails.append(final[final >= behind - zone - 8])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(ends, pa.binary()), *lists], names=[*batch.schema.names[:7], "ends", "heads", "tails"])

    return split


def _between_seams(files: tuple[str, str]):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(files)
        for batch in batches:
            out = []
            for start, body, ends, seam, until in zip(*(batch.column(x).to_pylist() for x in ("start", "body", "ends", "seam", "until")), strict=True):
                at = np.frombuffer(ends, "<i8")
                lo, hi = seam - start, until - start
                at = at[(at > lo) & (at <= hi)].tolist()
                out.append(c.ids([body[a:b].decode() for a, b in zip([lo, *at], at, strict=False)]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("part"), pa.array(out, pa.binary())], names=["row", "doc_id", "part", "ids"])

    return encode


def _seams(chunks: DataFrame) -> DataFrame:
    """row, part, before, seam: the first boundary that a chunk shares with the one before; null where there is none."""
    order = Window.partitionBy("row").orderBy("part")
    marks = chunks.select("row", "part", F.lag("part").over(order).alias("before")).filter("before IS NOT NULL")
    tails = chunks.select("row", F.col("part").alias("before"), "tails")
    return marks.join(tails, ["row", "before"]).join(chunks.select("row", "part", "heads"), ["row", "part"]).select("row", "part", "before", F.array_min(F.array_intersect("heads", "tails")).alias("seam"))


def _stitched(chunks: DataFrame, split) -> tuple[DataFrame, DataFrame]:
    """The chunks and their seams, once all neighbours agree somewhere; those that don't are one chunk from then on."""
    while True:
        seams = common.handed_over(_seams(chunks), "bpe-seams")
        if not seams.filter("seam IS NULL").limit(1).count():
            return chunks, seams
        lead = F.max(F.when(F.col("seam").isNotNull() | F.col("before").isNull(), F.col("part"))).over(Window.partitionBy("row").orderBy("part"))
        led = chunks.select("row", "part").join(seams.select("row", "part", "before", "seam"), ["row", "part"], "left").withColumn("lead", lead)
        led = common.handed_over(led.withColumn("many", F.count("*").over(Window.partitionBy("row", "lead"))).select("row", "part", "lead", "many"), "bpe-leads")
        alone = chunks.join(led.filter("many = 1").select("row", "part"), ["row", "part"])
        member = F.struct("part", "doc_id", "start", "behind", "last", "body")
        groups = chunks.join(led.filter("many > 1"), ["row", "part"]).groupBy("row", "lead").agg(F.sort_array(F.collect_list(member)).alias("m"))
        joined = groups.mapInArrow(_joined, "row long, doc_id long, part long, start long, behind long, last boolean, body binary").mapInArrow(split, CHUNK)
        chunks = common.handed_over(alone.select(*chunks.columns).unionByName(joined), "bpe-chunks")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, members in zip(batch.column("row").to_pylist(), batch.column("m").to_pylist(), strict=True):
            first, last = members[0], members[-1]
            starts = [m["start"] for m in members[1:]] + [last["behind"]]
            body = b"".join(m["body"][: s - m["start"]] for m, s in zip(members, starts, strict=True))
            values = (row, first["doc_id"], first["part"], first["start"], last["behind"], last["last"], body)
            yield pa.RecordBatch.from_pylist([dict(zip(("row", "doc_id", "part", "start", "behind", "last", "body"), values, strict=True))], schema=pa.schema([*((c, pa.int64()) for c in ("row", "doc_id", "part", "start", "behind")), ("last", pa.bool_()), ("body", pa.binary())]))


def _encoders(docs: DataFrame, files: tuple[str, str], chunk_bytes: int, overlap: int):
    """Rows of whole texts and of stitched chunks, each with the function of Arrow batches that encodes them."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > chunk_bytes
    whole = slim.filter(~long).select(F.lit(-1).cast("long").alias("row"), "doc_id", "text")
    split = _pretokenised(files, overlap)
    cut = slim.filter(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(_cut(chunk_bytes, overlap), "row long, doc_id long, part long, start long, behind long, last boolean, body binary")
    cut = common.handed_over(cut, "bpe-cut")  # from here on a row keeps its name, and its chunks go to any task
    chunks = common.handed_over(cut.repartition("row", "part").mapInArrow(split, CHUNK), "bpe-chunks")
    chunks, seams = _stitched(chunks, split)
    until = seams.select("row", F.col("before").alias("part"), F.col("seam").alias("until"))
    placed = chunks.join(seams.select("row", "part", "seam"), ["row", "part"], "left").join(until, ["row", "part"], "left")
    placed = placed.select("row", "doc_id", "part", "start", "body", "ends", F.coalesce("seam", "start").alias("seam"), F.coalesce("until", "behind").alias("until"))
    return (whole, _whole(files)), (placed, _between_seams(files))


def encoded(docs: DataFrame, files: tuple[str, str] | None = None, chunk_bytes: int = 1 << 16, overlap: int = 1 << 10) -> tuple[DataFrame, DataFrame]:
    """(whole, parts), both row, doc_id, part, ids (little-endian unsigned 32-bit): texts of up to chunk_bytes, one row each,
    and the parts in order of longer ones, which `row` names.

    docs needs doc_id and text. overlap is at most chunk_bytes."""
    whole, parts = (rows.mapInArrow(f, PARTS) for rows, f in _encoders(docs, files or public_files(), chunk_bytes, overlap))
    return whole, parts


def _decoding(files: tuple[str, str]):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(files)
        for batch in batches:
            raw = pa.array([c.bytes(x.as_py()) for x in batch.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, raw], names=[*batch.schema.names, "raw"])

    return decode


def decoded(parts: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """parts of encoded() with `raw`, the bytes of their ids; those of a text's parts one after the other are its bytes."""
    return parts.mapInArrow(_decoding(files or public_files()), PARTS + ", raw binary")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row its parts in order, hashed as they come; what a task holds is a batch, however long a text is."""

    def out(row, doc_id, n, ids, raw):
        return pa.RecordBatch.from_pylist([{"doc_id": doc_id, "n_tokens": n, "ids_sha256": ids.hexdigest(), "decoded_sha256": raw.hexdigest()}], schema=pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    open_row = None
    for batch in batches:
        for row, doc_id, ids, raw in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "ids", "raw")), strict=True):
            if open_row is None or open_row[0] != row:
                if open_row:
                    yield out(*open_row)
                open_row = [row, doc_id, 0, hashlib.sha256(), hashlib.sha256()]
            open_row[2] += len(ids) // 4
            open_row[3].update(ids)
            open_row[4].update(raw)
    if open_row:
        yield out(*open_row)


def digests(docs: DataFrame, files: tuple[str, str] | None = None, chunk_bytes: int = 1 << 16, overlap: int = 1 << 10) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text: encoded() and decoded() in one pass."""
    files = files or public_files()
    (whole, encode), (placed, encode_part) = _encoders(docs, files, chunk_bytes, overlap)
    decode = _decoding(files)
    short = whole.mapInArrow(lambda batches: decode(encode(batches)), PARTS + ", raw binary")
    short = short.select("doc_id", F.expr("cast(octet_length(ids) / 4 AS long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))
    ordered = placed.mapInArrow(encode_part, PARTS).repartition("row").sortWithinPartitions("row", "part")
    return short.unionByName(ordered.mapInArrow(lambda batches: _digests(decode(batches)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
