"""Suffix-array dedup: every byte of a repeated 200-byte string goes, wherever the string starts.

The corpus is sorted as many small suffix arrays that together see every repeat:

1. Anchors. Among the k-grams that a 200-byte window holds, the one of least hash is its anchor; suffixes smaller than
   their successors come first. Equal windows have equal anchors at the same place, so that windows need comparing
   only within the bucket of their anchor. Buckets of one occurrence drop out.
2. Segments. The windows of one anchor are one segment of text. Segments are counted by hash before any byte moves; one
   that occurs twice is covered whole. Of a bucket with several different ones, each sends its bytes once.
3. Two-stage sorting. In a bucket of several different segments, only the suffixes at the anchors are sorted directly;
   those to the left are induced one byte at a time by a stable scan of the buckets of their first byte, and adjacent
   common prefixes follow by range minima. A common prefix of 200 bytes marks a repeated window.
4. Spans. Covered windows go back to the texts they came from, once per different text, and are merged there.

A bucket of more than `most_in_bucket` different segments is not sorted in one task: its windows are counted by hash in
a shuffle, with the same result.

Defined results: a null text is empty; texts shorter than the length lose nothing; repeated rows are copies of each other
and lose every byte if they are long enough; an empty table gives no rows; other columns are ignored. Strings are
judged on the input. Segments and texts are told apart by 128 and 96 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common

SEGMENT = ["h", "left", "size", "sh"]
FOUND_DDL = "h long, left short, size short, sh long, near short, far short"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray, length: int, k: int):
    """(position, hash, first window, last window) of each anchor; windows are `length` bytes within one text."""
    none = np.zeros(0, np.int64)
    width = length - k + 1
    if len(data) < length:
        return none, none.astype(np.uint64), none, none
    _, down = common.power(len(prefix))
    h = common.mixed((prefix[k:] - prefix[:-k]) * down[: len(prefix) - k])
    key = h >> np.uint64(1)
    key |= (data[: len(key)] >= data[1 : len(key) + 1]).astype(np.uint64) << np.uint64(63)
    least = _sliding_min(key, width)
    cross = np.zeros(len(data) + 1, np.int32)
    np.add.at(cross, np.maximum(offsets[1:-1] - length + 1, 0), 1)
    np.add.at(cross, offsets[1:-1], -1)
    valid = np.cumsum(cross)[: len(least)] == 0
    # position p is an anchor if a valid window that holds it has its key as the least
    seen = np.zeros(len(key) + width - 1, np.uint64)
    seen[width - 1 : width - 1 + len(least)] = np.where(valid, least, 0)
    at = np.flatnonzero(key == ~_sliding_min(~seen, width)[: len(key)])
    ends = np.flatnonzero((least[1:] != least[:-1]) | (valid[1:] != valid[:-1]))
    first = np.concatenate([[0], ends + 1])
    last = np.concatenate([ends, [len(least) - 1]])
    first, last = first[valid[first]], last[valid[first]]
    lo, hi = np.searchsorted(at, first), np.searchsorted(at, last + width - 1, "right")
    run = np.repeat(np.arange(len(first)), hi - lo)
    p = at[np.arange(len(run)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[run]] if len(run) else none
    same = key[p] == least[first[run]]
    run, p = run[same], p[same]
    s0, s1 = np.maximum(first[run], p - width + 1), np.minimum(last[run], p)
    s0[1:] = np.where(run[1:] == run[:-1], np.maximum(s0[1:], p[:-1] + 1), s0[1:])
    keep = s0 <= s1
    return p[keep], h[p[keep]], s0[keep], s1[keep]


def _anchor_counts(length: int, k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in common.steps(batch):
                h, n = np.unique(anchors(data, offsets, common.prefix_hash(data), length, k)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return scan


def _occurrences(length: int, k: int, bitmap: np.ndarray):
    """Occurrences of the anchors in the bitmap, each with its segment."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in common.steps(batch):
                prefix = common.prefix_hash(data)
                p, h, s0, s1 = anchors(data, offsets, prefix, length, k)
                keep = common.in_bitmap(bitmap, h)
                p, h, s0, s1 = p[keep], h[keep], s0[keep], s1[keep]
                doc = np.searchsorted(offsets, s0, "right") - 1
                take = pa.array(doc + rows.start)
                cols = [h.view(np.int64), (p - s0).astype(np.int16), (s1 + length - s0).astype(np.int16), common.span_hash(prefix, s0, s1 + length).view(np.int64)]
                own = [batch.column(c).take(take) for c in ("t1", "t2", "doc_id")]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), *own, pa.array(p - offsets[doc])], names=[*SEGMENT, "t1", "t2", "doc_id", "pos"])

    return scan


def _told_apart(doc_id: np.ndarray, pos: np.ndarray, sh: np.ndarray) -> np.ndarray:
    mix = np.uint64(0x9E3779B97F4A7C15)
    return common.mixed(common.mixed(doc_id.astype(np.uint64) * mix + pos.astype(np.uint64)) ^ sh.astype(np.uint64))


def _bytes_of(length: int, k: int, bitmap: np.ndarray):
    """(h, segment, bytes) of the occurrences in the bitmap: the one that stands for a segment, and a few by chance."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in common.steps(batch):
                prefix = common.prefix_hash(data)
                p, h, s0, s1 = anchors(data, offsets, prefix, length, k)
                doc = np.searchsorted(offsets, s0, "right") - 1
                sh = common.span_hash(prefix, s0, s1 + length)
                ids = batch.column("doc_id").fill_null(-1).to_numpy()[rows]
                keep = common.in_bitmap(bitmap, _told_apart(ids[doc].astype(np.int64).view(np.uint64), p - offsets[doc], sh)) if len(p) else np.zeros(0, bool)
                p, h, s0, s1, sh = p[keep], h[keep], s0[keep], s1[keep], sh[keep]
                whole = data.tobytes() if len(p) else b""
                segs = [whole[a:b] for a, b in zip(s0.tolist(), (s1 + length).tolist(), strict=True)]
                cols = [pa.array(h.view(np.int64)), pa.array((p - s0).astype(np.int16)), pa.array((s1 + length - s0).astype(np.int16)), pa.array(sh.view(np.int64)), pa.array(segs, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[*SEGMENT, "seg"])

    return scan


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_id, pos, sh = (batch.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("doc_id", "pos", "sh"))
        yield pa.RecordBatch.from_arrays([pa.array(_told_apart(doc_id, pos, sh).view(np.int64))], names=["place"])


def _in(bitmap: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    return common.in_bitmap(bitmap, batch.column("t1").to_numpy().view(np.uint64)) if batch.num_rows else np.zeros(0, bool)


def _with_spans(bitmap: np.ndarray):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_in(bitmap, batch)))

    return scan


def _without_spans(bitmap: np.ndarray):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.filter(pa.array(~_in(bitmap, batch)))
            none = pa.nulls(rest.num_rows, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
            yield from _cut(iter([pa.RecordBatch.from_arrays([rest.column("doc_id"), rest.column("text"), none], names=["doc_id", "text", "spans"])]))

    return scan


def _parts(segs: list[bytes], left: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes from each anchor on, and those before it backwards, as zero-padded rows."""
    sizes = np.array([len(s) for s in segs])
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.frombuffer(b"".join(segs) + b"\0", np.uint8)
    at = (start + left)[:, None]
    ahead = at + np.arange(length)
    right = np.where(np.arange(length) < (sizes - left)[:, None], flat[np.minimum(ahead, len(flat) - 1)], 0).astype(np.uint8)
    back = at - 1 - np.arange(reach)
    behind = np.where(np.arange(reach) < left[:, None], flat[np.maximum(back, 0)], 0).astype(np.uint8)
    return right, behind


def common_windows(bucket: np.ndarray, left: np.ndarray, segs: list[bytes], length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each segment the nearest and farthest start, in bytes left of the anchor, of a window that another segment of
    its bucket has too; near is -1 where there is none. Two-stage sorting of all suffixes from the anchors leftward."""
    n, reach = len(segs), length - k
    right, behind = _parts(segs, left, length, reach)
    ahead = np.array([len(s) for s in segs]) - left
    near, far = np.full(n, -1), np.full(n, -1)
    padded = np.zeros((n, -(-length // 8) * 8), np.uint8)
    padded[:, :length] = right
    columns = padded.view(">u8").astype(np.uint64)
    order = np.lexsort((*columns.T[::-1], bucket))  # direct sorting: the suffixes at the anchors
    differ = right[order[1:]] != right[order[:-1]]
    prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    prefix = np.minimum(prefix, np.minimum(ahead[order[1:]], ahead[order[:-1]]))
    lcp = np.concatenate([[0], np.where(bucket[order[1:]] == bucket[order[:-1]], prefix, 0)])
    for step in range(reach + 1):
        if step:  # induce: suffixes one byte longer, scanned in the order of what follows that byte
            order_left = left[order] >= step
            byte = bucket[order].astype(np.int64) * 256 + behind[order, step - 1]
            kept = np.flatnonzero(order_left)
            if len(kept) < 2:
                break
            scan = kept[np.argsort(byte[kept], kind="stable")]
            same = byte[scan[1:]] == byte[scan[:-1]]
            spans = np.column_stack([scan[:-1] + 1, scan[1:] + 1])
            spans[~same] = (0, 1)
            low = np.minimum.reduceat(np.concatenate([lcp, [0]]), spans.ravel())[::2]
            new = np.concatenate([[0], np.where(same, low + 1, 0)])
            alone = (new == 0) & np.concatenate([new[1:] == 0, [True]])
            order, lcp = order[scan][~alone], new[~alone]
            if not len(order):
                break
        hit = np.flatnonzero(lcp >= length)
        both = np.concatenate([order[hit - 1], order[hit]])
        far[both] = step
        near[both] = np.where(near[both] < 0, step, near[both])
    return near, far


def _induced(length: int, k: int, at_once: int = 20_000):
    """Rows sorted by h, in chunks that end with a bucket."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        left = table.column("left").to_numpy().astype(np.int64)
        near, far = common_windows(np.unique(table.column("h").to_numpy(), return_inverse=True)[1], left, table.column("seg").to_pylist(), length, k)
        hit = np.flatnonzero(near >= 0)
        cols = [table.column(c).combine_chunks().take(pa.array(hit)) for c in SEGMENT]
        cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
        return pa.RecordBatch.from_arrays([*cols, pa.array(near[hit].astype(np.int16)), pa.array(far[hit].astype(np.int16))], names=[*SEGMENT, "near", "far"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= at_once:
                table = pa.Table.from_batches(held)
                h = table.column("h").to_numpy()
                edge = int(np.searchsorted(h, h[-1]))
                if edge:
                    yield solve(table.slice(0, edge))
                    held = table.slice(edge).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    return scan


def _windows(length: int):
    """(segment, steps left of the anchor, hash) of every window of a segment."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in common.steps(batch, "seg", 1 << 18):
                prefix = common.prefix_hash(data)
                n = offsets[1:] - offsets[:-1] - length + 1
                seg = np.repeat(np.arange(len(n)), n)
                start = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n) + offsets[seg]
                take = pa.array(seg + rows.start)
                left = batch.column("left").to_numpy()[rows].astype(np.int64)
                cols = [batch.column(c).take(take) for c in SEGMENT]
                steps = left[seg] - (start - offsets[seg])
                yield pa.RecordBatch.from_arrays([*cols, pa.array(steps.astype(np.int16)), pa.array(common.span_hash(prefix, start, start + length).view(np.int64))], names=[*SEGMENT, "step", "wh"])

    return scan


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column("text"), batch.column("spans").to_pylist()
        out: list[tuple] = []
        for i, found in enumerate(spans):
            raw = memoryview(texts[i].as_buffer()) if texts[i].is_valid else b""
            kept, at, gone, runs = [], 0, 0, 0
            reach = -1
            for a, b in sorted((s["a"], s["b"]) for s in found or ()):
                if a > reach:
                    kept.append(raw[at:a])
                    runs += 1
                    gone += b - a
                    reach = at = b
                elif b > reach:
                    gone += b - reach
                    reach = at = b
            kept.append(raw[at:])
            rest = b"".join(kept)
            out.append((len(raw), gone, runs, hashlib.sha256(rest).hexdigest(), rest))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_spans(texts: DataFrame, length: int = 200, k: int = 64, most_in_bucket: int = 50_000) -> DataFrame:
    """t1, t2 (key of a text), spans: array of (a, b), overlapping, not merged; texts has t1, t2, doc_id, text, a row per document."""
    repeated = texts.select("text").mapInArrow(_anchor_counts(length, k), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
    repeated = common.handed_over(repeated, "anchors")
    bitmap = common.bitmap_of(repeated, "h", repeated.count())
    found = texts.mapInArrow(_occurrences(length, k, bitmap), "h long, left short, size short, sh long, t1 long, t2 long, doc_id long, pos long")
    if repeated.count() > len(bitmap) * 4:  # too many for the bitmap to tell
        found = found.join(repeated, "h", "left_semi")
    found = common.handed_over(found, "occurrences")
    one = F.struct(F.coalesce("doc_id", F.lit(-1)).cast("long").alias("doc_id"), "pos")
    counts = found.groupBy(*SEGMENT).agg(F.count("*").alias("c"), F.min(one).alias("one"))
    counts = common.handed_over(counts.select(*SEGMENT, "c", "one.doc_id", "one.pos"), "segment-counts")
    whole = counts.filter("c > 1").select(*SEGMENT, (F.lit(length) - (F.col("size") - F.col("left"))).cast("short").alias("near"), F.col("left").alias("far"))
    buckets = common.handed_over(counts.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    places = counts.join(buckets, "h", "left_semi").select("doc_id", "pos", "sh").mapInArrow(_places, "place long")
    several = texts.mapInArrow(_bytes_of(length, k, common.bitmap_of(places, "place", places.count())), "h long, left short, size short, sh long, seg binary").dropDuplicates(SEGMENT)
    hot = buckets.filter(F.col("n") > most_in_bucket).select("h")
    parts = [whole]
    if hot.limit(1).count():
        windows = several.join(hot, "h", "left_semi").mapInArrow(_windows(length), "h long, left short, size short, sh long, step short, wh long")
        twice = windows.groupBy("h", "step", "wh").agg(F.count("*").alias("n")).filter("n > 1").select("h", "step", "wh")
        parts.append(windows.join(twice, ["h", "step", "wh"]).groupBy(*SEGMENT).agg(F.min("step").alias("near"), F.max("step").alias("far")))
        several = several.join(hot, "h", "left_anti")
    parts.append(several.repartition("h").sortWithinPartitions("h").mapInArrow(_induced(length, k), FOUND_DDL))
    covered = parts[0]
    for part in parts[1:]:
        covered = covered.unionByName(part)
    covered = covered.groupBy(*SEGMENT).agg(F.min("near").alias("near"), F.max("far").alias("far"))
    return (
        found.join(common.handed_over(covered, "covered"), SEGMENT)
        .select("t1", "t2", F.struct((F.col("pos") - F.col("far")).alias("a"), (F.col("pos") - F.col("near") + length).alias("b")).alias("s"))
        .groupBy("t1", "t2").agg(F.collect_set("s").alias("spans"))
    )


def deduped(docs: DataFrame, length: int = 200, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes; docs needs doc_id and text.

    Only texts that lose something, and the few that a fixed-size bitmap takes for them, are shuffled."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", *common.text_key(), "text")
    spans = common.handed_over(repeated_spans(texts, length, **options), "spans")
    bitmap = common.bitmap_of(spans, "t1", spans.count())
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    hit = texts.mapInArrow(_with_spans(bitmap), texts.schema).join(spans, ["t1", "t2"], "left").select("doc_id", "text", "spans")
    return hit.mapInArrow(_cut, ddl).unionByName(texts.mapInArrow(_without_spans(bitmap), ddl))


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return deduped(common.table(spark, sf_dir, "documents")).drop("kept")


ORACLE_SQL = r"""
WITH raw AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), places AS (
  SELECT doc_id, b, octet_length(b) AS n, unnest(range(octet_length(b))) AS i FROM raw
), starts AS (
  SELECT doc_id, i, upper(hex(b[i + 1:i + 1])) AS byte, CASE WHEN i + 200 <= n THEN md5(hex(b[i + 1:i + 200])) END AS h FROM places
), twice AS (
  SELECT h FROM starts WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1
), marked AS (
  SELECT doc_id, i, byte, max(CASE WHEN t.h IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS 199 PRECEDING) AS gone FROM starts s LEFT JOIN twice t USING (h)
), runs AS (
  SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM marked
), kept AS (
  SELECT doc_id, sum(gone)::BIGINT AS n_removed, count(*) FILTER (WHERE gone = 1 AND before = 0) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (WHERE gone = 0) AS x FROM runs GROUP BY 1
)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(x, ''))) AS kept_sha256
FROM raw LEFT JOIN kept USING (doc_id)
"""
