"""Line dedup by distinct-site spread.

Each line of `min_words` words or more (1: all lines with a word) has a HyperLogLog sketch of the sites it occurs on; sketches merge by
aggregation. Lines whose estimate lies near the threshold get an exact distinct count. Lines on `min_sites` sites or
more are boilerplate and leave every document, whatever share of it they are. With `spare_copies`, a text that as a whole,
byte for byte, is on `min_sites` sites or more stays as it is in each of its copies, for a near-duplicate stage behind to
leave one.

A line is what \\n parts, without the white space [\\x20\\x09-\\x0D] at its ends.
Defined results: a null text or site: no lines, or one site of its own name; repeated rows count one site;
a document without such lines stays as it is; an empty table gives no rows; other columns pass through untouched, but
for those named like the three counts of the result, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common

NO_SITE = "\x00none"
#: Columns of the joins, which are none of the callers'.
T1, T2, WHOLE, LINES = (f"_line_dedup_{c}" for c in ("t1", "t2", "whole", "lines"))


def _lines(data: np.ndarray, offsets: np.ndarray):
    """(text number, first byte, byte behind, words, hash) of each line that has a word."""
    start, end, doc = common.words(data, offsets)
    breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
    line = breaks[start] + doc  # grows with each line and each text
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(start) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:], [len(start)]]) - 1 if len(start) else first
    return doc[first], start[first], end[last], last - first + 1, common.span_hash(common.prefix_hash(data), start[first], end[last])


def _occurrences(min_words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sites = batch.column("site").dictionary_encode()
            code = sites.indices.to_numpy()
            for rows, data, offsets in common.steps(batch):
                doc, _, _, n, h = _lines(data, offsets)
                keep = n >= min_words
                pairs = np.unique(np.stack([h[keep].view(np.int64), code[rows][doc[keep]].astype(np.int64)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), sites.dictionary.take(pa.array(pairs[:, 1]))], names=["line", "site"])

    return scan


def boilerplate(docs: DataFrame, min_sites: int = 10, min_words: int = 1, near: float = 0.5) -> DataFrame:
    """`line`: hashes of the lines on min_sites sites or more."""
    seen = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("source").cast("string"), F.lit(NO_SITE)).alias("site")).mapInArrow(_occurrences(min_words), "line long, site string")
    spread = common.handed_over(
        seen.groupBy("line").agg(F.hll_sketch_agg("site", 10).alias("sketch")).select("line", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites * (1 - near)), "line-spread"
    )
    sure = spread.filter(F.col("sites") > min_sites * (1 + near)).select("line")
    unsure = spread.filter(F.col("sites") <= min_sites * (1 + near)).select("line")
    exact = seen.join(_small(unsure), "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("sites")).filter(F.col("sites") >= min_sites).select("line")
    return common.handed_over(sure.unionByName(exact), "boilerplate")


def _small(lines: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Sent to every executor only if counted to be small; else Spark shuffles it."""
    return F.broadcast(lines) if lines.count() <= most else lines


def _remove(min_words: int, everywhere: np.ndarray | None):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = None if everywhere is not None else batch.column(LINES)
            whole = batch.column(WHOLE).fill_null(False).to_numpy(zero_copy_only=False)
            for rows, data, offsets in common.steps(batch):
                doc, first, behind, n, h = _lines(data, offsets)
                n_docs = len(offsets) - 1
                if everywhere is not None:
                    at = np.searchsorted(everywhere, h)
                    at[at == len(everywhere)] = 0
                    hit = everywhere[at] == h if len(everywhere) else np.zeros(len(h), bool)
                else:
                    lists = own.slice(rows.start, n_docs)
                    hit = np.zeros(len(h), bool)
                    edges = np.searchsorted(doc, np.arange(n_docs + 1))
                    for i in np.flatnonzero(lists.value_lengths().fill_null(0).to_numpy()):
                        hit[edges[i] : edges[i + 1]] = np.isin(h[edges[i] : edges[i + 1]], np.array(lists[i].as_py(), np.int64).view(np.uint64))
                hit &= n >= min_words
                drop = hit & ~whole[rows][doc]
                n_lines, n_drop, n_hit = (np.bincount(doc[x], minlength=n_docs) for x in (slice(None), drop, hit))
                texts = batch.column("text").slice(rows.start, n_docs).to_pylist()
                edges = np.searchsorted(doc, np.arange(n_docs + 1))
                for i in np.flatnonzero(n_drop):
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    cut, out = 0, []
                    lines = raw.split(b"\n")
                    # lines with a word, in order, stand at these places
                    places = np.searchsorted(np.cumsum([len(x) + 1 for x in lines]), first[edges[i] : edges[i + 1]] - offsets[i], "right")
                    dropped = set(places[drop[edges[i] : edges[i + 1]]].tolist())
                    out = [x for k, x in enumerate(lines) if k not in dropped]
                    texts[i] = b"\n".join(out).decode("utf-8", "surrogateescape")
                rest = [batch.column(c).slice(rows.start, n_docs) for c in batch.schema.names if c not in ("text", LINES, WHOLE)]
                names = [c for c in batch.schema.names if c not in ("text", LINES, WHOLE)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string()), pa.array(n_lines), pa.array(n_hit), pa.array(n_drop)], names=[*names, "text", "n_lines", "n_boilerplate_lines", "n_removed_lines"])

    return remove


def cleaned(docs: DataFrame, min_sites: int = 10, min_words: int = 1, near: float = 0.5, most_everywhere: int = 1_000_000, spare_copies: bool = False) -> DataFrame:
    """docs with text cleaned, n_lines, n_boilerplate_lines (found) and n_removed_lines; docs needs doc_id, text, source.

    Boilerplate hashes go to every task if there are at most `most_everywhere` (8 MB); else they meet the documents in a join."""
    docs = docs.withColumn("text", F.col("text").cast("string")).drop("n_lines", "n_boilerplate_lines", "n_removed_lines")
    lines = boilerplate(docs, min_sites, min_words, near)
    order = [c for c in docs.columns if c != "text"] + ["text"]
    schema = docs.select(*order).schema.add("n_lines", "long").add("n_boilerplate_lines", "long").add("n_removed_lines", "long")
    keyed = docs.withColumns(dict(zip((T1, T2), common.text_key(), strict=True)))
    keyed = keyed.join(_small(_whole_copies(keyed, min_sites)), [T1, T2], "left") if spare_copies else keyed.withColumn(WHOLE, F.lit(False))
    if lines.count() <= most_everywhere:
        everywhere = np.sort(lines.toArrow().column("line").to_numpy().view(np.uint64))
        return keyed.drop(T1, T2).mapInArrow(_remove(min_words, everywhere), schema)
    hits = keyed.select(T1, T2, "text").mapInArrow(_own_lines(min_words), f"{T1} long, {T2} long, line long").join(lines, "line", "left_semi")
    hits = hits.distinct().groupBy(T1, T2).agg(F.collect_list("line").alias(LINES))
    return keyed.join(hits, [T1, T2], "left").drop(T1, T2).mapInArrow(_remove(min_words, None), schema)


def _whole_copies(keyed: DataFrame, min_sites: int) -> DataFrame:
    """The keys of the texts that as a whole are on min_sites sites or more."""
    seen = keyed.select(T1, T2, F.coalesce(F.col("source").cast("string"), F.lit(NO_SITE)).alias("site")).distinct()
    return common.handed_over(seen.groupBy(T1, T2).agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites).select(T1, T2, F.lit(True).alias(WHOLE)), "whole-copies")


def _own_lines(min_words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in common.steps(batch):
                doc, _, _, n, h = _lines(data, offsets)
                doc, h = doc[n >= min_words], h[n >= min_words]
                take = pa.array(doc + rows.start)
                yield pa.RecordBatch.from_arrays([batch.column(T1).take(take), batch.column(T2).take(take), pa.array(h.view(np.int64))], names=[T1, T2, "line"])

    return scan


def op9_line_spread(spark, sf_dir: str) -> DataFrame:
    out = cleaned(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_boilerplate_lines", "n_removed_lines", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_kept_bytes"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, text, u.i AS i, u.l AS l, trim(u.l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
  FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i) u
), spread AS (
  SELECT t FROM lines WHERE t <> '' GROUP BY t HAVING count(DISTINCT coalesce(source, chr(0) || 'none')) >= 10
), marked AS (
  SELECT l.*, s.t IS NOT NULL AS hit FROM lines l LEFT JOIN spread s ON l.t = s.t
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE t <> '') AS n_lines, count(*) FILTER (WHERE hit) AS n_hit, count(*) FILTER (WHERE hit) AS n_gone,
         string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT hit) AS text
  FROM marked GROUP BY doc_id
)
SELECT x.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_hit, 0)::BIGINT AS n_boilerplate_lines, coalesce(k.n_gone, 0)::BIGINT AS n_removed_lines,
       strlen(coalesce(k.text, ''))::BIGINT AS n_kept_bytes, md5(coalesce(k.text, '')) AS kept_md5
FROM documents x LEFT JOIN kept k USING (doc_id)
"""
