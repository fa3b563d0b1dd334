"""Queries that keep tables and caches up to date: merges, replacements, caches of verdicts, counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.jobs.base import query
from corpusloom.operators import knn
from corpusloom.sources.tables import table

_PAIRS = "SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey"
_CACHED = f"""WITH p AS ({_PAIRS}), c AS (SELECT a, b, md5(a::VARCHAR) AS ha, CASE WHEN b % 3 = 0 THEN 'old' ELSE md5(b::VARCHAR) END AS hb, (a + b) % 100 / 100.0::DOUBLE AS confidence FROM p WHERE a % 2 = 0),
hits AS (SELECT p.a, p.b, c.confidence FROM p LEFT JOIN c ON p.a = c.a AND p.b = c.b AND ha = md5(p.a::VARCHAR) AND hb = md5(p.b::VARCHAR))"""


def _cached(spark, sf_dir):
    """Pairs, and the cached verdict where both contents are the ones it was made from."""
    h = table(spark, sf_dir, "lineitem").filter("l_partkey != l_suppkey").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()
    h = h.select("a", "b", F.md5(F.col("a").cast("string")).alias("ha"), F.md5(F.col("b").cast("string")).alias("hb"))
    cache = h.filter("a % 2 = 0").select("a", "b", "ha", F.when(F.col("b") % 3 == 0, "old").otherwise(F.col("hb")).alias("hb"), ((F.col("a") + F.col("b")) % 100 / 100).alias("confidence"))
    return h, cache


@query(_CACHED + " SELECT a, b, confidence FROM hits WHERE confidence IS NOT NULL")
def verdict_cache_hits(spark, sf_dir):
    h, cache = _cached(spark, sf_dir)
    return h.join(cache, ["a", "b", "ha", "hb"]).select("a", "b", "confidence")


@query(_CACHED + " SELECT a, b FROM hits WHERE confidence IS NULL")
def verdict_cache_misses(spark, sf_dir):
    h, cache = _cached(spark, sf_dir)
    return h.join(cache, ["a", "b", "ha", "hb"], "left_anti").select("a", "b")


@query(_CACHED + " SELECT a, b, coalesce(confidence, b % 7 / 10.0::DOUBLE) AS confidence FROM hits WHERE coalesce(confidence, b % 7 / 10.0::DOUBLE) >= 0.5")
def confirmed_edges(spark, sf_dir):
    """Cached and fresh verdicts as one set of edges, in one pass over the pairs."""
    h, cache = _cached(spark, sf_dir)
    both = h.join(cache, ["a", "b", "ha", "hb"], "left").withColumn("confidence", F.coalesce("confidence", F.col("b") % 7 / 10))
    return both.filter("confidence >= 0.5").select("a", "b", "confidence")


@query("SELECT doc_id, coalesce(max(d.source), 'Unknown') AS title, coalesce(max(d.n_chars), 0) AS n_chars, l.quality FROM labels l LEFT JOIN documents d USING (doc_id) GROUP BY 1, 4")
def members_with_details(spark, sf_dir):
    details = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.max("source").alias("title"), F.max("n_chars").alias("n_chars"))
    return table(spark, sf_dir, "labels").select("doc_id", "quality").distinct().join(details, "doc_id", "left").select("doc_id", F.coalesce("title", F.lit("Unknown")).alias("title"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"), "quality")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_by_parent(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(gone, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN url END AS answer, page_id % 7 = 0 AS failed FROM pages")
def aligned_results(spark, sf_dir):
    """Each request with its answer; a request without one is an error row."""
    asked = table(spark, sf_dir, "pages").select("page_id")
    answers = table(spark, sf_dir, "pages").filter("page_id % 7 != 0").select("page_id", F.col("url").alias("answer"), F.lit(False).alias("failed"))
    return asked.join(answers, "page_id", "left").select("page_id", "answer", F.coalesce("failed", F.lit(True)).alias("failed"))


@query("SELECT c_custkey, coalesce(n, 0) AS runs, round(c_acctbal + coalesce(spent, 0), 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS spent FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def counter_update(spark, sf_dir):
    more = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("spent"))
    c = table(spark, sf_dir, "customer").join(more, "c_custkey", "left")
    return c.select("c_custkey", F.coalesce("n", F.lit(0)).alias("runs"), F.round(F.col("c_acctbal") + F.coalesce("spent", F.lit(0.0)), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def startable_scans(spark, sf_dir):
    """Repositories without an active scan; the others reuse theirs."""
    active = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(active, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE n_chars = 0 OR text IS NULL) AS skipped, count(*) FILTER (WHERE length(text) > 12000) AS too_large, count(*) FILTER (WHERE lang IS NULL) AS no_lang FROM documents")
def ingest_counters(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.agg(F.count("*").alias("n"), F.count_if((F.col("n_chars") == 0) | F.col("text").isNull()).alias("skipped"), F.count_if(F.length("text") > 12000).alias("too_large"), F.count_if(F.col("lang").isNull()).alias("no_lang"))


@query("SELECT (ceil(greatest(max(p), 5) / 5.0) * 5 + 5)::BIGINT AS top FROM (SELECT 100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*) AS p FROM events GROUP BY user_id)")
def chart_axis(spark, sf_dir):
    p = table(spark, sf_dir, "events").groupBy("user_id").agg((100 * F.count_if(F.col("event_type") == "error") / F.count("*")).alias("p"))
    return p.agg((F.ceil(F.greatest(F.max("p"), F.lit(5.0)) / 5) * 5 + 5).alias("top"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'patched' END, c_mktsegment) AS segment, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 0.0 END, c_acctbal) AS balance FROM customer")
def patch_merge(spark, sf_dir):
    """A nested record under a patch by section: a null field of the patch keeps the base's."""
    key = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")).alias("base"))
    patch = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.when(key % 2 == 0, "patched").alias("segment"), F.when(key % 3 == 0, 0.0).alias("balance")).alias("patch"))
    return base.join(patch, "c_custkey", "left").select("c_custkey", *[F.coalesce(f"patch.{f}", f"base.{f}").alias(f) for f in ("segment", "balance")])


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS c, (embedding::DOUBLE[])[1:8] AS i FROM embeddings), s AS (SELECT a.vec_id AS q_id, b.vec_id AS m_id, round(list_cosine_similarity(a.c, b.c), 12) AS code,
round(list_cosine_similarity(a.i, b.i), 12) AS intent FROM v a, v b WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY code DESC, m_id) AS rc, row_number() OVER (PARTITION BY q_id ORDER BY intent DESC, m_id) AS ri FROM s),
h AS (SELECT q_id, m_id, CASE WHEN rc <= 11 THEN code ELSE 0 END AS code, CASE WHEN ri <= 11 THEN intent ELSE 0 END AS intent FROM r WHERE (rc <= 11 OR ri <= 11) AND q_id <> m_id),
t AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY greatest(code, intent) DESC, m_id) AS k FROM h)
SELECT q_id, m_id, round(code, 6) AS code_score, round(intent, 6) AS intent_score FROM t WHERE k <= 10""")
def review_similar(spark, sf_dir):
    """For each asked record the ten most similar of two collections, by the better of the two scores."""
    e = table(spark, sf_dir, "embeddings")
    asked = F.col("id") % 50 == 0
    code = knn.knn_join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 11, -1.0, asks=asked)
    intent = knn.knn_join(e.select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 8).alias("vector")), 11, -1.0, asks=asked)
    return knn.merged(code, intent, 10).select("q_id", "m_id", F.round("code_score", 6).alias("code_score"), F.round("intent_score", 6).alias("intent_score"))
