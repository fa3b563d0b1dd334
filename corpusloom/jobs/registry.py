"""The library's own queries by name, with their SQL.

Records are documents (repository: source), vectors are embeddings, scans are orders, the job queue is events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.jobs import collection, store, streams, texts, upkeep  # noqa: F401  (their queries register themselves)
from corpusloom.jobs.base import oracle_sql, queries, query  # noqa: F401
from corpusloom.operators import chunks, graph, knn
from corpusloom.sources.tables import handed_over, table

NEAR = 0.35

_HITS = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id AS q_id, b.vec_id AS m_id, list_cosine_similarity(a.e, b.e) AS score FROM v a, v b),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 12) DESC, m_id) AS r FROM s),
hits AS (SELECT q_id, m_id, score FROM r WHERE r <= 10 AND score >= 0.35 AND q_id <> m_id)
"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.knn_join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 10, NEAR)


@query(_HITS + "SELECT q_id, m_id, round(score, 6) AS score FROM hits")
def knn_topk(spark, sf_dir):
    return _hits(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(_HITS + "SELECT least(q_id, m_id) AS a, greatest(q_id, m_id) AS b, round(max(score), 6) AS score FROM hits GROUP BY 1, 2")
def candidate_pairs(spark, sf_dir):
    return knn.candidate_pairs(_hits(spark, sf_dir)).withColumn("score", F.round("score", 6))


_PAIRS = _HITS + ", p AS (SELECT least(q_id, m_id) AS a, greatest(q_id, m_id) AS b, max(score) AS score FROM hits GROUP BY 1, 2)"
_CLIQUES = _PAIRS.replace("WITH v", "WITH RECURSIVE v", 1) + """,
o AS (SELECT a, b, score, row_number() OVER (ORDER BY round(score, 12) DESC, a, b) AS i FROM p),
ends AS (SELECT a AS x, b AS y, i FROM o UNION ALL SELECT b, a, i FROM o),
near AS (SELECT map(list(x), list(ys)) AS m FROM (SELECT x, list(y ORDER BY i) AS ys FROM ends GROUP BY x)),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS used, []::BIGINT[] AS clique
UNION ALL SELECT k.i, list_concat(k.used, k.clique), k.clique FROM (SELECT o.i, w.used, CASE WHEN list_contains(w.used, o.a) OR list_contains(w.used, o.b) THEN []::BIGINT[] ELSE
list_reduce(list_concat([[o.a, o.b]], list_transform(list_filter(list_concat(near.m[o.a], near.m[o.b]), lambda x: NOT list_contains(w.used, x)), lambda x: [x])),
lambda c, x: CASE WHEN NOT list_contains(c, x[1]) AND list_has_all(near.m[x[1]], c) THEN list_concat(c, x) ELSE c END) END AS clique FROM walk w JOIN o ON o.i = w.i + 1, near) k),
members AS (SELECT list_min(clique) AS group_id, unnest(clique) AS member FROM walk WHERE len(clique) > 0)
"""


def _cliques(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The pairs, their scores rounded so that ties are ties, and the cliques that cover them."""
    pairs = handed_over(knn.candidate_pairs(_hits(spark, sf_dir)).withColumn("score", F.round("score", 12)), "pairs")
    return pairs, knn.clique_cover(pairs)


@query(_CLIQUES + """, e AS (SELECT g.group_id, g.member, p.score FROM members g JOIN members h ON g.group_id = h.group_id AND g.member <> h.member JOIN p ON p.a = least(g.member, h.member) AND p.b = greatest(g.member, h.member)),
m AS (SELECT group_id, member, round(avg(score), 6) AS score FROM e GROUP BY 1, 2), c AS (SELECT group_id, round(avg(score), 6) AS avg_confidence FROM e GROUP BY 1),
t AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, member) AS place FROM m)
SELECT group_id, member, place AS rank, CASE WHEN place = 1 THEN 'MERGE' ELSE 'CLOSE' END AS verdict, score, avg_confidence FROM t JOIN c USING (group_id)""")
def entry_dupe_groups(spark, sf_dir):
    """Vectors -> neighbours -> pairs -> cliques, never by transitivity -> members ranked by their mean score in the group."""
    pairs, groups = _cliques(spark, sf_dir)
    groups = handed_over(groups, "groups")
    mine, other = groups.select("group_id", "member"), groups.select("group_id", F.col("member").alias("other"))
    both = mine.join(other, "group_id").filter("member != other").select("group_id", "member", F.least("member", "other").alias("a"), F.greatest("member", "other").alias("b")).join(pairs, ["a", "b"])
    score = F.round(F.avg("score"), 6)
    ranked = both.groupBy("group_id", "member").agg(score.alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("score"), "member")).cast("long"))
    verdict = F.when(F.col("rank") == 1, "MERGE").otherwise("CLOSE").alias("verdict")
    return ranked.join(both.groupBy("group_id").agg(score.alias("avg_confidence")), "group_id").select("group_id", "member", "rank", verdict, "score", "avg_confidence")


@query(_CLIQUES + "SELECT group_id, member FROM members")
def clique_cover(spark, sf_dir):
    return _cliques(spark, sf_dir)[1].select("group_id", "member")


@query(_PAIRS.replace("WITH v", "WITH RECURSIVE v", 1) + """, e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), reach AS (SELECT a AS node, a AS label FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.label = e.a)
SELECT node, min(label) AS label FROM reach GROUP BY 1""")
def connected_components(spark, sf_dir):
    return graph.components(knn.candidate_pairs(_hits(spark, sf_dir)))


@query(_HITS + "SELECT q_id, m_id, round(score, 6) AS score FROM hits WHERE m_id IN (SELECT doc_id FROM labels)")
def neighbours_in_scan(spark, sf_dir):
    """Neighbours outside the scan's own records go after the best k are found, and so leave their places empty."""
    scan = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("m_id")).distinct()
    return _hits(spark, sf_dir).join(scan, "m_id", "left_semi").select("q_id", "m_id", F.round("score", 6).alias("score"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS c, (embedding::DOUBLE[])[1:8] AS i FROM embeddings), s AS (SELECT a.vec_id AS q_id, b.vec_id AS m_id, list_cosine_similarity(a.c, b.c) AS code, list_cosine_similarity(a.i, b.i) AS intent FROM v a, v b),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(code, 12) DESC, m_id) AS rc, row_number() OVER (PARTITION BY q_id ORDER BY round(intent, 12) DESC, m_id) AS ri FROM s),
h AS (SELECT q_id, m_id, code AS score, 'code' AS signal FROM r WHERE rc <= 10 AND code >= 0.35 AND q_id <> m_id UNION ALL SELECT q_id, m_id, intent, 'intent' FROM r WHERE ri <= 10 AND intent >= 0.85 AND q_id <> m_id)
SELECT least(q_id, m_id) AS a, greatest(q_id, m_id) AS b, round(max(score), 6) AS score, count(DISTINCT signal) AS signals FROM h GROUP BY 1, 2""")
def candidate_pairs_two_signals(spark, sf_dir):
    """A pair counts if either signal proposes it, from either end."""
    e = table(spark, sf_dir, "embeddings")
    intent = knn.knn_join(e.select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 8).alias("vector")), 10, 0.85)
    both = _hits(spark, sf_dir).withColumn("signal", F.lit("code")).unionByName(intent.withColumn("signal", F.lit("intent")))
    return both.groupBy(F.least("q_id", "m_id").alias("a"), F.greatest("q_id", "m_id").alias("b")).agg(F.round(F.max("score"), 6).alias("score"), F.count_distinct("signal").alias("signals"))


@query("SELECT md5(text) AS text_md5, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("text_md5")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).filter("n > 1")


@query("""SELECT doc_id, substr(sha256(md5(coalesce(text, '')) || '|' || coalesce(source, '') || '|' || coalesce(text, '') || '|' || to_json([coalesce(lang, ''), coalesce(source, '')])::VARCHAR), 1, 16) AS embed_hash FROM documents""")
def embed_hash(spark, sf_dir):
    """Of the diff's hash, the title, the body and the paths as JSON; a null is empty but keeps its place."""
    none = F.lit("")
    text, source, paths = F.coalesce("text", none), F.coalesce("source", none), F.to_json(F.array(F.coalesce("lang", none), F.coalesce("source", none)))
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(F.concat_ws("|", F.md5(text), source, text, paths), 256), 1, 16).alias("embed_hash"))


@query("SELECT doc_id, regexp_replace(md5(source || '-' || doc_id || '-code'), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS point_id FROM documents")
def point_uuid(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.md5(F.concat_ws("-", "source", "doc_id", F.lit("code"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5").alias("point_id"))


@query("SELECT doc_id, ceil(length(text) / 3.5)::BIGINT AS tokens_35, ceil(length(text) / 4.0)::BIGINT AS tokens_4 FROM documents")
def token_heuristic(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.ceil(F.length("text") / F.lit(3.5)).alias("tokens_35"), F.ceil(F.length("text") / F.lit(4.0)).alias("tokens_4"))


@query("SELECT doc_id, substr(text, 1, 200) AS label FROM documents")
def label_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 200).alias("label"))


@query("SELECT c_custkey, CASE WHEN length(c_name) > 4 THEN '****' || right(c_name, 4) ELSE c_name END AS redacted FROM customer")
def redact(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.length("c_name") > 4, F.concat(F.lit("****"), F.expr("right(c_name, 4)"))).otherwise(F.col("c_name")).alias("redacted"))


@query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(max(o_orderkey) FILTER (WHERE o_orderstatus = 'O'), -1) AS active FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def repo_enrichment(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("active"))
    c = table(spark, sf_dir, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("active", F.lit(-1)).alias("active"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus = 'F') WHERE r = 1")
def latest_scan_per_repo(spark, sf_dir):
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return done.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", "m.o_orderkey", "m.o_orderdate")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'P') GROUP BY 1")
def active_scan(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(~F.col("o_orderstatus").isin("F", "P")).groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def in_list_semi(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m"))
    return e.select("user_id", "event_type", "m.event_id", "m.ts", "m.value")


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def incremental_since(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("ts >= TIMESTAMP '2024-01-15 00:00:00'").select("event_id", "user_id")


@query("SELECT event_id, (CASE WHEN event_type = 'error' THEN 60000 ELSE 1000 END * pow(2, event_id % 4))::BIGINT AS delay_ms, event_id % 4 + 1 >= 3 AS exhausted FROM events")
def retry_backoff(spark, sf_dir):
    base = F.when(F.col("event_type").rlike("(?i)error"), 60000).otherwise(1000)
    return table(spark, sf_dir, "events").select("event_id", (base * F.pow(F.lit(2), F.col("event_id") % 4)).cast("long").alias("delay_ms"), (F.col("event_id") % 4 + 1 >= 3).alias("exhausted"))


@query("""SELECT event_type, round(sum(json_extract(props, '$.k')::BIGINT) / 1e6 * coalesce(max(p), 0), 9) AS cost FROM events
LEFT JOIN (VALUES ('click', 0.05), ('view', 0.4), ('purchase', 0.02)) t(kind, p) ON event_type = kind GROUP BY 1""")
def cost_estimate(spark, sf_dir):
    price = F.create_map(*[F.lit(x) for x in ("click", 0.05, "view", 0.4, "purchase", 0.02)])
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))
    return e.select("event_type", F.round(F.col("k") / 1e6 * F.coalesce(F.try_element_at(price, F.col("event_type")), F.lit(0.0)), 9).alias("cost"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_decode(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("""SELECT doc_id, first_doc, r AS rank, CASE WHEN r = 1 THEN 'MERGE' ELSE 'CLOSE' END AS tag FROM
(SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_doc, row_number() OVER (PARTITION BY text ORDER BY coalesce(quality, 0) DESC, doc_id) AS r, count(*) OVER (PARTITION BY text) AS n
FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)) WHERE n > 1""")
def rank_members(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h")).join(labels, "doc_id", "left")
    w = Window.partitionBy("h")
    r = F.row_number().over(w.orderBy(F.desc(F.coalesce("quality", F.lit(0))), "doc_id"))
    d = d.select("doc_id", F.min("doc_id").over(w).alias("first_doc"), r.alias("rank"), F.count("*").over(w).alias("n")).filter("n > 1")
    return d.select("doc_id", "first_doc", F.col("rank").cast("long").alias("rank"), F.when(F.col("rank") == 1, "MERGE").otherwise("CLOSE").alias("tag"))


@query("SELECT count(*) AS n_scans, count(DISTINCT o_custkey) AS n_repos, round(sum(o_totalprice), 2) AS total FROM orders")
def cumulative_stats(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n_scans"), F.count_distinct("o_custkey").alias("n_repos"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) OVER w AS before, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 AS latest
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def trend_series(spark, sf_dir):
    w = Window.partitionBy("o_custkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.lag("o_totalprice").over(w.orderBy("o_orderkey")).alias("before"), (F.row_number().over(w.orderBy(F.desc("o_orderkey"))) == 1).alias("latest"))


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey")
def pair_key_dedup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_partkey != l_suppkey").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()


@query("""SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'open' ELSE 'closed' END AS state FROM customer""")
def stale_close(spark, sf_dir):
    """Stored records that a fetch doesn't have any more are closed."""
    fetched = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("there")).distinct()
    return table(spark, sf_dir, "customer").select("c_custkey").join(fetched, "c_custkey", "left").select("c_custkey", F.when(F.col("there"), "open").otherwise("closed").alias("state"))


@query("""SELECT source, count(*) AS n, count(*) FILTER (WHERE r > 1) AS n_dup, round(100.0 * count(*) FILTER (WHERE r > 1) / count(*))::BIGINT AS pct
FROM (SELECT source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) GROUP BY 1""")
def dup_count_pct(spark, sf_dir):
    """Of each source, the documents that are not the first with their text; null is a text of its own, and of rows that repeat one is first."""
    d = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h"), "doc_id", "source").agg(F.count("*").alias("k"))
    first = d.groupBy("h").agg(F.min(F.struct("doc_id", "source")).alias("first"))
    both = d.join(first.withColumnRenamed("h", "g"), F.col("h").eqNullSafe(F.col("g"))).withColumn("dup", F.col("k") - F.struct("doc_id", "source").eqNullSafe(F.col("first")).cast("int"))
    return both.groupBy("source").agg(F.sum("k").alias("n"), F.sum("dup").alias("n_dup"), F.round(100 * F.sum("dup") / F.sum("k")).cast("long").alias("pct"))


@query("""SELECT d.doc_id, coalesce(d.h = s.h, false) AS hit FROM (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents) d
LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'stale' ELSE md5(coalesce(text, '')) END AS h FROM documents JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)) s USING (doc_id)""")
def hash_partition(spark, sf_dir):
    """Which records' stored features are still valid, as their content hash is the one they were made from; new records have none."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    stored = d.join(marks, "doc_id").select("doc_id", F.when(F.col("toxic") == 1, "stale").otherwise(F.col("h")).alias("s"))
    return d.join(stored, "doc_id", "left").select("doc_id", F.coalesce(F.col("h") == F.col("s"), F.lit(False)).alias("hit"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, md5(coalesce(text, ''))) AS r, ceil(length(coalesce(text, '')) / 4.0)::BIGINT + 50 AS n FROM conversations),
c AS (SELECT conv_id, r, 0::BIGINT AS chunk, n AS filled, 1 AS k FROM t WHERE r = 1
UNION ALL SELECT t.conv_id, t.r, CASE WHEN c.filled + t.n > 400 OR c.k = 3 THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN c.filled + t.n > 400 OR c.k = 3 THEN t.n ELSE c.filled + t.n END, CASE WHEN c.filled + t.n > 400 OR c.k = 3 THEN 1 ELSE c.k + 1 END
FROM c JOIN t ON t.conv_id = c.conv_id AND t.r = c.r + 1)
SELECT conv_id, chunk, count(*) AS n_turns, max(filled) AS tokens FROM c GROUP BY 1, 2""")
def chunk_by_budget(spark, sf_dir):
    """Turns of a conversation in chunks of 400 tokens, 50 of them overhead a turn, and three turns at most; a larger turn stands alone."""
    text = F.coalesce("text", F.lit(""))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.struct("turn", F.md5(text)).alias("at"), (F.ceil(F.length(text) / F.lit(4.0)) + 50).alias("size"))
    return chunks.chunked(turns, 400, 3).select(F.col("key").alias("conv_id"), "chunk", F.col("n").alias("n_turns"), F.col("filled").alias("tokens"))


from corpusloom.jobs import deltas, records  # noqa: E402,F401  (its queries have the SQL of those above)
