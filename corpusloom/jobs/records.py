"""Queries over records of scans: usage by phase, updates of some columns, closed records and their counts, relationships."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import bpe
from corpusloom.jobs import registry as base_queries
from corpusloom.jobs.base import query
from corpusloom.operators import knn
from corpusloom.sources import sinks
from corpusloom.sources.tables import table

#: Phases of a scan in order; embedding has no output.
PHASES = ("intent", "embedding", "verify", "rank")


@query("""WITH t AS (SELECT conv_id, turn % 4 AS p, CASE WHEN role = 'assistant' THEN 'o' ELSE 'i' END AS d, ceil(length(coalesce(text, '')) / 4.0)::BIGINT AS n FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, """ + ", ".join(f"coalesce(sum(n) FILTER (WHERE p = {i} AND d = '{d}'), 0)::BIGINT AS {d}{i}" for i in range(4) for d in "io") + """ FROM t GROUP BY 1)
SELECT conv_id, '{"intent":{"input":' || i0 || ',"output":' || o0 || '},"embedding":{"input":' || i1 || '},"verify":{"input":' || i2 || ',"output":' || o2 || '},"rank":{"input":' || i3 || ',"output":' || o3 || '}}' AS token_usage,
i0 + i1 + i2 + i3 AS input_tokens, o0 + o2 + o3 AS output_tokens FROM s""")
def usage_by_phase(spark, sf_dir):
    """A scan's usage as nested JSON by phase, and its totals: embeddings count as input and have no output."""
    c = table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL").withColumn("n", F.ceil(F.length(F.coalesce("text", F.lit(""))) / F.lit(4.0)))
    output = F.coalesce(F.col("role") == "assistant", F.lit(False))

    def tokens(i, out):
        return F.coalesce(F.sum(F.when((F.col("turn") % 4 == i) & (output if out else ~output), F.col("n"))), F.lit(0)).cast("long")

    usage = F.struct(*[F.struct(*[tokens(i, d == "output").alias(d) for d in (("input",) if p == "embedding" else ("input", "output"))]).alias(p) for i, p in enumerate(PHASES)])
    used = c.groupBy("conv_id").agg(usage.alias("u"))
    total = {d: sum((F.col(f"u.{p}.{d}") for p in PHASES if (p, d) != ("embedding", "output")), F.lit(0)).cast("long") for d in ("input", "output")}
    return used.select("conv_id", F.to_json("u").alias("token_usage"), total["input"].alias("input_tokens"), total["output"].alias("output_tokens"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'done' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'failed at ' || o_orderkey WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS error,
CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey * 2 ELSE o_custkey END AS records FROM orders""")
def scan_update(spark, sf_dir):
    """Scans under an update that sets some columns of each, makes some null and leaves the others."""
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("error"), F.col("o_custkey").alias("records"))
    error = F.when(key % 3 == 0, F.struct(F.concat(F.lit("failed at "), key.cast("string")).alias("value"))).when(key % 5 == 0, F.struct(F.lit(None).cast("string").alias("value")))
    patches = o.filter((key % 2 == 0) | (key % 3 == 0) | (key % 5 == 0) | (key % 7 == 0)).select("o_orderkey", F.when(key % 2 == 0, F.struct(F.lit("done").alias("value"))).alias("status"), error.alias("error"), F.when(key % 7 == 0, F.struct((key * 2).alias("value"))).alias("records"))
    return sinks.patched(o, patches, ["o_orderkey"])


@query("""WITH r AS (SELECT c_nationkey AS repo, c_custkey AS number, CASE WHEN c_acctbal > 0 THEN 'open' ELSE 'merged' END AS state FROM customer),
f AS (SELECT DISTINCT o_custkey AS number FROM orders WHERE o_orderstatus = 'O')
SELECT repo, count(*) FILTER (WHERE state = 'open') AS open_before, count(*) FILTER (WHERE state = 'open' AND closes) AS closed, count(*) FILTER (WHERE state = 'open' AND NOT closes) AS open_after, count(*) FILTER (WHERE state = 'merged') AS others
FROM (SELECT *, repo % 6 <> 1 AND (repo % 5 = 0 OR number NOT IN (SELECT number FROM f)) AS closes FROM r) GROUP BY 1""")
def stale_close_counts(spark, sf_dir):
    """Open records before and after a fetch, and how many it closes: an empty fetch closes all of a repository, a repository that wasn't fetched keeps its own."""
    stored = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("repo"), F.col("c_custkey").alias("number"), F.when(F.col("c_acctbal") > 0, "open").otherwise("merged").alias("state"))
    seen = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("number")).distinct()
    fetched = stored.filter("repo % 6 != 1 AND repo % 5 != 0").join(seen, "number", "left_semi")
    rows = sinks.closed(stored, fetched, "repo", "number", stored.filter("repo % 6 != 1"))
    opened = F.col("state") == "open"
    return rows.groupBy("repo").agg(F.count_if(opened | F.col("closes")).alias("open_before"), F.count_if("closes").alias("closed"), F.count_if(opened).alias("open_after"), F.count_if(F.col("state") == "merged").alias("others"))


@query(base_queries._CLIQUES + """, e AS (SELECT g.group_id, p.a, p.b, p.score FROM members g JOIN members h ON g.group_id = h.group_id AND g.member < h.member JOIN p ON p.a = g.member AND p.b = h.member),
seeds AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY round(score, 12) DESC, a, b) AS r FROM e)
SELECT group_id, CASE (a + b) % 3 WHEN 0 THEN 'near' WHEN 1 THEN 'related' ELSE 'exact' END AS relationship, (SELECT count(*) FROM members m WHERE m.group_id = seeds.group_id) AS members FROM seeds WHERE r = 1""")
def group_relationships(spark, sf_dir):
    """Each group's relationship is that of the edge it grew from."""
    pairs, groups = base_queries._cliques(spark, sf_dir)
    kind = (F.col("a") + F.col("b")) % 3
    edges = pairs.withColumn("relationship", F.when(kind == 0, "near").when(kind == 1, "related").otherwise("exact"))
    return knn.related(groups, edges).groupBy("group_id", "relationship").agg(F.count("*").alias("members"))


@query()
def embedding_cut(spark, sf_dir):
    """What the embedding model gets of every document, at its limit of 8191 tokens, as length and hash."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    cut = bpe.embeddable(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return cut.select(F.col("id").alias("doc_id"), F.length("input").cast("long").alias("chars"), F.md5("input").alias("md5"))
