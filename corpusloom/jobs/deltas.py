"""Queries that keep stored results in step with what has changed, and reuse what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.jobs import registry as base_queries
from corpusloom.jobs.base import oracle_sql, query
from corpusloom.operators import copies, features
from corpusloom.operators.maintenance import Neighbours
from corpusloom.sources import sinks
from corpusloom.sources.snapshots import Change, Snapshots
from corpusloom.sources.tables import shared_folder, table
from corpusloom.sources.timeline import Timeline
from corpusloom.sources.vectors import VectorCollection


@query(oracle_sql()["clique_cover"])
def incremental_groups(spark, sf_dir):
    """Groups after a first build without some vectors and with others turned round, and a change that mends both."""
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    n = Neighbours(VectorCollection(spark, shared_folder(spark, "incremental"), 500, 8), 10, base_queries.NEAR)
    extra = points.filter("id % 61 = 2").withColumn("id", F.col("id") + 1_000_000_000)
    n.changed(points.filter("id % 53 != 5").withColumn("vector", F.when(F.col("id") % 47 == 1, F.reverse("vector")).otherwise(F.col("vector"))).unionByName(extra))
    n.changed(points.filter("id % 53 = 5 OR id % 47 = 1"), extra)
    return n.groups().select("group_id", "member")


@query("""WITH g AS (SELECT text, min(doc_id) AS group_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
o AS (SELECT text, min(doc_id) AS group_id FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0 GROUP BY 1 HAVING count(*) > 1)
SELECT 1::BIGINT AS version, o.group_id, count(*) AS members FROM o JOIN documents d ON d.text = o.text AND d.doc_id % 2 = 0 GROUP BY 2
UNION ALL SELECT 2, g.group_id, count(*) FROM g JOIN documents d ON d.text = g.text GROUP BY 2""")
def groups_in_one_commit(spark, sf_dir):
    """Groups and members of two scans, each pair of tables one version; the reader of the first keeps it after the second."""
    store = Snapshots(spark, shared_folder(spark, "groups"))

    def scan(docs):
        d = docs.filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
        groups = d.groupBy("h").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n")).filter("n > 1")
        members = d.join(groups.select("h", "group_id"), "h").select("group_id", "doc_id")
        at = store.open()
        return store.commit(at, {"groups": Change(store.stage("groups", groups.select("group_id", "n"))), "members": Change(store.stage("members", members))})

    docs = table(spark, sf_dir, "documents")
    first = scan(docs.filter("doc_id % 2 = 0"))
    second = scan(docs)
    store.stage("groups", docs.select(F.col("doc_id").alias("group_id"), F.lit(0).cast("long").alias("n")))  # a scan that never commits
    parts = [v.table("members").join(v.table("groups"), "group_id").groupBy("group_id").agg(F.count("*").alias("members")).withColumn("version", F.lit(v.version).cast("long")) for v in (first, second)]
    return parts[0].unionByName(parts[1]).select("version", "group_id", "members")


@query("""SELECT c_nationkey::BIGINT AS nation, CASE WHEN c_nationkey < 18 THEN 'first' ELSE 'second' END AS export, count(*) AS n FROM customer WHERE c_nationkey >= 6 GROUP BY 1, 2""")
def export_in_step(spark, sf_dir):
    """Exports of nations 0 to 17, then in step with 6 to 24: those that are there stay, new ones come, vanished ones go."""
    path = shared_folder(spark, "exports")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    sinks.exported_in_step(c.filter("nation < 18").withColumn("export", F.lit("first")), path, "nation")
    sinks.exported_in_step(c.filter("nation >= 6").withColumn("export", F.lit("second")), path, "nation")
    back = spark.read.schema("c_custkey long, export string, nation long").json(path)
    return back.groupBy("nation", "export").agg(F.count("*").alias("n"))


_COPIES = base_queries._HITS.replace("SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings", "SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings UNION ALL SELECT vec_id * 100 + 1000000000 + i, embedding::DOUBLE[] FROM embeddings, range(CASE WHEN vec_id % 90 = 0 THEN 12 ELSE 1 END) r(i) WHERE vec_id % 3 = 0")


@query(_COPIES + "SELECT q_id, m_id, round(score, 6) AS score FROM hits")
def knn_with_copies(spark, sf_dir):
    """The neighbour join where over a third of the vectors are copies: one search for equal ones, members afterwards."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    more = e.filter("id % 3 = 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.when(F.col("id") % 90 == 0, 11).otherwise(0)))).select((F.col("id") * 100 + 1_000_000_000 + F.col("i")).alias("id"), "vector")
    return copies.knn_by_class(e.unionByName(more), 10, base_queries.NEAR).withColumn("score", F.round("score", 6))


@query("SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events WHERE event_id % 3 <> 0 AND ts < TIMESTAMP '2024-01-15 00:00:00')")
def incremental_with_mark(spark, sf_dir):
    """A reader has read all that had come by a moment; later it opens the files that may hold newer rows, and no others."""
    e = table(spark, sf_dir, "events")
    log = Timeline(spark, shared_folder(spark, "timeline"), "ts", rows_per_file=2000)
    early = (F.col("event_id") % 3 != 0) & (F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    log.append(e.filter(early))
    _, read = log.unread("scan")
    log.advanced("scan", read)
    log.append(e.filter(~early))
    return log.unread("scan")[0].select("event_id", "user_id")


@query(oracle_sql()["ingest_counters"])
def ingest_counters_in_passing(spark, sf_dir):
    """The counters of an ingest, taken while its rows are written."""
    d = table(spark, sf_dir, "documents")
    counts = {"n": F.count(F.lit(1)), "skipped": F.count_if((F.col("n_chars") == 0) | F.col("text").isNull()), "too_large": F.count_if(F.length("text") > 12000), "no_lang": F.count_if(F.col("lang").isNull())}
    seen = sinks.written_with_counts(d, lambda rows: rows.write.parquet(shared_folder(spark, "ingested")), **counts)
    return spark.createDataFrame([tuple(seen[c] for c in counts)], ", ".join(f"{c} long" for c in counts))


@query("SELECT doc_id, length(coalesce(text, '')) + CASE WHEN doc_id % 10 = 4 THEN 1 ELSE 0 END AS feature, CASE WHEN doc_id % 10 = 4 OR doc_id % 7 = 0 THEN 2 ELSE 1 END AS attempt FROM (SELECT doc_id, max(text) AS text FROM documents GROUP BY 1)")
def features_reused(spark, sf_dir):
    """A first attempt computes the features of most records, then fails; the next one computes what is missing or has changed since."""
    store = Snapshots(spark, shared_folder(spark, "features"))
    d = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.max("text").alias("text")).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))

    def attempt(records, number):
        def lengths(missing):
            return missing.select("id", F.length("text").alias("feature"), F.lit(number).alias("attempt"))

        hashed = records.withColumn("hash", F.sha2("text", 256))
        rows, _ = features.computed(hashed, store, "lengths", lengths, "feature int, attempt int", 8)
        if number == 1:
            raise RuntimeError("the stage behind the features fails")
        return rows

    try:
        attempt(d.filter("id % 7 != 0"), 1)
    except RuntimeError:
        pass
    changed = d.withColumn("text", F.when(F.col("id") % 10 == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return attempt(changed, 2).select(F.col("id").alias("doc_id"), F.col("feature").cast("long").alias("feature"), "attempt")
