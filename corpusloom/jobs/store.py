"""Queries that write tables: inserts with ids, upserts, replaced results, cascades, exports; and look-ups in them.

Stored state is what events or orders were before a moment, fetched state is what they are since."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.jobs.base import query
from corpusloom.sources import sinks
from corpusloom.sources.tables import shared_folder, table

THEN = "2024-01-15 00:00:00"

_STATES = f"""WITH s AS (SELECT user_id, event_type, min((ts, event_id))[2] AS id, min(ts) AS created_at, max((ts, event_id, value))[3] AS value, max(ts) AS updated_at, md5(event_type || user_id) AS embed_hash
FROM events WHERE ts < TIMESTAMP '{THEN}' GROUP BY 1, 2),
n AS (SELECT user_id, event_type, min((ts, event_id))[2] AS id, min(ts) AS created_at, max((ts, event_id, value))[3] AS value, max(ts) AS updated_at FROM events WHERE ts >= TIMESTAMP '{THEN}' GROUP BY 1, 2)
"""


def _states(spark, sf_dir):
    """Records of a user and a kind of event: as stored, and as fetched since."""
    e = table(spark, sf_dir, "events")
    made = [F.min(F.struct("ts", "event_id"))["event_id"].alias("id"), F.min("ts").alias("created_at"), F.max(F.struct("ts", "event_id", "value"))["value"].alias("value"), F.max("ts").alias("updated_at")]
    stored, fetched = (e.filter(F.col("ts") < THEN if old else F.col("ts") >= THEN).groupBy("user_id", "event_type").agg(*made) for old in (True, False))
    return stored.withColumn("embed_hash", F.md5(F.concat("event_type", F.col("user_id").cast("string")))), fetched


@query(_STATES + """SELECT user_id, event_type, CASE WHEN s.user_id IS NOT NULL THEN s.id ELSE n.id END AS id, CASE WHEN s.user_id IS NOT NULL THEN s.created_at ELSE n.created_at END AS created_at,
CASE WHEN n.user_id IS NOT NULL THEN n.value ELSE s.value END AS value, CASE WHEN n.user_id IS NOT NULL THEN n.updated_at ELSE s.updated_at END AS updated_at,
CASE WHEN n.user_id IS NULL THEN s.embed_hash END AS embed_hash FROM s FULL JOIN n USING (user_id, event_type)""")
def upsert_records(spark, sf_dir):
    """A conflict keeps id and created_at and clears the cached hash."""
    stored, fetched = _states(spark, sf_dir)
    return sinks.upserted(stored, fetched, ["user_id", "event_type"], ["id", "created_at"], ["embed_hash"])


@query(_STATES + "SELECT user_id, event_type, id, value, updated_at FROM n UNION ALL SELECT user_id, event_type, id, value, updated_at FROM s ANTI JOIN n USING (user_id, event_type)")
def insert_or_replace(spark, sf_dir):
    stored, fetched = (x.select("user_id", "event_type", "id", "value", "updated_at") for x in _states(spark, sf_dir))
    return sinks.replaced(stored, fetched, ["user_id", "event_type"])


@query(_STATES + "SELECT user_id, event_type, s.updated_at IS NOT DISTINCT FROM n.updated_at AS skipped FROM s FULL JOIN n USING (user_id, event_type)")
def freshness_skips(spark, sf_dir):
    """Null-safe: a record is skipped if what was stored and what was fetched bear the same moment."""
    stored, fetched = _states(spark, sf_dir)
    both = stored.select("user_id", "event_type", F.col("updated_at").alias("old")).join(fetched.select("user_id", "event_type", "updated_at"), ["user_id", "event_type"], "full")
    return both.select("user_id", "event_type", F.col("old").eqNullSafe(F.col("updated_at")).alias("skipped"))


@query("SELECT row_number() OVER (ORDER BY first_doc) + 100 AS id, first_doc, n FROM (SELECT min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def insert_with_ids(spark, sf_dir):
    """New groups, with dense ids behind the last one given."""
    groups = table(spark, sf_dir, "documents").groupBy(F.coalesce(F.sha2("text", 256), F.lit("")).alias("h")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).filter("n > 1").drop("h")
    return sinks.numbered(groups, ["first_doc"], 101)


_RESULTS = "SELECT o_orderpriority AS scan, o_custkey AS member, count(*) AS n FROM orders {} GROUP BY 1, 2"


@query(f"SELECT * FROM ({_RESULTS.format('')}) WHERE scan IN ('1-URGENT', '2-HIGH') UNION ALL SELECT * FROM ({_RESULTS.format(chr(10) + chr(32) + 'WHERE o_orderdate < TIMESTAMP ' + chr(39) + '1997-01-01' + chr(39))}) WHERE scan NOT IN ('1-URGENT', '2-HIGH')")
def replace_results(spark, sf_dir):
    """Two scans run again replace their own results, whole, in the table of all scans."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("scan"), F.col("o_custkey").alias("member"), "o_orderdate")
    path = shared_folder(spark, "results")
    sinks.partitions_replaced(o.filter("o_orderdate < TIMESTAMP '1997-01-01'").groupBy("scan", "member").agg(F.count("*").alias("n")), path, "scan")
    again = o.filter(F.col("scan").isin("1-URGENT", "2-HIGH")).groupBy("scan", "member").agg(F.count("*").alias("n"))
    sinks.partitions_replaced(again, path, "scan")
    return spark.read.schema("member long, n long, scan string").parquet(path).select("scan", "member", "n")


_GONE = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"


@query(f"""SELECT 'orders' AS kind, o_orderkey AS k, count(*) AS n FROM orders WHERE o_custkey NOT IN ({_GONE}) GROUP BY 2 UNION ALL
SELECT 'lineitem', l_orderkey, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN ({_GONE})) GROUP BY 2""")
def cascade_delete(spark, sf_dir):
    """What is left below when repositories go: their scans, and the results of these."""
    gone = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    orders, items = sinks.deleted_below(gone, "c_custkey", (table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey"), (table(spark, sf_dir, "lineitem"), "l_orderkey", None))
    counts = [x.groupBy(F.col(k).alias("k")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "k", "n") for x, k, kind in ((orders, "o_orderkey", "orders"), (items, "l_orderkey", "lineitem"))]
    return counts[0].unionByName(counts[1])


@query(f"SELECT c_custkey, c_name, CASE WHEN c_mktsegment <> 'BUILDING' THEN md5(c_name) END AS embed_hash, CASE WHEN c_mktsegment <> 'BUILDING' THEN n END AS scans FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN ({_GONE}) GROUP BY 1) ON c_custkey = o_custkey")
def clear_scans(spark, sf_dir):
    """Scans of some repositories go, and their cached columns become null; the repositories stay."""
    c = table(spark, sf_dir, "customer")
    cleared = F.col("c_mktsegment") == "BUILDING"
    (left,) = sinks.deleted_below(c.filter(cleared), "c_custkey", (table(spark, sf_dir, "orders"), "o_custkey", None))
    scans = left.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("scans"))
    return c.join(scans, "c_custkey", "left").select("c_custkey", "c_name", F.when(~cleared, F.md5("c_name")).alias("embed_hash"), F.when(~cleared, F.col("scans")).alias("scans"))


@query("SELECT o_orderstatus AS repo, o_orderkey AS id, o_totalprice AS total, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey DESC) AS place FROM orders")
def json_dataset(spark, sf_dir):
    """Scans exported as JSON, a folder a repository, and found again there, the newest first."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("repo"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"))
    found = spark.read.schema("repo string, id long, total double").json(sinks.exported_json(o, "scans", "repo"))
    return found.select("repo", "id", "total", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("id"))).cast("long").alias("place"))


_LINES = "SELECT event_id, CASE WHEN value < 2 THEN '  ' WHEN value > 40 THEN substr(props, 1, length(props) - 1) ELSE props END AS line FROM events"


@query(f"SELECT event_id, CASE WHEN json_valid(line) THEN json_extract(line, '$.k')::BIGINT END AS k, CASE WHEN NOT json_valid(line) THEN line END AS error FROM ({_LINES}) WHERE trim(line) <> ''")
def jsonl_decode(spark, sf_dir):
    """Lines of a batch's output: blank ones are skipped, broken ones are errors of their own."""
    cut = F.expr("substr(props, 1, length(props) - 1)")
    lines = table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") < 2, "  ").when(F.col("value") > 40, cut).otherwise(F.col("props")).alias("line"))
    read = F.from_json("line", "k long, error string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "error"})
    return lines.filter("trim(line) != ''").select("event_id", read.alias("r")).select("event_id", "r.k", "r.error")


@query("""SELECT user_id, CASE WHEN merged_at IS NOT NULL THEN 'merged' WHEN closed_at IS NOT NULL THEN 'closed' ELSE 'open' END AS state FROM
(SELECT user_id, min(ts) FILTER (WHERE event_type = 'purchase' AND value > 15) AS merged_at, min(ts) FILTER (WHERE event_type = 'error' AND value > 15) AS closed_at FROM events GROUP BY 1)""")
def state_derivation(spark, sf_dir):
    first = {name: F.min(F.when((F.col("event_type") == kind) & (F.col("value") > 15), F.col("ts"))).alias(name) for name, kind in (("merged_at", "purchase"), ("closed_at", "error"))}
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(*first.values())
    return u.select("user_id", F.when(F.col("merged_at").isNotNull(), "merged").when(F.col("closed_at").isNotNull(), "closed").otherwise("open").alias("state"))


@query("SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS files, count(*) AS n FROM lineitem GROUP BY 1")
def child_rows_to_array(spark, sf_dir):
    """The changed files of a request, in their order, as one array (here joined to a text)."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("f"), F.count("*").alias("n"))
    return rows.select("l_orderkey", F.array_join(F.transform("f", lambda x: x["l_partkey"].cast("string")), ",").alias("files"), "n")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_custkey = 769 AND o_orderstatus <> 'P' ORDER BY o_orderkey")
def point_lookup(spark, sf_dir):
    """Rows under a key, in order; both conditions reach the scan."""
    return table(spark, sf_dir, "orders").filter("o_custkey = 769 AND o_orderstatus != 'P'").select("o_custkey", "o_orderkey", "o_orderdate").orderBy("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'N' ORDER BY l_orderkey, l_linenumber, l_partkey")
def open_records_in_order(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").select("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT l.doc_id, g.group_id, g.n FROM (SELECT DISTINCT doc_id FROM labels) l JOIN documents d USING (doc_id)
JOIN (SELECT text, min(doc_id) AS group_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1) g ON d.text IS NOT DISTINCT FROM g.text""")
def groups_with_record(spark, sf_dir):
    """For each asked record the groups that have it as a member."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.sha2("text", 256), F.lit("")).alias("h"))
    groups = d.groupBy("h").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n")).filter("n > 1")
    return d.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").join(groups, "h").select("doc_id", "group_id", "n")


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS g, l_linenumber AS number FROM lineitem WHERE l_returnflag <> 'R'),
k AS (SELECT l_orderkey AS g, l_linenumber AS number, l_quantity AS score, l_partkey AS pos FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber % 3 + 1, l_discount * 500, l_suppkey FROM lineitem),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, number ORDER BY round(score, 6) DESC, pos) AS r FROM k) WHERE r = 1),
j AS (SELECT f.*, count(*) OVER (PARTITION BY g) AS n FROM f JOIN m USING (g, number))
SELECT g, number, round(score, 6) AS score, row_number() OVER (PARTITION BY g ORDER BY round(score, 6) DESC, number) AS rank FROM j WHERE n >= 2""")
def dedup_rankings(spark, sf_dir):
    """Rankings of groups: the best per number wins, numbers that are no members go, and so do groups under two."""
    items = table(spark, sf_dir, "lineitem")
    members = items.filter("l_returnflag != 'R'").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("number")).distinct()
    said = items.selectExpr("l_orderkey AS g", "l_linenumber AS number", "round(l_quantity, 6) AS score", "l_partkey AS at").unionByName(items.selectExpr("l_orderkey AS g", "l_linenumber % 3 + 1 AS number", "round(l_discount * 500, 6) AS score", "l_suppkey AS at"))
    best = said.groupBy("g", "number").agg(F.max(F.struct("score", (-F.col("at")).alias("at")))["score"].alias("score")).join(members, ["g", "number"])
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "number"))
    return best.withColumn("n", F.count("*").over(Window.partitionBy("g"))).withColumn("rank", rank.cast("long")).filter("n >= 2").select("g", "number", "score", "rank")


@query("SELECT l_orderkey, count(*) FILTER (WHERE l_discount >= 0.05) AS n_members, count(*) AS pr_count, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) FILTER (WHERE l_discount >= 0.05) AS members FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_discount >= 0.05) > 0")
def min_score_nested(spark, sf_dir):
    """Groups with an array of members: those under the score go, emptied groups go; the stated count stays."""
    groups = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_discount").alias("score")))).alias("m"), F.count("*").alias("pr_count"))
    left = groups.withColumn("m", F.filter("m", lambda x: x["score"] >= 0.05)).filter(F.size("m") > 0)
    return left.select("l_orderkey", F.size("m").cast("long").alias("n_members"), "pr_count", F.array_join(F.transform("m", lambda x: x["l_linenumber"].cast("string")), ",").alias("members"))


#: Dollars for a million tokens, in and out.
PRICES = (("small-chat", 0.05, 0.40), ("small-embedding", 0.02, 0.0), ("large-embedding", 0.13, 0.0))
_MODEL = "CASE l_shipmonth % 4 WHEN 0 THEN 'small-chat' WHEN 1 THEN 'small-embedding' WHEN 2 THEN 'large-embedding' ELSE 'unknown' END"


@query(f"""WITH u AS (SELECT l_orderkey AS scan, l_returnflag AS phase, {_MODEL} AS model, floor(l_extendedprice)::BIGINT AS i, floor(l_quantity * 10)::BIGINT AS o FROM (SELECT *, month(l_shipdate) AS l_shipmonth FROM lineitem))
SELECT scan, phase, sum(i)::BIGINT AS tokens_in, sum(o)::BIGINT AS tokens_out, sum(i * coalesce(p_in, 0) + o * coalesce(p_out, 0))::BIGINT / 1e8::DOUBLE AS cost FROM u
LEFT JOIN (VALUES ('small-chat', 5, 40), ('small-embedding', 2, 0), ('large-embedding', 13, 0)) p(model, p_in, p_out) USING (model) GROUP BY 1, 2""")
def cost_by_phase(spark, sf_dir):
    """Tokens and cost of each scan and phase; an unknown model costs nothing."""
    prices = spark.createDataFrame([(m, round(100 * i), round(100 * o)) for m, i, o in PRICES], "model string, p_in long, p_out long")  # in cents, to add up exactly
    model = F.expr(_MODEL.replace("l_shipmonth", "month(l_shipdate)"))
    used = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan"), F.col("l_returnflag").alias("phase"), model.alias("model"), F.floor("l_extendedprice").alias("i"), F.floor(F.col("l_quantity") * 10).alias("o"))
    cost = F.col("i") * F.coalesce("p_in", F.lit(0)) + F.col("o") * F.coalesce("p_out", F.lit(0))
    return used.join(F.broadcast(prices), "model", "left").groupBy("scan", "phase").agg(F.sum("i").alias("tokens_in"), F.sum("o").alias("tokens_out"), (F.sum(cost) / 1e8).alias("cost"))


@query("SELECT sum(n)::BIGINT AS members, count(*) AS groups FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def group_totals(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").groupBy(F.coalesce(F.sha2("text", 256), F.lit(""))).agg(F.count("*").alias("n")).filter("n > 1")
    return groups.agg(F.sum("n").alias("members"), F.count("*").alias("groups"))


@query(f"""SELECT event_id, CASE WHEN queued AND due THEN 'running' ELSE status END AS status, attempts + (queued AND due)::INT AS attempts FROM
(SELECT *, status = 'queued' AS queued, run_after IS NULL OR run_after <= TIMESTAMP '{THEN}' AS due FROM
(SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'queued' END AS status, json_extract(props, '$.k')::INT % 3 AS attempts, CASE WHEN value > 10 THEN ts END AS run_after FROM events))""")
def queue_claim(spark, sf_dir):
    """A worker's turn over the whole queue: every queued job that is due is running from now on, with an attempt more."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").otherwise("queued")
    jobs = table(spark, sf_dir, "events").select("event_id", status.alias("status"), (F.get_json_object("props", "$.k").cast("int") % 3).alias("attempts"), F.when(F.col("value") > 10, F.col("ts")).alias("run_after"))
    due = (F.col("status") == "queued") & (F.col("run_after").isNull() | (F.col("run_after") <= THEN))
    return jobs.select("event_id", F.when(due, "running").otherwise(F.col("status")).alias("status"), (F.col("attempts") + due.cast("int")).alias("attempts"))


_NEXT = {"signup": ("view", "error"), "view": ("click", "error"), "click": ("purchase", "error"), "purchase": ("view",), "error": ("view", "signup")}


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (WHERE before IS NOT NULL AND (before, event_type) NOT IN (('signup', 'view'), ('signup', 'error'), ('view', 'click'), ('view', 'error'), ('click', 'purchase'), ('click', 'error'),
('purchase', 'view'), ('error', 'view'), ('error', 'signup'))) AS refused, max_by(event_type, (ts, event_id)) AS status FROM
(SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY 1""")
def state_transitions(spark, sf_dir):
    """How many steps of each record the state machine doesn't allow, and where it stands."""
    e = table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    allowed = F.lit(False)
    for state, after in _NEXT.items():
        allowed = allowed | ((F.col("before") == state) & F.col("event_type").isin(*after))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("before").isNotNull() & ~allowed).alias("refused"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


@query("""SELECT conv_id, coalesce(sum(n) FILTER (WHERE role = 'user'), 0)::BIGINT AS tokens_in, coalesce(sum(n) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS tokens_out, coalesce(sum(n), 0)::BIGINT AS total, count(DISTINCT role) AS phases
FROM (SELECT *, ceil(length(coalesce(text, '')) / 4.0)::BIGINT AS n FROM conversations) GROUP BY 1""")
def token_usage_rollup(spark, sf_dir):
    """Tokens of each conversation, in and out, and all."""
    c = table(spark, sf_dir, "conversations").withColumn("n", F.ceil(F.length(F.coalesce("text", F.lit(""))) / F.lit(4.0)))
    of = {name: F.coalesce(F.sum(F.when(F.col("role") == role, F.col("n"))), F.lit(0)).alias(name) for name, role in (("tokens_in", "user"), ("tokens_out", "assistant"))}
    return c.groupBy("conv_id").agg(*of.values(), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_distinct("role").alias("phases"))


@query("""SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, CASE WHEN l_partkey <= l_suppkey THEN h1 ELSE h2 END AS hash_a, CASE WHEN l_partkey <= l_suppkey THEN h2 ELSE h1 END AS hash_b, count(*) AS n
FROM (SELECT *, md5('p' || l_partkey) AS h1, md5('s' || l_suppkey) AS h2 FROM lineitem) GROUP BY 1, 2, 3, 4""")
def verdict_keys(spark, sf_dir):
    """Cache keys of verdicts: the lesser endpoint first, and the hashes swapped along with the endpoints."""
    p = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.md5(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("h1"), F.md5(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("h2"))
    in_order = F.col("l_partkey") <= F.col("l_suppkey")
    keys = p.select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"), F.when(in_order, F.col("h1")).otherwise(F.col("h2")).alias("hash_a"), F.when(in_order, F.col("h2")).otherwise(F.col("h1")).alias("hash_b"))
    return keys.groupBy("a", "b", "hash_a", "hash_b").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, 'Title: ' || coalesce(source, '') || E'\\nBody: ' || CASE WHEN coalesce(text, '') = '' THEN '(none)' ELSE substr(text, 1, 2000) END || E'\\n' ||
CASE WHEN length(coalesce(text, '')) BETWEEN 1 AND 12000 THEN 'Diff: ' || text ELSE 'Files: ' || coalesce(lang, '(none)') END AS prompt FROM documents""")
def intent_prompt(spark, sf_dir):
    """Body up to 2000 characters; the diff if it has 12000 or fewer, else the list of files."""
    n = F.length(F.coalesce("text", F.lit("")))
    body = F.when(n == 0, "(none)").otherwise(F.substring("text", 1, 2000))
    rest = F.when(n.between(1, 12000), F.concat(F.lit("Diff: "), "text")).otherwise(F.concat(F.lit("Files: "), F.coalesce("lang", F.lit("(none)"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Title: "), F.coalesce("source", F.lit("")), F.lit("\nBody: "), body, F.lit("\n"), rest).alias("prompt"))


@query("""SELECT l.doc_id, array_to_string(w[1:20], ', ') || E'\\n' || CASE WHEN coalesce(text, '') = '' THEN '(none)' ELSE substr(text, 1, 500) END AS side
FROM (SELECT DISTINCT doc_id FROM labels) l JOIN (SELECT doc_id, text, string_split(coalesce(text, ''), ' ') AS w FROM documents) d USING (doc_id)""")
def verify_prompt(spark, sf_dir):
    """One side of a pair to verify: twenty files at most, joined, and a body of 500 characters."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    files = F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 20), ", ")
    return d.select("doc_id", F.concat(files, F.lit("\n"), F.when(F.coalesce("text", F.lit("")) == "", "(none)").otherwise(F.substring("text", 1, 500))).alias("side"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def vector_lookup(spark, sf_dir):
    """Points by their ids."""
    asked = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf_dir, "embeddings").join(asked, "vec_id", "left_semi").select("vec_id", "label")


@query("SELECT vec_id, label FROM embeddings WHERE NOT coalesce(label = 3, false)")
def vector_delete(spark, sf_dir):
    """What is left when the points that a filter names are gone; an unknown answer is no match."""
    return table(spark, sf_dir, "embeddings").filter(~F.coalesce(F.col("label") == 3, F.lit(False))).select("vec_id", "label")
