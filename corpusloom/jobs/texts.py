"""Queries over text functions. Diffs, file lists and answers are derived from the given tables by plain expressions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import bpe
from corpusloom.functions import text as T
from corpusloom.jobs.base import query
from corpusloom.operators.prompts import rank_prompts
from corpusloom.sources.tables import table

_DIFF = """SELECT doc_id, 'diff --git a/z b/z/' || coalesce(source, '') || E'\nindex 1..2\n--- a\n+++ b\n@@ -1 +1 @@\n' || coalesce(text, '')
|| E'\ndiff --git a/' || coalesce(lang, '') || E' b/l\n  + ' || doc_id || E'\n\n' AS x FROM documents"""
_TRIM = r"regexp_replace({}, '^[\s\x0B\p{{Z}}\x{{FEFF}}]+|[\s\x0B\p{{Z}}\x{{FEFF}}]+$', '', 'g')"


@query(
    f"""WITH d AS ({_DIFF}),
p AS (SELECT doc_id, list_filter(regexp_split_to_array(x, '(?m)^diff --git '), lambda p: {_TRIM.format("p")} <> '') AS parts FROM d),
f AS (SELECT doc_id, list_transform(parts, lambda p: {{'path': regexp_extract(split_part(p, E'\\n', 1), '\\sb/(.+)$', 1), 'content': array_to_string(list_filter(list_transform(
list_filter(string_split(p, E'\\n')[2:], lambda x: NOT regexp_matches(x, '^(index |--- |\\+\\+\\+ |@@ )')), lambda x: {_TRIM.format("x")}), lambda x: x <> ''), E'\\n')}}) AS files FROM p)
SELECT doc_id, sha256(array_to_string(list_transform(list_sort(files), lambda f: f.content), E'\\n')) AS diff_hash FROM f"""
)
def diff_hash(spark, sf_dir):
    """Hash of the normalised diff of each document: two files out of order, with metadata lines."""
    none = F.lit("")
    diff = F.concat(
        F.lit("diff --git a/z b/z/"), F.coalesce("source", none), F.lit("\nindex 1..2\n--- a\n+++ b\n@@ -1 +1 @@\n"), F.coalesce("text", none),
        F.lit("\ndiff --git a/"), F.coalesce("lang", none), F.lit(" b/l\n  + "), F.col("doc_id").cast("string"), F.lit("\n\n"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", T.diff_hash(diff).alias("diff_hash"))


@query("""WITH t AS (SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, md5(coalesce(text, ''))) AS r FROM conversations),
u AS (SELECT *, sum(ceil(length(text) / 4.0) + (r > 1)::INT) OVER (PARTITION BY conv_id ORDER BY r) AS used FROM t)
SELECT conv_id, coalesce(nullif(string_agg(text, E'\\n' ORDER BY r) FILTER (WHERE used <= 120), ''), '(no files)') AS input FROM u GROUP BY 1""")
def code_input(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", "m").rowsBetween(Window.unboundedPreceding, -1)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(t).alias("m"), t.alias("t"))
    # Only the head that can fit meets in one row: a turn takes a token at least, for the break before it.
    turns = turns.withColumn("before", F.coalesce(F.sum(F.ceil(F.length("t") / 4) + 1).over(order), F.lit(0))).filter("before <= 121")
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "m", "t"))).alias("t"))
    return turns.select("conv_id", T.code_input(F.transform("t", lambda x: x["t"]), F.lit(120), F.lit("")).alias("input"))


@query("""WITH h AS (SELECT doc_id, coalesce(source, '') || E'\\n' || coalesce(text, '') AS h, coalesce(lang, '') AS lang FROM documents), n AS (SELECT *, ceil(length(h) / 4.0) AS n FROM h)
SELECT doc_id, CASE WHEN n >= 50 THEN substr(h, 1, floor(50::DOUBLE / n * length(h))::BIGINT) WHEN n + 1 + ceil(length(lang) / 4.0) <= 50 AND lang <> '' THEN h || E'\\n' || lang ELSE h END AS input FROM n""")
def intent_input(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.intent_input(F.col("source"), F.col("text"), F.array(F.coalesce("lang", F.lit(""))), 50).alias("input"))


@query("""SELECT doc_id, '#' || doc_id || ' ' || coalesce(source, '') || ' by ' || coalesce(lang, 'unknown') || E'\\nFiles: ' ||
CASE WHEN len(w) > 20 THEN array_to_string(w[1:20], ', ') || ', ... (+' || (len(w) - 20) || ' more)' ELSE array_to_string(w, ', ') END || E'\\nBody: ' ||
CASE WHEN text IS NULL THEN '(none)' WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS summary
FROM (SELECT *, string_split(coalesce(text, ''), ' ') AS w FROM documents)""")
def record_summary(spark, sf_dir):
    words = F.split(F.coalesce("text", F.lit("")), " ")
    made = T.summary(F.col("doc_id"), F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("unknown")), words, F.col("text"), 500, 20)
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("summary"))


@query("""WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, md5(coalesce(text, ''))) AS r, coalesce(role, '') || ': ' || coalesce(text, '') AS f FROM conversations),
s AS (SELECT *, substr(f, 1, 120) AS c, substr(f, 1, 40) AS l FROM c),
g AS (SELECT conv_id, count(*) AS n, sum(length(f)) + 2 * (count(*) - 1) AS fl, sum(length(c)) + 2 * (count(*) - 1) AS cl FROM s GROUP BY 1),
p AS (SELECT s.*, n, fl, cl, sum(length(c) + 2) OVER (PARTITION BY conv_id ORDER BY r) - 2 + length(E'\\n\\n(' || (n - r) || ' more left out for length)') AS used FROM s JOIN g USING (conv_id)),
k AS (SELECT *, max(CASE WHEN r >= 2 AND r < n AND used <= 350 THEN r END) OVER (PARTITION BY conv_id) AS most FROM p),
t AS (SELECT *, CASE WHEN fl <= 350 THEN 'full' WHEN cl <= 350 THEN 'cut' WHEN most IS NOT NULL THEN 'head' ELSE 'least' END AS tier FROM k)
SELECT conv_id, tier, count(*) AS n_kept, string_agg(CASE tier WHEN 'full' THEN f WHEN 'least' THEN l ELSE c END, E'\\n\\n' ORDER BY r) ||
CASE WHEN tier IN ('full', 'cut') THEN '' ELSE E'\\n\\n(' || (max(n) - greatest(count(*), 2)) || ' more left out for length)' END AS prompt
FROM t WHERE r <= CASE tier WHEN 'head' THEN most WHEN 'least' THEN 2 ELSE n END GROUP BY 1, 2""")
def rank_prompt(spark, sf_dir):
    """One prompt per conversation of 100 tokens at most, save where two records alone pass them."""
    full = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group"), F.struct("turn", F.md5(F.coalesce("text", F.lit("")))).alias("at"), full.alias("full"))
    made = rank_prompts(c.withColumn("cut", F.substring("full", 1, 120)).withColumn("least", F.substring("full", 1, 40)), 100)
    return made.withColumnRenamed("group", "conv_id")


@query("""WITH a AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"isDuplicate": true, "confidence": ' || event_id % 100 || ', "relationship": "near"}' WHEN 1 THEN '{"isDuplicate": "false", "confidence": "0.5"}'
WHEN 2 THEN '{"isDuplicate": 0, "confidence": "x", "relationship": null}' WHEN 3 THEN 'not json' WHEN 4 THEN 'null' ELSE '{"isDuplicate": false, "confidence": 1, "rationale": "r"}' END AS j FROM events),
v AS (SELECT event_id, json_valid(j) AND j <> 'null' AS ok, CASE WHEN json_valid(j) THEN j ELSE '{}' END AS j FROM a)
SELECT event_id, ok AND coalesce(CASE json_type(j, '$.isDuplicate') WHEN 'VARCHAR' THEN json_extract_string(j, '$.isDuplicate') <> '' ELSE json_extract_string(j, '$.isDuplicate') NOT IN ('false', '0', 'null') END, false) AS is_duplicate,
coalesce(try_cast(json_extract_string(j, '$.confidence') AS DOUBLE), 0) AS confidence, CASE WHEN ok THEN coalesce(json_extract_string(j, '$.relationship'), 'unknown') ELSE 'parse_error' END AS relationship,
CASE WHEN ok THEN coalesce(json_extract_string(j, '$.rationale'), '') ELSE 'no JSON' END AS rationale FROM v""")
def parsed_verdicts(spark, sf_dir):
    """Answers in code fences, of every form a model gives."""
    k = F.col("event_id") % 6
    answer = (
        F.when(k == 0, F.concat(F.lit('```json\n{"isDuplicate": true, "confidence": '), (F.col("event_id") % 100).cast("string"), F.lit(', "relationship": "near"}\n```')))
        .when(k == 1, F.lit('```\n{"isDuplicate": "false", "confidence": "0.5"}\n```\n')).when(k == 2, F.lit('{"isDuplicate": 0, "confidence": "x", "relationship": null}'))
        .when(k == 3, F.lit("not json")).when(k == 4, F.lit("null")).otherwise(F.lit('```JSON\n{"isDuplicate": false, "confidence": 1, "rationale": "r"}\n```'))
    )
    return table(spark, sf_dir, "events").select("event_id", T.verdict(answer).alias("v")).select("event_id", "v.*")


@query("""SELECT doc_id, CASE WHEN length(text) > 80 THEN CASE WHEN s > 40 THEN substr(text, 1, s) ELSE substr(text, 1, 80) END || '...' ELSE coalesce(text, '') END AS label
FROM (SELECT doc_id, text, length(regexp_extract(substr(text, 1, 80), '(?s)^(.*) ', 1)) AS s FROM documents)""")
def display_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.display_label(F.col("text")).alias("label"))


@query("""SELECT page_id, CASE WHEN ok THEN p[1] END AS owner, CASE WHEN ok THEN p[2] END AS name, try_cast(regexp_extract(url, '^\\D*(\\d+)', 1) AS BIGINT) AS number
FROM (SELECT *, len(p) = 2 AND p[1] <> '' AND p[2] <> '' AS ok FROM (SELECT page_id, url, string_split(regexp_extract(url, '://([^?#]*)', 1), '/') AS p FROM pages))""")
def slug_split(spark, sf_dir):
    s, digits = T.slug(F.regexp_extract("url", "://([^?#]*)", 1)), F.regexp_extract("url", r"^\D*(\d+)", 1)
    number = T.request_number(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("x/pull/"), digits, F.lit("/files"))).otherwise(F.concat(digits, F.lit("x"))))
    return table(spark, sf_dir, "pages").select("page_id", s["owner"].alias("owner"), s["name"].alias("name"), number.alias("number"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text, CASE WHEN h < 1 THEN 'just now' WHEN h < 24 THEN h || 'h ago' ELSE h // 24 || 'd ago' END AS age
FROM (SELECT *, floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3600000000)::BIGINT AS h FROM events)""")
def time_labels(spark, sf_dir):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_text"), T.age(F.col("ts"), now).alias("age"))


@query("""SELECT event_id, format('{:,}', event_id * 1009) AS thousands, CASE WHEN event_id % 400 < 1 THEN '<$0.01' ELSE '$' || printf('%.2f', event_id % 400 / 100.0) END AS cost FROM events""")
def number_labels(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.format_number(F.col("event_id") * 1009, 0).alias("thousands"), T.dollars(F.col("event_id") % 400 / 100).alias("cost"))


@query("SELECT doc_id, coalesce(source, '') || E'\\n' || coalesce(lang, '') AS code_text, CASE WHEN coalesce(text, '') = '' THEN ' ' ELSE substr(text, 1, 32764) END AS embeddable FROM documents")
def embedding_inputs(spark, sf_dir):
    none = F.lit("")
    return table(spark, sf_dir, "documents").select("doc_id", T.code_text(F.coalesce("source", none), F.array(F.coalesce("lang", none))).alias("code_text"), T.embeddable(F.col("text")).alias("embeddable"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.summary'), props) AS summary FROM events")
def summaries(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.summary_of(F.col("props")).alias("summary"))


@query()
def bpe_tokens(spark, sf_dir):
    """Tokens of every document by a byte-pair vocabulary, and the length and hash of what a limit of 8191 tokens leaves."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return bpe.counted(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).select(F.col("id").alias("doc_id"), "n_tokens", F.length("kept").cast("long").alias("kept_chars"), F.md5("kept").alias("kept_md5"))
