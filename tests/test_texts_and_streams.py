import datetime as dt

from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import knn
from corpusloom.operators.prompts import rank_prompts
from corpusloom.sources.snapshots import Snapshots
from corpusloom.streaming import jobs


def one(spark, c, **values):
    return spark.createDataFrame([Row(**values)]).select(c.alias("x")).head()["x"]


def test_normalized_diff(spark):
    diff = "diff --git a/z.ts b/z.ts\nindex 1..2 100644\n--- a/z.ts\n+++ b/z.ts\n@@ -1 +1 @@\n-  old\n+new  \n\ndiff --git a/a.ts b/a.ts\n+first\n"
    assert one(spark, T.normalized_diff(F.col("d")), d=diff) == "+first\n-  old\n+new"
    other = diff.replace("index 1..2", "index 8..9").replace("@@ -1 +1 @@", "@@ -7 +7 @@")
    assert one(spark, T.diff_hash(F.col("d")), d=other) == one(spark, T.diff_hash(F.col("d")), d=diff)
    assert one(spark, T.normalized_diff(F.col("d")), d="") == ""
    assert spark.range(1).select(T.normalized_diff(F.lit(None).cast("string"))).head()[0] == ""


def test_within_budget_stops_at_first_overflow(spark):
    items = ["abcd", "efgh", "x" * 40, "y"]
    assert one(spark, T.within_budget(F.col("i"), F.lit(4)), i=items) == "abcd\nefgh"
    assert one(spark, T.code_input(F.col("i"), F.lit(0), F.lit("")), i=items) == "(no files)"
    assert one(spark, T.code_input(F.col("i"), F.lit(0), F.lit("t")), i=items) == "t"


def test_verdict_coercions(spark):
    answers = {
        '```json\n{"isDuplicate": 1, "confidence": "0.9"}\n```': (True, 0.9, "unknown"),
        '{"isDuplicate": "false"}': (True, 0.0, "unknown"),
        '{"isDuplicate": ""}': (False, 0.0, "unknown"),
        '{"isDuplicate": false, "relationship": "near"}': (False, 0.0, "near"),
        "null": (False, 0.0, "parse_error"),
        "{": (False, 0.0, "parse_error"),
        "": (False, 0.0, "parse_error"),
    }
    df = spark.createDataFrame([(a,) for a in answers], "a string").select("a", T.verdict(F.col("a")).alias("v"))
    assert {r["a"]: tuple(r["v"])[:3] for r in df.collect()} == answers


def test_labels(spark):
    assert one(spark, T.display_label(F.col("t")), t="w" * 50 + " " + "v" * 50) == "w" * 50 + "..."
    assert one(spark, T.display_label(F.col("t")), t="w " + "v" * 90) == "w " + "v" * 78 + "..."
    assert one(spark, T.request_number(F.col("t")), t="https://x.org/a/b/pull/17/files") == 17
    assert one(spark, T.slug(F.col("t")), t="a/b/c") is None


def test_rank_prompt_tiers_and_odd_groups(spark):
    rows = [("full", i, "ab") for i in range(3)] + [("cut", i, "a" * 100) for i in range(2)] + [("head", i, "a" * 30) for i in range(40)] + [("least", i, "a" * 900) for i in range(3)] + [("one", 0, None)]
    m = spark.createDataFrame(rows, "`group` string, at long, full string").withColumn("full", F.coalesce("full", F.lit("")))
    made = rank_prompts(m.withColumn("cut", F.substring("full", 1, 80)).withColumn("least", F.substring("full", 1, 20)), 50, 3.5)
    got = {r["group"]: (r["tier"], r["n_kept"], len(r["prompt"])) for r in made.collect()}
    assert got["full"] == ("full", 3, 10) and got["cut"] == ("cut", 2, 162) and got["one"] == ("full", 1, 0)
    assert got["head"][0] == "head" and got["head"][2] <= 175 and got["head"][1] == 4
    assert got["least"][:2] == ("least", 2)
    assert rank_prompts(m.limit(0).withColumn("cut", F.col("full")).withColumn("least", F.col("full")), 50).count() == 0


def test_merged_hits_keep_what_one_list_lacks(spark):
    code = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.2)], "q_id long, m_id long, score double")
    intent = spark.createDataFrame([(1, 3, 0.5), (1, 4, 0.1)], "q_id long, m_id long, score double")
    assert {tuple(r) for r in knn.merged(code, intent, 2).collect()} == {(1, 2, 0.9, 0.0), (1, 3, 0.2, 0.5)}


def test_queue_over_several_batches(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    at = lambda i: t + dt.timedelta(seconds=i)
    log = [
        ("a", "enqueue", at(0), 0, None), ("a", "claim", at(1), 1, None), ("a", "complete", at(2), 2, None),
        ("b", "enqueue", at(0), 3, None), ("b", "claim", at(1), 4, None), ("b", "fail", at(2), 5, "HTTP 429"),
        ("c", "claim", at(1), 6, None), ("c", "claim", at(3), 7, None), ("c", "claim", at(4), 8, None), ("c", "fail", at(5), 9, "boom"),
        ("d", "claim", at(1), 10, None), ("d", "recover", at(9), 11, None), ("d", "nonsense", at(10), 12, None), (None, None, None, None, None),
    ]
    schema = "job string, kind string, at timestamp, seq long, message string"
    for part in (log[::2], log[1::2]):  # out of order across files
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.kept_states(jobs.job_states(stream), str(tmp_path / "rows"), str(tmp_path / "progress"))
    states = jobs.current(spark.read.parquet(str(tmp_path / "rows")), "job")
    got = {r["job"]: (r["status"], r["attempts"], r["run_after"]) for r in states.collect()}
    assert got == {"a": ("done", 1, None), "b": ("queued", 1, at(62)), "c": ("failed", 3, None), "d": ("queued", 1, None)}
    assert {r["job"] for r in jobs.claimable(states, F.lit(at(30))).collect()} == {"d"}
    assert {tuple(r) for r in states.select("job", "status").collect()} == {tuple(r) for r in jobs.job_states(spark.createDataFrame(log, schema)).select("job", "status").collect()}


def test_versions_of_a_stream_are_put_together(spark, tmp_path):
    schema, want = "k long, at long, v string", {}
    for i in range(7):
        rows = [(k, i, f"{k}-{i}") for k in range(i % 3, 6)]
        want |= {k: v for k, _, v in rows}
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = Snapshots(spark, f"file://{tmp_path}/store")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.kept_in(jobs.latest(stream, ["k"], ["at"]), store, "rows", "k", str(tmp_path / "progress"), every=3)

    run()
    assert {r["k"]: r["v"] for r in jobs.current(store.open().table("rows"), "k").collect()} == want
    n = len(store.versions())
    assert n >= 7 and store.open().table("rows").count() < 20 and len(store.open().folders("rows")) <= 3
    run()
    assert len(store.versions()) == n
