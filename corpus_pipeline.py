"""Corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, benchmark decontamination, best-fit packing.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. All but the last return the columns of documents.

The first stage judges each row where it lies; verdicts of later ones name rows by a hash of doc_id and text, so an id that
repeats with another text, or is null, is judged like any other. Null texts count as empty; rows that repeat whole share one verdict; an empty table passes through as one; other
columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common, decontamination, jaccard_join, line_dedup, packing, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None  # SQL can't express the classifier, the latent search or the packing


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(*COLUMNS).withColumn("row", F.xxhash64("doc_id", F.coalesce(text, F.lit("")), F.crc32(F.coalesce(text, F.lit("")))))


def _named_by_row(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("row").alias("doc_id"), "text")


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return docs.join(common.handed_over(rows.toDF("row").distinct(), "rejected"), "row", "left_anti")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more; an empty text gets the score of its statistics like any other."""
    return quality.kept(docs.select(*COLUMNS), common.table(spark, sf_dir, "labels"), 0.3)


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten sites or more share, n_chars follows; a null text stays null, a null source is one site,
    rows that repeat are cleaned each. Texts that as a whole are on ten sites wait for the next stage, which leaves one."""
    cleaned = line_dedup.cleaned(docs.select(*COLUMNS), spare_copies=True)
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies (null ids last, ties by hash); of rows that repeat whole, one.

    Texts without words are near to nothing."""
    docs = _keyed(docs)
    groups = common.handed_over(jaccard_join.linked(_named_by_row(docs)).select(F.col("doc_id").alias("row"), "component_id").distinct(), "groups")
    ids = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), "row")
    first = groups.join(docs.select("row", "doc_id").distinct(), "row").groupBy("component_id").agg(F.min(ids)["row"].alias("first"))
    kept = _without(docs, groups.select("row").join(first.select(F.col("first").alias("row")), "row", "left_anti"))
    return kept.dropDuplicates(["row"]).select(*COLUMNS)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; null and empty texts leak none."""
    docs = _keyed(docs)
    return _without(docs, decontamination.leaks(_named_by_row(docs), common.table(spark, sf_dir, "benchmark")).select("doc_id")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences of 2048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("line dedup", remove_boilerplate),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", remove_leaks),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), common.Scratch(spark)
    for name, stage in STAGES[:-1]:
        after = common.Scratch(spark)
        docs = after.handed_over(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        before.drop()
        before = after
    return STAGES[-1][1](spark, docs, sf_dir)
