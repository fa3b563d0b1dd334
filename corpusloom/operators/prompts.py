"""Prompts over groups of records, cut in tiers to a token budget."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank_prompts(members: DataFrame, budget: int, chars_per_token: float = 3.5) -> DataFrame:
    """group, tier, n_kept, prompt; members has group, at (order), full, cut, least: the record at three lengths.

    The whole group at full length if it fits, else cut; else as many cut records from its head as fit, two at least,
    then the first two at least length. A group of any size is counted by aggregation; only its head that can
    fit, each record taking two characters or more, meets in a window."""
    chars = math.floor(budget * chars_per_token)
    w = Window.partitionBy("group").orderBy("at")
    sizes = members.groupBy("group").agg(F.count("*").alias("n"), *[(F.sum(F.length(c)) + 2 * (F.count("*") - 1)).alias(f"{c}_chars") for c in ("full", "cut")])
    head = members.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= max(2, chars // 2 + 2))
    head = head.withColumn("used", F.sum(F.length("cut") + 2).over(Window.partitionBy("group").orderBy("r")) - 2).join(sizes, "group")
    note = F.concat(F.lit("\n\n("), (F.col("n") - F.col("r")).cast("string"), F.lit(" more left out for length)"))
    fits = F.when((F.col("r") >= 2) & (F.col("r") < F.col("n")) & (F.col("used") + F.length(note) <= chars), F.col("r"))
    head = head.withColumn("most", F.max(fits).over(Window.partitionBy("group")))
    tier = F.when(F.col("full_chars") <= chars, "full").when(F.col("cut_chars") <= chars, "cut").when(F.col("most").isNotNull(), "head").otherwise("least")
    head = head.withColumn("tier", tier)
    last = F.when(F.col("tier").isin("full", "cut"), F.col("n")).when(F.col("tier") == "head", F.col("most")).otherwise(2)
    shown = F.when(F.col("tier") == "full", F.col("full")).when(F.col("tier") == "least", F.col("least")).otherwise(F.col("cut"))
    kept = head.filter(F.col("r") <= last).groupBy("group", "tier", "n").agg(F.sort_array(F.collect_list(F.struct("r", shown.alias("t")))).alias("m"))
    text = F.array_join(F.transform("m", lambda x: x["t"]), "\n\n")
    left = F.concat(F.lit("\n\n("), (F.col("n") - F.greatest(F.size("m"), F.lit(2))).cast("string"), F.lit(" more left out for length)"))
    return kept.select("group", "tier", F.size("m").cast("long").alias("n_kept"), F.when(F.col("tier").isin("full", "cut"), text).otherwise(F.concat(text, left)).alias("prompt"))
