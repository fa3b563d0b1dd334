"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Equal texts are a group. Groups that hold more than 1/`grain` of a total, at most a few times `grain` of them, are
placed one by one; lighter groups are first dealt into `grain` lots by their key. Largest first, each is placed where
the dot product of its vector with the residual capacities is highest. Only a group that no shard can hold, as it has
more than a shard's share of bytes, tokens or rows, is split by row, by where the row lies in the table that is handed over,
so that rows without an id, or with one id, are split like any others; `group_split` marks its rows. What the driver places
is bounded by `grain`, whatever the input; the law that holds is `bytes`: sizes near equal.

Defined results: a null text has no bytes and counts as empty; rows that repeat are placed each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from corpusloom.llm import common

DIMENSIONS = ("bytes", "tokens", "n_rows")


def place(sizes: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each item (rows of sizes: shares of the totals), largest first, by the dot product with what is left."""
    shard = np.zeros(len(sizes), np.int64)
    left = np.full((n_shards, sizes.shape[1]), 1.0 / n_shards)
    for i in np.lexsort((np.arange(len(sizes)), -sizes.sum(axis=1), -sizes.max(axis=1))):
        v = sizes[i]
        fits = (left >= v - 1e-12).all(axis=1)
        score = left @ v
        at = np.flatnonzero(fits) if fits.any() else np.arange(n_shards)
        shard[i] = at[np.argmax(score[at])]
        left[shard[i]] -= v
    return shard


def sharded(docs: DataFrame, n_shards: int = 16, grain: int = 8192, rows_per_slot_run: int = 500_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null under this law), group_split."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = common.handed_over(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("g"),
            (F.size(F.split(F.trim(text), r"[\x20\x09-\x0D]+")) + 1).cast("long").alias("tokens"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "sharding-rows",
    )
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_rows")]
    total = rows.agg(*sums).head()
    if not total["n_rows"]:
        total = {d: 1 for d in DIMENSIONS}
    share = {d: total[d] / grain for d in DIMENSIONS}
    heavy_group = F.lit(False)
    for d in DIMENSIONS:
        heavy_group = heavy_group | (F.col(d) > share[d])
    groups = rows.groupBy("g").agg(*sums)
    # At most 3 * grain groups can hold over 1/grain of one of three totals.
    pieces = F.greatest(*[F.ceil(F.col(d) / F.lit(8.0 * share[d])) for d in DIMENSIONS])
    heavy = groups.filter(heavy_group).select("g", F.when(F.greatest(*[F.col(d) / F.lit(total[d]) for d in DIMENSIONS]) * n_shards > 1, pieces).otherwise(1).cast("int").alias("pieces"))
    lot = F.pmod(F.col("g"), F.lit(grain)).cast("long")
    placed = (
        rows.join(F.broadcast(heavy), "g", "left")
        .withColumn("group_split", F.coalesce(F.col("pieces") > 1, F.lit(False)))
        .withColumn("piece", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("place"), F.col("pieces"))).otherwise(0).cast("int"))
        .withColumn("unit", F.when(F.col("pieces").isNull(), lot).otherwise(F.col("g")))
        .withColumn("light", F.col("pieces").isNull())
        .drop("pieces")
    )
    items = placed.groupBy("light", "unit", "piece").agg(*sums).orderBy("light", "unit", "piece").toPandas()
    vectors = items[list(DIMENSIONS)].to_numpy(float).reshape(-1, 3) / np.array([total[d] for d in DIMENSIONS], float)
    items["shard"] = place(vectors, n_shards)
    where = spark.createDataFrame(items[["light", "unit", "piece", "shard"]], "light boolean, unit long, piece int, shard int") if len(items) else spark.createDataFrame([], "light boolean, unit long, piece int, shard int")
    dealt = placed.join(F.broadcast(where), ["light", "unit", "piece"])
    # Slots: rows are numbered in runs of bounded length, and each run starts where the ones before it end.
    n_runs = max(1, -(-int(total["n_rows"]) // (n_shards * rows_per_slot_run)) * 4)
    dealt = dealt.withColumn("run", F.pmod(F.xxhash64("place"), F.lit(n_runs)))
    runs = dealt.groupBy("shard", "run").agg(F.count("*").alias("n"))
    first = runs.select("shard", "run", (F.sum("n").over(W.Window.partitionBy("shard").orderBy("run")) - F.col("n")).alias("first"))
    in_run = F.row_number().over(W.Window.partitionBy("shard", "run").orderBy("place")) - 1
    return (
        dealt.withColumn("in_run", in_run)
        .join(first, ["shard", "run"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
            (F.col("first") + F.col("in_run")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_split",
        )
    )


def op3_vector_sharding(spark, sf_dir: str) -> DataFrame:
    return sharded(common.table(spark, sf_dir, "documents"))
