"""Writers of tables without a transaction log: each makes a new version or replaces whole partitions, so that a job that is
run again leaves the same table. Nothing reads and overwrites one path in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.sources.tables import handed_over, shared_folder


def upserted(stored: DataFrame, fetched: DataFrame, keys: list[str], kept: list[str], cleared: list[str]) -> DataFrame:
    """stored after an upsert of fetched: on a conflict `kept` columns stay, `cleared` ones become null, all others are
    overwritten; new rows take their columns from fetched. Keys are unique on either side and may be null-free only."""
    old = stored.select(*keys, *[F.col(c).alias(f"old_{c}") for c in stored.columns if c not in keys], F.lit(True).alias("was"))
    both = old.join(fetched.withColumn("is", F.lit(True)), keys, "full")
    both = both.withColumns({c: F.lit(None) for c in stored.columns if c not in both.columns})

    def value(c: str) -> Column:
        if c in kept:
            return F.when(F.col("was"), F.col(f"old_{c}")).otherwise(F.col(c))
        if c in cleared:
            return F.when(F.col("is").isNull(), F.col(f"old_{c}"))
        return F.when(F.col("is"), F.col(c)).otherwise(F.col(f"old_{c}"))

    return both.select(*keys, *[value(c).alias(c) for c in stored.columns if c not in keys])


def replaced(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace: all of fresh, and what stored has under other keys."""
    return fresh.unionByName(stored.join(fresh.select(*keys).distinct(), keys, "left_anti"))


def patched(stored: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """stored after an update of some columns of some rows. A patch has a column of kind struct<value> for each column that it
    may set: a null struct leaves the column as it is, a struct with a null value makes it null. Keys are unique in patches."""
    names = [c for c in patches.columns if c not in keys]
    both = stored.join(patches.select(*keys, *[F.col(c).alias(f"_set_{c}") for c in names]), keys, "left")
    return both.select(*[F.when(F.col(f"_set_{c}").isNotNull(), F.col(f"_set_{c}.value")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in stored.columns])


def closed(stored: DataFrame, fetched: DataFrame, scope: str, key: str, scopes: DataFrame | None = None) -> DataFrame:
    """stored (scope, key, state, ...) with `closes`: the open rows that a fetch doesn't have any more, whose state is closed
    now. fetched has scope and key; scopes lists what was fetched at all, so that an empty fetch closes all of its rows;
    without it every scope counts as fetched. Rows that aren't open stay as they are."""
    there = fetched.select(scope, key).distinct().withColumn("_there", F.lit(True))
    asked = (stored if scopes is None else scopes).select(scope).distinct().withColumn("_asked", F.lit(True))
    both = stored.join(there, [scope, key], "left").join(asked, scope, "left")
    closes = (F.col("state") == "open") & F.col("_there").isNull() & F.col("_asked").isNotNull()
    both = both.withColumn("closes", F.coalesce(closes, F.lit(False)))
    return both.withColumn("state", F.when(F.col("closes"), "closed").otherwise(F.col("state"))).select(*stored.columns, "closes")


def partitions_replaced(fresh: DataFrame, path: str, by: str) -> None:
    """The partitions that fresh has replace those of the table at path; the others stay as they are."""
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def numbered(df: DataFrame, order: list[str], first: int = 1) -> DataFrame:
    """df with a dense `id` from `first` on along `order`: rows are ranged, counted per range and numbered inside each."""
    ranged = handed_over(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_place", place).join(F.broadcast(before), "_range").select((F.col("_before") + F.col("_place") + (first - 1)).cast("long").alias("id"), *df.columns)


def deleted_below(parents: DataFrame, key: str, *children: tuple[DataFrame, str, str | None]) -> list[DataFrame]:
    """What is left of each child table after its rows under `parents` are gone, level by level.

    Each child is (table, its column that names the parent, its own key or None for the last level)."""
    gone, left = parents.select(F.col(key).alias("_gone")).distinct(), []
    for child, parent, own in children:
        left.append(child.join(gone, child[parent] == gone["_gone"], "left_anti"))
        if own:
            gone = child.join(gone, child[parent] == gone["_gone"], "left_semi").select(F.col(own).alias("_gone")).distinct()
    return left


def exported_json(df: DataFrame, name: str, by: str) -> str:
    """df as JSON files, a folder for each value of `by`; returns the path."""
    path = shared_folder(df.sparkSession, name)
    df.write.partitionBy(by).json(path)
    return path


def exported_in_step(df: DataFrame, path: str, by: str, refresh: bool = False) -> dict[str, int]:
    """Brings a folder of JSON exports, one folder per value of `by` (a whole number), in step with df.

    Exports that are there are left alone unless refresh; those whose value df doesn't have any more go. What is there is
    the listing of the folder, read as a table; an export counts once its files are complete. How many folders were
    written, skipped and removed."""
    spark = df.sparkSession
    there = _exports(spark, path, by)
    wanted = handed_over(df.select(F.col(by).cast("long").alias(by)).distinct().filter(F.col(by).isNotNull()), "export-wanted")
    there = handed_over(there, "export-there")
    new = wanted if refresh else wanted.join(there, by, "left_anti")
    new = handed_over(new, "export-new")
    n_new = new.count()
    if n_new:
        df.withColumn(by, F.col(by).cast("long")).join(new, by, "left_semi").repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).json(path)
    gone = there.join(wanted, by, "left_anti")
    removed = 0
    for row in gone.toLocalIterator():
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{by}={row[0]}")
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
        removed += 1
    return {"written": n_new, "skipped": wanted.count() - n_new, "removed": removed}


def _exports(spark: SparkSession, path: str, by: str) -> DataFrame:
    """by: the values that have an export in the folder."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"`{by}` long")
    return files.select(F.regexp_extract("path", f"/{by}=(-?[0-9]+)/", 1).try_cast("long").alias(by)).filter(F.col(by).isNotNull()).distinct()


def written_with_counts(df: DataFrame, write: Callable[[DataFrame], None], **counts: Column) -> dict[str, int]:
    """Writes df and gives the counts that were taken of its rows in passing, without a pass of their own.

    counts are aggregates, such as count_if. They are those of the rows that the write has seen once, whatever tasks were
    run again."""
    seen = Observation()
    write(df.observe(seen, *[c.alias(name) for name, c in counts.items()]))
    return seen.get
