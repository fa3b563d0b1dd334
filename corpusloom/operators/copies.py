"""Neighbours where many records are the same: the search runs over distinct vectors, the members come back afterwards.

A class is all records of one vector. In the order of (score, least id) the k best records of a query lie in its k best
classes: a record of any other class has k records before it, one of each class before its own. So the search is the
plain one over classes, each named by its least id; each class then stands for its first k members, and the lists of a
class are those of all its members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators import cells, knn
from corpusloom.sources.tables import handed_over

#: Members of a class that meet its list in one task.
MEMBERS_AT_ONCE = 50_000


def classes(vectors: DataFrame) -> DataFrame:
    """id, class_id: the least id that has the same vector, coordinate for coordinate; vectors has id and vector."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL")
    least = rows.groupBy("vector").agg(F.min("id").alias("class_id"))
    return rows.join(least, "vector").select("id", "class_id")


def knn_by_class(vectors: DataFrame, k: int = 10, threshold: float = 0.65, rows_per_block: int = 4000) -> DataFrame:
    """The rows of knn_join(vectors, k, threshold), of which at most one search runs for equal vectors.

    Zero and null vectors have no neighbours; ids are unique."""
    member = handed_over(classes(vectors), "class-members")
    one = vectors.select(F.col("id").cast("long").alias("id"), "vector").join(member.filter("id = class_id").select("id"), "id")
    hits = knn.knn_join(one, k, threshold, rows_per_block)
    # A class is near to itself, whatever knn_join leaves out; zero vectors are near to nothing.
    own = cells.unit(one).select(F.col("id").alias("q_id"), F.col("id").alias("m_id"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("score"))
    listed = member.withColumn("r", F.row_number().over(Window.partitionBy("class_id").orderBy("id"))).filter(F.col("r") <= k).select(F.col("class_id").alias("m_id"), "id")
    rows = hits.unionByName(own.filter(F.col("score") >= threshold)).join(listed, "m_id").select("q_id", F.col("id").alias("m_id"), "score")
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc(F.round("score", 12)), "m_id"))
    best = rows.withColumn("r", rank).filter(F.col("r") <= k).drop("r")
    lists = best.groupBy("q_id").agg(F.collect_list(F.struct("m_id", "score")).alias("hits"))  # k at most
    # Members of a large class are dealt out, each part with a copy of the list.
    parts = member.groupBy("class_id").agg(F.ceil(F.count("*") / MEMBERS_AT_ONCE).cast("int").alias("parts"))
    lists = lists.join(parts, lists["q_id"] == parts["class_id"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("class_id", "part", "hits")
    dealt = member.join(parts, "class_id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    out = dealt.join(lists, ["class_id", "part"]).select(F.col("id").alias("q_id"), F.explode("hits").alias("h")).select("q_id", "h.m_id", "h.score")
    return out.filter("q_id != m_id")
