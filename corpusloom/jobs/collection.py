"""Queries over a stored vector collection: build, upsert, delete, filtered search, recreation, rebuild."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.jobs.base import query
from corpusloom.sources.tables import shared_folder, table
from corpusloom.sources.vectors import VectorCollection

#: Small cells, so that an index has several even on small tables.
PER_CELL = 200


def _collection(spark, sf_dir, points=None):
    c = VectorCollection(spark, shared_folder(spark, "collection"), PER_CELL, 8)
    c.upsert(_points(spark, sf_dir) if points is None else points)
    return c


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


_SEARCH = """, s AS (SELECT a.id AS q_id, b.id AS m_id, round(list_cosine_similarity(a.v, b.v), 12) AS score FROM q a, p b),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, m_id) AS r FROM s)
SELECT q_id, m_id, round(score, 6) AS score FROM r WHERE r <= 10 AND score >= 0.2"""
_STORED = "WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"


@query(_STORED + ", q AS (SELECT * FROM p WHERE id % 50 = 0)" + _SEARCH)
def collection_search(spark, sf_dir):
    """The ten best points of each fiftieth one, itself among them."""
    c = _collection(spark, sf_dir)
    return c.search(_points(spark, sf_dir).filter("id % 50 = 0"), 10, 0.2).withColumn("score", F.round("score", 6))


@query("WITH q AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE label IN (1, 4))" + _SEARCH)
def collection_filtered_search(spark, sf_dir):
    """The ten best among the points whose payload passes a filter."""
    c = _collection(spark, sf_dir)
    return c.search(_points(spark, sf_dir).filter("id % 50 = 0"), 10, 0.2, F.col("label").isin(1, 4)).withColumn("score", F.round("score", 6))


@query("""WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 97 <> 5 AND vec_id % 100 <> 7
UNION ALL SELECT vec_id, list_reverse(embedding)::DOUBLE[] FROM embeddings WHERE vec_id % 100 = 7 AND vec_id % 97 <> 5
UNION ALL SELECT vec_id + 1000000000, list_reverse(embedding)::DOUBLE[] FROM embeddings WHERE vec_id % 100 = 8), q AS (SELECT * FROM p WHERE id % 50 IN (0, 7, 8))""" + _SEARCH)
def collection_upsert(spark, sf_dir):
    """After a build, one per cent of the points get another vector, as many new ones come and some go."""
    c, p = _collection(spark, sf_dir), _points(spark, sf_dir)
    turned = p.withColumn("vector", F.reverse("vector"))
    c.upsert(turned.filter("id % 100 = 7").unionByName(turned.filter("id % 100 = 8").withColumn("id", F.col("id") + 1_000_000_000)))
    c.delete(p.filter("id % 97 = 5").select("id"))
    return c.search(c.points().filter("id % 50 IN (0, 7, 8)"), 10, 0.2).withColumn("score", F.round("score", 6))


@query("SELECT vec_id AS id, label, round(list_sum(embedding[1:16]::DOUBLE[]), 6) AS total FROM embeddings WHERE vec_id % 20 = 3")
def collection_recreated(spark, sf_dir):
    """Vectors of another dimension: the old ones are dropped, the new ones can be looked up by id."""
    c, p = _collection(spark, sf_dir), _points(spark, sf_dir)
    if not c.ensure(16):
        c.upsert(p.withColumn("vector", F.slice("vector", 1, 16)))
    found = c.points(p.filter("id % 20 = 3").select("id"))
    return found.select("id", "label", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(_STORED + ", q AS (SELECT * FROM p WHERE id % 50 = 0 AND label <> 3), x AS (SELECT * FROM p), d AS (SELECT 1)" + _SEARCH.replace("FROM q a, p b", "FROM q a, (SELECT * FROM p WHERE label <> 3) b"))
def collection_rebuilt(spark, sf_dir):
    """Points come in two parts, those of one payload are deleted by a filter, and the index is fitted anew."""
    p = _points(spark, sf_dir)
    c = _collection(spark, sf_dir, p.filter("id % 3 = 0"))
    c.upsert(p.filter("id % 3 != 0"))
    c.delete_where(F.col("label") == 3)
    c.rebuild()
    return c.search(p.filter("id % 50 = 0 AND label != 3"), 10, 0.2).withColumn("score", F.round("score", 6))


_UUID = "regexp_replace(md5('1-' || vec_id || '-code'), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"


@query(f"WITH p AS (SELECT {_UUID} AS id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT {_UUID} AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0)" + _SEARCH)
def collection_by_uuid(spark, sf_dir):
    """Points under ids made from their names: the same points again change nothing, whatever batches they come in."""
    named = table(spark, sf_dir, "embeddings").select("vec_id", T.point_uuid(F.concat(F.lit("1-"), F.col("vec_id").cast("string"), F.lit("-code"))).alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    c = _collection(spark, sf_dir, named.drop("vec_id"))
    c.upsert(named.filter("vec_id % 5 = 2").drop("vec_id"))
    return c.search(named.filter("vec_id % 50 = 0").drop("vec_id"), 10, 0.2).withColumn("score", F.round("score", 6))
