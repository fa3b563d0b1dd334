"""A stored collection of vectors with an index of cells: upserts rewrite the cells they touch, searches meet the cells
they need."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import cells
from corpusloom.sources.snapshots import Change, Snapshot, Snapshots

#: The cell of vectors that no search can find: null and zero ones.
NOWHERE = -1


class VectorCollection:
    """Points (id, vector, payload columns) under `path`; every change is one version of all its tables.

    cells, by cell: the points and their angle to the centre. places, by hash of the id: the cell of each id. about: size
    and radius of each cell. index: dimension and centres, fitted when the first points come (or on rebuild) on a bounded
    sample; later points go to the nearest centre, and radii follow, so that searches stay exact."""

    def __init__(self, spark: SparkSession, path: str, per_cell: int = 4000, place_parts: int = 64):
        self.spark, self.store, self.per_cell, self.place_parts = spark, Snapshots(spark, path), per_cell, place_parts

    def dimension(self, at: Snapshot | None = None) -> int | None:
        at = at or self.store.open()
        return at.table("index").first()["dim"] if "index" in at.tables() else None

    def ensure(self, dim: int) -> bool:
        """Whether points of this dimension can be added as they are; a collection of another one is made empty first."""
        at = self.store.open()
        if self.dimension(at) == dim:
            return True
        self._emptied(at, dim)
        return False

    def _emptied(self, at: Snapshot, dim: int) -> Snapshot:
        index = self.spark.createDataFrame([(dim, [])], "dim int, centres array<array<double>>")
        return self.store.commit(at, {t: Change() for t in at.tables()} | {"index": Change(self.store.stage("index", index))})

    def _centres(self, at: Snapshot) -> np.ndarray:
        rows = at.table("index").first()["centres"]
        return np.array(rows, float).reshape(len(rows), -1)

    def _checked(self, points: DataFrame, dim: int) -> None:
        other = points.filter(F.size("vector") != dim).select(F.size("vector")).first()
        if other:
            raise ValueError(f"the collection has {dim} dimensions, a vector has {other[0]}")

    def _placed(self, points: DataFrame, centres: np.ndarray) -> DataFrame:
        where = cells.placed(cells.unit(points.select("id", "vector")), centres).select("id", "cell", "angle")
        return points.join(where, "id", "left").withColumn("cell", F.coalesce("cell", F.lit(NOWHERE).cast("long")))

    def _about(self, rows: DataFrame) -> DataFrame:
        return cells.extents(rows.filter(F.col("cell") != NOWHERE))

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.place_parts)).cast("long")

    def _built(self, at: Snapshot, points: DataFrame, dim: int) -> Snapshot:
        """All tables anew from points, with centres of their own."""
        units = cells.unit(points.select("id", "vector"))
        centres = cells.fitted(units, units.count(), dim, self.per_cell)
        if not len(centres):
            centres = np.eye(1, dim)
        own = self.store.stage("cells", self._placed(points, centres), "cell")
        places = self.store.stage("places", own.rows.select("id", "cell", self._part().alias("at")), "at")
        index = self.spark.createDataFrame([(dim, centres.tolist())], "dim int, centres array<array<double>>")
        changes = {"cells": own, "places": places, "about": self.store.stage("about", self._about(own.rows)), "index": self.store.stage("index", index)}
        emptied = Snapshot(self.spark, at.version, [])  # nothing of the old tables stays
        return self.store.commit(emptied, {t: Change(s) for t, s in changes.items()})

    def upsert(self, points: DataFrame) -> Snapshot:
        """Points of new ids are added, those of known ids replace them; ids are unique in points and not null."""
        at = self.store.open()
        dim = self.dimension(at)
        if dim is None:
            first = points.filter("vector IS NOT NULL").select(F.size("vector")).first()
            dim = first[0] if first else 1
        self._checked(points, dim)
        if "cells" not in at.tables():
            return self._built(at, points, dim)
        placed = self.store.stage("incoming", self._placed(points, self._centres(at)))
        return self._changed(at, placed.rows.select("id"), placed.rows)

    def _changed(self, at: Snapshot, ids: DataFrame, fresh: DataFrame | None) -> Snapshot:
        parts = [r[0] for r in ids.select(self._part()).distinct().collect()]
        if not parts:
            return at
        places = at.table("places", parts, by="at")
        touched = places.join(ids, "id", "left_semi").select("cell")
        if fresh is not None:
            touched = touched.union(fresh.select("cell"))
        touched = [r[0] for r in touched.distinct().collect()]  # MOST_CELLS at most
        if not touched:
            return at
        left = at.table("cells", touched, by="cell").join(ids, "id", "left_anti")
        known = places.join(ids, "id", "left_anti")
        if fresh is not None:
            left = left.unionByName(fresh)
            known = known.unionByName(fresh.select("id", "cell", self._part().alias("at")))
        own = self.store.stage("cells", left, "cell")
        about = at.table("about").filter(~F.col("cell").isin(touched)).unionByName(self._about(own.rows))
        return self.store.commit(at, {"cells": Change(own, touched), "places": Change(self.store.stage("places", known, "at"), parts), "about": Change(self.store.stage("about", about))})

    def delete(self, ids: DataFrame) -> Snapshot:
        """Without the points of these ids."""
        at = self.store.open()
        return self._changed(at, ids.select("id").distinct(), None) if "cells" in at.tables() else at

    def delete_where(self, predicate: Column) -> Snapshot:
        at = self.store.open()
        return self.delete(at.table("cells").filter(predicate).select("id")) if "cells" in at.tables() else at

    def rebuild(self) -> Snapshot:
        """The same points around centres fitted anew, for when far more, or other, points have come than were fitted on."""
        at = self.store.open()
        return self._built(at, at.table("cells").drop("angle"), self.dimension(at)) if "cells" in at.tables() else at

    def points(self, ids: DataFrame | None = None, at: Snapshot | None = None) -> DataFrame:
        """All points, or those of some ids, read from the cells that have them only."""
        at = at or self.store.open()
        if ids is None:
            return at.table("cells").drop("angle")
        parts = [r[0] for r in ids.select(self._part()).distinct().collect()]
        found = at.table("places", parts).join(ids, "id", "left_semi")
        touched = [r[0] for r in found.select("cell").distinct().collect()]
        return at.table("cells", touched).join(ids, "id", "left_semi").drop("angle")

    def search(self, queries: DataFrame, k: int = 10, threshold: float = 0.65, where: Column | None = None, at: Snapshot | None = None) -> DataFrame:
        """q_id, m_id, score: for each query (id, vector) the k best points, of those that `where` lets pass, with a score of
        threshold or more; the query itself is among them if it is a point."""
        at = at or self.store.open()
        if "cells" not in at.tables():
            return self.spark.createDataFrame([], "q_id long, m_id long, score double")
        self._checked(queries, self.dimension(at))
        rows = at.table("cells", by="cell").filter(F.col("cell") != NOWHERE)
        rows = cells.unit((rows if where is None else rows.filter(where)).select("id", "vector", "cell"))
        return cells.searched(cells.unit(queries.select("id", "vector")), rows, at.table("about"), self._centres(at), k, threshold, self.per_cell)
