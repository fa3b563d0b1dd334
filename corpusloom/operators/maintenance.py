"""Keeping neighbours, pairs and groups up to date: work goes with what has changed.

State is one store of tables that change together: hits (the k best of each record), edges (a < b, score), labels
(component of each record that has an edge) and groups (group_id, member, avg_confidence). A change of some vectors

1. searches the changed records, and those whose list held a changed one, against all;
2. searches all others against the changed records only, for scores above the worst of their own list;
3. compares the edges of the records whose list has changed;
4. covers anew the components that an edge came to or went from, and no others.

Components are independent in the greedy cover, so the result is that of a run over everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import cells, graph, knn
from corpusloom.sources.snapshots import Change, Snapshot
from corpusloom.sources.tables import handed_over
from corpusloom.sources.vectors import VectorCollection

HITS = "q_id long, m_id long, score double"


class Neighbours:
    """Groups over a vector collection. The k best of a record include itself, as in knn_join."""

    def __init__(self, collection: VectorCollection, k: int = 10, threshold: float = 0.65):
        self.points, self.k, self.threshold = collection, k, threshold
        self.spark, self.store = collection.spark, collection.store

    def table(self, name: str, ddl: str, at: Snapshot | None = None) -> DataFrame:
        at = at or self.store.open()
        return at.table(name) if name in at.tables() else self.spark.createDataFrame([], ddl)

    def groups(self) -> DataFrame:
        return self.table("groups", "group_id long, member long, avg_confidence double")

    def changed(self, upserted: DataFrame | None = None, deleted: DataFrame | None = None) -> dict[str, int]:
        """Takes points in (id, vector, payload) and ids out; how many records were searched and covered anew."""
        before = self.store.open()
        ids = [x.select("id") for x in (upserted, deleted) if x is not None]
        if not ids:
            return {"searched": 0, "looked_at": 0, "covered": 0}
        ids = handed_over((ids[0].unionByName(ids[1]) if len(ids) > 1 else ids[0]).distinct(), "changed")
        if upserted is not None:
            self.points.upsert(upserted)
        if deleted is not None:
            self.points.delete(deleted)
        at = self.store.open()
        old = self.table("hits", HITS, before)
        hits, stale, looked_at = self._hits(at, old, ids)
        # Records whose list is another now; their edges may come, go or change.
        fresh = hits.join(stale, hits["q_id"] == stale["id"], "left_semi")
        gone = old.join(stale, old["q_id"] == stale["id"], "left_semi")
        doubtful = handed_over(self._pairs(fresh.unionByName(gone)).select("a", "b").distinct(), "doubtful-pairs")
        now = doubtful.join(self._edges_of(hits, doubtful), ["a", "b"])
        edges = self.table("edges", "a long, b long, score double", before)
        was = edges.join(doubtful, ["a", "b"], "left_semi")
        moved = handed_over(was.exceptAll(now.select("a", "b", "score")).unionByName(now.select("a", "b", "score").exceptAll(was)).select("a", "b").distinct(), "moved-edges")
        all_edges = self.store.stage("edges", edges.join(doubtful, ["a", "b"], "left_anti").unionByName(now.select("a", "b", "score")))
        labels, groups, covered = self._covered(before, all_edges.rows, moved)
        self.store.commit(at, {"hits": Change(self.store.stage("hits", hits)), "edges": Change(all_edges), "labels": Change(self.store.stage("labels", labels)), "groups": Change(self.store.stage("groups", groups))})
        return {"searched": stale.count(), "looked_at": looked_at, "covered": covered}

    def _hits(self, at: Snapshot, old: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """The lists now, the records whose list was searched anew or has another entry, and how many met the changed ones."""
        points = at.table("cells", by="cell").filter("cell >= 0")
        held = old.join(ids, old["m_id"] == ids["id"], "left_semi").select(F.col("q_id").alias("id"))
        again = handed_over(ids.unionByName(held).distinct(), "search-again")
        asked = points.join(again, "id", "left_semi").select("id", "vector")
        whole = self.points.search(asked, self.k, self.threshold, at=at)
        rest = old.join(again, old["q_id"] == again["id"], "left_anti")
        # All others against the changed rows only.
        others = cells.unit(points.join(again, "id", "left_anti").select("id", "vector"))
        few = cells.unit(points.join(ids, "id", "left_semi").select("id", "vector", "cell", "angle"))
        few = handed_over(few, "changed-units")
        met = cells.searched(others, few, cells.extents(few), self.points._centres(at), self.k, self.threshold, max(4000, self.points.per_cell))
        worst = rest.groupBy("q_id").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
        better = met.join(worst, "q_id", "left").filter((F.coalesce("n", F.lit(0)) < self.k) | (F.round("score", 12) >= F.round("worst", 12))).select("q_id", "m_id", "score")
        better = handed_over(better, "better-hits")
        grown = rest.join(better.select("q_id").distinct(), "q_id", "left_semi").unionByName(better)
        same = rest.join(better.select("q_id").distinct(), "q_id", "left_anti")
        hits = handed_over(same.unionByName(cells._best(grown, self.k)).unionByName(whole), "hits")
        stale = handed_over(again.unionByName(better.select(F.col("q_id").alias("id"))).distinct(), "stale")
        return hits, stale, others.count() if few.limit(1).count() else 0

    @staticmethod
    def _pairs(hits: DataFrame) -> DataFrame:
        """Scores to 12 digits, so that equal ones are equal however they were added up."""
        return knn.candidate_pairs(hits.filter("q_id != m_id")).withColumn("score", F.round("score", 12))

    def _edges_of(self, hits: DataFrame, doubtful: DataFrame) -> DataFrame:
        """The score of those pairs, from the lists of either end, where they still are a pair."""
        ends = doubtful.select(F.col("a").alias("q_id")).unionByName(doubtful.select(F.col("b").alias("q_id"))).distinct()
        return self._pairs(hits.join(ends, "q_id", "left_semi"))

    def _covered(self, before: Snapshot, edges: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        labels = self.table("labels", "node long, label long", before)
        groups = self.table("groups", "group_id long, member long, avg_confidence double", before)
        ends = handed_over(moved.select(F.col("a").alias("node")).unionByName(moved.select(F.col("b").alias("node"))).distinct(), "moved-ends")
        touched = labels.join(labels.join(ends, "node", "left_semi").select("label").distinct(), "label", "left_semi").select("node")
        touched = handed_over(touched.unionByName(ends).distinct(), "touched")
        own = handed_over(edges.join(touched, edges["a"] == touched["node"], "left_semi"), "touched-edges")
        labels = labels.join(touched, "node", "left_anti").unionByName(graph.components(own))
        groups = groups.join(touched, groups["member"] == touched["node"], "left_anti").unionByName(knn.clique_cover(own).select("group_id", "member", "avg_confidence"))
        return labels, groups, touched.count()
