"""Exact cosine k-nearest-neighbour join, candidate pairs and the greedy clique cover."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators import cells
from corpusloom.sources.tables import handed_over


def knn_join(vectors: DataFrame, k: int = 10, threshold: float = 0.65, rows_per_block: int = 4000, asks: Column | None = None) -> DataFrame:
    """q_id, m_id, score: the k best of each row, itself included; then scores below threshold and the row itself are dropped.

    vectors has id and vector; ids are unique. Null and zero vectors have no neighbours; vectors of another length than most
    are an error, raised before any work. Ties fall to the least m_id. asks, over id, says which rows are searched for; all
    by default.

    Rows lie in cells around centres, and meet in blocks of bounded size the cells whose bound on the cosine leaves a chance
    (see operators.cells); up to rows_per_block of them are one cell."""
    rows = cells.unit(vectors.select(F.col("id").cast("long").alias("id"), "vector"))
    about = rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if about["n"] and about["least"] != about["most"]:
        raise ValueError(f"vectors have between {about['least']} and {about['most']} dimensions")
    if about["n"] <= rows_per_block:
        centres, dealt = np.eye(1, about["most"] or 1), rows.withColumns({"cell": F.lit(0).cast("long"), "angle": F.lit(np.pi)})
    else:
        centres = cells.fitted(rows, about["n"], about["most"], rows_per_block)
        dealt = handed_over(cells.placed(rows, centres), "knn-cells")
    asked = dealt if asks is None else dealt.filter(asks)
    hits = cells.searched(asked, dealt, cells.extents(dealt), centres, k, threshold, rows_per_block)
    return hits.filter("q_id != m_id")


def candidate_pairs(hits: DataFrame) -> DataFrame:
    """a < b, score: a pair counts if either end proposes it."""
    return hits.groupBy(F.least("q_id", "m_id").alias("a"), F.greatest("q_id", "m_id").alias("b")).agg(F.max("score").alias("score"))


def merged(code: DataFrame, intent: DataFrame, k: int) -> DataFrame:
    """q_id, m_id, code_score, intent_score: the k best hits of either list by the better score; a missing score is 0."""
    hits = code.withColumn("intent_score", F.lit(0.0)).withColumnRenamed("score", "code_score")
    hits = hits.unionByName(intent.withColumn("code_score", F.lit(0.0)).withColumnRenamed("score", "intent_score"))
    hits = hits.groupBy("q_id", "m_id").agg(*[F.sum(c).alias(c) for c in ("code_score", "intent_score")])
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc(F.round(F.greatest("code_score", "intent_score"), 12)), "m_id"))
    return hits.withColumn("r", rank).filter(F.col("r") <= k).drop("r")


def greedy_groups(edges: list[tuple[int, int, float]]) -> list[list[int]]:
    """Cliques from the strongest edge on: both ends free, joined by free neighbours of the ends that know all members."""
    return [members for _, _, members in _seeded(edges)]


def _seeded(edges: list[tuple[int, int, float]]) -> list[tuple[int, int, list[int]]]:
    """The edge that each clique grew from, and its members."""
    order = sorted(edges, key=lambda e: (-e[2], e[0], e[1]))
    near: dict[int, dict[int, None]] = {}
    for a, b, _ in order:
        near.setdefault(a, {})[b] = None
        near.setdefault(b, {})[a] = None
    used: set[int] = set()
    out = []
    for a, b, _ in order:
        if a in used or b in used:
            continue
        members = [a, b]
        for c in dict.fromkeys([*near[a], *near[b]]):
            if c not in used and c not in members and all(m in near[c] for m in members):
                members.append(c)
        used.update(members)
        out.append((a, b, sorted(members)))
    return out


def clique_cover(edges: DataFrame, most_in_task: int = 200_000) -> DataFrame:
    """group_id (least member), member, seed_a, seed_b (the edge that the group grew from) and avg_confidence of the greedy
    clique cover; edges a, b, score (a < b, each pair once).

    The greedy order is kept without walking it: an edge can be settled as soon as it comes first among all edges that
    compete for one of its ends or of their common neighbours, since only those can become members. Each round settles all
    such edges at once, drops what touches their members and writes what is left. Once at most `most_in_task` edges are
    left, counted, one task walks the rest; the result is the same for any such number."""
    left = handed_over(edges.select("a", "b", "score", F.struct((-F.col("score")).alias("s"), "a", "b").alias("at")), "clique-edges")
    done = []
    while (n := left.count()) > most_in_task:
        both = left.select("a", "b", "at").union(left.select(F.col("b").alias("a"), F.col("a").alias("b"), "at"))
        thirds = handed_over(_thirds(left, both), "clique-thirds")
        wants = left.select("at", F.explode(F.array("a", "b")).alias("v")).unionByName(thirds.select("at", F.col("c").alias("v")))
        first = wants.groupBy("v").agg(F.min("at").alias("first"))
        blocked = wants.join(first, "v").groupBy("at").agg(F.max((F.col("first") != F.col("at")).cast("int")).alias("waits"))
        settled = handed_over(left.join(blocked.filter("waits = 0").select("at"), "at"), "clique-settled")
        candidates = thirds.join(settled.select("at"), "at")
        # Of two candidates of an edge, whether they know each other.
        pair = candidates.select("at", F.col("c").alias("x")).join(candidates.select("at", F.col("c").alias("y")), "at").filter("x < y")
        known = pair.join(left.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"]).groupBy("at").agg(F.collect_list(F.struct("x", "y")).alias("known"))
        listed = candidates.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("order", "c"))).alias("c"))
        grown = settled.join(listed, "at", "left").join(known, "at", "left").select("a", "b", F.transform("c", lambda x: x["c"]).alias("c"), "known")
        members = handed_over(grown.mapInPandas(_grow, "seed_a long, seed_b long, member long"), "clique-members")
        done.append(members)
        used = members.select("member").distinct()
        for end in ("a", "b"):
            left = left.join(used.withColumnRenamed("member", end), end, "left_anti")
        left = handed_over(left.select("a", "b", "score", "at"), "clique-edges")
    if n:
        done.append(left.select("a", "b", "score").coalesce(1).mapInPandas(_walk, "seed_a long, seed_b long, member long"))
    if not done:
        return left.selectExpr("a AS group_id", "a AS member", "a AS seed_a", "b AS seed_b", "score AS avg_confidence")
    members = done[0]
    for part in done[1:]:
        members = members.unionByName(part)
    members = handed_over(members.join(members.groupBy("seed_a", "seed_b").agg(F.min("member").alias("group_id")), ["seed_a", "seed_b"]).select("group_id", "member", "seed_a", "seed_b"), "cliques")
    inner = edges.join(members.select(F.col("member").alias("a"), F.col("group_id").alias("ga")), "a").join(members.select(F.col("member").alias("b"), F.col("group_id").alias("gb")), "b").filter("ga = gb")
    return members.join(inner.groupBy(F.col("ga").alias("group_id")).agg(F.avg("score").alias("avg_confidence")), "group_id")


def _thirds(edges: DataFrame, both: DataFrame) -> DataFrame:
    """at, c, order: of each edge (a, b), named by `at`, the nodes c that know both ends, and the `at` of the edge (a, c).

    Triangles are listed from their end of least degree, so that a hub's neighbours are not all paired with each other: the
    rows grow with edges ** 1.5 at most, whatever the degrees are."""
    degree = both.groupBy(F.col("a").alias("n")).agg(F.count("*").alias("d"))
    for end in ("a", "b"):
        edges = edges.join(degree.select(F.col("n").alias(end), F.col("d").alias(f"d{end}")), end)
    ends = [F.struct(F.col(f"d{e}").alias("d"), F.col(e).alias("n")) for e in ("a", "b")]
    up = edges.select(F.least(*ends).alias("u"), F.greatest(*ends).alias("v"), "at")
    x, y, z = (up.select(*[F.col(c).alias(n) for c, n in zip(("u", "v", "at"), names, strict=True)]) for names in (("u", "v", "uv"), ("u", "w", "uw"), ("v", "w", "vw")))
    u, v, w = F.col("u.n"), F.col("v.n"), F.col("w.n")
    corners = [
        F.struct(F.col("uv").alias("at"), w.alias("c"), F.when(u < v, F.col("uw")).otherwise(F.col("vw")).alias("order")),
        F.struct(F.col("uw").alias("at"), v.alias("c"), F.when(u < w, F.col("uv")).otherwise(F.col("vw")).alias("order")),
        F.struct(F.col("vw").alias("at"), u.alias("c"), F.when(v < w, F.col("uv")).otherwise(F.col("uw")).alias("order")),
    ]
    return x.join(y, "u").filter(F.col("v") < F.col("w")).join(z, ["v", "w"]).select(F.explode(F.array(*corners)).alias("t")).select("t.*")


def related(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """groups of clique_cover with the relationship of the edge that each grew from; edges has a, b and relationship."""
    return groups.join(edges.select(F.col("a").alias("seed_a"), F.col("b").alias("seed_b"), "relationship"), ["seed_a", "seed_b"], "left")


def _grow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The clique of each settled edge: candidates in order, each if it knows all members."""
    for frame in frames:
        out = []
        for a, b, candidates, known in zip(frame.a, frame.b, frame.c, frame.known, strict=True):
            pairs = {(int(p["x"]), int(p["y"])) for p in (known if known is not None else ())}
            members: list[int] = []
            for c in candidates if candidates is not None else ():
                if all((min(c, m), max(c, m)) in pairs for m in members):
                    members.append(int(c))
            out += [(a, b, m) for m in (a, b, *members)]
        yield pd.DataFrame(out, columns=["seed_a", "seed_b", "member"])


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = [f for f in frames if len(f)]
    if held:
        rest = pd.concat(held)
        groups = _seeded([(int(a), int(b), float(s)) for a, b, s in zip(rest.a, rest.b, rest.score, strict=True)])
        yield pd.DataFrame([(a, b, m) for a, b, g in groups for m in g], columns=["seed_a", "seed_b", "member"])
