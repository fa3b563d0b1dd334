"""N-gram Jaccard join with a count-vector R-tree.

A document's set holds the hashes of its distinct word shingles; equal sets are one class. The hashes fall into groups,
and the group counts of a class are a point. Points of classes that can be linked at all meet in a bucket: with the
shingles of every set in one order, linked sets share one of their first n - ceil(t n) + 1. The order is rarest first:
shingles of more than `common_in` documents (a census counts them all) come last, the most common of all at the very end.
So what many documents quote opens no bucket as long as they have words of their own. At most `most_common` of them are
told apart from rare ones, which moves the order and never a result. Buckets with the same members are kept once.

In a bucket, an R-tree of points (leaves by set size, boxes by their upper corners and by what is left of the sets behind
the shared shingle) bounds the overlap of two boxes or points by the sum of the coordinate minima; pairs below the
overlap that t asks for are dropped, and so are pairs of which too little is left behind the shingle in either set.

Pairs are verified on their whole sets, in two rounds. First every bucket tries stars: the point nearest to the middle
against those it may link with, then again among the rest. Linked classes have one label from then on. Then only pairs
of different labels come from the full tree search. So large groups of near copies never become all pairs, and no link
between components is lost. A bucket of more than `most_in_bucket` classes is dealt out: each of its classes lies in one
block, and those that don't have the bucket's most frequent label visit every block.

Defined results: a null text or one without words has an empty set and is linked with nothing; a null id is never the
least, and where a group has no other the component is null; fewer words than a
shingle are one shingle; repeated rows share a class; an empty table gives no rows; other columns are ignored.
Hashes have 64 bits, and so has the hash of a set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common
from corpusloom.operators import graph

GROUPS = 128
LEAF = 64
#: Sets of more shingles also have a fine point, with about a group for every four shingles.
FINE_FROM = 1024
#: Leading bits of shingles that the census tells apart, and of keys, the last of them a mark.
CENSUS_BITS, KEY_BITS = 40, 48
_M = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the distinct shingles of lower-cased words, by text and hash."""
    data = common.LOWER[data]
    start, end, doc = common.words(data, offsets)
    h = common.span_hash(common.prefix_hash(data), start, end)
    n = len(h) - width + 1
    sets, owner = [], []
    if n > 0:
        s = h[:n].copy()
        for k in range(1, width):
            s = common.mixed(s * _M + h[k : k + n])
        whole = doc[width - 1 :] == doc[:n]
        sets.append(s[whole])
        owner.append(doc[:n][whole])
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        at = np.searchsorted(doc, d)
        s = h[at : at + 1].copy()
        for k in range(1, counts[d]):
            s = common.mixed(s * _M + h[at + k])
        sets.append(common.mixed(s + np.uint64(counts[d])))
        owner.append(np.array([d]))
    if not sets:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s, d = np.concatenate(sets), np.concatenate(owner)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    return s[new], d[new]


def _classes(s: np.ndarray, d: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set size, first place, class) of each text; the class of an empty set is 0."""
    n = np.bincount(d, minlength=n_docs)
    first = np.cumsum(n) - n
    cid = np.zeros(n_docs, np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        one = np.add.reduceat(common.mixed(s), first[some])
        two = np.add.reduceat(common.mixed(s ^ _M), first[some])
        cid[some] = common.mixed(common.mixed(one + n[some].astype(np.uint64)) ^ two)
    return n, first, cid


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def _ranks(s: np.ndarray, common_ones: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 for a rare shingle, else the power of two of how many documents have it."""
    known, rank = common_ones
    if not len(known):
        return np.zeros(len(s), np.uint8)
    lead = s >> np.uint64(64 - CENSUS_BITS)
    at = np.searchsorted(known, lead)
    at[at == len(known)] = 0
    return np.where(known[at] == lead, rank[at], 0).astype(np.uint8)


def _each_class_once(width: int):
    """The shingles of texts, those of equal sets in a task once."""

    def values_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, data, offsets in common.steps(batch):
            s, d = shingles(data, offsets, width)
            n, _, cid = _classes(s, d, len(offsets) - 1)
            once = np.zeros(len(n), bool)
            once[np.unique(cid, return_index=True)[1]] = True
            yield s[once[d]]

    return values_of


def _marked_keys(percent: int):
    """The first shingles of classes, with a mark on those that the smaller set of a pair may share."""

    def values_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        lists, n = batch.column("keys"), batch.column("n").to_numpy()
        keys = lists.flatten().to_numpy().view(np.uint64)
        length = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(n)), length)
        place = np.arange(len(keys)) - np.repeat(np.cumsum(length) - length, length)
        mark = ((100 + percent) * (n[row] - place) >= 2 * percent * n[row]).astype(np.uint64)
        at = np.uint64(64 - KEY_BITS)
        yield (keys >> (at + np.uint64(1)) << np.uint64(1) | mark) << at

    return values_of


def _points(percent: int, width: int, common_ones: tuple[np.ndarray, np.ndarray]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in common.steps(batch):
                s, d = shingles(data, offsets, width)
                n_docs = len(offsets) - 1
                n, first, cid = _classes(s, d, n_docs)
                group = (s & np.uint64(GROUPS - 1)).astype(np.int64)
                counts = np.minimum(np.bincount(d * GROUPS + group, minlength=n_docs * GROUPS), 255).astype(np.uint8)
                length = np.where(n > 0, prefix_length(n, percent), 0)
                rank = _ranks(s, common_ones)
                rare_first = s[np.lexsort((s, rank, d))] if rank.any() else s
                keep = np.arange(len(s)) - first[d] < length[d]
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(common.mixed(rare_first[keep] ^ _M).view(np.int64)))
                points = pa.FixedSizeBinaryArray.from_buffers(pa.binary(GROUPS), n_docs, [None, pa.py_buffer(counts.tobytes())]).cast(pa.binary())
                fine = [_fine(s[first[i] : first[i] + n[i]]) if n[i] > FINE_FROM else None for i in range(n_docs)]
                own = [batch.column("doc_id").slice(rows.start, n_docs), pa.array(cid.view(np.int64)), pa.array(n), points]
                yield pa.RecordBatch.from_arrays([*own, pa.array(fine, pa.binary()), keys], names=["doc_id", "cid", "n", "point", "fine", "keys"])

    return scan


def _fine(s: np.ndarray) -> bytes:
    groups = 1 << (len(s) // 4 - 1).bit_length()
    return np.minimum(np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups), 255).astype(np.uint8).tobytes()


def _fine_bound(p: np.ndarray, q: np.ndarray) -> int:
    """Summed coordinate minima of two fine points; the finer folds onto the groups of the other."""
    if p.max() == 255 or q.max() == 255:
        return 1 << 62
    groups = min(len(p), len(q))
    p, q = (x.reshape(-1, groups).sum(axis=0, dtype=np.int64) for x in (p, q))
    return int(np.minimum(p, q).sum())


def _still_near(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need = ((percent * (batch.column("na").to_numpy() + batch.column("nb").to_numpy())) / (100 + percent)).tolist()
            keep = [_fine_bound(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) >= m - 1e-6 for x, y, m in zip(batch.column("fa"), batch.column("fb"), need, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return check


def _hits(bitmap: np.ndarray):
    """A row for each key of a class that is in the bitmap; rest: shingles of the class from that one on."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column("keys"), batch.column("n").to_numpy()
            keys = lists.flatten().to_numpy()
            length = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(lists)), length)
            rest = n[row] - np.arange(len(keys)) + np.repeat(np.cumsum(length) - length, length)
            hit = np.flatnonzero(common.in_bitmap(bitmap, keys.view(np.uint64))) if len(keys) else row
            own = [batch.column(c).take(pa.array(row[hit])) for c in ("cid", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), *own, pa.array(rest[hit])], names=["key", "cid", "n", "rest"])

    return scan


# --- in a bucket -------------------------------------------------------------------------------


def _wide(points: np.ndarray) -> np.ndarray:
    """Counts as 16 bits; 255 stands for 255 or more and so bounds nothing."""
    wide = points.astype(np.uint16)
    wide[points == 255] = 60_000
    return wide


def _may_link(p: np.ndarray, n: np.ndarray, r: np.ndarray, q: np.ndarray, m: np.ndarray, t: np.ndarray, percent: int) -> np.ndarray:
    """For points p (n their sizes, r what is left of them) against q (m, t): sizes, summed coordinate minima and what is
    left behind the first shingle that they share allow a link."""
    low, high = np.minimum(n[:, None], m[None, :]), np.maximum(n[:, None], m[None, :])
    ok = (100 * low >= percent * high) & ((100 + percent) * np.minimum(r[:, None], t[None, :]) >= percent * (low + high))
    x, y = np.nonzero(ok)
    for a in range(0, len(x), 1 << 16):
        i, j = x[a : a + (1 << 16)], y[a : a + (1 << 16)]
        bound = np.minimum(p[i], q[j]).sum(axis=1, dtype=np.int64)
        ok[i, j] = (100 + percent) * bound >= percent * (n[i] + m[j])
    return ok


class Tree:
    """Points packed into leaves by size; each leaf has the upper corner of its box, its least and largest size and the most
    that is left of a set in it."""

    def __init__(self, points: np.ndarray, n: np.ndarray, rest: np.ndarray):
        self.order = np.lexsort((points.argmax(axis=1), n))
        self.points, self.n, self.rest = points[self.order], n[self.order], rest[self.order]
        self.edges = np.arange(0, len(n), LEAF)
        self.corner = np.maximum.reduceat(self.points, self.edges, axis=0)
        self.least, self.most, self.left = np.minimum.reduceat(self.n, self.edges), np.maximum.reduceat(self.n, self.edges), np.maximum.reduceat(self.rest, self.edges)

    def leaves(self, i: int) -> slice:
        return slice(self.edges[i], min(self.edges[i] + LEAF, len(self.n)))


def tree_pairs(a: Tree, b: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that may be linked, from the boxes down; each unordered pair once if a is b."""
    for i in range(len(a.edges)):
        bound = np.minimum(np.minimum(a.corner[i], b.corner).sum(axis=1, dtype=np.int64), np.minimum(a.left[i], b.left))
        fits = (100 * b.most >= percent * a.least[i]) & (100 * a.most[i] >= percent * b.least)
        fits &= (100 + percent) * bound >= percent * (a.least[i] + b.least)
        for j in np.flatnonzero(fits):
            if a is b and j < i:
                continue
            x, y = a.leaves(i), b.leaves(j)
            ok = _may_link(a.points[x], a.n[x], a.rest[x], b.points[y], b.n[y], b.rest[y], percent)
            if a is b and i == j:
                ok = np.triu(ok, 1)
            r, c = np.nonzero(ok)
            if len(r):
                yield a.order[r + x.start], b.order[c + y.start]


def _stars(points: np.ndarray, n: np.ndarray, rest_of: np.ndarray, cid: np.ndarray, percent: int, most: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rest = np.arange(len(n))
    for _ in range(most):
        if len(rest) < 2:
            return
        p = points[rest]
        off = np.abs(p - np.median(p, axis=0)).sum(axis=1) if len(rest) > 2 else np.zeros(len(rest))
        hub = np.lexsort((cid[rest], off))[0]
        ok = _may_link(p[hub : hub + 1], n[rest[hub : hub + 1]], rest_of[rest[hub : hub + 1]], p, n[rest], rest_of[rest], percent)[0]
        ok[hub] = False
        other = rest[ok]
        if len(other):
            yield np.full(len(other), rest[hub]), other
        ok[hub] = True
        rest = rest[~ok]


def _bucket_pairs(percent: int, full: bool):
    """Rows sorted by (key, bi, bj) -> pairs of classes a < b to verify."""

    def of(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key, bi, bj, cid, n, rest = (table.column(c).to_numpy() for c in ("key", "bi", "bj", "cid", "n", "rest"))
        points = _wide(np.frombuffer(b"".join(table.column("point").to_pylist()), np.uint8).reshape(-1, GROUPS))
        label = table.column("label").to_numpy() if full else None
        visits = table.column("visits").to_numpy(zero_copy_only=False) if full else None
        fine = table.column("fine") if full else None
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1]), [True]]))
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if hi - lo < 2 or (full and (label[lo:hi] == label[lo]).all()):
                continue
            p, m, r, c = points[lo:hi], n[lo:hi], rest[lo:hi], cid[lo:hi]
            if not full:
                for x, y in _stars(p, m, r, c, percent):
                    yield c[x], c[y]
                continue
            guest = visits[lo:hi]
            if not guest.any():
                tree = Tree(p, m, r)
                pairs = tree_pairs(tree, tree, percent)
            elif guest.all():
                continue
            else:
                left, right = np.flatnonzero(~guest), np.flatnonzero(guest)
                pairs = ((left[x], right[y]) for x, y in tree_pairs(Tree(p[left], m[left], r[left]), Tree(p[right], m[right], r[right]), percent))
            for x, y in pairs:
                apart = label[lo:hi][x] != label[lo:hi][y]
                x, y = x[apart], y[apart]
                large = (m[x] > FINE_FROM) & (m[y] > FINE_FROM)
                for i in np.flatnonzero(large):
                    p1, p2 = (np.frombuffer(fine[lo + int(z[i])].as_buffer(), np.uint8) for z in (x, y))
                    large[i] = (100 + percent) * _fine_bound(p1, p2) < percent * int(m[x[i]] + m[y[i]])
                yield c[x[~large]], c[y[~large]]

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        found = [np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1) for x, y in of(table)]
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= 50_000:
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                edge = int(np.searchsorted(key, key[-1]))
                if edge:
                    yield from emit(table.slice(0, edge))
                    held = table.slice(edge).to_batches()
        if held:
            yield from emit(pa.Table.from_batches(held))

    return scan


# --- verification ------------------------------------------------------------------------------


def _sets(bitmap: np.ndarray, width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in common.steps(batch):
                s, d = shingles(data, offsets, width)
                n, first, cid = _classes(s, d, len(offsets) - 1)
                hit = np.flatnonzero(common.in_bitmap(bitmap, cid) & (n > 0))
                hit = hit[np.unique(cid[hit], return_index=True)[1]]
                sets = [s[first[i] : first[i] + n[i]].tobytes() for i in hit]
                yield pa.RecordBatch.from_arrays([pa.array(cid[hit].view(np.int64)), pa.array(sets, pa.binary())], names=["cid", "s"])

    return scan


def _linked(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def _verified(docs: DataFrame, pairs: DataFrame, fine: DataFrame, percent: int, width: int, to: common.Scratch) -> DataFrame:
    """The links among pairs, written among the tables of `to`; of large sets only the pairs that their fine points let pass move whole sets."""
    with common.Scratch(docs.sparkSession) as own:
        both = _with_sets(docs, own.handed_over(pairs.distinct(), "pairs"), fine, percent, width, own)
        return to.handed_over(both.mapInArrow(_linked(percent), "a long, b long"), "links")


def _with_sets(docs: DataFrame, pairs: DataFrame, fine: DataFrame, percent: int, width: int, own: common.Scratch) -> DataFrame:
    """a, b, sa, sb: pairs that are worth it, with the whole sets of both."""
    sides = [fine.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"f{x}")) for x in "ab"]
    large = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "nb", "fa", "fb").mapInArrow(_still_near(percent), "a long, b long")
    ids = fine.select("cid")
    small = pairs.join(ids, pairs["a"] == ids["cid"], "left_anti").unionByName(pairs.join(ids, pairs["a"] == ids["cid"], "left_semi").join(ids, pairs["b"] == ids["cid"], "left_anti"))
    pairs = own.handed_over(small.unionByName(large), "pairs-left")
    needed = own.handed_over(pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct(), "needed")
    sets = docs.select("text").mapInArrow(_sets(common.bitmap_of(needed, "cid", needed.count()), width), "cid long, s binary").join(needed, "cid", "left_semi").dropDuplicates(["cid"])
    sets = own.handed_over(sets, "sets")
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb")


def _common_shingles(docs: DataFrame, width: int, common_in: int, most_common: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading bits, rising, and rank of the shingles of more than common_in documents, of the most common ones if they are many."""
    many = common.census(docs.select("text"), _each_class_once(width), common.text_bytes(docs) // 6, CENSUS_BITS, common_in + 1)
    with common.Scratch(docs.sparkSession) as own:
        many = own.handed_over(many, "common-shingles")
        rows = (many if many.count() <= most_common else many.orderBy(F.desc("n"), "value").limit(most_common)).toArrow()
    value, n = (rows.column(c).to_numpy() for c in ("value", "n"))
    order = np.argsort(value)
    return value[order].astype(np.uint64), np.frexp(n[order].astype(float))[1].astype(np.uint8)


def linked(docs: DataFrame, percent: int = 80, width: int = 5, most_in_bucket: int = 2000, common_in: int = 50, most_common: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every document; docs needs doc_id and text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with common.Scratch(docs.sparkSession) as own:
        return common.handed_over(_components(docs, percent, width, most_in_bucket, common_in, most_common, own), "components")


def _in_buckets(classes: DataFrame, percent: int, most_in_bucket: int, to: common.Scratch) -> DataFrame:
    """key, cid, rest, blocks, own, large: the classes in buckets of two or more, written among the tables of `to`."""
    with common.Scratch(classes.sparkSession) as own:
        n_keys = classes.agg(F.sum(F.size("keys"))).first()[0] or 0
        shared = own.handed_over(common.census(classes.select("n", "keys"), _marked_keys(percent), n_keys, KEY_BITS, 2, flagged=True), "shared")
        shared = common.bitmap_of(shared.withColumn("key", F.shiftleft("value", 65 - KEY_BITS)), "key", shared.count())
        members = own.handed_over(classes.select("cid", "n", "keys").mapInArrow(_hits(shared), "key long, cid long, n long, rest long"), "members")
        # Of buckets with the same members the first in the order stays: in it the most is left of each set.
        same = members.groupBy("key").agg(
            F.count("*").alias("c"), F.expr("sum(cast(cid AS decimal(20,0)))").alias("s1"), F.bit_xor(F.xxhash64("cid")).alias("s2"), F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.sum("rest").alias("left")
        )
        kept = own.handed_over(same.filter("lo != hi").groupBy("c", "s1", "s2", "lo", "hi").agg(F.max_by("key", "left").alias("key")).select("key", "c"), "buckets")
        blocks = F.greatest(F.ceil(F.col("c") / F.lit(most_in_bucket)), F.lit(1)).cast("int")
        rows = members.join(kept.select("key", blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        return to.handed_over(rows.select("key", "cid", "rest", "blocks", "own", (F.col("n") > FINE_FROM).alias("large")), "in-buckets")


def _components(docs: DataFrame, percent: int, width: int, most_in_bucket: int, common_in: int, most_common: int, own: common.Scratch) -> DataFrame:
    common_ones = _common_shingles(docs, width, common_in, most_common)
    points = own.handed_over(docs.mapInArrow(_points(percent, width, common_ones), "doc_id long, cid long, n long, point binary, fine binary, keys array<long>"), "points")
    classes = own.handed_over(points.filter("n > 0").drop("doc_id").dropDuplicates(["cid"]), "classes")
    fine = classes.filter("fine IS NOT NULL").select("cid", "n", "fine")
    in_buckets = _in_buckets(classes, percent, most_in_bucket, own)

    def search(rows: DataFrame, full: bool) -> DataFrame:
        """Rows carry ids only until they are dealt out; points join them there, fine ones where two of them can meet."""
        more = ["label", "visits"] if full else []
        rows = rows.join(classes.select("cid", "n", "point", *(["fine"] if full else [])), "cid")
        rows = rows.select("key", "bi", "bj", "cid", "rest", "n", "point", *more, *([F.when(F.col("fines"), F.col("fine")).alias("fine")] if full else []))
        return rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "cid").mapInArrow(_bucket_pairs(percent, full), "a long, b long")

    first = _verified(docs, search(in_buckets.select("key", F.col("own").alias("bi"), F.lit(0).alias("bj"), "cid", "rest"), False), fine, percent, width, own)
    labels = graph.components(first)
    labelled = in_buckets.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    labelled = own.handed_over(labelled, "labelled")
    by_label = labelled.groupBy("key", "label").agg(F.count("*").alias("k"), F.max("large").alias("large"))
    apart = by_label.groupBy("key").agg(F.count("*").alias("labels"), (F.count_if("large") > 1).alias("fines"), F.max_by("label", "k").alias("top"), (F.sum("k") - F.max("k")).alias("others")).filter("labels > 1")
    dealt = labelled.join(apart, "key").withColumn("other", F.col("label") != F.col("top"))
    # (bi, bj): block, and which part of the visitors; a bucket of one block is its own visitor.
    parts = F.greatest(F.ceil(F.col("others") / F.lit(most_in_bucket)), F.lit(1)).cast("int")
    dealt = dealt.withColumn("parts", F.when(F.col("blocks") > 1, parts).otherwise(1)).withColumn("part", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("parts")).cast("int"))
    stays = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.col("own").alias("bi"), j.alias("bj"), F.lit(False).alias("visits")))
    visits = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("bi"), F.col("part").alias("bj"), F.lit(True).alias("visits")))
    dealt = dealt.withColumn("at", F.explode(F.when((F.col("blocks") > 1) & F.col("other"), F.concat(stays, visits)).otherwise(stays))).select("key", "at.*", "cid", "rest", "label", "fines")
    second = _verified(docs, search(dealt, True), fine, percent, width, own)
    if second.limit(1).count():
        labels = graph.components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(second))
    slim = points.select("doc_id", "cid", "n")
    least = slim.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("m")).join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = own.handed_over(least, "class-labels")
    heads = least.select("cid", "label").join(least.groupBy("label").agg(F.min("m").alias("component_id")), "label").select("cid", "component_id")
    return slim.join(heads, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return linked(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS t FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), edge AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT x AS doc_id, x AS r FROM edge UNION SELECT reach.doc_id, edge.y FROM reach JOIN edge ON reach.r = edge.x
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(min(reach.r), d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id, n.n
"""
