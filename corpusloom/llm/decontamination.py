"""Benchmark decontamination by latent semantic retrieval.

1. Statistics: one census of the terms of all passages, `window` words each, of corpus and benchmark. The most
   frequent ones, without those in more than `common_share` of the passages, are the vocabulary, and all that the
   benchmark has; `terms` of them, by default 16384 and twice as many for each fourfold of 256 MB of text, up to 131072.
2. Basis: a distributed randomised SVD of the TF-IDF passages of the whole corpus and benchmark, each of the same weight,
   of rank `rank`, as a rule far below the number of items. Passages are written once as places in the vocabulary; each
   partition sums its part of (A'A)Q, twice; Spark adds the parts by blocks of terms.
3. Candidates: windows of every whole text, half overlapping, and items, long ones in passages of up to 1.5 windows, are
   vectors of that space; every window meets every passage in one matrix product, and those whose cosine is `near` or more
   are a candidate, whatever words they share. An inverted index of each passage's `keys` rarest terms adds the windows
   that have `shared` of them or more, for words that the vocabulary lacks.
4. Checks: the longest common subsequence of the whole item and a stretch of text around the window, in words. From
   `verbatim` of the item's words in a stretch of 1.25 times its length on it is a leak; from `paraphrase` on, `least_common`
   words at least, in 1.5 times its length, if the answer is there too: two thirds of the words of the item's answer if the benchmark has a
   column `answer`, else a third of the `n_answer` rarest words of the item.

The benchmark is a query set; all of it is met in one search of the corpus, `items_at_once` at a time if it is larger.
Words are lower-cased (A-Z) and lose one mark at the end. Terms are told apart by 48 bits of hash.
Defined results: null or empty texts and items, and items without words, are never leaks; repeated rows are found each;
an empty table of either kind gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common

#: Terms of which the sums are one row; cosines that a task holds at once.
SUM_TERMS, SCORES_AT_ONCE = 256, 2_000_000
#: Passages whose sums a task makes at once; places of one term that are added one after the other there.
PASSAGES_AT_ONCE, IN_TURN = 8192, 64
#: Words of an item up to which regions are checked side by side; words of a region beyond which its stretches are, at once.
MOST_BITS, LONG_REGION = 63, 256
#: Masks that are a table of 32 MB at most; beyond, they are searched.
DENSE_MASKS = 4_000_000
TERM_BITS = 48
#: Stands for a passage in the census.
PASSAGE = np.uint64(2**64 - 1)

_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
DDL = "doc_id long, item_id long, cosine double, common_words long, item_words long, kind string"


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leading bits of the hash of each word, text number)."""
    data = common.LOWER[data]
    start, end, doc = common.words(data, offsets)
    if len(start):
        end = end - (_MARK[data[end - 1]] & (end - start > 1))
    return common.span_hash(common.prefix_hash(data), start, end) >> np.uint64(64 - TERM_BITS), doc


def _places(doc: np.ndarray, n_docs: int) -> np.ndarray:
    n = np.bincount(doc, minlength=n_docs)
    return np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)


class Places:
    """Where hashes lie among rising ones, by a table of their leading bits."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        bits = min(22, self.n.bit_length() + 4)
        self.down = np.uint64(TERM_BITS - bits)
        n = np.bincount((values >> self.down).astype(np.int64), minlength=1 << bits)
        self.first = np.where(n > 0, np.cumsum(n) - n, self.n).astype(np.int32)
        self.values = np.append(values, np.uint64(2**64 - 1))

    def __reduce__(self):
        return Places, (self.values[:-1],)  # the table is made anew where it is needed

    def of(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or the number of values."""
        out = self.first[(h >> self.down).astype(np.int64)].astype(np.int64)
        left = np.flatnonzero(out < self.n)
        while len(left):
            found = self.values[out[left]]
            out[left[found > h[left]]] = self.n
            left = left[found < h[left]]
            out[left] += 1
        return out


def _passage_numbers(doc: np.ndarray, place: np.ndarray, window: int) -> np.ndarray:
    return np.cumsum(np.concatenate([[0], ((place[1:] % window == 0) | (doc[1:] != doc[:-1])).astype(np.int64)])) if len(doc) else doc


def _terms_of_passages(window: int):
    """The distinct terms of every passage, and a mark for the passage."""

    def values_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        up = 64 - TERM_BITS
        for _, data, offsets in common.steps(batch, limit=1 << 18):
            h, doc = _hashes(data, offsets)
            passage = _passage_numbers(doc, _places(doc, len(offsets) - 1), window)
            for first in range(0, int(passage[-1]) + 1 if len(passage) else 0, 1 << up):
                own = slice(*np.searchsorted(passage, [first, first + (1 << up)]))
                value = np.sort(((passage[own] - first).astype(np.uint64) << np.uint64(TERM_BITS)) | h[own])
                new = np.concatenate([[True], value[1:] != value[:-1]])
                yield np.concatenate([value[new] << np.uint64(up), np.full(int(passage[own][-1]) - first + 1, PASSAGE)])

    return values_of


def _known_passages(vocabulary: np.ndarray, idf: np.ndarray, window: int):
    """The passages that have terms of the vocabulary, some thousand a row: the places of those terms, passage by passage,
    how many each has, and the inverse square of its length as a vector."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = Places(vocabulary), len(vocabulary)
        for batch in batches:
            for _, data, offsets in common.steps(batch, limit=1 << 20):
                h, doc = _hashes(data, offsets)
                term = known.of(h)
                at = np.flatnonzero(term < size)
                cell = np.sort(_passage_numbers(doc, _places(doc, len(offsets) - 1), window)[at] * size + term[at])
                if not len(cell):
                    continue
                passage, term = cell // size, cell % size
                first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
                new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                n = np.diff(np.append(new, len(cell)))
                scale = 1 / np.add.reduceat((n * idf[term[new]]) ** 2, np.searchsorted(new, first))
                ends = np.append(first, len(cell))
                for a in range(0, len(first), PASSAGES_AT_ONCE):
                    b = min(a + PASSAGES_AT_ONCE, len(first))
                    cols = (term[ends[a] : ends[b]].astype("<i4"), np.diff(ends[a : b + 1]).astype("<i4"), scale[a:b].astype("<f4"))
                    yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cols], names=["terms", "sizes", "scales"])

    return rows


def _group_sums(rows: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(groups by falling size, sums of the rows of each) of groups of `size` places in `at`, one after the other; the j-th
    places of all groups are added at once."""
    order = np.argsort(-size, kind="stable")
    first, n = (np.cumsum(size) - size)[order], -size[order]
    out = np.take(rows, at[first], axis=0)
    for j in range(1, -int(n[0])):
        k = int(np.searchsorted(n, -j, "left"))  # those that have more than j
        out[:k] += np.take(rows, at[first[:k] + j], axis=0)
    return order, out


def _covariance(weighted: np.ndarray):
    """A'(A q) of a partition's passages without the weights of the terms on the left, in blocks of terms; weighted: q with
    those on the right."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(weighted.shape, np.float32)
        for batch in batches:
            for terms, sizes, scales in zip(*(batch.column(c) for c in ("terms", "sizes", "scales")), strict=True):
                term, size = np.frombuffer(terms.as_buffer(), "<i4"), np.frombuffer(sizes.as_buffer(), "<i4").astype(np.int64)
                order, p = _group_sums(weighted, term, size)
                p *= np.frombuffer(scales.as_buffer(), "<f4")[order][:, None]
                place = np.empty(len(size), np.int64)
                place[order] = np.arange(len(size))
                by_term = np.argsort(term, kind="stable")
                term = term[by_term]
                new = np.concatenate([[True], term[1:] != term[:-1]])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(term)))
                # A term that is met very often here is several groups.
                turns = -(-n // IN_TURN)
                part = np.repeat(first, turns) + IN_TURN * (np.arange(turns.sum()) - np.repeat(np.cumsum(turns) - turns, turns))
                order, added = _group_sums(p, np.repeat(place, size)[by_term], np.diff(np.append(part, len(term))))
                own, once = term[part][order], np.repeat(turns == 1, turns)[order]
                total[own[once]] += added[once]
                np.add.at(total, own[~once], added[~once])
        blocks = np.arange(0, len(total), SUM_TERMS)
        sums = [total[i : i + SUM_TERMS].tobytes() for i in blocks]
        part = np.full(len(blocks), TaskContext.get().partitionId(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(part), pa.array(sums, pa.binary())], names=["block", "part", "sums"])

    return sums


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of sums per block, from rows sorted by block and part."""
    held, total = None, np.zeros(0, np.float32)
    for batch in batches:
        for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
            x = np.frombuffer(sums.as_buffer(), np.float32)
            if block == held:
                total += x
                continue
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([total.tobytes()], pa.binary())], names=["block", "sums"])
            held, total = block, x.copy()
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([total.tobytes()], pa.binary())], names=["block", "sums"])


def basis(texts: DataFrame, vocabulary: np.ndarray, idf: np.ndarray, window: int, rank: int, n_sums: int = 12, seed: int = 3) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF passages of texts (text), by a randomised range finder."""
    size = len(vocabulary)
    rank = min(rank, size)
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, min(size, rank + 8))))

    def covariance(passages: DataFrame, x: np.ndarray) -> np.ndarray:
        parts = passages.coalesce(n_sums).mapInArrow(_covariance((idf[:, None] * x).astype(np.float32)), "block long, part long, sums binary")
        sums = parts.repartition(n_sums, "block").sortWithinPartitions("block", "part").mapInArrow(_added, "block long, sums binary").toArrow()
        out = np.zeros(x.shape)
        for block, rows in zip(sums.column("block").to_pylist(), sums.column("sums"), strict=True):
            out[block : block + SUM_TERMS] = np.frombuffer(rows.as_buffer(), np.float32).reshape(-1, x.shape[1])
        return idf[:, None] * out

    with common.Scratch(texts.sparkSession) as own:
        passages = own.handed_over(texts.mapInArrow(_known_passages(vocabulary, idf, window), "terms binary, sizes binary, scales binary"), "known-passages")
        q, _ = np.linalg.qr(covariance(passages, q))
        values, vectors = np.linalg.eigh(q.T @ covariance(passages, q))
    return q @ vectors[:, np.argsort(-values)[:rank]]


class Items:
    """Benchmark items as words (places in `words`), with masks for common subsequences and the words that answer them."""

    def __init__(self, ids: list[int], terms: list[np.ndarray], answers: list[tuple[set, float]]):
        self.ids, self.terms, self.answers = ids, terms, answers
        self.masks: list[dict[int, int]] = []
        for t in terms:
            mask: dict[int, int] = {}
            for i, x in enumerate(t.tolist()):
                mask[x] = mask.get(x, 0) | 1 << i
            self.masks.append(mask)
        # The masks of items of up to 63 words, by (item, word), for many subsequences at once.
        self.size = np.array([len(t) for t in terms], np.int64)
        self.stride = 2 + max((int(t.max()) for t in terms if len(t)), default=0)
        pairs = sorted((i * self.stride + x, m) for i, mask in enumerate(self.masks) if self.size[i] <= MOST_BITS for x, m in mask.items())
        self.pair = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.mask = np.array([m for _, m in pairs] or [0], np.uint64)
        self.dense = None
        if len(terms) * self.stride <= DENSE_MASKS:  # a plain table of them is looked up faster
            self.dense = np.zeros(len(terms) * self.stride, np.uint64)
            self.dense[self.pair[self.pair >= 0]] = self.mask[self.pair >= 0]

    def commons(self, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, words: np.ndarray) -> np.ndarray:
        """common() of each item, of up to 63 words, and words[lo:hi], side by side."""
        order = np.argsort(lo - hi, kind="stable")
        item, lo, n = item[order], lo[order], (hi - lo)[order]
        base, full = item * self.stride, (np.uint64(1) << self.size[item].astype(np.uint64)) - np.uint64(1)
        row, words = full.copy(), np.minimum(words, self.stride - 1)
        for t in range(int(n[0]) if len(n) else 0):
            k = int(np.searchsorted(-n, -t, "left"))  # those that are longer than t
            key = base[:k] + words[lo[:k] + t]
            if self.dense is not None:
                u = row[:k] & self.dense[key]
            else:
                at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
                u = row[:k] & np.where(self.pair[at] == key, self.mask[at], np.uint64(0))
            row[:k] = ((row[:k] + u) | (row[:k] - u)) & full[:k]
        out = np.empty(len(item), np.int64)
        out[order] = self.size[item] - np.bitwise_count(row).astype(np.int64)
        return out

    def bests(self, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, words: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, first word) of best() for each item and words[lo:hi]."""
        step = np.maximum(1, width // 8)
        spots = -(-np.maximum(1, hi - lo - width + step) // step)
        row = np.repeat(np.arange(len(item)), spots)
        a = lo[row] + (np.arange(len(row)) - np.repeat(np.cumsum(spots) - spots, spots)) * step[row]
        found = self.commons(item[row], a, np.minimum(a + width[row], hi[row]), words)
        order = np.lexsort((a, -found, row))
        first = order[np.flatnonzero(np.concatenate([[True], row[order][1:] != row[order][:-1]]))] if len(row) else order
        return found[first], a[first]

    def verdicts(self, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, words: np.ndarray, verbatim: float, paraphrase: float, least_common: int) -> Iterator[tuple[int, tuple[int, int, str]]]:
        """(region, verdict()) of the regions words[lo:hi] that leak their item."""
        size = self.size[item]
        short = size <= MOST_BITS
        for r in np.flatnonzero(~short).tolist():
            said = self.verdict(int(item[r]), words[lo[r] : hi[r]].tolist(), verbatim, paraphrase, least_common)
            if said:
                yield r, said
        left = np.flatnonzero(short)
        # Of a long region the subsequence as a whole says little; its stretches are looked at at once.
        few = left[hi[left] - lo[left] <= LONG_REGION]
        few = few[self.commons(item[few], lo[few], hi[few], words) >= paraphrase * size[few]]
        left = np.sort(np.concatenate([few, left[hi[left] - lo[left] > LONG_REGION]]))
        found, _ = self.bests(item[left], lo[left], hi[left], words, -(-5 * size[left] // 4))
        sure = found >= verbatim * size[left]
        for r, n in zip(left[sure].tolist(), found[sure].tolist(), strict=True):
            yield r, (n, int(size[r]), "verbatim")
        left = left[~sure]
        width = -(-3 * size[left] // 2)
        found, a = self.bests(item[left], lo[left], hi[left], words, width)
        enough = found >= np.maximum(paraphrase * size[left], least_common)
        for r, n, at, w in zip(left[enough].tolist(), found[enough].tolist(), a[enough].tolist(), width[enough].tolist(), strict=True):
            i, half = int(item[r]), int(size[r]) // 2
            answer, share = self.answers[i]
            if len(answer.intersection(words[max(lo[r], at - half) : min(hi[r], at + w + half)].tolist())) >= share * len(answer):
                yield r, (n, int(size[r]), "paraphrase")

    def common(self, item: int, words: list[int]) -> int:
        """Length of the longest common subsequence, a bit per word of the item."""
        mask, full = self.masks[item], (1 << len(self.terms[item])) - 1
        row = full
        for w in words:
            m = mask.get(w)
            if m is not None:
                u = row & m
                row = (row + u | row - u) & full
        return len(self.terms[item]) - row.bit_count()

    def best(self, item: int, words: list[int], width: int) -> tuple[int, int, int]:
        """(length, first word, word behind) of the longest common subsequence in a stretch of `width` words, to an eighth of it."""
        step = max(1, width // 8)
        spots = range(0, max(1, len(words) - width + step), step)
        return max(((self.common(item, words[a : a + width]), a, a + width) for a in spots), key=lambda x: x[0])

    def verdict(self, item: int, words: list[int], verbatim: float, paraphrase: float, least_common: int) -> tuple[int, int, str] | None:
        size = len(self.terms[item])
        if self.common(item, words) < paraphrase * size:
            return None
        lcs, _, _ = self.best(item, words, -(-5 * size // 4))
        if lcs >= verbatim * size:
            return lcs, size, "verbatim"
        lcs, a, b = self.best(item, words, -(-3 * size // 2))
        answer, share = self.answers[item]
        near_by = words[max(0, a - size // 2) : b + size // 2]
        if lcs >= max(paraphrase * size, least_common) and len(answer.intersection(near_by)) >= share * len(answer):
            return lcs, size, "paraphrase"
        return None


class Index:
    """Passages of items by their key terms (hashes, rising), and as latent vectors of length 1 or 0."""

    def __init__(self, keys: list[np.ndarray], owner: np.ndarray, latent: np.ndarray):
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        unit = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        order = np.argsort(flat, kind="stable")
        key, first = np.unique(flat[order], return_index=True)
        self.units, self.first = unit[order], np.append(first, len(flat))
        self.owner, self.latent = owner, latent
        self.places = Places(key)

    def met(self, h: np.ndarray, where: np.ndarray, follows: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window, passage, first and last word among its keys) where a window, blocks w and w + 1, has `shared` different
        keys of the passage; follows[b]: block b has the same text as b - 1."""
        key = self.places.of(h)
        hit = np.flatnonzero(key < self.places.n)
        key, block = key[hit], where[hit]
        n = self.first[key + 1] - self.first[key]
        row = np.repeat(np.arange(len(key)), n)
        unit = self.units[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.first[key[row]]]
        block, key, hit = block[row], key[row], hit[row]
        before = np.flatnonzero(follows[block])
        window, unit, key, hit = (np.concatenate([x, y[before]]) for x, y in ((block, block - 1), (unit, unit), (key, key), (hit, hit)))
        order = np.lexsort((key, unit, window))
        window, unit, key, hit = window[order], unit[order], key[order], hit[order]
        same = (window[1:] == window[:-1]) & (unit[1:] == unit[:-1])
        new = np.concatenate([[True], ~same])[: len(key)]
        other = np.concatenate([[True], ~same | (key[1:] != key[:-1])])[: len(key)]
        first = np.flatnonzero(new)
        if not len(first):
            return first, first, first, first
        enough = np.add.reduceat(other.astype(np.int64), first) >= shared
        return window[first][enough], unit[first][enough], np.minimum.reduceat(hit, first)[enough], np.maximum.reduceat(hit, first)[enough]


def _search(items: Items, index: Index, words: np.ndarray, vocabulary: np.ndarray, vectors: np.ndarray, window: int, near: float, shared: int, verbatim: float, paraphrase: float, least_common: int):
    half = window // 2
    known_terms, item_words = Places(vocabulary), Places(words)

    def latent(term: np.ndarray, block: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Windows (blocks w and w + 1 of one text) as vectors of length 1, or 0 where no term is known."""
        known = np.flatnonzero(term < known_terms.n)
        sums = np.zeros((len(follows), vectors.shape[1]), np.float32)
        if len(known):
            own = block[known]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            order, added = _group_sums(vectors, term[known], np.diff(np.append(first, len(own))))
            sums[own[first][order]] = added
        on = np.flatnonzero(follows)
        out = sums.copy()
        out[on - 1] += sums[on]
        norm = np.sqrt(np.einsum("ij,ij->i", out, out))
        return out / np.where(norm > 0, norm, 1)[:, None]

    def candidates(h: np.ndarray, block: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, passage, cosine) of those that lie near each other in the latent space; the index adds those that share
        key terms, for words that the vocabulary doesn't have."""
        w = latent(known_terms.of(h), block, follows)
        win, unit, _, _ = index.met(h, block, follows, shared)
        found = [(win, unit, np.einsum("ij,ij->i", w[win], index.latent[unit]))]
        for at in range(0, len(w), step := max(1, SCORES_AT_ONCE // len(index.latent))):
            scores = w[at : at + step] @ index.latent.T
            q, u = np.nonzero(scores >= near)
            found.append((q + at, u, scores[q, u]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def regions(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, ...]:
        """(text, item, first word, word behind, cosine) of the stretches around candidate windows; those of one item that
        touch are one."""
        place = _places(doc, n_docs)
        begins = place % half == 0
        start = np.flatnonzero(begins)
        block = np.cumsum(begins) - 1
        follows = np.concatenate([[False], doc[start][1:] == doc[start][:-1]])
        win, unit, cosine = candidates(h, block, follows)
        item = index.owner[unit]
        order = np.lexsort((win, item))
        win, item, cosine = win[order], item[order], cosine[order]
        n = np.bincount(doc, minlength=n_docs)
        behind, text = np.cumsum(n), doc[start[win]]
        lo = np.maximum(behind[text] - n[text], start[win] - items.size[item])
        hi = np.minimum(behind[text], start[win] + window + items.size[item])
        apart = np.ones(len(win), bool)
        apart[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (lo[1:] > hi[:-1])
        first = np.flatnonzero(apart)
        last = np.append(first[1:], len(win))[: len(first)] - 1
        return text[first], item[first], lo[first], hi[last], np.maximum.reduceat(cosine, first) if len(first) else cosine

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in common.steps(batch, limit=1 << 18):
                ids = batch.column("doc_id").slice(rows.start, rows.stop - rows.start).to_pylist()
                h, doc = _hashes(data, offsets)
                best: dict[tuple, tuple] = {}
                if len(h):
                    text, item, lo, hi, cosine = regions(h, doc, len(ids))
                    for r, said in items.verdicts(item, lo, hi, item_words.of(h), verbatim, paraphrase, least_common):
                        d, i = int(text[r]), int(item[r])
                        if (d, i) not in best or best[d, i][1] < said[0]:
                            best[d, i] = (float(cosine[r]), *said)
                out = [(ids[d], items.ids[i], *x) for (d, i), x in best.items()]
                cols = list(zip(*out, strict=True)) if out else [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "cosine", "common_words", "item_words", "kind"])

    return scan


def _asked(rows: pa.Table, frequency: dict[int, int], vocabulary: np.ndarray, vectors: np.ndarray, window: int, keys: int, n_answer: int) -> tuple[Items, Index, np.ndarray]:
    """The items, the index of their passages and all their words, of a part of the benchmark."""
    batch = rows.combine_chunks().to_batches()[0]

    def texts(column: str) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for _, data, offsets in common.steps(batch, column):
            h, d = _hashes(data, offsets)
            out += np.split(h, np.searchsorted(d, np.arange(1, len(offsets) - 1)))
        return out

    hashes = texts("text")
    words = np.unique(np.concatenate(hashes))

    def rarest(h: np.ndarray, n: int) -> np.ndarray:
        return np.array(sorted(set(h.tolist()), key=lambda x: (frequency.get(x, 1), x))[:n], np.uint64)

    answers = []
    for h, said in zip(hashes, texts("answer"), strict=True):
        told = [int(np.searchsorted(words, x)) if x in words else -1 for x in said]
        answers.append((set(told), 2 / 3) if told else (set(np.searchsorted(words, rarest(h, n_answer)).tolist()), 1 / 3))
    parts = [(i, x) for i, h in enumerate(hashes) for x in np.array_split(h, -(-2 * len(h) // (3 * window)))]
    known = Places(vocabulary)
    latent = np.stack([vectors[known.of(x)].sum(axis=0) for _, x in parts])
    norm = np.sqrt((latent**2).sum(axis=1, keepdims=True))
    latent = np.where(norm > 0, latent / np.where(norm == 0, 1, norm), 0).astype(np.float32)
    items = Items([int(x) for x in rows.column("item_id").to_pylist()], [np.searchsorted(words, h) for h in hashes], answers)
    return items, Index([rarest(x, keys) for _, x in parts], np.array([i for i, _ in parts]), latent), words


def leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = 24, rank: int = 96, terms: int | None = None, near: float = 0.5, common_share: float = 0.01, keys: int = 10, shared: int = 2,
    verbatim: float = 0.8, paraphrase: float = 0.45, least_common: int = 8, n_answer: int = 6, items_at_once: int = 20_000,
) -> DataFrame:
    """doc_id, item_id, cosine, common_words, item_words, kind of each document and benchmark item that it leaks.

    docs needs doc_id and text; benchmark item_id and text, and may have answer."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
    asked = asked.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    blocks = -(-asked.count() // items_at_once)
    n_bytes = common.text_bytes(docs)
    if not blocks or not n_bytes:
        return spark.createDataFrame([], DDL)
    parts = []
    with common.Scratch(spark) as own:
        both = docs.select("text").unionByName(asked.select("text"))
        found = own.handed_over(common.census(both, _terms_of_passages(window), n_bytes // 6, TERM_BITS, 2), "term-frequency")
        passages = PASSAGE >> np.uint64(64 - TERM_BITS)
        n_passages = (found.filter(F.col("value") == int(passages)).agg(F.sum("n")).first()[0] or 1) if blocks else 1
        if terms is None:
            terms = 1 << min(17, 14 + max(0, (n_bytes >> 28).bit_length() // 2))
        telling = found.filter((F.col("n") <= max(2, common_share * n_passages)) & (F.col("value") != int(passages)))
        asked_terms = own.handed_over(asked.select("text").mapInArrow(_own_terms, "value long").distinct(), "item-terms")
        first = telling.join(asked_terms.withColumn("own", F.lit(0)), "value", "left").orderBy(F.coalesce("own", F.lit(1)), F.desc("n"), "value")
        frequent = first.limit(terms).select("value", "n").toArrow()
        value, n = (frequent.column(c).to_numpy() for c in ("value", "n"))
        order = np.argsort(value)
        vocabulary, idf = value[order].astype(np.uint64), np.log((n_passages + 1) / (n[order] + 1)) + 1e-3
        if len(vocabulary):
            v = basis(both, vocabulary, idf, window, rank, max(12, n_bytes >> 29))
            vectors = np.concatenate([idf[:, None] * v, np.zeros((1, v.shape[1]))]).astype(np.float32)
        else:
            vectors = np.zeros((1, 1), np.float32)
        for block in range(blocks):
            block_items = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
            rows = block_items.orderBy("item_id", "text").toArrow()
            if not rows.num_rows:
                continue
            known = block_items.select("text").mapInArrow(_own_terms, "value long").distinct().join(found, "value").toArrow()
            frequency = dict(zip(known.column("value").to_pylist(), known.column("n").to_pylist(), strict=True))
            items, index, words = _asked(rows, frequency, vocabulary, vectors, window, keys, n_answer)
            parts.append(docs.mapInArrow(_search(items, index, words, vocabulary, vectors, window, near, shared, verbatim, paraphrase, least_common), DDL))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _own_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in common.steps(batch):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_hashes(data, offsets)[0]).view(np.int64))], names=["value"])


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
