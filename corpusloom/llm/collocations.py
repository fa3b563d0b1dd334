"""Phrase collocations with counting quotient filters.

1. Texts become blocks of word numbers with a dictionary of their own, one row per block and language.
2. Words met `least` times or more get dense ids; a phrase that is met that often has no other words. The dictionary of a
   block meets the ids by (lang, word), a row per block and distinct word, and comes back as one row per block.
3. The word ids of each 2 to `longest` consecutive words are packed into one number, which an invertible permutation
   spreads evenly. Its leading bits choose the part, the next ones are the quotient and all others the remainder: a
   task's filter of a part keeps remainders in runs by quotient with a counter each, so that counts are exact and the
   phrase can be computed back. Sorted filters of one part are merged across tasks.
4. Phrases with `least` occurrences meet the counts of their parts in joins; scores are exact decimals.

What a task holds is a block, or the entries of a part; every part gets a like share, and a phrase is one entry per task
however often it occurs there. Words are told apart by their bytes (within a block by 64-bit hashes).

Defined results: a null or empty text has no words; a null lang is `und`; rows that repeat count each; ties are broken by
the phrase; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm import common
from corpusloom.sources import sinks

BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = True
APART = BREAK.copy()
APART[[0x20, 0x09]] = True
#: Words of a block, distinct words of a block, entries that a task gathers before it writes filters, and entries
#: expected in a part.
BLOCK_WORDS, BLOCK_DISTINCT, GATHERED, PART_ENTRIES = 1 << 21, 1 << 19, 1 << 21, 1 << 22
ROUND_KEYS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


# --- blocks of word numbers ------------------------------------------------------------------------


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of each word; pieces are numbered upwards and never go on into the next text."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~APART[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start = np.flatnonzero((edge[:-1] == 1) | (inside & first[:-1]))
    end = np.flatnonzero((edge[1:] == -1) | (inside & first[1:])) + 1
    return start, end, np.cumsum(BREAK[data])[start] + np.searchsorted(offsets, start, "right")


class _Block:
    def __init__(self):
        self.number: dict[int, int] = {}
        self.words: list[bytes] = []
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, data: np.ndarray, offsets: np.ndarray) -> None:
        start, end, piece = _words(data, offsets)
        if not len(start):
            return
        value, at, inverse = np.unique(common.span_hash(common.prefix_hash(data), start, end), return_index=True, return_inverse=True)
        numbers = np.empty(len(value), np.uint32)
        for i, (h, a) in enumerate(zip(value.tolist(), at.tolist(), strict=True)):
            n = self.number.get(h)
            if n is None:
                n = self.number[h] = len(self.words) + 1
                self.words.append(data[start[a] : end[a]].tobytes())
            numbers[i] = n
        apart = np.concatenate([[1], piece[1:] != piece[:-1]]).astype(np.int64)
        out = np.zeros(len(start) + int(apart.sum()), np.uint32)
        out[np.arange(len(start)) + np.cumsum(apart)] = numbers[inverse]
        self.held.append(out)
        self.n += len(start)

    def row(self, block: int, lang: str) -> pa.RecordBatch:
        seq = np.concatenate(self.held)
        times = np.bincount(seq, minlength=len(self.words) + 1)[1:]
        wide = len(self.words) >= 1 << 16
        lists = [pa.ListArray.from_arrays([0, len(self.words)], x) for x in (pa.array(self.words, pa.binary()).cast(pa.string()), pa.array(times, pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([lang]), pa.array([self.n]), pa.array([wide]), pa.array([seq.astype("<u4" if wide else "<u2").tobytes()], pa.binary()), *lists], names=["block", "lang", "n_words", "wide", "seq", "words", "times"])


def _blocks(block_words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Block] = {}
        done = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal done
            for lang, b in held.items():
                if b.n:
                    yield b.row(TaskContext.get().partitionId() << 32 | done, lang)
                    done += 1
            held.clear()

        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                own = batch.filter(pc.equal(langs.indices, code))
                for _, data, offsets in common.steps(own):
                    held.setdefault(lang, _Block()).add(common.LOWER[data], offsets)
                    if sum(b.n for b in held.values()) >= block_words or sum(len(b.words) for b in held.values()) >= BLOCK_DISTINCT:
                        yield from flushed()
        yield from flushed()

    return scan


# --- packed phrases, permuted ------------------------------------------------------------------------


class Packing:
    """n word ids of `bits` bits each as one number of 2 * half bits, permuted; a key is one row of limbs, 1 or 2 of them."""

    def __init__(self, n: int, bits: int, part_bits: int):
        self.n, self.bits, self.half = n, bits, -(-n * bits // 2)
        if self.half > 63:
            raise ValueError(f"phrases of {n} words out of 2**{bits} don't fit into 126 bits")
        self.limbs = 1 if self.half <= 32 else 2
        self.part_bits = min(part_bits, self.half)

    def _round(self, x: np.ndarray, key: int) -> np.ndarray:
        return common.mixed(x ^ np.uint64(key)) & self._mask(self.half)

    @staticmethod
    def _mask(n: int) -> np.uint64:
        return np.uint64((1 << n) - 1)

    def keys(self, ids: list[np.ndarray]) -> np.ndarray:
        left, right, room = np.zeros(len(ids[0]), np.uint64), np.zeros(len(ids[0]), np.uint64), self.half - self.bits
        up, down, low = np.uint64(self.bits), np.uint64(room), self._mask(room)
        for x in ids:
            left = ((left & low) << up) | (right >> down)
            right = ((right & low) << up) | x.astype(np.uint64)
        for key in ROUND_KEYS:
            left, right = right, left ^ self._round(right, key)
        return np.stack([left, right]) if self.limbs == 2 else ((left << np.uint64(self.half)) | right)[None]

    def ids(self, keys: np.ndarray) -> list[np.ndarray]:
        left, right = keys if self.limbs == 2 else (keys[0] >> np.uint64(self.half), keys[0] & self._mask(self.half))
        for key in reversed(ROUND_KEYS):
            left, right = right ^ self._round(left, key), left
        up, down, low, out = np.uint64(self.bits), np.uint64(self.half - self.bits), self._mask(self.bits), []
        for _ in range(self.n):
            out.append((right & low).astype(np.int64))
            right = (right >> up) | ((left & low) << down)
            left = left >> up
        return out[::-1]

    def part(self, keys: np.ndarray) -> np.ndarray:
        top = self.half if self.limbs == 2 else 2 * self.half
        return (keys[0] >> np.uint64(top - self.part_bits)).astype(np.int64)


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising distinct keys with the sums of their counts; sorted stretches are merged, not sorted anew."""
    if keys.shape[1] < 2:
        return keys, counts
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys, counts = keys[:, order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
    return keys[:, first], np.add.reduceat(counts, first)


class QuotientFilter:
    """A counting quotient filter of the distinct, rising keys of one part.

    runs: for each quotient as many ones as it has remainders, then a zero. remainders: the rest of the bits of each key,
    by byte. more: which counters are over one; tails: those less two, 255 and up in `large`."""

    @staticmethod
    def packed(keys: np.ndarray, counts: np.ndarray, packing: Packing) -> bytes:
        n = keys.shape[1]
        top = (packing.half if packing.limbs == 2 else 2 * packing.half) - packing.part_bits  # bits of the first limb behind the part's
        quotient_bits = min(top, max(0, n.bit_length() - 1))
        lead = keys[0] & Packing._mask(top)
        quotient = (lead >> np.uint64(top - quotient_bits)).astype(np.int64)
        runs = np.zeros(n + (1 << quotient_bits), bool)
        runs[np.arange(n) + quotient] = True
        rest = [lead & Packing._mask(top - quotient_bits), *keys[1:]]
        planes = [(x >> np.uint64(8 * b)).astype(np.uint8) for x, bits in zip(rest, [top - quotient_bits, packing.half], strict=False) for b in range(-(-bits // 8))]
        more = counts > 1
        tails = counts[more] - 2
        large = tails[tails >= 255]
        head = np.array([n, quotient_bits, len(tails), len(large)], "<i8")
        return b"".join([head.tobytes(), np.packbits(runs).tobytes(), *(p.tobytes() for p in planes), np.packbits(more).tobytes(), np.minimum(tails, 255).astype(np.uint8).tobytes(), large.astype("<i8").tobytes()])

    @staticmethod
    def unpacked(raw: bytes, part: int, packing: Packing) -> tuple[np.ndarray, np.ndarray]:
        n, quotient_bits, n_tails, n_large = np.frombuffer(raw, "<i8", 4).tolist()
        at = 32

        def taken(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(raw, np.uint8, size, at - size)

        top = (packing.half if packing.limbs == 2 else 2 * packing.half) - packing.part_bits
        n_bits = n + (1 << quotient_bits)
        quotient = np.flatnonzero(np.unpackbits(taken(-(-n_bits // 8)), count=n_bits)) - np.arange(n)
        rest = []
        for bits in [top - quotient_bits, packing.half][: packing.limbs]:
            x = np.zeros(n, np.uint64)
            for b in range(-(-bits // 8)):
                x |= taken(n).astype(np.uint64) << np.uint64(8 * b)
            rest.append(x)
        rest[0] |= quotient.astype(np.uint64) << np.uint64(top - quotient_bits)
        if packing.part_bits:
            rest[0] |= np.uint64(part) << np.uint64(top)
        counts = np.ones(n, np.int64)
        more = np.unpackbits(taken(-(-n // 8)), count=n).astype(bool)
        tails = taken(n_tails).astype(np.int64)
        tails[tails == 255] = np.frombuffer(taken(8 * n_large).tobytes(), "<i8")
        counts[more] = tails + 2
        return np.stack(rest), counts


def _filters(bits: int, lengths: list[int], part_bits: int):
    """Blocks with the ids of their words -> a filter for each task, length of phrase and part."""
    packings = {n: Packing(n, bits, part_bits) for n in lengths}

    def emit(n: int, held: list) -> Iterator[pa.RecordBatch]:
        packing = packings[n]
        keys, counts = counted(*(np.concatenate(x, axis=-1) for x in zip(*held, strict=True)))
        part = packing.part(keys)
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        size = 0
        rows: list[tuple] = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            rows.append((n, int(part[a]), QuotientFilter.packed(keys[:, a:b], counts[a:b], packing)))
            size += len(rows[-1][2])
            if size > 8 << 20 or b == len(part):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["n", "part", "body"])
                rows, size = [], 0

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {n: [] for n in lengths}
        size = dict.fromkeys(lengths, 0)
        for batch in batches:
            for seq, wide, known, distinct in zip(batch.column("seq"), batch.column("wide").to_pylist(), batch.column("known"), batch.column("n_distinct").to_pylist(), strict=True):
                ids = np.zeros(distinct + 1, np.int64)
                pairs = known.values
                ids[pairs.field("at").to_numpy() + 1] = pairs.field("id").to_numpy()
                told = ids[np.frombuffer(seq.as_buffer(), "<u4" if wide else "<u2")]
                full = told > 0
                for n in lengths:
                    all_known = functools.reduce(np.logical_and, [full[k : len(full) - n + 1 + k] for k in range(n)]) if len(full) >= n else full[:0]
                    at = np.flatnonzero(all_known)
                    if len(at):
                        keys = packings[n].keys([told[at + k] for k in range(n)])
                        held[n].append(counted(keys, np.ones(len(at), np.int64)))
                        size[n] += held[n][-1][0].shape[1]
                    if size[n] >= GATHERED:
                        yield from emit(n, held[n])
                        held[n], size[n] = [], 0
        for n in lengths:
            if held[n]:
                yield from emit(n, held[n])

    return scan


def _merged(bits: int, lengths: list[int], part_bits: int, least: int):
    """Filters in order of (n, part) -> the phrases with `least` occurrences or more."""
    packings = {n: Packing(n, bits, part_bits) for n in lengths}

    def phrases(n: int, held: list) -> pa.RecordBatch:
        keys, counts = counted(*(np.concatenate(x, axis=-1) for x in zip(*held, strict=True)))
        keys, counts = keys[:, counts >= least], counts[counts >= least]
        ids = np.stack(packings[n].ids(keys), axis=1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * n, pa.int32()), pa.array(ids.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), n), pa.int32()), lists, pa.array(counts)], names=["n", "ids", "f"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, size = [], None, 0
        for batch in batches:
            for n, part, body in zip(batch.column("n").to_pylist(), batch.column("part").to_pylist(), batch.column("body"), strict=True):
                if (n, part) != own and held:
                    yield phrases(own[0], held)
                    held, size = [], 0
                own = (n, part)
                held.append(QuotientFilter.unpacked(body.as_buffer().to_pybytes(), part, packings[n]))
                size += held[-1][0].shape[1]
                if size > PART_ENTRIES:
                    held = [counted(*(np.concatenate(x, axis=-1) for x in zip(*held, strict=True)))]
                    size = held[0][0].shape[1] // 2
        if held:
            yield phrases(own[0], held)

    return merge


# --- counts and scores -----------------------------------------------------------------------------


def counts(docs: DataFrame, longest: int = 3, least: int = 10, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals: lang, n), (words: id, lang, word, f) and (phrases: n, ids, f): all words and all phrases of 2 to `longest`
    words with `least` occurrences or more, exactly counted."""
    slim = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    blocks = common.handed_over(slim.mapInArrow(_blocks(block_words), "block long, lang string, n_words long, wide boolean, seq binary, words array<string>, times array<long>"), "phrase-blocks")
    totals = common.handed_over(blocks.groupBy("lang").agg(F.sum("n_words").alias("n")), "phrase-totals")
    said = blocks.select("lang", F.explode(F.arrays_zip("words", "times")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.times").alias("f"))
    words = common.handed_over(said.filter(F.col("f") >= least), "phrase-words")
    words = common.handed_over(sinks.numbered(words, ["lang", "word"]), "phrase-ids")
    bits = max(1, (words.agg(F.max("id")).first()[0] or 0).bit_length())
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    part_bits = max(6, (n_words // PART_ENTRIES).bit_length())
    lengths = list(range(2, longest + 1))
    own = blocks.select("block", "lang", F.posexplode("words").alias("at", "word")).join(words, ["lang", "word"]).select("block", "at", "id")
    known = own.groupBy("block").agg(F.collect_list(F.struct(F.col("at").cast("long").alias("at"), "id")).alias("known"))
    told = blocks.select("block", "wide", "seq", F.size("words").alias("n_distinct")).join(known, "block").select("seq", "wide", "known", "n_distinct")
    filters = told.mapInArrow(_filters(bits, lengths, part_bits), "n int, part long, body binary")
    dealt = filters.repartition("n", "part").sortWithinPartitions("n", "part")
    return totals, words, common.handed_over(dealt.mapInArrow(_merged(bits, lengths, part_bits, least), "n int, ids array<long>, f long"), "phrases")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, absorbed: int = 50, most: int = 2000, salts: int = 64, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's `most` best phrases.

    A phrase is left out if it lies inside a longer one that has at least `absorbed` per cent of its occurrences."""
    totals, words, phrases = counts(docs, longest, least, **options)
    grams = {n: phrases.filter(F.col("n") == n).select(*[F.col("ids")[k].alias(f"i{k}") for k in range(n)], F.col("f").alias("a")) for n in range(2, longest + 1)}
    scored = []
    for n, gram in grams.items():
        row = gram
        for k in range(n):
            row = row.join(words.select(F.col("id").alias(f"i{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}_1"), *([F.col("lang")] if k == 0 else [])), f"i{k}")
        for size in range(2, n):
            for k in (0, n - size):
                row = row.join(grams[size].select(*[F.col(f"i{j}").alias(f"i{k + j}") for j in range(size)], F.col("a").alias(f"f{k}_{size}")), [f"i{k + j}" for j in range(size)])
        cuts = []
        for k in range(1, n):
            left, right = f"f0_{k}", f"f{k}_{n - k}"
            exact = F.expr(f"(cast(1000000 AS decimal(38,0)) * cast(a AS decimal(38,0)) * cast(a AS decimal(38,0))) div (cast({left} AS decimal(38,0)) * cast({right} AS decimal(38,0)))")
            cuts.append(F.struct(exact.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")))
        row = row.withColumn("cut", F.array_min(F.array(*cuts)))
        for longer in range(n + 1, longest + 1):
            inside = F.explode(F.array(*[F.struct(*[F.col(f"i{j + k}").alias(f"i{k}") for k in range(n)]) for j in range(longer - n + 1)]))
            above = grams[longer].select("a", inside.alias("x")).groupBy("x").agg(F.max("a").alias("above")).select("x.*", "above")
            row = row.join(above, [f"i{k}" for k in range(n)], "left").filter(F.coalesce(100 * F.col("above") < absorbed * F.col("a"), F.lit(True))).drop("above")
        scored.append(row.select("lang", F.concat_ws(" ", *[f"w{k}" for k in range(n)]).alias("phrase"), "a", "cut.l", "cut.r", "cut.score"))
    rows = functools.reduce(DataFrame.unionByName, scored)
    best = (F.desc("score"), F.desc("a"), F.col("phrase"))
    some = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("rank") <= most).drop("salt", "rank")
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= most)
    return some.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), one AS (
  SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY ALL
), total AS (
  SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY 1
), two AS (
  SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM w) GROUP BY ALL HAVING count(*) >= 10
), three AS (
  SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM w) GROUP BY ALL HAVING count(*) >= 10
), longer AS (
  SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY ALL
), scored AS (
  SELECT two.lang, two.x || ' ' || two.y AS phrase, two.f AS a, a.f AS l, b.f AS r, (1000000::HUGEINT * two.f * two.f) // (a.f::HUGEINT * b.f) AS score
  FROM two JOIN one a ON a.lang = two.lang AND a.x = two.x JOIN one b ON b.lang = two.lang AND b.x = two.y
  LEFT JOIN longer g ON g.lang = two.lang AND g.x = two.x AND g.y = two.y WHERE g.f IS NULL OR 100 * g.f < 50 * two.f
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM (
    SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z AS phrase, t.f AS a, a.f AS l1, yz.f AS r1, xy.f AS l2, c.f AS r2,
           (1000000::HUGEINT * t.f * t.f) // (a.f::HUGEINT * yz.f) AS s1, (1000000::HUGEINT * t.f * t.f) // (xy.f::HUGEINT * c.f) AS s2
    FROM three t JOIN one a ON a.lang = t.lang AND a.x = t.x JOIN one c ON c.lang = t.lang AND c.x = t.z
    JOIN two xy ON xy.lang = t.lang AND xy.x = t.x AND xy.y = t.y JOIN two yz ON yz.lang = t.lang AND yz.x = t.y AND yz.y = t.z)
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored) JOIN total USING (lang) WHERE rank <= 2000
"""
