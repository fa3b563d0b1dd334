"""Whole results of operators that SQL can't express, against plain versions of them, and texts over one vector step."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common, jaccard_join, line_dedup, packing, quality, rules, sharding, suffix_dedup, token_counts, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "doc_id long, text string, source string, fold int, score double, size long, piece int, shard int, label double, g long, pattern int"


def _said(rng, n):
    return " ".join(rng.choice(["so", "then", "we", "went", "A#B", "home!", "ÄÖ", "one.", "two,"]) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(21)
    texts = [None, "", " \n ", "x", *(_said(rng, n) for n in (5, 49, 50, 51, 90, 200, 900)), "so long " * 80_000, "line\n" * 30 + "own words here"]
    texts += [texts[8]] * 40 + [_said(rng, rng.randrange(1, 120)) for _ in range(120)]
    rows = [(i, t, f"s{i % 3}", 1, 0.5, 7, 3, 9, 0.1, 2, 4) for i, t in enumerate(texts)]
    rows += [rows[9], (None, "an id is missing", None, *[None] * 8), (9, "another text of the same id", "s", *[None] * 8)]
    return spark.createDataFrame(rows, CLASH).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


def test_rules_statistics_and_verdict(docs, empty):
    def stats(text):
        w = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        three = list(zip(w, w[1:], w[2:]))
        many = collections.Counter(three)
        again = len({i + k for i, t in enumerate(three) if many[t] > 1 for k in range(3)})
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), again

    want = collections.Counter()
    for r in docs.collect():
        s = stats(r["text"])
        want[(r["doc_id"], *s, s[0] < 50 or 100 * s[4] > 50 * s[0])] += 1
    got = rules.judged(docs).collect()
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collections.Counter(tuple(r[c] for c in columns) for r in got) == want
    assert all(r["kept"] == (not r["base_failed"] and r["p_good"] >= 0.5) for r in got)
    assert rules.judged(empty).count() == 0


def test_estimation_equals_a_walk_over_documents():
    """Expectation-maximisation document by document, with the beliefs as documents, gives the posteriors of the patterns."""
    rng = np.random.default_rng(3)
    good = rng.random(3000) < 0.8
    votes = np.stack([np.where(rng.random(3000) < (0.9 if k < 5 else 0.6), np.where(good ^ (rng.random(3000) < 0.1 + 0.05 * k), 1, rng.choice([2, 3], 3000)), 0) for k in range(7)], axis=1)
    failed = ~good & (rng.random(3000) < 0.3)
    counts = collections.defaultdict(lambda: [0, 0])
    for v, f in zip(map(tuple, votes.tolist()), failed, strict=True):
        counts[v][int(f)] += 1
    for belief in (10.0, 200.0):
        prior, shifts = rules.estimate(counts, belief, 30)
        p = np.where(failed, 0.0, np.choose(np.minimum((votes == rules.BAD).sum(axis=1), 2), [0.95, 0.5, 0.05]))
        for _ in range(30):
            share = (p.sum() + rules.BELIEVED_SHARE * belief) / ((~failed).sum() + belief)
            odds = np.full(3000, np.log(share / (1 - share)))
            for k in range(7):
                chance = [np.array([rules.BELIEVED[y][v] * belief + w[votes[:, k] == v].sum() for v in range(4)]) / (belief + w.sum()) for y, w in ((0, 1 - p), (1, p))]
                odds += np.log(chance[1] / chance[0])[votes[:, k]]
            p = np.where(failed, 0.0, 1 / (1 + np.exp(-odds)))
        told = np.array([rules.posterior(tuple(v), prior, shifts) for v in votes.tolist()])
        assert np.abs(told - p)[~failed].max() < 1e-6


def test_sharding_contract(docs, empty):
    rows = sharding.sharded(docs, n_shards=4).collect()
    want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sharding.sharded(empty).count() == 0


def test_sharding_keeps_groups_and_balances(spark):
    rng = random.Random(5)
    texts = [_said(rng, 40) for _ in range(3000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5000 + i, "a group of copies that one shard can hold " * 5) for i in range(120)] + [(9000 + i, "a hot group") for i in range(1700)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=4).collect()
    size = collections.Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert max(size.values()) <= 1.02 * min(size.values())
    assert len({r["shard"] for r in got if 5000 <= r["doc_id"] < 9000}) == 1
    assert {r["group_split"] for r in got if r["doc_id"] < 9000} == {False} and {r["group_split"] for r in got if r["doc_id"] >= 9000} == {True}


def test_quality_ranks_held_out_rows(spark):
    def auc(pairs):
        good, bad = ([s for y, s in pairs if y == k] for k in (1, 0))
        return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))

    rng = random.Random(6)
    rows = [(i, _said(rng, 60) if i % 3 else "$$$ ### BUY!!! " * rng.randrange(3, 20) + _said(rng, 20)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)], "doc_id long, quality int")
    got = quality.scored(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert auc([(int(r["doc_id"] % 3 > 0), r["score"]) for r in held]) > 0.98
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {(r["doc_id"], r["score"]) for r in quality.scored(docs, flipped).collect()} == {(r["doc_id"], r["score"]) for r in got}  # held-out labels change nothing


def test_packing_equals_plain_pieces(docs, empty):
    encode = tokens.encoder(tokens.public_files())
    want, total = collections.Counter(), 0
    for r in docs.collect():
        ids = np.append(encode(r["text"] or ""), 0).astype("<u4")
        total += len(ids)
        first = len(ids) % 512 or 512
        for piece, a in enumerate([0, *range(first, len(ids), 512)]):
            b = first if a == 0 else a + 512
            want[r["doc_id"], piece, a, b - a, zlib.crc32(ids[a:b])] += 1
    rows = packing.packed(docs, capacity=512, fan_in=2).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = np.cumsum([0, *(n for _, n in sorted(parts))])
        assert [a for a, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 512
    assert len(sequences) <= 1.03 * -(-total // 512) + 1
    assert packing.packed(empty).count() == 0


def test_texts_over_a_vector_step(spark, monkeypatch):
    """Results don't depend on how texts fall into steps; one text here is larger than a step of 512 KB."""
    rng = random.Random(9)
    long = _said(rng, 110_000)
    assert len(long) > common.STEP_BYTES
    rows = [(0, long, "a"), (1, "in front\n" + long[1000:400_000], "b"), (2, None, "c"), (3, _said(rng, 300), None), (4, long + " x", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    groups = {r["doc_id"]: r["component_id"] for r in jaccard_join.linked(docs).collect()}
    assert groups == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}
    for r in suffix_dedup.deduped(docs).collect():
        raw = (rows[r["doc_id"]][1] or "").encode()
        assert r["n_bytes"] == len(raw)
        assert r["n_removed"] == {0: len(raw), 1: len(raw) - 9, 2: 0, 3: 0, 4: len(raw) - 2}[r["doc_id"]]
    assert {r["doc_id"]: r["text"] for r in line_dedup.cleaned(docs).collect()} == {r[0]: r[1] for r in rows}


def test_token_counts_of_nothing_and_other_columns(spark, docs, empty, tmp_path):
    token_counts.write_flat(empty, f"file://{tmp_path}/none")
    assert token_counts.token_counts(spark, f"file://{tmp_path}/none").count() == 0
    token_counts.write_flat(docs.withColumn("ids", F.lit(1)), f"file://{tmp_path}/some")
    encode = tokens.encoder(tokens.public_files())
    got = sorted(r["n_tokens"] for r in token_counts.token_counts(spark, f"file://{tmp_path}/some", 1000).collect())
    assert got == sorted(len(encode(r["text"] or "")) for r in docs.collect())


def test_token_counts_name_their_documents(spark, docs, tmp_path):
    odd = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-5, "below zero"), (2**63 - 1, None), (2570, "id of line ends")], "doc_id long, text string"))
    for width in (2, 4):
        token_counts.write_flat(odd, f"file://{tmp_path}/n{width}", width=width, numbered=True, rows_per_file=50)
        encode = tokens.encoder(tokens.public_files())
        want = collections.Counter((r["doc_id"], len(encode(r["text"] or ""))) for r in odd.collect())
        for block in (11, 1 << 20):
            got = token_counts.token_counts(spark, f"file://{tmp_path}/n{width}", block, width, numbered=True).collect()
            assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in got) == want
            assert all(r["closed"] for r in got)
    with pytest.raises(Exception, match="doesn't fit"):
        token_counts.write_flat(odd, f"file://{tmp_path}/small", width=1)


def test_jaccard_join_of_null_ids(spark):
    a, b = "one two three four five six seven", "quite another text that has words of its own"
    rows = [(None, a), (5, a), (7, a), (None, b), (None, ""), (9, None)]
    got = collections.Counter(tuple(r) for r in jaccard_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect())
    assert got == collections.Counter([(None, 3, 5), (5, 3, 5), (7, 3, 5), (None, 5, None), (None, 0, None), (9, 0, 9)])


@pytest.mark.parametrize("doc_id", [7, None, "own"])
def test_sharding_splits_repeated_rows_evenly(spark, doc_id):
    """A text that no shard can hold, in rows of one id, of none, or of their own."""
    rng = random.Random(9)
    rows = [(i if doc_id == "own" else doc_id, "the same text again " * 5) for i in range(3000)] + [(10_000 + i, _said(rng, rng.randrange(5, 20))) for i in range(1000)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n_shards=16).collect()
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 4000 and sorted(sizes) == list(range(16))
    assert max(sizes.values()) <= 1.02 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
