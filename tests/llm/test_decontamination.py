"""Recall of the latent search on planted paraphrases, and what must not be found."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import common, decontamination


def _planted(rng, words, share, sizes):
    """Items, and texts that say each with that share of its words replaced, in order, among words of their own."""
    items = [rng.choices(words, k=n) for n in sizes]
    said = []
    for item in items:
        new = list(item)
        for at in rng.sample(range(2, len(item)), round(share * len(item))):
            new[at] = rng.choice(words)
        said.append(" ".join(rng.choices(words, k=rng.randrange(15, 60)) + new + rng.choices(words, k=rng.randrange(15, 60))))
    return items, said


@pytest.mark.parametrize("with_answer", [True, False])
def test_recall_of_paraphrases(spark, with_answer):
    rng = random.Random(5)
    common_words = [f"of{i}" for i in range(40)]
    words = [f"w{i}" for i in range(4000)] + common_words * 60
    items, rows = [], [(i, " ".join(rng.choices(words, k=250))) for i in range(150)]
    for share in (0.3, 0.4, 0.5):
        more, said = _planted(rng, words, share, [rng.randrange(20, 60) for _ in range(30)])
        rows += [(1000 + len(items) + i, text) for i, text in enumerate(said)]
        items += more
    scattered = rng.choices(words[:4000], k=30)
    rows.append((5000, " ".join(x for w in scattered for x in (w, *rng.choices(words, k=3)))))
    bench = [(i, " ".join(x), " ".join(x[:2]) if with_answer else None) for i, x in enumerate([*items, scattered])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontamination.leaks(docs, spark.createDataFrame(bench, "item_id long, text string, answer string"), rank=32).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    hit = sum((1000 + i, i) in pairs for i in range(len(items)))
    assert hit >= 0.9 * len(items), hit
    assert pairs <= {(1000 + i, i) for i in range(len(items))}
    assert {r["kind"] for r in got} == {"paraphrase"}


def test_other_columns_nulls_and_repeated_rows(spark):
    rng = random.Random(6)
    item = " ".join(f"x{rng.randrange(900)}" for _ in range(30))
    rows = [(1, f"before {item} behind", 5, "k"), (1, f"before {item} behind", 5, "k"), (None, item, 1, None), (2, None, None, None), (3, "", 2, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long, kind string")
    bench = spark.createDataFrame([(7, item, "d", 1), (7, item, "d", 1), (8, None, None, None)], "item_id long, text string, kind string, doc_id long")
    got = sorted((r["doc_id"] or 0, r["item_id"], r["kind"]) for r in decontamination.leaks(docs, bench).collect())
    assert got == [(0, 7, "verbatim")] * 2 + [(1, 7, "verbatim")] * 4


def _synonyms(seed, n_items=60):
    """A corpus of topics whose words have two forms each, used alike; items of a topic, and texts that say them with every
    word of the topic in its other form, in order, among filler words that stay."""
    rng = random.Random(seed)
    topics, filler = [[f"t{t}c{c}" for c in range(30)] for t in range(40)], [f"of{i}" for i in range(200)]

    def said(topic, n):
        return [rng.choice(topics[topic]) + rng.choice("ab") if rng.random() < 0.42 else rng.choice(filler) for _ in range(n)]

    rows, items = [(i, " ".join(said(rng.randrange(40), 200))) for i in range(900)], []
    for k in range(n_items):
        item = said(rng.randrange(40), rng.randrange(24, 40))
        items.append(item)
        other = [w[:-1] + ("b" if w[-1] == "a" else "a") if w[0] == "t" else w for w in item]
        rows.append((5000 + k, " ".join(said(rng.randrange(40), rng.randrange(20, 60)) + other + said(rng.randrange(40), rng.randrange(20, 60)))))
    answers = [" ".join(w for w in item if w[0] == "o")[:9] for item in items]
    return rows, [(i, " ".join(x), a) for i, (x, a) in enumerate(zip(items, answers, strict=True))]


def test_the_latent_search_finds_synonyms_that_the_index_does_not(spark):
    rows, bench = _synonyms(3)
    docs, items = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(bench, "item_id long, text string, answer string")

    def found(**options):
        return {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, items, **options).collect()}

    accepted = found(near=-2.0)  # every window meets every item, and the checks alone decide
    own = {p for p in accepted if p[0] == 5000 + p[1]}
    assert len(own) > 20
    by_index, by_both = found(near=2.0), found()
    assert len(by_both & own) >= 0.9 * len(own) and by_both <= accepted
    assert len(by_index & own) < 0.7 * len(own)


def test_every_document_forms_the_basis(spark):
    """Which forms belong together is told only by documents that one half of all ids, by hash, doesn't have."""
    rows, bench = _synonyms(3)
    ids = [r["id"] for r in spark.range(4000).filter("pmod(xxhash64(id), 2) = 1").limit(len(rows)).collect()]
    named = dict(zip((doc_id for doc_id, _ in rows), ids, strict=True))
    docs = spark.createDataFrame([(named[doc_id], text) for doc_id, text in rows], "doc_id long, text string").repartition(4)
    others = spark.range(10_000, 44_000).selectExpr("id AS doc_id", "concat_ws(' ', 'q', id % 997, id % 991) AS text")
    items = spark.createDataFrame(bench, "item_id long, text string, answer string")

    def own(**options):
        got = decontamination.leaks(docs.unionByName(others), items, **options).collect()
        return {(r["doc_id"], r["item_id"]) for r in got if r["doc_id"] == named.get(5000 + r["item_id"])}

    accepted = own(near=-2.0)
    assert len(accepted) > 20
    assert len(own() & accepted) >= 0.9 * len(accepted)


def test_sums_of_passages_equal_plain_products(monkeypatch):
    monkeypatch.setattr(decontamination, "PASSAGES_AT_ONCE", 7)
    monkeypatch.setattr(decontamination, "IN_TURN", 3)
    monkeypatch.setattr(decontamination.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 0})()))
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 90, n) ** 2 // 90) for n in (0, 1, 24, 25, 700, 3)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    every = np.unique(decontamination._hashes(*next(common.steps(batch))[1:])[0])
    vocabulary = every[::2]
    for h in (vocabulary, vocabulary[:1], vocabulary[:0]):
        want = [int(np.flatnonzero(h == x)[0]) if x in h else len(h) for x in every]
        assert decontamination.Places(h).of(every).tolist() == want
    idf, q, place = rng.random(len(vocabulary)) + 0.1, rng.normal(size=(len(vocabulary), 5)), {int(x): i for i, x in enumerate(vocabulary)}
    a = []
    for text in texts:
        said = (text or "").split()
        for at in range(0, len(said), 24):
            row = np.zeros(len(vocabulary))
            for x in decontamination._hashes(*next(common.steps(pa.RecordBatch.from_arrays([pa.array([" ".join(said[at : at + 24])])], names=["text"])))[1:])[0]:
                if int(x) in place:
                    row[place[int(x)]] += idf[place[int(x)]]
            a.append(row / (np.linalg.norm(row) or 1))
    rows = list(decontamination._known_passages(vocabulary, idf, 24)(iter([batch])))
    (sums,) = decontamination._covariance((idf[:, None] * q).astype(np.float32))(iter(rows))
    got = np.concatenate([np.frombuffer(x.as_buffer(), np.float32) for x in sums.column("sums")]).reshape(q.shape) * idf[:, None]
    assert len(rows) > 3
    np.testing.assert_allclose(got, np.array(a).T @ (np.array(a) @ q), atol=1e-4)


def test_clashing_columns_and_texts_over_a_step(spark):
    rng = random.Random(8)
    item = [f"x{rng.randrange(900)}" for _ in range(40)]
    long = " ".join(rng.choice(["and", "so", "on", "it", "goes"]) for _ in range(90_000))
    rows = [(1, f"{long} {' '.join(item)} {long}", 1.0, 2, "v"), (2, long, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cosine double, common_words int, value string")
    got = decontamination.leaks(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["kind"], r["common_words"]) for r in got] == [(1, 7, "verbatim", 40)]


def test_subsequences_side_by_side_equal_those_one_by_one(monkeypatch):
    rng = np.random.default_rng(4)
    terms = [rng.integers(0, 60, n) for n in (1, 5, 30, 63, 40, 64, 90)]
    answers = [({int(t[0])}, 1.0) for t in terms]
    words = rng.integers(0, 61, 3000)  # 60 is in no item
    for i, at in enumerate(rng.integers(0, 2500, 30)):
        t = terms[i % 7]
        words[at : at + len(t)] = np.where(rng.random(len(t)) < 0.8, t, 60)
    item = rng.integers(0, 7, 200)
    lo = rng.integers(0, 2900, 200)
    hi = np.minimum(lo + rng.integers(1, 600, 200), 3000)
    want = {}
    for most in (10**6, 0):
        monkeypatch.setattr(decontamination, "DENSE_MASKS", most)
        items = decontamination.Items(list(range(7)), terms, answers)
        short = items.size[item] <= 63
        assert items.commons(item[short], lo[short], hi[short], words).tolist() == [items.common(i, words[a:b].tolist()) for i, a, b in zip(item[short], lo[short], hi[short], strict=True)]
        for r, (i, a, b) in enumerate(zip(item.tolist(), lo, hi, strict=True)):
            if (said := items.verdict(i, words[a:b].tolist(), 0.8, 0.45, 3)):
                want[r] = said
        assert dict(items.verdicts(item, lo, hi, words, 0.8, 0.45, 3)) == want
        assert {x[2] for x in want.values()} == {"verbatim", "paraphrase"}
