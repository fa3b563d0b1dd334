"""Writers, the clique cover in rounds, long chains, chunks and null-safe look-ups."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import cells, chunks, graph, knn
from corpusloom.sources import sinks


def test_clique_cover_in_rounds_equals_the_walk(spark):
    rng = random.Random(2)
    edges = {}
    while len(edges) < 300:
        a, b = sorted(rng.sample(range(60), 2))
        edges[a, b] = rng.choice([0.5, 0.6, 0.7, rng.random()])
    rows = [(a, b, s) for (a, b), s in edges.items()]
    df = spark.createDataFrame(rows, "a long, b long, score double")
    want = sorted(tuple(g) for g in knn.greedy_groups(rows))
    for most in (0, 120, 10_000):
        got = {}
        for r in knn.clique_cover(df, most_in_task=most).collect():
            got.setdefault(r["group_id"], []).append(r["member"])
            inner = [s for (a, b), s in edges.items() if r["group_id"] in (a, b)]
            assert min(min(inner), 0) <= r["avg_confidence"] <= 1
        assert sorted(tuple(sorted(g)) for g in got.values()) == want
    assert knn.clique_cover(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    both = chain.union(spark.createDataFrame([(1000, 1001), (1003, 1003)], "a long, b long"))
    got = {r["node"]: r["label"] for r in graph.components(both).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 1003: 1003}


def test_neighbours_by_blocks_equal_one_block(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELLS_AT_ONCE", 100)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)] + [(500, [0.0] * 6), (501, None)] + [(600 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    for asks in (None, F.col("id") % 7 == 0):
        one, many = ({(r["q_id"], r["m_id"], round(r["score"], 9)) for r in knn.knn_join(df, 5, 0.8, n, asks).collect()} for n in (4000, 17))
        assert one == many and one
    with pytest.raises(ValueError, match="dimensions"):
        knn.knn_join(df.union(spark.createDataFrame([(9, [1.0])], df.schema)))


def test_chunks_of_one_key_across_batches(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.randrange(1, 60)) for k in (1, 2) for i in range(700)] + [(3, 0, 500), (3, 1, 1)]
    items = spark.createDataFrame(rows, "key long, at long, size long")
    want = []
    for key in (1, 2, 3):
        n = filled = chunk = 0
        for _, _, size in (r for r in rows if r[0] == key):
            if n and (filled + size > 100 or n == 4):
                want.append((key, chunk, n, filled))
                chunk, n, filled = chunk + 1, 0, 0
            n, filled = n + 1, filled + size
        want.append((key, chunk, n, filled))
    assert sorted(tuple(r) for r in chunks.chunked(items, 100, 4).collect()) == want
    assert chunks.chunked(items.limit(0), 100).count() == 0


def test_upsert_keeps_clears_and_overwrites(spark):
    schema = "k long, id long, title string, hash string, etag string"
    stored = spark.createDataFrame([(1, 10, "old", "h1", "e1"), (2, 20, "stays", "h2", "e2")], schema)
    fetched = spark.createDataFrame([(1, 99, None), (3, 30, "new")], "k long, id long, title string")
    got = sorted(tuple(r) for r in sinks.upserted(stored, fetched, ["k"], ["id", "etag"], ["hash"]).collect())
    assert got == [(1, 10, None, None, "e1"), (2, 20, "stays", "h2", "e2"), (3, 30, "new", None, None)]


def test_partitions_replaced_twice_and_dense_ids(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.partitions_replaced(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "v long, scan string"), path, "scan")
    for _ in range(2):
        sinks.partitions_replaced(spark.createDataFrame([(7, "a")], "v long, scan string"), path, "scan")
    assert sorted((r["v"], r["scan"]) for r in spark.read.parquet(path).collect()) == [(3, "b"), (7, "a")]
    df = spark.createDataFrame([(random.Random(i).randrange(10**6), i) for i in range(500)], "x long, i long").repartition(5)
    got = sorted((r["id"], r["x"]) for r in sinks.numbered(df, ["x", "i"], 11).collect())
    assert [i for i, _ in got] == list(range(11, 511)) and [x for _, x in got] == sorted(x for _, x in got)
    assert sinks.numbered(df.limit(0), ["x"]).count() == 0


def test_bpe_counts_equal_the_definition(spark):
    from tokenizers import Tokenizer

    import public_tokenizers
    from corpusloom.functions import bpe

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "Hello world!  \n\n x", "ÄÖ ü €uro 12345", "it's 'll\t\ttabs " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = {r["id"]: r for r in bpe.counted(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), 20).collect()}
    for i, t in enumerate(texts):
        ids = exact.encode(t or "", add_special_tokens=False).ids
        assert rows[i]["n_tokens"] == len(ids)
        assert (t or "").startswith(rows[i]["kept"])
        assert rows[i]["kept"] == (t or "") if len(ids) <= 20 else 0 < len(rows[i]["kept"]) < len(t)


def test_embedding_inputs_are_cut_at_tokens(spark):
    from tokenizers import Tokenizer

    import public_tokenizers
    from corpusloom.functions import bpe

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "short", "ÄÖ€ " * 30, "many words go here, " * 40, "x" * 25]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id long, text string, input string")
    got = {r["id"]: r["input"] for r in bpe.embeddable(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), 25).collect()}
    assert got[0] == got[1] == " " and got[2] == "short" and got[5] == "x" * 25
    for i in (3, 4):
        kept = exact.encode(got[i], add_special_tokens=False).ids
        assert texts[i].startswith(got[i]) and 20 <= len(kept) <= 25


def test_relationship_and_seed_of_groups(spark):
    edges = spark.createDataFrame([(1, 2, 0.6, "near"), (2, 3, 0.9, "same"), (1, 3, 0.8, "far"), (4, 5, 0.5, "odd")], "a long, b long, score double, relationship string")
    for most in (0, 1000):
        got = knn.related(knn.clique_cover(edges.drop("relationship"), most), edges)
        assert sorted((r["group_id"], r["member"], r["relationship"]) for r in got.collect()) == [(1, 1, "same"), (1, 2, "same"), (1, 3, "same"), (4, 4, "odd"), (4, 5, "odd")]


def test_closed_records_and_empty_fetches(spark):
    stored = spark.createDataFrame([("a", 1, "open"), ("a", 2, "open"), ("a", 3, "merged"), ("b", 1, "open"), ("c", 1, "open")], "repo string, number long, state string")
    fetched, asked = spark.createDataFrame([("a", 2), ("x", 9)], "repo string, number long"), spark.createDataFrame([("a",), ("b",)], "repo string")
    got = sorted((r["repo"], r["number"], r["state"], r["closes"]) for r in sinks.closed(stored, fetched, "repo", "number", asked).collect())
    assert got == [("a", 1, "closed", True), ("a", 2, "open", False), ("a", 3, "merged", False), ("b", 1, "closed", True), ("c", 1, "open", False)]
    assert sinks.closed(stored, fetched.limit(0), "repo", "number").filter("closes").count() == 4
