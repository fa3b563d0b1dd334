import random
import re
from pathlib import Path

import corpus_pipeline
from corpusloom.llm import common, decontamination, packing, quality

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert tuple(after.columns) == corpus_pipeline.COLUMNS
        after = after.cache()
        assert 0 < after.count() <= before.count()
        before = after
    want = {tuple(r) for r in packing.packed(before).select("doc_id", "piece", "length", "ids_crc32").collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect()} == want


def _written(spark, folder, docs, labels=(), benchmark=()):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, h string"
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def _said(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def test_nulls_repeated_ids_and_other_columns(spark, tmp_path):
    """An id that repeats with another text loses only the text that is rejected; rows with a null id are judged too."""
    rng = random.Random(8)
    plain = [_said(rng, 80) for _ in range(12)]
    item = _said(rng, 30)
    rows = [(i, t, "en", "s", 1, 5, "x") for i, t in enumerate(plain)]
    rows += [(0, f"{_said(rng, 20)} {item} {_said(rng, 20)}", "en", "s", 1, 5, "x"), (None, item, None, None, None, None, None), (None, plain[3], "en", "s", 1, 5, "x")]
    rows += [(3, plain[3], "en", "s", 1, 5, "x"), (50, None, None, None, None, None, None), (51, "", "en", "s", 0, 1, "x"), (None, plain[4] + " more", "en", "s", 1, 5, "x")]
    _written(spark, tmp_path, rows, benchmark=[(1, item), (2, None)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    near = corpus_pipeline.keep_one_of_each_group(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in near.collect() if r["text"]) == sorted([(False, i, t) for i, t in enumerate(plain)] + [(r[0] is None, r[0], r[1]) for r in rows[12:14]])
    clean = corpus_pipeline.remove_leaks(spark, docs, str(tmp_path))
    assert sorted(r["text"] or "" for r in clean.collect()) == sorted((r[1] or "") for i, r in enumerate(rows) if i not in (12, 13))
    scored = corpus_pipeline.reject_low_quality(spark, docs, str(tmp_path))
    assert scored.count() == len(rows) and tuple(scored.columns) == corpus_pipeline.COLUMNS
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == {*range(12), 50, 51}


def test_empty_tables(spark, tmp_path):
    _written(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def _hand_over_tables(spark):
    return {x.name for x in Path(common.shared_dir(spark).removeprefix("file://")).glob("corpusloom-*")}


def test_tables_of_a_stage_go_with_it(spark):
    before = _hand_over_tables(spark)
    out = corpus_pipeline.run(spark, SF)
    left = {re.fullmatch(r"corpusloom-(.*)-[0-9a-f]{32}", x)[1] for x in _hand_over_tables(spark) - before}
    assert {"benchmark-decontamination", "packing-0"} <= left  # what the result is made from
    assert not left & {"quality-classifier", "line-dedup", "n-gram-Jaccard-join", "statistics", "labelled", "common-shingles", "points", "classes", "shared", "members", "buckets", "in-buckets"}
    assert not left & {"pairs", "pairs-left", "needed", "sets", "links", "class-labels", "term-frequency", "item-terms", "known-passages"}
    assert out.count() == out.count() > 0


def test_quality_verdicts_move_no_text(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.reject_low_quality(spark, docs, SF)
        assert "Exchange" not in kept._jdf.queryExecution().toString()
        want = {r["doc_id"] for r in quality.scored(docs, labels).collect() if r["score"] >= 0.3}
        assert {r["doc_id"] for r in kept.collect()} == want and 0 < len(want) < docs.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_leaks_are_fitted_on_every_document(spark, tmp_path, monkeypatch):
    """The basis of the stage's search reads all documents and items: of 34,000 documents and more, a sample was fitted once."""
    seen = []

    def basis(texts, *args, fit=decontamination.basis):
        seen.append(texts.count())
        return fit(texts, *args)

    monkeypatch.setattr(decontamination, "basis", basis)
    item = " ".join(f"w{i}" for i in range(30))
    _written(spark, tmp_path, [], benchmark=[(1, item)])
    docs = spark.range(34_000).selectExpr("id AS doc_id", f"IF(id = 7, '{item}', concat_ws(' ', 'q', id % 997, id % 991)) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    kept = corpus_pipeline.remove_leaks(spark, docs, str(tmp_path))
    assert kept.count() == 33_999 and kept.filter("doc_id = 7").count() == 0
    assert seen == [34_001]
