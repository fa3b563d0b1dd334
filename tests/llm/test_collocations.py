"""Collocations against plain counts, the packing and the filters by themselves."""

import collections
import random
import re

import numpy as np
import pytest

from corpusloom.llm import collocations as C

SCHEMA = "doc_id long, lang string, text string, word string, n int, block long"


def _plain(rows, longest, least, absorbed, most):
    total, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = tuple(re.findall("[^\x20\x09]+", piece))
            total[lang] += len(w)
            for n in range(1, longest + 1):
                f.update((lang, w[i : i + n]) for i in range(len(w) - n + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    above = collections.Counter()
    for (lang, w), a in candidates.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                above[lang, w[i : i + n]] = max(above[lang, w[i : i + n]], a)
    out = collections.defaultdict(list)
    for (lang, w), a in candidates.items():
        if (lang, w) in above and 100 * above[lang, w] >= absorbed * a:
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:most]))


def _rows(seed):
    rng = random.Random(seed)
    vocabulary = ["New", "york", "City", "the", "of", "ÄÖ", "naïve", "日本", "a#b", "x", "I'm", "ß"] + [f"w{i}" for i in range(40)]
    joins = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r\n", " ! ", "\x0b", " "]
    rows = [(rng.choice(["en", "de", None, ""]), "".join(rng.choice(vocabulary[: rng.choice([6, 52])]) + rng.choice(joins) for _ in range(rng.randrange(0, 200)))) for _ in range(120)]
    return rows + [(None, None), ("en", ""), ("en", "\n . \t"), ("en", "so it goes " * 3000), *[("und", "same words again")] * 25]


@pytest.mark.parametrize(("seed", "longest", "block", "most"), [(1, 3, 200, 30), (2, 3, 1 << 21, 2000), (3, 4, 500, 2000), (4, 2, 100, 2000)])
def test_equal_to_plain_counts(spark, seed, longest, block, most):
    rows = _rows(seed)
    df = spark.createDataFrame([(i, *r, "clash", 1, 2) for i, r in enumerate(rows)], SCHEMA).repartition(4)
    got = C.collocations(df, longest=longest, most=most, block_words=block).collect()
    assert sorted(tuple(r) for r in got) == _plain(rows, longest, 10, 50, most)


@pytest.mark.parametrize(("n", "bits", "part_bits"), [(2, 1, 1), (2, 17, 6), (3, 20, 6), (3, 21, 8), (3, 42, 20), (4, 31, 6), (2, 63, 10)])
def test_packing_and_filter_lose_nothing(n, bits, part_bits):
    rng = np.random.default_rng(n * bits)
    packing = C.Packing(n, bits, part_bits)
    ids = [rng.integers(0, 1 << bits, 5000) for _ in range(n)]
    keys = packing.keys(ids)
    assert all((a == b).all() for a, b in zip(ids, packing.ids(keys), strict=True))
    sorted_keys, counts = C.counted(keys, rng.choice([1, 2, 256, 257, 300, 10**12], 5000))
    part, whole = packing.part(sorted_keys), []
    assert (np.diff(part) >= 0).all()
    for p in np.unique(part):
        own = part == p
        raw = C.QuotientFilter.packed(sorted_keys[:, own], counts[own], packing)
        back, times = C.QuotientFilter.unpacked(raw, int(p), packing)
        assert (back == sorted_keys[:, own]).all() and (times == counts[own]).all()
        whole.append((back, times))
    again = C.counted(np.concatenate([k for k, _ in whole[::-1]], axis=1), np.concatenate([c for _, c in whole[::-1]]))
    assert (again[0] == sorted_keys).all() and (again[1] == counts).all()


def test_too_many_words_for_the_packing():
    with pytest.raises(ValueError, match="126 bits"):
        C.Packing(3, 43, 6)


def test_no_rows(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, "en", "a b", None, None, None)], SCHEMA)).count() == 0


def test_query_equals_sql(spark, tmp_path):
    import duckdb

    C.op12_phrase_collocations(spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "out"))
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    cols = "a, l, lang, n, phrase, r, rank, score"
    want, got = f"(select {cols} from ({C.ORACLE_SQL}))", f"(select {cols} from '{tmp_path}/out/*.parquet')"
    assert con.execute(f"select count(*) from {want}").fetchone()[0] > 100
    for x, y in ((want, got), (got, want)):
        assert con.execute(f"select count(*) from ({x} except all {y})").fetchall() == [(0,)]
