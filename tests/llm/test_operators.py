import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, jaccard_join, line_dedup, packing, quality, rules, sharding, suffix_dedup, token_counts, tokens, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, lang string, n long, cid long, h long, size long, line string, shard int"


def _text(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    base = [_text(rng, n) for n in (3, 60, 120, 300, 2500)]
    texts = [None, "", " \n\t ", "one", "a a a a a a a a", "ÄÖ ü €uro", "x" * 5000, "z" * 700, *base, *base[:3]]
    for b in base[1:4]:
        words = b.split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts.append(base[4] + " " + base[3])
    shared = "shared boilerplate line of many sites."
    texts += [f"{_text(rng, 40)}\n{shared}\n{_text(rng, 30)}" for _ in range(12)]
    rows = [(i, t, f"s{i % 12}" if i % 7 else None, "en", 1, 2, 3, 4, "l", 5) for i, t in enumerate(texts)]
    rows += [rows[10], (None, "no id here", None, None, *[None] * 6)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_dedup_equals_brute_force(docs, empty):
    want = _brute_suffix([r["text"] for r in docs.collect()])
    for options in ({}, {"most_in_bucket": 1}):
        got = collections.Counter((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.deduped(docs, **options).collect())
        assert got == want
    assert suffix_dedup.deduped(empty).count() == 0


def _brute_suffix(texts):
    raws, seen = [(t or "").encode() for t in texts], collections.Counter()
    for r in raws:
        seen.update(r[i : i + 200] for i in range(len(r) - 199))
    out = collections.Counter()
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[len(r), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(r, gone) if not g)).hexdigest()] += 1
    return out


def test_jaccard_join_equals_brute_force(docs, empty):
    rows = [r for r in docs.collect() if r["doc_id"] is not None]
    sets = {}
    for r in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {d: new if x == old else x for d, x in label.items()}
    for most in (2000, 2):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.linked(docs.filter("doc_id IS NOT NULL"), most_in_bucket=most).collect()}
        assert got == {d: (len(sets[d]), label[d]) for d in sets}
    assert jaccard_join.linked(docs).count() == docs.count()
    assert jaccard_join.linked(empty).count() == 0


def test_packing_round_trip(docs, empty):
    files = tokens.public_files()
    rows = packing.packed(docs, capacity=256, fan_in=2).collect()
    by_seq, by_doc = collections.defaultdict(list), collections.Counter()
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]] += r["length"]
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    want = collections.Counter()
    for r in docs.collect():
        want[r["doc_id"]] += len(tokens.encoder(files)(r["text"] or "")) + 1
    assert by_doc == want
    assert packing.packed(empty).count() == 0


def test_ids_are_those_of_the_definition():
    from tokenizers import Tokenizer

    files = tokens.public_files()
    exact = Tokenizer.from_file(files[0])
    for text in ("", "Hello world!  \n\n x", "ÄÖ ü €uro 12345", "a<|endoftext|>b", "it's 'll\t\ttabs"):
        assert tokens.encoder(files)(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_token_counts_stitch_blocks(spark, docs, tmp_path):
    path = f"file://{tmp_path}/flat"
    token_counts.write_flat(docs, path)
    want = sorted(len(tokens.encoder(tokens.public_files())(r["text"] or "")) for r in docs.collect())
    for block in (7, 1 << 20):
        rows = token_counts.token_counts(spark, path, block).collect()
        assert sorted(r["n_tokens"] for r in rows) == want
        assert all(r["closed"] for r in rows)
    (tmp_path / "open").mkdir()
    (tmp_path / "open" / "a.bin").write_bytes(np.array([5, 0, 0, 6, 7], "<u4").tobytes())
    assert sorted((r["doc_no"], r["start"], r["n_tokens"], r["closed"]) for r in token_counts.token_counts(spark, f"file://{tmp_path}/open", 2, width=4).collect()) == [(0, 0, 1, True), (1, 2, 0, True), (2, 3, 2, False)]


def test_sharding(docs, empty):
    rows = sharding.sharded(docs, n_shards=4).collect()
    assert len(rows) == docs.count()
    for s in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.sharded(empty).count() == 0


def test_line_dedup(docs, empty):
    rows = line_dedup.cleaned(docs, most_everywhere=1000).collect()
    other = line_dedup.cleaned(docs, most_everywhere=-1).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in rows) == collections.Counter((r["doc_id"], r["text"]) for r in other)
    assert sum("shared boilerplate" in (r["text"] or "") for r in rows) == 0
    assert sum(r["n_removed_lines"] for r in rows) == 12
    assert line_dedup.cleaned(empty).count() == 0


def test_quality_rules_statistics(docs, empty):
    for r in rules.judged(docs.filter("doc_id IS NOT NULL")).collect():
        text = next(x["text"] for x in docs.collect() if x["doc_id"] == r["doc_id"]) or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        three = list(zip(w, w[1:], w[2:]))
        many = collections.Counter(three)
        again = {i + k for i, t in enumerate(three) if many[t] > 1 for k in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(again))
        assert not (r["kept"] and r["base_failed"])
    assert rules.judged(empty).count() == 0


def test_quality_scores(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8, 30)] + [(8, 1, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in quality.scored(docs, labels).collect())
    assert quality.scored(docs, labels.limit(0)).count() == docs.count()
    assert quality.scored(empty, labels).count() == 0
    assert quality.isotonic(None, np.array([1.0, 0, 1]), np.array([1.0, 1, 1])).tolist() == [0.5, 0.5, 1.0]


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://X.Example.ORG/en/12?q#f", "https://a.example.org/es/1", "https://example.com/de/", "https://foo.com/fr/x", "http://casino-win.example.net/en/1", "http://org?x/", "://", "http://" + "a" * 20000 + ".net/" + "b" * 20000]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = {r["page_id"]: r for r in url_filter.judged(pages, url_filter.trained(url_filter.labelled_urls(spark), rounds=8)).collect()}
    assert [(out[i]["host"], out[i]["path"], out[i]["rule"]) for i in (0, 2, 3, 4, 5, 6, 8)] == [
        ("", "", None), ("", "", None), ("x.example.org", "/en/12", "example.org/en/1"), ("a.example.org", "/es/1", "example.org/es/"), ("example.com", "/de/", "com/de/"), ("foo.com", "/fr/x", "com/fr/"), ("org", "", None),
    ]
    assert out[7]["verdict"] == "block"
    assert url_filter.judged(pages.limit(0), [0.0] * 2049).count() == 0


def test_decontamination(spark, docs, empty):
    rng = random.Random(3)
    items = [_text(rng, 30) for _ in range(4)]
    changed = items[1].split()
    changed[4:7] = ["other", "words", "here"]
    leaky = [(100, f"{_text(rng, 50)} {items[0]} {_text(rng, 50)}"), (101, f"{_text(rng, 80)} {' '.join(changed)}"), (102, items[2][: len(items[2]) // 4])]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(leaky, "doc_id long, text string"))
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    for at_once in (200, 2):
        assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(both, bench, items_at_once=at_once).collect()} == {(100, 0), (101, 1)}
    assert decontamination.leaks(empty, bench).count() == 0
    assert decontamination.leaks(both, bench.limit(0)).count() == 0
    assert bench.filter(F.col("text").isNull()).count() == 1
