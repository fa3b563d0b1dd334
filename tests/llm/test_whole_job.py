"""Cases that the reviews of a round found to be cut short."""

import collections
import math
import random

import numpy as np

from corpusloom.llm import common, decontamination, line_dedup, rules, suffix_dedup, url_filter


def _judge(counts, belief=rules.BELIEF):
    prior, shifts = rules.estimate({p: (n, 0) for p, n in counts.items()}, belief)
    return lambda *votes: rules.posterior(votes, prior, shifts)


def test_inaccurate_rule_is_outvoted():
    g, x = rules.GOOD, rules.BAD
    counts = {(noisy, *rest): n * share for noisy, n in ((g, 7), (x, 3)) for rest, share in (((g,) * 6, 880), ((g, g, x, x, x, g), 120))}
    for belief in (rules.BELIEF / 2, rules.BELIEF, rules.BELIEF * 2):
        p = _judge(counts, belief)
        assert p(x, *[g] * 6) > 0.5  # it alone votes bad, on three tenths of all documents
        assert p(x, g, g, x, x, x, g) < 0.5 and p(g, g, g, x, x, x, g) < 0.5


def test_rare_bad_votes_and_common_doubts():
    g, d, x = rules.GOOD, rules.DOUBTFUL, rules.BAD
    counts = {(g,) * 7: 9000} | {tuple(x if k in (j, (j + 1) % 7) else g for k in range(7)): 80 for j in range(7)} | {(d, *[g] * 6): 900, (d, d, *[g] * 5): 90}
    for belief in (rules.BELIEF / 2, rules.BELIEF, rules.BELIEF * 2):
        p = _judge(counts, belief)
        assert p(*[g] * 7) > 0.5 > p(g, x, x, *[g] * 4)  # rare bad votes that bear each other out
        assert p(d, *[g] * 6) > 0.5  # a tenth of all documents is doubtful here, and nothing else ails them


def test_boilerplate_leaves_short_pages_too(spark):
    line = "licensed under the general public licence"
    rows = [(i, f"own words of page {i} alone are many more than the others\n{line}", f"s{i}") for i in range(12)]
    rows += [(100, f"short page\n{line}", "a"), (101, line, "b"), (102, f"twice here\n{line}", "c"), (103, f"twice here\n{line}", "d")]
    copy = "one text that many sites\nhave as it is here"
    rows += [(200 + i, copy, f"t{i}") for i in range(11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for most in (1000, -1):
        for spare in (True, False):
            got = {r["doc_id"]: r["text"] for r in line_dedup.cleaned(docs, most_everywhere=most, spare_copies=spare).collect()}
            assert [got[i] for i in (100, 101, 102, 103)] == ["short page", "", "twice here", "twice here"]
            assert not any(line in x for x in got.values())
            assert all(got[200 + i] == (copy if spare else "") for i in range(11))


def test_line_dedup_keeps_columns_of_any_name(spark):
    rows = [(i, f"own words {i}\nthe same line everywhere", f"s{i}", i * 10, "w", ["l"], 7) for i in range(12)] + [(99, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, t1 long, whole string, lines array<string>, n_lines long")
    for most in (1000, -1):
        got = {r["doc_id"]: r for r in line_dedup.cleaned(docs, most_everywhere=most, spare_copies=True).collect()}
        assert [(r["t1"], r["whole"], r["lines"]) for i, r in sorted(got.items())] == [(x[3], x[4], x[5]) for x in rows]
        assert got[3]["text"] == "own words 3" and got[3]["n_lines"] == 2 and got[99]["text"] is None or got[99]["text"] == ""


def test_long_items_are_found(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    sizes = (62, 90, 150, 400, 1000)
    items = [rng.choices(words, k=n) for n in sizes]
    rows = [(i, " ".join(rng.choices(words, k=200))) for i in range(60)]
    for i, item in enumerate(items):
        said = [w if rng.random() < 0.7 or w in item[:2] else rng.choice(words) for w in item]
        around = [" ".join(rng.choices(words, k=37)) for _ in range(4)]
        rows += [(100 + i, f"{around[0]} {' '.join(item)} {around[1]}"), (200 + i, f"{around[2]} {' '.join(said)} {around[3]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x), " ".join(x[:2])) for i, x in enumerate(items)], "item_id long, text string, answer string")
    for at_once in (200, 2):
        got = {(r["doc_id"], r["item_id"], r["kind"]) for r in decontamination.leaks(docs, bench, items_at_once=at_once).collect()}
        assert got == {(100 + i, i, "verbatim") for i in range(len(sizes))} | {(200 + i, i, "paraphrase") for i in range(len(sizes))}


def test_anchors_do_not_depend_on_the_step():
    rng = np.random.default_rng(4)
    for _ in range(2000):
        data = rng.integers(97, 123, 400).astype(np.uint8)
        seen = []
        for step, offsets in ((data[:200], [0, 200]), (data, [0, 200, 400])):
            p, h, s0, _ = suffix_dedup.anchors(step, np.array(offsets), common.prefix_hash(step), 200, 64)
            seen.append([(a, b) for a, b, c in zip(p.tolist(), h.tolist(), s0.tolist(), strict=True) if c == 0])
        assert seen[0] == seen[1]


def test_url_scores_and_hosts_held_out(spark):
    """Scores equal a plain logistic function over the hashed n-grams; hosts that were not trained on are told apart."""
    rows = url_filter.labelled_urls(spark).collect()
    hit, weights = collections.Counter(), []
    for fold in range(5):
        weights = url_filter.trained(spark.createDataFrame([r for i, r in enumerate(rows) if i % 5 != fold]))
        test = [r for i, r in enumerate(rows) if i % 5 == fold]
        pages = spark.createDataFrame([(i, r["url"]) for i, r in enumerate(test)], "page_id long, url string")
        for r in url_filter.judged(pages, weights, rules=()).collect():
            hit[test[r["page_id"]]["label"], r["verdict"]] += 1
    assert hit[1, "block"] >= 0.75 * (hit[1, "block"] + hit[0, "block"])
    assert hit[1, "block"] >= 0.3 * (hit[1, "block"] + hit[1, "allow"])
    parts = spark.createDataFrame([("free-casino.example.org", "/x/12")], "host string, path string")
    grams = url_filter._features(parts).head()
    total = sum(w * sum(weights[g] for g in grams[c]) / len(grams[c]) for c, w in (("host_grams", 1), ("path_grams", url_filter.PATH_WEIGHT)))
    got = url_filter.judged(spark.createDataFrame([(1, "https://free-casino.example.org/x/12?q")], "page_id long, url string"), weights).head()
    assert abs(got["block_score"] - 1 / (1 + math.exp(-total - 0.2 * weights[-1]))) < 1e-9
    assert (got["rule"], got["verdict"]) == ("org/", "allow")
