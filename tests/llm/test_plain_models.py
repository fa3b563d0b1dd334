"""The two trained models against plain versions of them: statistics, kernel, sums and calibration; the fold over labelled urls."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common, quality, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _statistics(text):
    words, lines = WORD.findall(text), [x.strip(" \t\n\x0b\x0c\r") for x in text.split("\n") if WORD.search(x)]
    n, chars = max(len(words), 1), max(len(text), 1)
    by_class = [sum(c in members for c in text) / n for members in ("#*$%&|<>=_^~\\@{}[]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?", ".,;:", "|")]
    return [
        math.log1p(len(words)), sum(map(len, words)) / n, *by_class, sum(ord(c) > 127 for c in text) / chars, len(set(words)) / n,
        (len(lines) - len(set(lines))) / max(len(lines), 1), math.log1p(len(words) / max(len(lines), 1)), 1 - sum(map(len, words)) / chars, sum(len(w.encode()) > 20 for w in words) / n,
    ]


def _monotone(points):
    """Pools neighbours until means rise; points are (sum, weight) along x."""
    groups = [[[t], [w]] for t, w in points]
    i = 0
    while i + 1 < len(groups):
        if sum(groups[i][0]) / sum(groups[i][1]) >= sum(groups[i + 1][0]) / sum(groups[i + 1][1]):
            groups[i] = [groups[i][0] + groups[i + 1][0], groups[i][1] + groups[i + 1][1]]
            del groups[i + 1]
            i = max(i - 1, 0)
        else:
            i += 1
    return [sum(t) / sum(w) for t, w in groups for _ in t]


def _said(rng, junk):
    words = ["menu", "|", "###", "WIN", "now!!", "x" * 25] if junk else ["the", "river", "Ähre", "flows,", "on.", "and", "time", "goes", "by"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  "]) for _ in range(rng.randrange(5, 120)))


def test_quality_scores_equal_a_plain_version(spark):
    rng = random.Random(31)
    texts = [None, "", "one", "same line\nsame line\nsame line", *(_said(rng, i % 3 == 0) for i in range(240))]
    labels = [(i, int(bool(i % 3) ^ (rng.random() < 0.1))) for i in range(4, 220)] + [(10, 0), (11, None), (None, 1)]
    rows = [(i, t, 9, 0.5, 3.0, 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fold int, score double, label double, row_key long").repartition(3)
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, spark.createDataFrame(labels, "doc_id long, quality int"), n_features=32).collect()}

    x = np.array([_statistics(t or "") for t in texts])
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in range(len(texts))])
    said = collections.defaultdict(list)
    for i, q in labels:
        if i is not None and q is not None:
            said[i].append(q)
    y = np.array([np.mean(said[i]) if i in said else np.nan for i in range(len(texts))])
    learned = ~np.isnan(y) & (fold != 0)
    mean, std = x[learned].mean(axis=0), np.maximum(x[learned].std(axis=0), 1e-6)
    draw = np.random.default_rng(7)
    w, b = draw.normal(size=(x.shape[1], 32)) / np.sqrt(x.shape[1]), draw.uniform(0, 2 * np.pi, 32)
    z = np.column_stack([np.sqrt(2 / 32) * np.cos(np.clip((x - mean) / std, -8, 8) @ w + b), np.ones(len(x))])
    fit, check = learned & (fold != 4), learned & (fold == 4)
    n = fit.sum()
    beta = np.linalg.solve(z[fit].T @ z[fit] + 1e-3 * n * np.eye(33) / 33, z[fit].T @ y[fit])
    raw = z @ beta
    bins = collections.defaultdict(lambda: [0.0, 0])
    for r, q in zip(raw[check], y[check], strict=True):
        at = math.floor(min(max(r, -0.5), 1.5) * 1000 + 0.5) / 1000
        bins[at][0] += q
        bins[at][1] += 1
    steps = sorted(bins)
    calibrated = np.interp(raw, steps, np.clip(_monotone([bins[s] for s in steps]), 0, 1))
    want = np.clip(0.98 * calibrated + 0.02 * np.clip(raw, 0, 1), 0, 1)
    assert len(got) == len(texts) and max(abs(got[i] - want[i]) for i in range(len(texts))) < 1e-6


def test_a_text_over_a_step_has_the_statistics_of_its_whole(spark):
    text = "The river flows, on and on.\n" * (2 * common.STEP_BYTES // 28) + "END!"
    data = np.frombuffer(text.encode(), np.uint8)
    assert quality.statistics(data, np.array([0, len(data)]))[0] == pytest.approx(_statistics(text))


def test_the_fold_over_labelled_urls_equals_a_loop(spark):
    labelled = spark.createDataFrame([("https://casino-bets.example/win/1", 1), ("https://news.example/2024/07/story", 0), ("http://ÄÖ.example?x", 0), ("no host", 1), (None, 1), ("https://a.example/", None)], "url string, label int")
    got = url_filter.trained(labelled, rounds=3, rate=20.0)
    host, path = url_filter.host_and_path(F.col("url"))
    rows = url_filter._features(labelled.filter("url IS NOT NULL AND label IS NOT NULL").select(F.xxhash64("url").alias("o"), "label", host.alias("host"), path.alias("path"))).collect()
    w, at = [0.0] * (2 * url_filter.BUCKETS + 1), 0
    for _ in range(3):
        for r in sorted(rows, key=lambda r: r["o"]):
            x = [0.0] * len(w)
            for grams, weight in ((r["host_grams"], 1.0), (r["path_grams"], url_filter.PATH_WEIGHT)):
                for g in grams:
                    x[g] += weight / len(grams)
            x[-1] = 0.2
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
            step = 20.0 / (1 + at / len(rows)) * (r["label"] - p)
            w = [a * (1 - 3e-4) + step * b for a, b in zip(w, x, strict=True)]
            at += 1
    assert max(abs(a - b) for a, b in zip(got, w, strict=True)) < 1e-9
