"""Quality classifier: random Fourier features of document statistics, ridge by partition-summed normal equations, isotonic calibration.

Statistics come from the whole text; labels, language, source and id are never among them. Random Fourier features
approximate a Gaussian kernel over the standardised statistics. Each partition sums its part of the normal equations;
at most `n_sums` such sums of fixed size reach the driver. A fold of the labelled rows that the ridge didn't see
calibrates: its scores, counted in a fixed number of bins, are made monotone by pooling adjacent violators.

Defined results: a null or empty text has statistics of zero and still gets a score; rows without a label are scored
only; several labels of one document count as their mean; without any usable label every score is 0.5; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common

STATISTICS = ("log_words", "word_len", "symbols", "upper", "digits", "bangs", "stops", "pipes", "not_ascii", "new_words", "dup_lines", "line_words", "spaces", "long_words")
_CLASSES = {"symbols": b"#*$%&|<>=_^~\\@{}[]", "upper": bytes(range(65, 91)), "digits": bytes(range(48, 58)), "bangs": b"!?", "stops": b".,;:", "pipes": b"|"}
_TABLE = np.zeros((len(_CLASSES), 256), bool)
for _i, _chars in enumerate(_CLASSES.values()):
    _TABLE[_i, list(_chars)] = True


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(STATISTICS)))
    start, end, doc = common.words(data, offsets)
    n_words = np.bincount(doc, minlength=n)
    some = np.maximum(n_words, 1)
    length = end - start
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    n_chars = np.maximum(chars[offsets[1:]] - chars[offsets[:-1]], 1)
    h = common.span_hash(common.prefix_hash(data), start, end)
    order = np.lexsort((h, doc))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    ends_line = np.concatenate([[0], np.cumsum(data == 0x0A)])
    line = ends_line[start] + doc
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(start) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:], [len(start)]]) - 1 if len(start) else first
    n_lines = np.bincount(doc[first], minlength=n)
    lh = common.span_hash(common.prefix_hash(data), start[first], end[last])
    lo = np.lexsort((lh, doc[first]))
    old = np.zeros(len(lo), bool)
    old[1:] = (lh[lo][1:] == lh[lo][:-1]) & (doc[first][lo][1:] == doc[first][lo][:-1])

    def count(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return total[offsets[1:]] - total[offsets[:-1]]

    col = dict(zip(STATISTICS, out.T, strict=True))
    col["log_words"][:] = np.log1p(n_words)
    col["word_len"][:] = np.bincount(doc, chars[end] - chars[start], n) / some
    for name, row in zip(_CLASSES, _TABLE, strict=True):
        col[name][:] = count(row[data]) / some
    col["not_ascii"][:] = count(data >= 0xC0) / n_chars
    col["new_words"][:] = np.bincount(doc[order], new, n) / some
    col["dup_lines"][:] = np.bincount(doc[first][lo], old, n) / np.maximum(n_lines, 1)
    col["line_words"][:] = np.log1p(n_words / np.maximum(n_lines, 1))
    col["spaces"][:] = 1 - np.bincount(doc, chars[end] - chars[start], n) / n_chars
    col["long_words"][:] = np.bincount(doc, length > 20, n) / some
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [c for c in batch.schema.names if c != "text"]
        for rows, data, offsets in common.steps(batch):
            rest = [batch.column(c).slice(rows.start, rows.stop - rows.start) for c in own]
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(c) for c in statistics(data, offsets).T)], names=[*own, *STATISTICS])


class Kernel:
    """Random Fourier features of standardised statistics, with a constant."""

    def __init__(self, mean, std, n_features: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.std = np.array(mean), np.array(std)
        self.w = rng.normal(size=(len(self.mean), n_features)) / np.sqrt(len(self.mean))
        self.b = rng.uniform(0, 2 * np.pi, n_features)

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        return self.features(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATISTICS], axis=1))

    def features(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.std, -8, 8)
        return np.concatenate([np.sqrt(2 / len(self.b)) * np.cos(x @ self.w + self.b), np.ones((len(x), 1))], axis=1)


def _normal_equations(kernel: Kernel):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            z = kernel(batch)
            part = z.T @ np.column_stack([z, batch.column("label").to_numpy(zero_copy_only=False)])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return sums


def _raw(kernel: Kernel, beta: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(kernel(batch) @ beta)], names=["label", "score"])

    return score


def _scored(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), pa.array(model.score(model.kernel(batch)))], names=["doc_id", "fold", "score"])

    return score


def _kept(model: Model, threshold: float):
    """The rows, as they are, whose text has a score of threshold or more."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(model.kernel.features(statistics(data, offsets))) for _, data, offsets in common.steps(batch)]
            yield batch.filter(pa.array(np.concatenate([*scores, np.zeros(0)]) >= threshold))

    return keep


class Model(NamedTuple):
    """Kernel, weights of its features, and the steps of the calibration."""

    kernel: Kernel
    beta: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        raw = features @ self.beta
        raw = 0.98 * np.interp(raw, self.x, self.y) + 0.02 * np.clip(raw, 0, 1)  # raw parts ties of the calibrated steps
        return np.clip(raw, 0, 1)


def isotonic(x: np.ndarray, total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Monotone means of total / weight over rising x: adjacent violators are pooled."""
    blocks: list[list[float]] = []
    for t, w in zip(total, weight, strict=True):
        blocks.append([t, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, w, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + w, blocks[-1][2] + k]
    return np.repeat([t / w for t, w, _ in blocks], [int(k) for *_, k in blocks])


def _statistics_of(docs: DataFrame, folds: int, from_fold: int = 0) -> DataFrame:
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds)).cast("int")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("fold"), F.col("text").cast("string").alias("text"))
    return slim.filter(F.col("fold") >= from_fold).mapInArrow(_statistics, "doc_id long, fold int, " + ", ".join(f"{c} double" for c in STATISTICS))


def fitted(stats: DataFrame, labels: DataFrame, n_features: int = 256, ridge: float = 1e-3, seed: int = 7, n_sums: int = 32, folds: int = 5) -> Model | None:
    """A model of the labelled rows but those of fold 0; None where there are none. stats: doc_id, fold and STATISTICS."""
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").cast("double").alias("label"))
    with common.Scratch(stats.sparkSession) as own:
        learn = own.handed_over(stats.filter("fold != 0").join(marks, "doc_id").select("fold", "label", *STATISTICS), "labelled")
        about = learn.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in STATISTICS], *[F.stddev_pop(c).alias(f"s_{c}") for c in STATISTICS]).head()
        if not about["n"]:
            return None
        kernel = Kernel([about[f"m_{c}"] for c in STATISTICS], [max(about[f"s_{c}"], 1e-6) for c in STATISTICS], n_features, seed)
        fit, check = learn.filter(F.col("fold") != folds - 1), learn.filter(F.col("fold") == folds - 1)
        if not fit.limit(1).count():
            fit = learn
        size = n_features + 1
        parts = fit.coalesce(n_sums).mapInArrow(_normal_equations(kernel), "sums binary").collect()
        total = sum(np.frombuffer(r["sums"]).reshape(size, size + 1) for r in parts)
        beta = np.linalg.solve(total[:, :size] + ridge * total[size - 1, size - 1] * np.eye(size) / size, total[:, size])
        bins = check.mapInArrow(_raw(kernel, beta), "label double, score double")
        bins = bins.groupBy(F.round(F.least(F.greatest("score", F.lit(-0.5)), F.lit(1.5)), 3).alias("x")).agg(F.sum("label").alias("t"), F.count("*").alias("w")).orderBy("x").collect()
    x = np.array([r["x"] for r in bins] or [0.0, 1.0])
    y = isotonic(x, np.array([r["t"] for r in bins], float), np.array([r["w"] for r in bins], float)) if bins else x
    return Model(kernel, beta, x, np.clip(y, 0, 1))


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5, **options) -> DataFrame:
    """doc_id, held_out, score (0 to 1). Rows of fold 0 are never learned from; the last fold calibrates.

    docs needs doc_id and text; labels doc_id and quality (0 or 1). The options are those of fitted."""
    stats = common.handed_over(_statistics_of(docs, folds), "statistics")
    model = fitted(stats, labels, folds=folds, **options)
    held = (F.col("fold") == 0).alias("held_out")
    if model is None:
        return stats.select("doc_id", held, F.lit(0.5).alias("score"))
    return stats.mapInArrow(_scored(model), "doc_id long, fold int, score double").select("doc_id", held, "score")


def kept(docs: DataFrame, labels: DataFrame, threshold: float, folds: int = 5, **options) -> DataFrame:
    """The rows of docs with a score of threshold or more, which scored gives; each is judged where it lies, so that no text moves."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    model = fitted(_statistics_of(docs, folds, 1), labels, folds=folds, **options)
    if model is None:
        return docs if threshold <= 0.5 else docs.limit(0)
    return docs.mapInArrow(_kept(model, threshold), docs.schema)


def op4_quality_scores(spark, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    out = scored(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
