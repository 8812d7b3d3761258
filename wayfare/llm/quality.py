"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

A document is described by shares of character classes and of repeated words, lines and word triples. The
classifier is linear in clipped forms of these, with squared loss. Its non-negative risk
``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))`` then depends on the data only through first and second moments of
the features over the trusted positives and over the unlabelled text. So one pass over *all* documents sums those
moments (one small matrix a task, summed by Spark), and the driver minimises the risk exactly as if it held every
row. The class prior ``pi`` is the smallest ratio of unlabelled to positive mass above any threshold of a first
classifier; it comes from two histograms over all rows. Labelled rows
only calibrate the score, by one histogram for each class.

Texts are read once; shuffled are the features (some 150 bytes a document) for the join with the labels.

Defined results: a null or empty text is scored like a text without words; texts are taken whole at any length; equal
texts have equal scores, and a score of just the threshold passes; labels that are null are no labels, a
document labelled both ways is a negative; null ids are never labelled; repeated rows each give their row; without
any positive label every score is 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, text_or_empty, unused

#: Character classes by byte: upper, lower, digit, space, line end, sentence marks, symbols, cries, other marks, the rest.
_CLASS = np.full(256, 9, dtype=np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b".,;:", b"#*$%&|<>", b"!?", b"@_=+/\\^~`\"'()[]{}-")):
    _CLASS[list(_chars)] = _k
#: Shares below these values count in full, and once more as a whole: a feature can matter by its small values alone.
CLIPS = (1.0, 0.2, 0.05)
#: 11 shares, each clipped; 2 lengths; 1.
WIDTH = 11 * len(CLIPS) + 3
BINS = 400


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``WIDTH`` numbers for each text."""
    n = len(texts)
    py = texts.to_pylist()
    data = [t.encode() for t in py]
    sizes = np.fromiter(map(len, data), dtype=np.int64, count=n)
    kinds = _CLASS[np.frombuffer(b"".join(data), dtype=np.uint8)]
    starts = np.r_[0, np.cumsum(sizes)]
    per = np.zeros((n, 10))
    for i in range(n):  # one counting pass over each text's bytes
        per[i] = np.bincount(kinds[starts[i] : starts[i + 1]], minlength=10)
    letters = np.maximum(per[:, 0] + per[:, 1], 1)
    shown = np.maximum(per.sum(1) - per[:, 3] - per[:, 4], 1)
    seen, triples, same, n_words, mean, lines = (np.empty(n) for _ in range(6))
    for i, t in enumerate(py):
        w = t.split()
        k = n_words[i] = len(w)
        seen[i] = 1 - len(set(w)) / k if k else 0.0
        triples[i] = 1 - len(set(zip(w, w[1:], w[2:], strict=False))) / (k - 2) if k > 2 else 0.0
        same[i] = sum(map(str.__eq__, w, w[1:])) / k if k else 0.0
        rows = t.split("\n")
        lines[i] = 1 - len(set(rows)) / len(rows)
        mean[i] = (len(t) - k) / k if k else 0.0
    shares = np.stack([per[:, 0] / letters, per[:, 2] / shown, per[:, 5] / shown, per[:, 6] / shown, per[:, 7] / shown, per[:, 8] / shown, seen, triples, same, lines, per[:, 4] / shown], axis=1)
    return np.hstack([*(np.minimum(shares, c) / c for c in CLIPS), np.log1p(n_words)[:, None] / 10, np.minimum(mean, 20)[:, None] / 20, np.ones((n, 1))])


def described(docs: DataFrame, *, keep: list[str] | None = None, name: str = "x") -> DataFrame:
    """doc_id (or the columns to ``keep``) and features, as ``name``, of every document, written once."""
    kept = keep or ["doc_id"]
    (text,) = unused(docs, "text_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x = features(part.column(len(kept))).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * WIDTH), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], lists], names=[*kept, name])

    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])
    return materialize(docs.select(*kept, text_or_empty().alias(text)).mapInArrow(run, schema), "features")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, WIDTH).astype(np.float64)


def moments(rows: DataFrame) -> tuple[int, np.ndarray]:
    """(number of rows, mean of x x'): one partial matrix a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((WIDTH, WIDTH))
        for batch in batches:
            x = _matrix(batch)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH * WIDTH)), pa.array(total.ravel())], names=["i", "v"])

    sums = np.zeros(WIDTH * WIDTH)
    for i, v in rows.select("x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        sums[i] = v
    m = sums.reshape(WIDTH, WIDTH)
    n = round(m[-1, -1])  # the last feature is 1
    return n, m / max(n, 1)


def nn_risk(theta: np.ndarray, prior: float, p: np.ndarray, u: np.ndarray) -> tuple[float, float, float]:
    """(positive part, negative part before it is cut at 0, non-negative risk), by moments; the mean of x is their last row."""

    def loss(m: np.ndarray, y: int) -> float:
        return float(1 - 2 * y * (m[-1] @ theta) + theta @ m @ theta) / 4

    positive, negative = prior * loss(p, 1), loss(u, -1) - prior * loss(p, -1)
    return positive, negative, positive + max(0.0, negative)


def fit_nn(prior: float, p: np.ndarray, u: np.ndarray, *, ridge: float, steps: int = 300) -> np.ndarray:
    """Weights of least non-negative risk: the unbiased minimum, then descent that backs off where the negative part is under 0."""
    eye = np.eye(WIDTH)
    theta = np.linalg.solve(u + 2 * ridge * eye, 2 * prior * p[-1] - u[-1])
    best, least = theta, nn_risk(theta, prior, p, u)[2] + ridge * theta @ theta
    rate = 0.5 / np.linalg.eigvalsh(u + p).max()
    for _ in range(steps):
        up, down = prior * (p @ theta - p[-1]) / 2, (u @ theta + u[-1]) / 2 - prior * (p @ theta + p[-1]) / 2
        negative = nn_risk(theta, prior, p, u)[1]
        theta = theta - rate * (up + down + 2 * ridge * theta if negative >= 0 else -down)
        risk = nn_risk(theta, prior, p, u)[2] + ridge * theta @ theta
        if risk < least:
            best, least = theta, risk
    return best


def _decision(theta: np.ndarray, x: str = "x") -> Column:
    """theta . x as a column."""
    weights = F.array(*[F.lit(float(w)) for w in theta])
    return F.aggregate(F.zip_with(x, weights, lambda x, w: x * w), F.lit(0.0), lambda a, b: a + b)


def _histogram(rows: DataFrame, theta: np.ndarray) -> np.ndarray:
    bin_of = F.least(F.greatest(F.floor((_decision(theta) + 2) / 4 * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    out = np.zeros(BINS)
    for b, n in rows.groupBy(bin_of.alias("b")).count().collect():
        out[b] = n
    return out


def estimate_prior(positives: DataFrame, rows: DataFrame, theta: np.ndarray, *, least: float = 0.05, most: float = 0.98) -> float:
    """Smallest ratio of unlabelled to positive mass above a threshold, with two standard errors' slack for the positives."""
    p, u = _histogram(positives, theta)[::-1].cumsum(), _histogram(rows, theta)[::-1].cumsum()
    share, mass = p / max(p[-1], 1), u / max(u[-1], 1)
    slack = 2 * np.sqrt(share * (1 - share) / max(p[-1], 1))
    wide = share >= 0.2
    return float(np.clip(((mass + slack)[wide] / share[wide]).min() if wide.any() else 0.5, least, most))


def calibrate(ones: np.ndarray, zeros: np.ndarray, *, steps: int = 200) -> tuple[float, float]:
    """(a, b) of sigmoid(a g + b) from histograms of g, by Newton steps with targets drawn in as Platt's are; (4, 0) if a class is missing."""
    n1, n0 = ones.sum(), zeros.sum()
    if not n1 or not n0:
        return 4.0, 0.0
    rows, hits = ones + zeros, ones * (n1 + 1) / (n1 + 2) + zeros / (n0 + 2)
    g = (np.arange(BINS) + 0.5) / BINS * 4 - 2
    x, w = np.stack([g, np.ones_like(g)], axis=1), np.array([1.0, 0.0])
    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (rows * (s * (1 - s) + 1e-6))[:, None]) + 1e-3 * np.eye(2), x.T @ (rows * s - hits) + 1e-3 * np.array([w[0], 0]))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return (float(max(w[0], 1e-3)), float(w[1]))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


class Model(NamedTuple):
    """Weights over the features, and the calibration of their sum."""

    theta: np.ndarray
    a: float
    b: float

    def score(self, x: str = "x") -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.a) * _decision(self.theta, x) + F.lit(self.b))))


def fit(rows: DataFrame, labels: DataFrame) -> Model:
    """The classifier for described rows; without a positive label, one that scores everything 0.5."""
    marks = labels.filter("doc_id is not null and quality is not null").filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marked = materialize(rows.join(marks, "doc_id").select("doc_id", "x", "quality"), "labelled")
    positives = marked.filter("quality = 1")
    (n_p, p), (_, u) = moments(positives), moments(rows)
    if not n_p:
        return Model(np.zeros(WIDTH), 0.0, 0.0)
    ridge = 1e-3 + 2 / n_p  # few positives: short documents would be fitted one by one
    prior = estimate_prior(positives, rows, fit_nn(0.5, p, u, ridge=ridge))
    theta = fit_nn(prior, p, u, ridge=ridge)
    return Model(theta, *calibrate(_histogram(positives, theta), _histogram(marked.filter("quality = 0"), theta)))


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text); ``labels`` has doc_id and quality.

    Labels of held-out rows are never used. The driver gets sums and histograms, never rows.
    """
    rows = described(docs)
    model = fit(rows, labels)
    scored = rows.select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score below the threshold; they are written with their features, without a join."""
    (x,) = unused(docs, "x_")
    rows = described(docs, keep=docs.columns, name=x)
    model = fit(rows.select("doc_id", F.col(x).alias("x")), labels)
    return rows.filter(model.score(x) >= threshold).select(*docs.columns)
