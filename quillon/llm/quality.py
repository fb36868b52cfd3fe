"""Quality classification with naive Bayes support vectors.

A text is the set of its byte n-grams (n in NGRAMS, hashed to FEATURES classes). Over all labelled
training rows the document frequencies of the n-grams in either class give log-count ratios; a
text's indicators are scaled by them and brought to unit length. On about SAMPLE_ROWS training rows
(each is drawn by a hash of its id), as many of either class where there are enough, a linear hinge-loss model is fitted by dual
coordinate descent and interpolated with its mean magnitude; the other half of the sample
calibrates its margins to probabilities.

Labels of rows whose crc32(doc_id as text) leaves the remainder HELD_OUT are never learnt from. Only
the text is an input of a score.

Edge cases: null and empty texts score by the intercept alone. Texts are read whole, however long.
Labels without a document, null labels and labels other than 0 and 1 are left out; repeated rows
count as often as they occur. Without labels of both classes every score is 0.5. An empty table
gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import bounded_batches, materialize

FEATURES = 1 << 16
NGRAMS = (2, 3, 4)
#: Rows of the fitted sample, both classes together, about.
SAMPLE_ROWS = 3000
#: Smoothing of document frequencies; weight of the fitted model against its mean magnitude.
SMOOTHING, INTERPOLATION = 1.0, 0.25
#: Bound of the dual variables, passes over the sample.
C, EPOCHS = 1.0, 12
HELD_OUT, FOLDS = 1, 3


def ngrams(text: str | None) -> np.ndarray:
    """Distinct n-gram classes of a text."""
    a = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    found = np.zeros(FEATURES, bool)
    for at in range(0, len(a), 1 << 20):
        part = a[at : at + (1 << 20) + max(NGRAMS)]
        for n in NGRAMS:
            if len(part) >= n:
                code = np.full(len(part) - n + 1, n, np.uint32)
                for i in range(n):
                    code = code * np.uint32(0x01000193) ^ part[i : len(part) - n + 1 + i]
                found[(code * np.uint32(0x9E3779B1)) >> np.uint32(16)] = True
    return np.flatnonzero(found).astype(np.int32)


def _bits(features: np.ndarray) -> bytes:
    """A set of n-gram classes as FEATURES bits, so that a row of the sample has 8 kB however long its text is."""
    found = np.zeros(FEATURES, bool)
    found[features] = True
    return np.packbits(found).tobytes()


def is_held_out(doc_id: Column) -> Column:
    """Whether a row's label is kept from training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


class Model:
    """Weights of n-gram classes; score() gives a probability."""

    def __init__(self, ratios: np.ndarray, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.ratios, self.bias, self.slope, self.offset = ratios, bias, slope, offset
        self.folded, self.squares = ratios * weights, ratios**2

    def margin(self, features: np.ndarray) -> float:
        norm = float(np.sqrt(self.squares[features].sum()))
        return float(self.folded[features].sum()) / norm + self.bias if norm else self.bias

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(ngrams(text)) + self.offset
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0))))


NEUTRAL = Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0, 0.0)


def _descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Hinge-loss weights and intercept by dual coordinate descent."""
    w, bias = np.zeros(FEATURES), 0.0
    alpha = np.zeros(len(rows))
    shuffled = np.random.default_rng(5)
    diagonal = np.array([float((v * v).sum()) + 1.0 for v in values])
    for _ in range(EPOCHS):
        for i in shuffled.permutation(len(rows)).tolist():
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1.0
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), C)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w, bias


def _calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins (Newton steps, smoothed targets)."""
    plus, minus = float((y > 0).sum()), float((y < 0).sum())
    goal = np.where(y > 0, (plus + 1) / (plus + 2), 1 / (minus + 2))
    x = np.column_stack([margins, np.ones(len(y))])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.linalg.solve(hessian, x.T @ (p - goal) + 1e-3 * (theta - [1.0, 0.0]))
    return float(theta[0]), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from documents and labels (doc_id, quality)."""
    bounded_batches(docs.sparkSession)
    known = labels.filter(F.col("quality").isin(0, 1) & ~is_held_out(F.col("doc_id"))).select(
        F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y")
    )
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return NEUTRAL
    share = {y: min(1.0, sample_rows / 2 / n) for y, n in sizes.items()}
    unit = F.shiftrightunsigned(F.xxhash64("id", F.lit(11)), 11) / F.lit(float(1 << 53))
    known = known.withColumn("picked", unit < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros((2, FEATURES), np.int64)
        for b in batches:
            picked = []
            for y, take, text in zip(b["y"], b["picked"], b["text"], strict=True):
                f = ngrams(text)
                df[y, f] += 1
                if take:
                    picked.append((y, None, None, _bits(f)))
            if picked:
                yield pd.DataFrame(picked, columns=["y", "feature", "n", "features"]).astype({"feature": "Int32", "n": "Int64"})
        for y in (0, 1):
            at = np.flatnonzero(df[y])
            if len(at):
                yield pd.DataFrame({"y": y, "feature": at.astype(np.int32), "n": df[y, at], "features": None})

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter(~is_held_out(F.col("id")))
    # Always a shuffled join: labels grow with the corpus, and small ones shall not take another path.
    joined = texts.join(known.hint("merge"), "id").select("y", "picked", "text")
    counted = materialize(joined.mapInPandas(count, "y int, feature int, n long, features binary"), "quality-counts")
    # At most two rows for each feature, whatever the size of the corpus.
    table = counted.filter("features is null").groupBy("y", "feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.full((2, FEATURES), SMOOTHING)
    df[table["y"].to_numpy(), table["feature"].to_numpy()] += table["n"].to_numpy()
    ratios = np.log(df[1] / df[1].sum()) - np.log(df[0] / df[0].sum())
    picked = counted.filter("features is not null").select("y", "features").orderBy(F.sha2("features", 256)).collect()
    if len({r["y"] for r in picked}) < 2:
        return NEUTRAL
    rows = [np.flatnonzero(np.unpackbits(np.frombuffer(r["features"], np.uint8))) for r in picked]
    y = np.array([1.0 if r["y"] else -1.0 for r in picked])
    values = [ratios[f] / (np.linalg.norm(ratios[f]) or 1.0) for f in rows]
    # Fitted on one half to calibrate on the other, then on the whole.
    half = np.arange(len(rows)) % 2 == 0
    if len(set(y[half])) == 2 and len(set(y[~half])) == 2:
        w, bias = _descend([r for r, h in zip(rows, half, strict=True) if h], [v for v, h in zip(values, half, strict=True) if h], y[half])
        w = _interpolated(w)
        margins = np.array([float(w[r] @ v) + bias for r, v, h in zip(rows, values, half, strict=True) if not h])
        slope, offset = _calibrate(margins, y[~half])
    else:
        slope, offset = 1.0, 0.0
    w, bias = _descend(rows, values, y)
    return Model(ratios, _interpolated(w), bias, slope, offset)


def _interpolated(w: np.ndarray) -> np.ndarray:
    used = w[w != 0]
    mean = float(np.abs(used).mean()) if len(used) else 0.0
    return (1 - INTERPOLATION) * mean + INTERPOLATION * w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": [model.score(x) for x in b["text"]]})

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInPandas(run, "doc_id long, score double")
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
