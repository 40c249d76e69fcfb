"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The feature of a text is which hashed n-grams of four and five characters (code points) of its lower-cased form it has.
A feature's scale is the log ratio of its smoothed shares in toxic and other texts; a logistic
regression on the scaled features gives the weights. The features that differ most surely have a weight each,
all others share one, on the mean of their ratios. Learning takes a bounded sample of each label; the
intercept is set back to the labels' own proportion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_steps, fold, staged, table
from .features import character_hashes, labelled_sample

ORDERS = (4, 5)
BITS = 20
#: Bounds of the sample of labelled rows, by label, and of the features with weights of their own.
SAMPLE = {0: 8000, 1: 8000}
FEATURES = 2048
LEAST_DOCS = 5
PARTS = 16


def grams(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers."""
    lower = (text or "").lower()
    found = [h for n in ORDERS for h in character_hashes(lower, n, BITS)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many texts of either label have each feature: (2, 2**BITS), and the texts of either."""
    blocks, width = 64, (1 << BITS) // 64

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, texts = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                n[label, grams(text)] += 1
                texts[label] += 1
        if texts.any():
            yield pd.DataFrame([(k, n[:, k * width : (k + 1) * width].tobytes()) for k in range(blocks)] + [(blocks, texts.tobytes())], columns=["block", "n"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        kind = np.int64 if frame["block"].iat[0] == blocks else np.int32
        total = sum(np.frombuffer(x, kind) for x in frame["n"])
        return pd.DataFrame({"block": frame["block"].iloc[:1], "n": [total.astype(kind).tobytes()]})

    rows = sample.mapInPandas(run, "block int, n binary").groupBy("block").applyInPandas(add, "block int, n binary").collect()  # 8 MB
    got = {r["block"]: r["n"] for r in rows}
    if not got:
        return np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
    counts = np.concatenate([np.frombuffer(got[k], np.int32).reshape(2, width) for k in range(blocks)], axis=1)
    return counts, np.frombuffer(got[blocks], np.int64)


def log_count_ratios(counts: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ratios, and those of the FEATURES features that differ most surely."""
    p, q = counts[1] + 1.0, counts[0] + 1.0
    ratio = np.log(p / (texts[1] + 2.0)) - np.log(q / (texts[0] + 2.0))
    sure = np.abs(ratio) / np.sqrt(1 / p + 1 / q)
    sure[counts.sum(0) < LEAST_DOCS] = -1
    kept = np.argsort(-sure, kind="stable")[:FEATURES]
    return ratio, np.sort(kept[sure[kept] > 0])


def logistic(x: np.ndarray, scale: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights on x * scale and an intercept, by accelerated gradient steps."""
    w, b, vw, vb = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    n = max(1, len(x))
    xs = x.astype(np.float32, copy=False)
    norm = 1.0
    probe = np.random.default_rng(0).normal(size=x.shape[1]).astype(np.float32)
    for _ in range(8):  # largest curvature, by power steps
        probe = (xs.T @ (xs @ (probe * scale))) * scale / n
        norm = float(np.linalg.norm(probe))
        if not norm:
            break
        probe = (probe / norm).astype(np.float32)
    rate = 1 / (0.25 * (norm + 1) * 1.1 + l2 / n)
    for k in range(steps):
        s = xs @ (vw * scale).astype(np.float32) + vb
        g = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - y
        new_w = vw - rate * ((xs.T @ g.astype(np.float32)) * scale / n + l2 / n * vw)
        new_b = vb - rate * float(g.mean()) if len(g) else 0.0
        m = k / (k + 3)
        vw, vb = new_w + m * (new_w - w), new_b + m * (new_b - b)
        w, b = new_w, new_b
    return w, b


def occurrences(text: str | None, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """(feature numbers as they occur, mean of `ratio` over them)."""
    lower = (text or "").lower()
    found = np.concatenate([np.zeros(0, np.int64), *[h for n in ORDERS for h in character_hashes(lower, n, BITS)]])
    return found, float(ratio[found].mean()) if len(found) else 0.0


class Model:
    """Features (sorted numbers), their weights in a text's sum, the intercept; the ratios of all other features
    and the weight that they share."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, intercept: float, ratio: np.ndarray | None = None, shared: float = 0.0):
        self.features, self.weights, self.intercept, self.shared = features, weights, intercept, shared
        self.others = others(ratio, features) if ratio is not None else np.zeros(1 << BITS, np.float32)
        self._table = None

    def score(self, text: str | None) -> float:
        if self._table is None:
            self._table = np.zeros(1 << BITS, np.int32)
            self._table[self.features] = np.arange(1, len(self.features) + 1)
        found, rest = occurrences(text, self.others)
        hit = np.zeros(len(self.features) + 1, bool)
        hit[self._table[found]] = True
        s = self.intercept + float(self.weights[hit[1:]].sum()) + self.shared * rest
        return float(1 / (1 + np.exp(-np.clip(s, -500, 500))))


def others(ratio: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The ratios of the features without a weight of their own."""
    out = ratio.astype(np.float32)
    out[kept] = 0
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: dict[int, int] = SAMPLE) -> Model:
    rows, known = labelled_sample(docs, labels, label, sample)
    rows = staged(rows.repartition(PARTS), "toxicity-sample")
    counts, texts = _counts(rows)
    ratio, kept = log_count_ratios(counts, texts)

    rest = others(ratio, kept)
    sent = docs.sparkSession.sparkContext.broadcast(rest)  # 2**BITS numbers

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        bits = [np.packbits(np.isin(kept, grams(t), assume_unique=True)).tobytes() for t in batch["text"]]
        return pd.DataFrame({"label": batch["label"], "bits": bits, "rest": [occurrences(t, sent.value)[1] for t in batch["text"]]})

    got = sorted((r["label"], bytes(r["bits"]), r["rest"]) for r in by_steps(rows, run, "label int, bits binary, rest double").collect())
    y = np.array([r[0] for r in got], float)
    if len(set(y)) < 2:  # nothing to tell apart
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(kept[:0], np.zeros(0), float(np.log(share / (1 - share))) if len(y) else 0.0)
    x = np.empty((len(got), len(kept) + 1), np.float32)
    for i, r in enumerate(got):
        x[i, :-1] = np.unpackbits(np.frombuffer(r[1], np.uint8), count=len(kept))
        x[i, -1] = r[2]
    w, b = logistic(x, np.append(ratio[kept], 1.0), y)
    prior = np.log(max(known[1][1], 1e-9) / max(known[0][1], 1e-9))  # how much more often label 1 was sampled
    return Model(kept, w[:-1] * ratio[kept], b - float(prior), ratio, float(w[-1]))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of every row's whole text.

    Null and empty texts get the score of no feature at all. Null ids are kept, equal rows are scored
    each, other columns are ignored, an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS ratios, FEATURES weights at most

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": batch["doc_id"], "score": np.array([sent.value.score(t if isinstance(t, str) else None) for t in batch["text"]], float)})

    return by_steps(docs.select(F.col("doc_id").cast("string"), "text"), run, "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = classify(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
