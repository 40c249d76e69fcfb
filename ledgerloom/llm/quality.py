"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are hashed byte trigrams, hashed four-grams of its shape (letters become a or A, digits
0, other characters stay) and one term for its share of distinct words. Log counts, weighted by the
terms' rarity, are mapped to a few latent dimensions by an SVD of a bounded sample of labelled texts.
The sample's vectors are broadcast; every document's exact cosine products with all of them are taken
in blocks, and its nearest vote with their similarities.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_steps, fold, give_back, small_batches, table
from .features import gram_hashes, labelled_sample

BITS = 11
VARIETY = 10
#: Bound of the sample of labelled rows; latent dimensions; voters of a document.
SAMPLE = 4000
DIMENSIONS = 48
NEIGHBOURS = 25
BLOCK = 512
THRESHOLD = 0.3
_SHAPE = bytes(ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c for c in range(256))
WIDTH = 2 * (1 << BITS) + VARIETY + 1


def terms(text: str | None) -> np.ndarray:
    """Log term counts, each of the three kinds scaled to length 1."""
    data, out = (text or "").encode(), np.zeros(WIDTH, np.float32)
    for kind, (content, n) in enumerate(((data, 3), (data.translate(_SHAPE), 4))):
        own = out[kind << BITS : (kind + 1) << BITS]
        for h in gram_hashes(content, n, BITS):
            own += np.bincount(h, minlength=1 << BITS)
        np.log1p(own, out=own)
        own /= max(float(np.linalg.norm(own)), 1e-9)
    words = data.split()
    variety = int(VARIETY * len(set(words)) / len(words)) if words else VARIETY
    out[(2 << BITS) + variety] = 1
    return out


def top_axes(x: np.ndarray, dimensions: int, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration."""
    q = np.random.default_rng(0).normal(size=(x.shape[1], min(dimensions + 10, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    values, turn = np.linalg.eigh((x @ q).T @ (x @ q))
    keep = np.argsort(-values)[:dimensions]
    return np.ascontiguousarray(q @ turn[:, keep[values[keep] > 1e-9 * max(float(values.max()), 1e-30)]])


class Model:
    def __init__(self, weights: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.weights, self.axes, self.vectors, self.labels = weights, axes, vectors, labels

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, in_place: bool = False) -> Model:
        """in_place: x is weighted where it lies, so that there is one copy of the driver's largest array."""
        weights = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + np.float32(0.1)
        weighted = np.multiply(x, weights, out=x if in_place else None)
        axes = top_axes(weighted, dimensions)
        return cls(weights, axes, cls.unit(weighted @ axes), labels.astype(np.float32))

    @staticmethod
    def unit(v: np.ndarray) -> np.ndarray:
        return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def latent(self, x: np.ndarray) -> np.ndarray:
        return self.unit((x * self.weights) @ self.axes)

    def scores(self, texts: list) -> np.ndarray:
        out = [np.zeros(0)]
        for i in range(0, len(texts), BLOCK):
            near = self.latent(np.stack([terms(t) for t in texts[i : i + BLOCK]])) @ self.vectors.T
            k = min(NEIGHBOURS, near.shape[1])
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, top, 1), 1e-6).astype(float)
            out.append((weight * self.labels[top]).sum(1) / weight.sum(1))
        return np.concatenate(out)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model | None:
    rows, _ = labelled_sample(docs, labels, label, sample)

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"label": batch["label"], "x": [terms(t if isinstance(t, str) else None).tobytes() for t in batch["text"]]})

    got = sorted((r["label"], bytes(r["x"])) for r in by_steps(rows, run, "label int, x binary").toLocalIterator())
    if not got:
        return None
    x, own = np.empty((len(got), WIDTH), np.float32), np.array([r[0] for r in got])
    for i in range(len(got)):
        x[i], got[i] = np.frombuffer(got[i][1], np.float32), None
    give_back()
    model = Model.fit(x, own, in_place=True)
    del x
    give_back()
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs and quality_score (0 to 1) of every row's whole text.

    Null and empty texts have no words and are scored as such; without a model every score is 1, so
    that nothing is rejected. Null ids are kept, equal rows are scored each, an empty table gives an
    empty result. A column named quality_score in docs is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SAMPLE vectors, about
    docs = docs.drop("quality_score")

    def of(texts: pa.Array) -> pa.Array:
        """A block of texts at a time becomes Python's."""
        if sent.value is None:
            return pa.array(np.ones(len(texts)))
        blocks = [sent.value.scores(texts.slice(i, BLOCK).to_pylist()) for i in range(0, len(texts), BLOCK)]
        give_back()
        return pa.array(np.concatenate([np.zeros(0), *blocks]))

    return small_batches(docs).withColumn("quality_score", F.arrow_udf(of, "double")(F.col("text")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    value = F.col("quality_score")
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), value.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
