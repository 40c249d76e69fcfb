"""Language ID by blended-spectrum string kernels.

A text's feature is which hashed n-grams of one to three bytes it has; the kernel is the cosine of two
such presence vectors. Landmarks (Nyström) stand for the training texts; one-versus-rest kernel ridge
regression on them gives a weight per landmark and language. Scoring is two matrix products a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, by_steps, fold, staged, table
from .features import gram_hashes, in_sample

ORDERS = (1, 2, 3)
BITS = 14
#: Bounds of what is learned from: texts of each language, texts of all (but LEAST of each language), landmarks of
#: each language and of all. Every language is learned, however many there are.
PER_LANGUAGE = 500
MAX_TEXTS = 4000
LEAST = 8
LANDMARKS = 32
MAX_LANDMARKS = 2048
RIDGE = 1e-2
BATCH = 256
UND = "und"


def presence(text: str, bits: int = BITS) -> np.ndarray:
    found, data = np.zeros(1 << bits, bool), text.lower().encode()
    for n in ORDERS:
        for h in gram_hashes(data, n, bits):
            found[h] = True
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def has_letter(text) -> bool:
    return isinstance(text, str) and regex.search(r"\p{L}", text) is not None


class Model:
    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.landmarks, self.weights = languages, landmarks, weights

    @classmethod
    def fit(cls, features: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
        """features: bool, a row for each text."""
        languages = sorted(set(langs), key=lambda x: x.encode())
        langs = np.array(langs, dtype=object)
        x = _unit(features)
        each = min(landmarks, max(1, MAX_LANDMARKS // len(languages)))
        at = np.sort(np.concatenate([np.flatnonzero(langs == k)[:each] for k in languages]))
        marks = x[at[:: -(-len(at) // MAX_LANDMARKS)]]
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        kept = values > 1e-6 * values.max()
        root = vectors[:, kept] / np.sqrt(values[kept])
        z = (x @ marks.T).astype(np.float64) @ root
        y = np.where(langs[:, None] == np.array(languages, dtype=object)[None, :], 1.0, -1.0)
        share = 1 / np.array([(langs == k).sum() for k in languages])
        w = np.array([share[languages.index(k)] for k in langs])[:, None]
        w /= w.mean()
        own = np.linalg.solve(z.T @ (w * z) + ridge * len(z) * np.eye(z.shape[1]), z.T @ (w * y))
        return cls(languages, marks, (root @ own).astype(np.float32))

    def scores(self, texts: list[str]) -> np.ndarray:
        out = [np.zeros((0, len(self.languages)), np.float32)]
        for i in range(0, len(texts), BATCH):
            x = np.stack([presence(t) for t in texts[i : i + BATCH]])
            out.append(_unit(x) @ self.landmarks.T @ self.weights)
        return np.concatenate(out)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """From texts with a language outside the held-out fold; of each language at most about per_language."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    counts = staged(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = counts.count()
    if not languages:
        return None
    per_language = min(per_language, max(LEAST, MAX_TEXTS // languages))
    rates = counts.select(F.col("lang").alias("of"), F.least(F.lit(1.0), per_language / F.col("n")).alias("rate"))
    picked = known.join(broadcast_if_small(rates), F.col("lang") == F.col("of")).where(in_sample(F.col("doc_id"), F.col("rate")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[has_letter(t) for t in batch["text"]]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"], "bits": [np.packbits(presence(t)).tobytes() for t in batch["text"]]})

    rows = picked.select(F.col("doc_id").cast("long"), "lang", "text").mapInPandas(run, "doc_id long, lang string, bits binary")
    rows = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["lang"], bytes(r["bits"])))
    if not rows:
        return None
    features = np.stack([np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in rows]).astype(bool)
    return Model.fit(features, [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of every row's whole text.

    Null texts and those without a letter are "und" with score 0; so is every text if nothing could be
    learned. Null ids are kept, equal rows are scored each, other columns are ignored, an empty table
    gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANDMARKS rows of 2**BITS

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        own = sent.value
        pred, score = np.full(len(batch), UND, dtype=object), np.zeros(len(batch))
        at = np.flatnonzero([own is not None and has_letter(t) for t in batch["text"]])
        if len(at):
            s = own.scores([batch["text"].iat[i] for i in at])
            best = s.argmax(1)
            pred[at], score[at] = np.array(own.languages, dtype=object)[best], np.clip((s.max(1) + 1) / 2, 0, 1)
        return pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": pred, "score": score})

    found = by_steps(docs.select(F.col("doc_id").cast("string"), "text"), run, "doc_id string, lang_pred string, score double")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
