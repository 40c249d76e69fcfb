"""Near copies by word shingles: SimHash and MinHash find candidates, exact Jaccard similarity decides.

A text is the set of its five-word shingles; texts of equal sets are one class. Classes meet in buckets:
those whose SimHash fingerprints the BK-trees of `simhash` link are one, and since a radius that trees can
search leaves out most pairs of a similarity of 0.8 (they differ in some ten of 64 bits), each of 32 bands of
four MinHashes makes more: of two such classes one band at least agrees but for one pair in 20 million. Equal
buckets of several bands count once. Within a bucket sets are compared exactly, each with all that it is
not yet linked to, and linked sets give one edge each, no pair list; crowded buckets are compared in
blocks. Components follow by alternating stars.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import by_steps, staged
from .simhash import components

SHINGLE = 5
BANDS, ROWS = 32, 4
#: Similarity from which texts are near copies: 4 / 5.
ENOUGH = (4, 5)
#: Sets that one task compares at once, about; a bucket of more is dealt over parts of half as many.
GROUP = 2048
KEY = ("no_id", "id", "h")
_rng = np.random.default_rng(42)
_ADD = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_FACTOR = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, in order; a shorter text is one shingle, a wordless one has none."""
    import xxhash

    found = (text or "").encode().lower().split()
    k = min(words, len(found))
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(found[i : i + k])) for i in range(len(found) - k + 1)] if found else [], np.uint64))


def band_hashes(sets: np.ndarray) -> np.ndarray:
    """A long for each band; none for an empty set."""
    import xxhash

    if not len(sets):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(sets), 2048):
        least = np.minimum(least, ((sets[None, i : i + 2048] ^ _ADD[:, None]) * _FACTOR[:, None]).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), seed) for seed, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def key() -> list[Column]:
    """What rows are told apart and ordered by: null ids last, a hash of the text."""
    return [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("h")]


def profiles(docs: DataFrame) -> DataFrame:
    """(no_id, id, h, c, fp, bands) of every row; c: digest of its set of shingles, fp: SimHash of the set."""
    import xxhash

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t) for t in rows["text"]]
        fp = np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
        return rows[list(KEY)].assign(c=[xxhash.xxh3_128_digest(s.tobytes()) for s in sets], fp=fp, bands=[band_hashes(s) for s in sets])

    return by_steps(docs.select(*key(), "text"), run, "no_id boolean, id long, h long, c binary, fp long, bands array<long>")


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the least position of its component of sets of enough similarity."""
    labels = np.arange(len(sets))
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    first = np.cumsum(size) - size
    has = np.zeros(flat.max() + 1, bool)
    for i in range(len(sets)):
        if (labels == labels[i]).all():
            break
        own = flat[first[i] : first[i] + size[i]]
        has[own] = True
        both = np.add.reduceat(has[flat].astype(np.int64), first)
        has[own] = False
        near = np.isin(labels, labels[both * ENOUGH[1] >= (size + size[i] - both) * ENOUGH[0]])
        labels[near] = labels[near].min()
    return labels


def links(docs: DataFrame, classes: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges (u, v) that connect the classes (c, least, bands) that near copies connect."""
    bands = classes.select("c", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.bit_xor(F.xxhash64("c")).alias("x")).where("n > 1")
    buckets = buckets.groupBy("n", "low", "x").agg(F.min("band").alias("b")).select("b", "n", F.when(F.col("n") > group, F.ceil(F.col("n") * 2 / group)).otherwise(1).alias("parts"))
    members = bands.join(staged(buckets, "buckets"), F.col("band") == F.col("b")).select("c", "b", "parts")
    mine = F.pmod(F.xxhash64("c"), F.col("parts"))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: F.struct(F.least(p, mine).alias("i"), F.greatest(p, mine).alias("j")))
    members = staged(members.select("c", "b", F.explode(others).alias("x")).select("c", F.xxhash64("b", "x.i", "x.j").alias("b")), "members")
    groups = max(1, members.count() // group)

    def sets(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sc": rows["c"], "s": [shingles(t).tobytes() for t in rows["text"]]})

    asked = classes.join(members.select(F.col("c").alias("m")).distinct(), F.col("c") == F.col("m"), "left_semi").select("c", "least.*")
    texts = by_steps(docs.select(*key(), "text").join(asked, list(KEY)).select("c", "text"), sets, "sc binary, s binary")
    texts = staged(texts.dropDuplicates(["sc"]), "sets")
    rows = members.join(texts, F.col("c") == F.col("sc")).select("c", "b", "s", F.pmod(F.xxhash64("b"), F.lit(groups).cast("long")).alias("g"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        u, v = [], []
        for at in frame.groupby("b", sort=False).indices.values():
            c = frame["c"].to_numpy()[at]
            labels = linked([np.frombuffer(s, np.uint64) for s in frame["s"].to_numpy()[at]])
            apart = np.flatnonzero(labels != np.arange(len(at)))
            u += c[apart].tolist()
            v += c[labels[apart]].tolist()
        return pd.DataFrame({"u": u, "v": v})

    return rows.groupBy("g").applyInPandas(run, "u binary, v binary").distinct()


def kept(docs: DataFrame) -> DataFrame:
    """(no_id, id, h, many): the key of the least row of each component, ids first and null ids last;
    many: several rows have that key. All wordless texts are near copies of each other."""
    rows = staged(profiles(docs), "profiles")
    found = rows.groupBy("c").agg(F.min(F.struct(*KEY)).alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    found = staged(found, "classes")
    near = components(simhash.links(found.select("fp").distinct())).select(F.col("node").alias("f"), F.col("root").alias("near"))
    found = found.withColumn("f", F.col("fp")).join(near, "f", "left")
    bands = F.concat(F.coalesce("bands", F.array().cast("array<bigint>")), F.array(F.xxhash64(F.lit("simhash"), F.coalesce("near", "fp"))))
    classes = staged(found.select("c", "least", bands.alias("bands")), "classes")
    roots = components(links(docs, classes)).select(F.col("node").alias("n"), "root")
    least = classes.join(roots, F.col("c") == F.col("n"), "left").groupBy(F.coalesce("root", "c").alias("r")).agg(F.min("least").alias("least"))
    several = rows.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY, F.lit(True).alias("several"))
    return staged(least.select("least.*").join(several, list(KEY), "left").select(*KEY, F.coalesce("several", F.lit(False)).alias("many")), "kept")
