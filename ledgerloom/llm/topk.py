"""Exact top-k inner products of integer vectors, sorted by length and rotated by an SVD.

Vectors are ordered by descending length and cut into blocks. A query first takes its k-th best score
in the head block as a bound; then it meets the other blocks it could still gain from (length times
the block's greatest length reaches the bound). In a block vectors come in descending length; partial
sums over the leading SVD directions plus the product of what is left of both (Cauchy-Schwarz) drop a
pair unless it can reach the bound, the remaining ones are computed exactly in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, staged, table
from .vectors import answers, best_lists, classes, norm, queries_of, usable

SCALE = 1024
HEAD = 1024
BLOCK = 2048
STRIPE = 512
MAX_BLOCKS = 4096
LEADING = 0.5
#: Integers to here are exact as doubles, and so are sums below it.
EXACT = float(1 << 53)


def exact_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row-wise integer inner products of float arrays that hold integers."""
    if np.sqrt((q * q).sum(1).max() * (v * v).sum(1).max()) < EXACT / 2:
        return (q * v).sum(1).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q, v, strict=True)], dtype=np.int64)


def kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    """Of each row the k-th largest; -inf where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def stripe_search(q: np.ndarray, v: np.ndarray, turn: np.ndarray, bound: np.ndarray, k: int, stripe: int = STRIPE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of all pairs that may be among a query's k best; both as integers in floats.

    bound: a score that k vectors are known to reach, of each query; raised as better ones are found.
    """
    order = np.argsort(-(v * v).sum(1), kind="stable")
    lead = max(1, int(LEADING * q.shape[1]))
    qr, vr = q @ turn, v[order] @ turn
    q_len, v_len = np.linalg.norm(q, axis=1), np.linalg.norm(v[order], axis=1)
    q_rest, v_rest = np.linalg.norm(qr[:, lead:], axis=1), np.linalg.norm(vr[:, lead:], axis=1)
    slack = 1e-9 * (q_len * (v_len.max(initial=0) + 1) + 1)  # more than rounding can change
    bound, found = bound.copy(), []
    for a in range(0, len(v), stripe):
        live = np.flatnonzero(q_len * v_len[a] + slack >= bound)
        if not len(live):
            continue  # another query may have a negative bound, but lengths only fall from here
        part = slice(a, a + stripe)
        could = qr[live, :lead] @ vr[part, :lead].T + np.outer(q_rest[live], v_rest[part])
        i, j = np.nonzero(could + slack[live, None] >= bound[live, None])
        if not len(i):
            continue
        i, j = live[i], order[part][j]
        score = exact_products(q[i], v[j])
        good = score >= bound[i]
        i, j, score = i[good], j[good], score[good]
        found.append((i, j, score))
        for x in np.unique(i):
            own = score[i == x]
            if len(own) >= k:
                bound[x] = max(bound[x], np.partition(own, len(own) - k)[len(own) - k])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
    good = score >= bound[i]
    return i[good], j[good], score[good]


def search(vectors: DataFrame, k: int = 10, modulus: int = 100, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by modulus the k others with
    the highest integer inner products of floor(scale * component); ties go to the smaller id.

    Null and ragged vectors, those with null or non-finite components and null ids take no part; zero
    vectors do. A query of fewer others gets them all. Equal integer vectors are searched once; an id
    counts once, with the least of its vectors. An integer or a score that leaves 64 bits is an error.
    An empty table gives no row.
    """
    spark = vectors.sparkSession
    bad = F.raise_error(F.lit("a component is too large for an integer of 64 bits")).cast("double")
    large = float(1 << 62) / scale
    whole = usable(vectors, nonzero=False).select("vec_id", F.transform("v", lambda x: F.when(F.abs(x) < large, F.floor(x * F.lit(float(scale))).cast("double")).otherwise(bad)).alias("v"))
    whole = staged(whole, "integers")
    reps = classes(whole, k + 1)
    asked = queries_of(whole, reps, modulus)
    reps = staged(reps.withColumn("length", norm(F.col("v"))), "lengths")
    n = reps.count()
    empty = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], empty)
    d = len(reps.select("v").first()["v"])

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for batch in batches:
            x = np.stack(batch["v"].to_numpy())
            total += x.T @ x
        yield pd.DataFrame({"i": np.arange(d), "row": list(total)})

    sums = reps.select("v").mapInPandas(gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    square = np.zeros((d, d))
    for r in sums.collect():  # d * d numbers
        square[r["i"], r["j"]] = r["x"]
    _, axes = np.linalg.eigh(square)
    turn = axes[:, ::-1].copy()

    asking = staged(asked.select("rep").distinct().join(reps, "rep").select("rep", "v", "length", "ids"), "asking")
    head = reps.orderBy(F.desc("length"), "rep").limit(HEAD).select("rep", "v", "ids").collect()
    sent = spark.sparkContext.broadcast((np.array([r["rep"] for r in head]), np.array([r["v"] for r in head]), np.array([len(r["ids"]) for r in head])))

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, v, copies = sent.value
        for batch in batches:
            q = np.stack(batch["v"].to_numpy())
            scores = (q @ v.T).astype(float)
            scores -= 1e-9 * (np.abs(scores) + 1)
            bound = kth_best(np.where(ids[None, :] == batch["rep"].to_numpy()[:, None], -np.inf, scores), k)
            yield batch[["rep", "v", "length"]].assign(bound=np.where(np.isfinite(bound), np.floor(bound), -1e300))

    asking = staged(asking.mapInPandas(bounds, "rep long, v array<double>, length double, bound double"), "bounds")
    # blocks by descending length; crowded lengths are dealt over several
    block = max(BLOCK, n // MAX_BLOCKS)
    cuts = -(-n // block)
    edges = sorted(set(reps.agg(F.percentile_approx("length", [i / cuts for i in range(1, cuts)], 20_000)).first()[0] if cuts > 1 else []), reverse=True)
    band = lambda c: F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array().cast("array<double>"), lambda e: e > c))
    banded = reps.select("rep", "v", "length", band(F.col("length")).alias("band"))
    sizes = F.broadcast(banded.groupBy("band").agg(F.ceil(F.count("*") / block).alias("parts")))  # MAX_BLOCKS rows at most
    blocks = banded.join(sizes, "band").select("band", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part"), "rep", "v", "length")
    blocks = staged(blocks, "blocks")
    reach = blocks.groupBy("band", "part").agg(F.max("length").alias("reach"))
    # queries alike in what they can gain from are grouped: by the length that a vector needs to reach their bound
    need = F.col("bound") / F.greatest("length", F.lit(1e-300))
    groups = max(1, -(-asking.count() // BLOCK))
    marks = asking.agg(F.percentile_approx(need, [i / groups for i in range(1, groups)], 20_000)).first()[0] if groups > 1 else []
    near = F.size(F.filter(F.array(*[F.lit(float(m)) for m in sorted(set(marks))]), lambda m: m < need)) if marks else F.lit(0)
    sized = asking.withColumn("n", near.cast("long"))
    crowd = F.broadcast(sized.groupBy("n").agg(F.ceil(F.count("*") / BLOCK).alias("of")))  # a row for each group
    asking = sized.join(crowd, "n").withColumn("g", F.col("n") * (1 << 20) + F.pmod(F.xxhash64("rep"), F.col("of"))).drop("n", "of")
    # each query with the blocks that it can gain from, each block with the groups of such queries
    shelf = reach.agg(F.collect_list(F.struct("band", "part", "reach")).alias("b")).first()["b"]
    places = F.from_json(F.lit("[" + ",".join(f'{{"band":{r["band"]},"part":{r["part"]},"reach":{float(r["reach"])!r}}}' for r in shelf) + "]"), "array<struct<band:int,part:long,reach:double>>")
    useful = F.filter(places, lambda b: b["reach"] * F.col("length") * (1 + 1e-9) + 1 >= F.col("bound"))
    wanted = asking.select("g", "rep", "v", "bound", F.explode(useful).alias("b")).select(F.col("b.band").alias("band"), F.col("b.part").alias("part"), "g", "rep", "v", "bound")
    right = staged(wanted, "wanted")
    pairs = staged(right.select("band", "part", "g").distinct(), "pairs")
    left = blocks.join(broadcast_if_small(pairs, 100_000), ["band", "part"]).select("band", "part", "g", "rep", "v")

    def meet(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(queries):
            return pd.DataFrame({"rep": np.zeros(0, np.int64), "best": []})
        v, q = np.stack(own["v"].to_numpy()), np.stack(queries["v"].to_numpy())
        i, j, score = stripe_search(q, v, turn, queries["bound"].to_numpy(), k + 1)
        best = best_lists(i, own["rep"].to_numpy()[j], score, k + 1)
        return pd.DataFrame({"rep": queries["rep"].to_numpy()[: len(best)], "best": best})

    key = ["band", "part", "g"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, "rep long, best array<struct<n:long,near:long>>")
    return answers(asked, found, reps, k, 1)


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, o.vec_id, list_sum(list_transform(list_zip(q.v, o.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM sound q JOIN sound o ON q.vec_id % 100 = 0 AND o.vec_id <> q.vec_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
