"""What the two vector searches share: usable vectors, classes of equal ones, merging of finds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

SALTS = 32
#: The largest double: lengths beyond count as this.
LARGEST = 1.7976931348623157e308


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """(vec_id long, v array<double>) of vectors without null or non-finite components, all of the
    most frequent length (of equally frequent ones the longest). Null ids take no part; of several vectors
    of one id the least does, by its components in order."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(sound)
    if nonzero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    rows = staged(rows, "vectors")
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.where(F.size("v") == common["d"]) if common else rows
    again = staged(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "repeated-ids")
    if again.isEmpty():
        return rows
    least = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    return staged(rows.join(again, "vec_id", "left_anti").unionByName(least), "vectors")


def classes(rows: DataFrame, first: int) -> DataFrame:
    """(rep, v, ids): equal vectors as one, with their smallest id and their `first` smallest ids.

    Equal vectors are dealt over salts first, so that a vector of many rows is no single group.
    """
    head = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, first)
    key = F.xxhash64("v")
    part = rows.groupBy(key.alias("h"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("s")).agg(head(F.collect_list("vec_id")).alias("ids"))
    whole = part.groupBy("h", "v").agg(head(F.flatten(F.collect_list("ids"))).alias("ids"))
    return staged(whole.select(F.element_at("ids", 1).alias("rep"), "v", "ids"), "classes")


def answers(asked: DataFrame, found: DataFrame, reps: DataFrame, k: int, copies: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query.

    asked: (query_id, rep) with the class each query is of. found: (rep, best), of one block of classes
    each, best: array of (n: negative score, near) that holds its k + 1 best classes in order, rep's own
    among them; a class stands in at most `copies` blocks. As every class has a row, k + 1 classes of
    k + 1 ids each are enough for any query.
    """
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, (k + 1) * copies)
    few = found.groupBy("rep").agg(F.slice(F.array_distinct(merged), 1, k + 1).alias("best"))
    each = few.select("rep", F.explode("best").alias("b")).select("rep", "b.n", "b.near")
    each = each.join(reps.select(F.col("rep").alias("near"), "ids"), "near")
    ids = F.transform("ids", lambda i: F.struct(F.col("n").alias("n"), i.alias("vec_id")))
    best = each.groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list(ids))), 1, k + 1).alias("best"))
    mine = asked.join(best.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r"))
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    rows = mine.select("query_id", F.posexplode(others).alias("rank", "x"))
    return rows.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.n")).alias("score"))


def best_lists(query: np.ndarray, near: np.ndarray, score: np.ndarray, most: int) -> list[list[dict]]:
    """For each query in order 0..max the `most` best of its finds as (n, near), best first, ties to the smaller."""
    order = np.lexsort((near, -score, query))
    query, near, score = query[order], near[order], -score[order]
    first = np.searchsorted(query, np.arange(int(query.max(initial=-1)) + 1))
    ends = np.append(first[1:], len(query))
    return [[{"n": n, "near": v} for n, v in zip(score[a : min(b, a + most)].tolist(), near[a : min(b, a + most)].tolist(), strict=True)] for a, b in zip(first, ends, strict=True)]


def queries_of(rows: DataFrame, reps: DataFrame, modulus: int) -> DataFrame:
    """(query_id, rep) of the rows whose id is divisible by modulus."""
    asked = rows.where(F.pmod("vec_id", F.lit(modulus)) == 0).select(F.col("vec_id").alias("query_id"), "v", F.xxhash64("v").alias("h"))
    reps = reps.select("rep", F.col("v").alias("w"), F.xxhash64("v").alias("g"))
    return staged(asked.join(reps, (F.col("h") == F.col("g")) & (F.col("v") == F.col("w"))).select("query_id", "rep"), "queries")


def norm(v: Column) -> Column:
    """Length, scaled by the largest component, so that no square overflows; 0 for zero vectors."""
    most = F.array_max(F.transform(v, F.abs))
    scaled = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / most) * (x / most)))
    return F.when(most > 0, F.least(most * scaled, F.lit(LARGEST))).otherwise(F.lit(0.0))
