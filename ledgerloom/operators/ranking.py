"""Positions and exact quantiles over all rows, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .staging import staged, staged_path


def numbered(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """df with the position of each row, from 1, in the order of all rows (ties in any order).

    Rows are dealt out by range and numbered within; only the sizes of the ranges are summed up in one place.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = staged(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    before = W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    sizes = parts.groupBy("part_").agg(F.count("*").alias("n_")).select(F.col("part_").alias("of_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    own = F.row_number().over(W.partitionBy("part_").orderBy(*order))
    found = parts.withColumn("own_", own).join(F.broadcast(sizes), F.col("part_") == F.col("of_"))
    return found.withColumn(name, F.col("before_") + F.col("own_")).drop("part_", "of_", "own_", "before_")


class Ranged:
    """Rows dealt out by range of an order and written apart, so that those at given positions are read alone."""

    def __init__(self, df: DataFrame, *order: Column | str):
        self.order = [F.col(o) if isinstance(o, str) else o for o in order]
        parts = df.repartitionByRange(*self.order).withColumn("part_", F.spark_partition_id())
        path = staged_path(df.sparkSession)
        parts.write.partitionBy("part_").parquet(path)
        self.parts = df.sparkSession.read.schema(parts.schema).parquet(path)
        self.before, at = {}, 0  # positions before each range
        for r in sorted(self.parts.groupBy("part_").agg(F.count("*").alias("n")).collect()):  # a row for each range
            self.before[r["part_"]], at = at, at + r["n"]
        self.count = at

    def between(self, first: int, last: int, name: str = "position") -> DataFrame:
        """The rows at the positions first to last, from 1, with these; only their ranges are read and sorted."""
        starts = sorted(self.before.items(), key=lambda x: x[1])
        ends = [b for _, b in starts[1:]] + [self.count] * bool(starts)
        wanted = {p: b for (p, b), end in zip(starts, ends, strict=True) if b < last and end >= first}
        own = F.row_number().over(W.partitionBy("part_").orderBy(*self.order))
        before = F.coalesce(*[F.when(F.col("part_") == p, F.lit(b).cast("long")) for p, b in wanted.items()], F.lit(0).cast("long"))
        rows = self.parts.where(F.col("part_").isin(*wanted)).withColumn(name, before + own)
        return rows.where(F.col(name).between(first, last)).drop("part_")


def nearest_rank(df: DataFrame, value: str, **percents: int) -> DataFrame:
    """One row with the nearest-rank quantile of the non-null values for each name=percent; null if there is none.

    Equal values are one row with their number before anything is dealt out, so no range has more than its share.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n_"))
    parts = staged(counts.repartitionByRange(value).withColumn("part_", F.spark_partition_id()))
    sizes = parts.groupBy("part_").agg(F.sum("n_").alias("n")).collect()  # a row for each range
    n, at, reach = sum(r["n"] for r in sizes), 0, {}
    for r in sorted(sizes):
        reach[r["part_"]], at = at, at + r["n"]
    before = F.coalesce(*[F.when(F.col("part_") == p, F.lit(b).cast("long")) for p, b in reach.items()], F.lit(0).cast("long"))
    upto = before + F.sum("n_").over(W.partitionBy("part_").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    ranked = parts.withColumn("upto_", upto)
    return ranked.agg(*[F.min(F.when(F.col("upto_") >= -(-n * p // 100), F.col(value))).alias(name) for name, p in percents.items()])
