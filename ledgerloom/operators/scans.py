"""What came before a row among the rows of its key, without a task that sees all rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .staging import staged


def latest_before(rows: DataFrame, key: str, order: str, value: str, name: str = "latest") -> DataFrame:
    """rows with the latest non-null value of an earlier row of the same key; null if there is none.

    Rows are dealt out by range of (key, order), so a key of many rows lies in several ranges. Each range is
    scanned by itself; what it ends with is carried to the later ranges of the same key, of which there
    are at most two keys for each range's edge.
    """
    parts = staged(rows.repartitionByRange(key, order).withColumn("part_", F.spark_partition_id()))
    within = W.partitionBy("part_", key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    scanned = parts.withColumn(name, F.last(value, ignorenulls=True).over(within))
    there = F.col(value).isNotNull()
    ends = parts.groupBy("part_", key).agg(F.max_by(F.when(there, F.col(value)), F.when(there, F.col(order))).alias("end_"))
    split = ends.join(ends.groupBy(key).agg(F.count("*").alias("n_")).where("n_ > 1").select(key), key)  # keys over an edge: a row for each range
    earlier = W.partitionBy(key).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    carried = split.select(F.col("part_").alias("of_part_"), F.col(key).alias("of_key_"), F.last("end_", ignorenulls=True).over(earlier).alias("carried_")).where("carried_ IS NOT NULL")
    found = scanned.join(carried, (F.col("part_") == F.col("of_part_")) & (F.col(key) == F.col("of_key_")), "left")
    return found.withColumn(name, F.coalesce(name, "carried_")).drop("part_", "of_part_", "of_key_", "carried_")
