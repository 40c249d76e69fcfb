"""The revision feed as a stream: what is told doesn't depend on how the feeds are split into batches.

A row waits until its feed is `lateness` ids ahead, so rows may come in another order by that much. What is kept of a
feed is the last row that was settled and those that wait. Ids that come again, or later than they may, go to a table of
their own and change nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.feeds import ROW, changes
from ..operators.staging import staged

LANDED = "feed long, id long, data_revision long, status_revision long"
STATE = f"{LANDED}, settled boolean"
EVENT = f"{LANDED}, kind string"


def tell(landed: DataFrame, path: str, number: int, lateness: int) -> None:
    """Writes what batch `number` (from 0) tells, what came too late, and what the next batch must know, each to a
    folder of the batch. A batch that runs again gives the same. Of rows of one feed and id the least counts; rows
    without either say nothing."""
    spark = landed.sparkSession
    new = landed.where("feed IS NOT NULL AND id IS NOT NULL").groupBy("feed", "id").agg(F.min(F.struct("data_revision", "status_revision")).alias("p"))
    new = new.select("feed", "id", "p.*", F.lit(False).alias("settled"))
    before = spark.read.schema(STATE).parquet(f"{path}/state/batch={number - 1}") if number else spark.createDataFrame([], STATE)
    last = before.where("settled").select(F.col("feed").alias("of"), F.col("id").alias("last_id"))
    new = staged(new.join(last, F.col("feed") == F.col("of"), "left").drop("of").withColumn("late", F.coalesce(F.col("id") <= F.col("last_id"), F.lit(False))))
    new.where("late").select(*ROW).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
    known = before.unionByName(new.where("NOT late").select(*ROW, "settled"))
    known = known.groupBy("feed", "id").agg(F.min(F.struct("data_revision", "status_revision", "settled")).alias("p")).select("feed", "id", "p.*")
    ahead = known.groupBy(F.col("feed").alias("of")).agg((F.max("id") - lateness).alias("bound"))
    known = staged(known.join(ahead, F.col("feed") == F.col("of")).drop("of").withColumn("due", F.col("settled") | (F.col("id") <= F.col("bound"))))
    due = known.where("due").select(*ROW, "settled")
    changes(due).where("NOT settled").select(*ROW, "kind").write.mode("overwrite").parquet(f"{path}/events/batch={number}")
    edge = due.groupBy("feed").agg(F.max(F.struct(*ROW[1:])).alias("r")).select("feed", "r.*", F.lit(True).alias("settled"))
    edge.unionByName(known.where("NOT due").select(*ROW, F.lit(False).alias("settled"))).write.mode("overwrite").parquet(f"{path}/state/batch={number}")


def told(spark: SparkSession, path: str) -> DataFrame:
    """What batches that are whole have told."""
    try:
        whole = spark.read.schema(f"{STATE}, batch long").parquet(f"{path}/state").agg(F.max("batch")).first()[0]
        return spark.read.schema(f"{EVENT}, batch long").parquet(f"{path}/events").where(F.col("batch") <= F.lit(whole)).drop("batch")
    except AnalysisException:  # no such path
        return spark.createDataFrame([], EVENT)


def revision_stream(spark: SparkSession, landing: str, path: str, checkpoint: str, lateness: int, once: bool = True):
    """Landed rows of feeds (LANDED, a JSON record each) as a stream into the tables at path."""
    source = spark.readStream.schema(LANDED).json(landing)
    writer = source.writeStream.foreachBatch(lambda batch, number: tell(batch, path, number, lateness)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
