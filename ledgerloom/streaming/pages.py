"""Pages of a day's requests as they land, into a store: a day is saved once its pages prove that none is missing.

A pull of a day asks for page after page; each lands as {"day", "pull", "offset", "total", "rows"}. Pages of one pull
may come in several batches. Those of the latest pull count; a gap, an overlap, a total that moved, or a
row that isn't of the day holds the day back until another pull.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schemas import PAGE
from ..sources.store import LANDING, Snapshot, Store
from . import load as L
from .sync import newest, save_days

SEEN = "day string, pull long, offset long, count long, total long, batch long"


def manifest(pages: DataFrame) -> DataFrame:
    """(day, pull, offset, count, total) of pages (PAGE); rows of other days don't count. Pages without a day or pull say nothing."""
    own = F.size(F.filter("rows", lambda r: r["local_day"] == F.col("day")))
    count = F.when(F.col("rows").isNull(), 0).otherwise(own).cast("long")
    return pages.where("day IS NOT NULL AND pull IS NOT NULL").select("day", "pull", "offset", count.alias("count"), "total")


def latest_pulls(seen: DataFrame) -> DataFrame:
    """The pages of each day's latest pull."""
    last = seen.groupBy(F.col("day").alias("of_day")).agg(F.max("pull").alias("of_pull"))
    return seen.join(last, (F.col("day") == F.col("of_day")) & (F.col("pull") == F.col("of_pull"))).drop("of_day", "of_pull")


def proven_pulls(seen: DataFrame) -> DataFrame:
    """(day, pull, total) of the days whose latest pull is whole."""
    last = latest_pulls(seen)
    pulls = last.groupBy(F.col("day").alias("of_day")).agg(F.max("pull").alias("pull"))
    return L.proven_pages(last).join(pulls, F.col("day") == F.col("of_day")).select("day", "pull", "total")


def joined_up(seen: DataFrame, proven: DataFrame) -> DataFrame:
    """What later batches need to know (SEEN): one page for each proven pull, the pages of all other latest pulls."""
    whole = proven.select("day", "pull", F.lit(0).cast("long").alias("offset"), F.col("total").alias("count"), "total", F.lit(None).cast("long").alias("batch"))
    return latest_pulls(seen).join(proven, "day", "left_anti").unionByName(whole)


def save_pages(store: Store, pages: DataFrame, number: int = 0, today: str | None = None, zone: str = "UTC") -> Snapshot:
    """Saves the days whose latest pull became whole with this batch of pages (PAGE and landed), all at once.

    number: of the batch; one that the store has is skipped, one that was cut short starts afresh and gives the
    same. Rows are written once, by day and pull, and read again only when their pull is whole.
    """
    with store.writing() as base:
        before = base.whole["usage_batch"]
        if before >= number:
            return base
        spark, at = store.spark, f"{store.path}/pages"
        pages_at, rows_at, seen_at = (f"{at}/{name}/batch={number}" for name in ("landed", "rows", "seen"))
        manifest(pages).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(pages_at)
        rows = pages.where("pull IS NOT NULL").select("day", "pull", "landed", F.explode("rows").alias("r")).where("r.local_day = day")
        rows.select("r.*", "landed", F.col("day").alias("day_"), F.col("pull").alias("pull_")).write.mode("overwrite").partitionBy("day_", "pull_").parquet(rows_at)
        own = spark.read.schema(SEEN).parquet(pages_at)
        seen = own.unionByName(spark.read.schema(SEEN).parquet(f"{at}/seen/batch={before}")) if before >= 0 else own
        proven = proven_pulls(seen)
        joined_up(seen, proven).write.mode("overwrite").parquet(seen_at)
        touched = own.select("day", "pull").distinct()
        parts = seen.where("count > 0").select("day", "pull", "batch").distinct()
        found = proven.join(touched, ["day", "pull"]).join(parts, ["day", "pull"], "left").collect()  # a row for each day and batch
        folders = [f"{at}/rows/batch={r['batch']}/day_={r['day']}/pull_={r['pull']}" for r in found if r["batch"] is not None]
        good = spark.read.schema(LANDING).parquet(*folders) if folders else spark.createDataFrame([], LANDING)
        totals = spark.createDataFrame(sorted({(r["day"], r["total"]) for r in found}), "day string, total long")
        landed = pages.agg(F.max(F.unix_micros("landed")).alias("landed")).collect()
        return save_days(store, good, totals, number, today, zone, newest(landed))


def page_stream(spark: SparkSession, landing: str, path: str, checkpoint: str, once: bool = True, today: str | None = None, zone: str = "UTC"):
    """Landed pages, a JSON record each, as a stream into the store at path, which no other usage stream may feed."""
    source = spark.readStream.schema(PAGE).json(landing).select("*", F.col("_metadata.file_modification_time").alias("landed"))
    store = Store(spark, path)
    writer = source.writeStream.foreachBatch(lambda batch, number: save_pages(store, batch, number, today, zone)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
