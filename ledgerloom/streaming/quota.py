"""The quota keeper as a stream: the last poll that was read, and whether a later one failed, over restarts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quotas as Q
from ..sources.schemas import QUOTA

_ONE = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in QUOTA.fields if f.name != "state")
#: A poll as it lands: what went wrong, or the quotas of all providers.
POLL = f"error string, quotas array<struct<error:string,{_ONE}>>"
KEPT = f"version long, batch long, loaded boolean, {POLL}"


def kept(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of what is kept: one row, or none before the first poll."""
    try:
        rows = spark.read.schema(KEPT).parquet(path)
    except AnalysisException:  # no such path
        return spark.createDataFrame([], KEPT)
    return rows.where(F.col("version") == rows.agg(F.max("version")).first()[0])


def keep(polls: DataFrame, path: str, number: int) -> None:
    """A new version after polls (POLL, landed), the last of which counts: one that was read replaces all, one that failed
    leaves the quotas and sets the error. A batch that the kept version has is skipped."""
    spark = polls.sparkSession
    before = kept(spark, path)
    at = before.select("version", "batch").first()
    if at and at["batch"] >= number:
        return
    none = F.lit(None).cast("timestamp")
    both = before.select(F.lit(0).alias("n"), none.alias("landed"), "loaded", "error", "quotas")
    both = both.unionByName(polls.select(F.lit(1).alias("n"), "landed", (F.coalesce("error", F.lit("")) == "").alias("loaded"), F.coalesce("error", F.lit("")).alias("error"), "quotas"))
    order = F.struct("n", "landed")
    good = F.col("loaded") & (F.coalesce("error", F.lit("")) == "") | (F.col("n") == 0)
    new = both.groupBy().agg(F.bool_or("loaded").alias("loaded"), F.max_by("error", order).alias("error"), F.max_by(F.when(good, F.col("quotas")), F.when(good, order)).alias("quotas"))
    version = at["version"] + 1 if at else 1
    new.select(F.lit(version).alias("version"), F.lit(number).cast("long").alias("batch"), "loaded", "error", "quotas").coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def quota_stream(spark: SparkSession, landing: str, path: str, checkpoint: str, once: bool = True):
    """Landed polls as a stream into the table at path, a file at a time in their order."""
    source = spark.readStream.schema(POLL).option("maxFilesPerTrigger", 1).json(landing).select("error", "quotas", F.col("_metadata.file_modification_time").alias("landed"))
    writer = source.writeStream.foreachBatch(lambda batch, number: keep(batch, path, number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The quotas of the last poll that was read."""
    return kept(spark, path).select(F.explode("quotas").alias("q")).select(F.lit("now").alias("day"), "q.*")


def public_now(spark: SparkSession, path: str) -> DataFrame:
    """The published quota, one row: unavailable if the last poll failed, loading before any was read, else as
    operators.quotas.public_view has it."""
    now = spark.range(1).select(F.lit("now").alias("day"))
    view = Q.public_view(now, current(spark, path))
    feed = kept(spark, path).agg(F.max("error").alias("failed"), F.bool_or("loaded").alias("loaded")).withColumn("day", F.lit("now"))
    failed, loaded = F.coalesce("failed", F.lit("")) != "", F.coalesce("loaded", F.lit(False))
    status = F.when(failed, "unavailable").when(~loaded, "loading").otherwise(F.col("status"))
    known = ~failed & loaded
    return view.join(feed, "day").select(status.alias("status"), *[F.when(known, F.col(c)).alias(c) for c in view.columns if c not in ("day", "status")])
