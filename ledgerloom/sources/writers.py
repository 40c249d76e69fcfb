"""Nested results as JSON: nulls stay, times are milliseconds, arrays are in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.measures import ratio
from ..operators.threads import KEY

COUNTED = ("calls", "errors", "input", "output", "cache_read", "cache_write", "cache_write_1h", "reasoning", "unpriced", "retried")
ROLLED = {"self_": "self_usage", "sub_": "subagent_usage", "unknown_": "unknown_usage", "": "inclusive_usage"}


def milliseconds(name: str) -> Column:
    """A column of nanoseconds as milliseconds; null for none."""
    return F.expr(f"{name} div 1000000").alias(name.removesuffix("_ns") + "_ms")


def session_documents(items: DataFrame, efforts: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """key, type, title, last_activity_ms, subagent_count, usage and model_efforts (in their order) of each session.

    items and efforts have derived measures; efforts have their place.
    """
    usage = F.struct(*measures)
    each = F.struct("place", F.col("model_name").alias("model"), "effort", usage.alias("usage"), "compaction_tokens")
    own = efforts.groupBy(*KEY).agg(F.sort_array(F.collect_list(each)).alias("model_efforts"))
    rows = items.join(own, KEY, "left")
    none = F.array().cast(own.schema["model_efforts"].dataType)
    return rows.select(F.struct(*KEY).alias("key"), "type", "title", milliseconds("last_activity"), "subagent_count", usage.alias("usage"), F.coalesce("model_efforts", none).alias("model_efforts"))


def usage(prefix: str = "") -> Column:
    """The usage of a result, of sums whose names begin with prefix; no sum counts as 0, ratios of nothing stay null."""
    of = lambda name: F.coalesce(F.col(prefix + name), F.lit(0))
    prompt = of("input") + of("cache_read") + of("cache_write")
    return F.struct(
        *[of(name).alias(name) for name in COUNTED], (prompt + of("output")).alias("total"), ratio(of("cache_read"), prompt).alias("cache_hit_rate"),
        F.round(of("cost").cast("double"), 6).alias("cost"), ratio(of("decode_out") * 1000.0, of("decode_ms")).alias("output_speed"), of("decode_n").alias("speed_samples"),
    )


def summary_document(summary: DataFrame) -> DataFrame:
    """usage, request_metrics, session_count, session_median and session_p90 of a summary's one row; median and p90 are
    null where no session was used."""
    metrics = {"rm_calls": "calls", "rm_errors": "errors", "rm_retried": "retried", "metric_speed": "output_speed", "rm_samples": "speed_samples", "mean_ttft_s": "mean_ttft_seconds", "rm_ttft_n": "ttft_samples"}
    given = F.struct(*[F.col(c).alias(name) for c, name in metrics.items()])
    return summary.select(usage().alias("usage"), given.alias("request_metrics"), F.col("sessions").alias("session_count"), F.col("median").alias("session_median"), F.col("p90").alias("session_p90"))


def thread_documents(threads: DataFrame, by_bucket: DataFrame, efforts: DataFrame) -> DataFrame:
    """KEY and `thread`, the document of each thread with its own usage: a parent is null where none is known, the times
    are 0 and the list of models empty where nothing was used."""
    each = F.struct("place", F.col("model_name").alias("model"), "effort", usage().alias("usage"), "compaction_tokens")
    lists = efforts.groupBy(*KEY).agg(F.sort_array(F.collect_list(each)).alias("model_effort"))
    none = F.array().cast(lists.schema["model_effort"].dataType)
    rows = threads.join(by_bucket.where("bucket = 'own'").drop("bucket"), KEY, "left").join(lists, KEY, "left")
    at = lambda name: F.coalesce(F.expr(f"{name} div 1000000"), F.lit(0)).alias(name + "_ms")
    parent = F.when(F.col("parent") != "", F.col("parent")).alias("parent_thread_id")
    document = F.struct(
        F.struct(*KEY).alias("key"), "type", parent, F.coalesce("title", F.lit("")).alias("title"), F.coalesce("nickname", F.lit("")).alias("nickname"),
        "project", at("first_usage"), at("last_usage"), F.coalesce("model_effort", none).alias("model_effort"), usage().alias("usage"),
    )
    return rows.select(*KEY, document.alias("thread"))


def list_documents(items: DataFrame, threads: DataFrame) -> DataFrame:
    """position and the document of each item of the session list; threads: of thread_documents."""
    rolled = [usage(prefix).alias(name) for prefix, name in ROLLED.items()]
    return items.select("position", *KEY, *rolled, "has_usage_rows", milliseconds("last_activity"), "subagent_count").join(threads, KEY).drop(*KEY)


def detail_documents(detail: DataFrame, threads: DataFrame, last_activity: DataFrame) -> DataFrame:
    """place and the documents of a thread (place 0, with what it adds up to) and of those below it (from 1, in order),
    a row for each, as they may be many. last_activity: (KEY, last_activity) of listed threads; others have their last usage."""
    top = F.col("place") == 0
    rolled = [F.when(top, usage(prefix)).alias(name) for prefix, name in ROLLED.items()]
    rows = detail.select("place", *KEY, *rolled).join(threads, KEY).join(last_activity.select(*KEY, milliseconds("last_activity"), F.lit(True).alias("listed")), KEY, "left")
    last = F.when(F.col("listed"), F.col("last_activity_ms")).otherwise(F.nullif("thread.last_usage_ms", F.lit(0)))
    return rows.withColumn("last_activity_ms", F.when(top, last)).drop(*KEY, "listed")


def write_documents(documents: DataFrame, path: str) -> None:
    documents.write.option("ignoreNullFields", "false").json(path)
