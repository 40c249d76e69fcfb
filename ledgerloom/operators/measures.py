"""The measures of requests: a column per measure and row, their sums, and what follows from the sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import request as R

COUNTS = ("calls", "errors", "retried", "input", "output", "cache_read", "cache_write", "cache_write_1h", "reasoning", "unpriced", "decode_ms", "decode_out", "decode_n")
METRICS = ("rm_calls", "rm_errors", "rm_retried", "rm_decode_ms", "rm_decode_out", "rm_samples", "rm_ttft_ms", "rm_ttft_n")
ADDITIVE = (*COUNTS, "cost", *METRICS)


def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0).cast("long")


def with_measures(rows: DataFrame) -> DataFrame:
    """Rows of the ledger (with family in `agent`) with a column per measure; cost as an exact decimal."""
    own, met, failed = R.decode_sample(), R.request_decode_sample(F.col("agent")), R.failed()
    rows = rows.withColumns({"own_sample": own, "metric_sample": met, "failed": failed})
    failed, direct, timed = F.col("failed"), ~F.col("handed_on"), ~F.col("failed") & (F.col("ttft_ms") > 0)
    zero = F.lit(0).cast("long")
    return rows.withColumns(
        {
            "calls": F.lit(1).cast("long"), "errors": _flag(failed), "retried": _flag(R.retried()), "unpriced": _flag(R.unpriced()),
            "decode_ms": F.coalesce("own_sample.ms", zero), "decode_out": F.coalesce("own_sample.tokens", zero), "decode_n": _flag(F.col("own_sample").isNotNull()),
            "cost": F.col("cost").cast("decimal(38,10)"),
            "rm_calls": _flag(direct), "rm_errors": _flag(direct & failed), "rm_retried": _flag(direct & R.retried()),
            "rm_decode_ms": F.coalesce("metric_sample.ms", zero), "rm_decode_out": F.coalesce("metric_sample.tokens", zero), "rm_samples": _flag(F.col("metric_sample").isNotNull()),
            "rm_ttft_ms": F.when(timed, F.col("ttft_ms")).otherwise(zero), "rm_ttft_n": _flag(timed),
        }
    ).drop("own_sample", "metric_sample", "failed")


def sums(names=ADDITIVE, only: Column | None = None, prefix: str = "") -> list[Column]:
    pick = lambda n: F.col(n) if only is None else F.when(only, F.col(n))
    return [F.coalesce(F.sum(pick(n)), F.lit(0)).cast("decimal(38,10)" if n == "cost" else "long").alias(prefix + n) for n in names]


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / b, 9))


def derived(df: DataFrame) -> DataFrame:
    """Sums with total, hit rate and speed; cost as a rounded double."""
    prompt = F.col("input") + F.col("cache_read") + F.col("cache_write")
    return df.withColumns(
        {
            "total": prompt + F.col("output"),
            "cache_hit_rate": ratio(F.col("cache_read"), prompt),
            "output_speed": ratio(F.col("decode_out") * 1000.0, F.col("decode_ms")),
            "cost": F.round(F.col("cost").cast("double"), 6),
        }
    )


def metric_view(df: DataFrame) -> DataFrame:
    """Sums of the request metrics as calls, errors, retried, samples, speed and mean seconds to the first token."""
    return df.withColumns(
        {
            "metric_speed": F.when(F.col("rm_samples") > 0, ratio(F.col("rm_decode_out") * 1000.0, F.col("rm_decode_ms"))),
            "mean_ttft_s": F.when(F.col("rm_ttft_n") > 0, F.round(F.col("rm_ttft_ms") / F.col("rm_ttft_n") / 1000, 9)),
        }
    )
