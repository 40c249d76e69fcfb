"""Quota snapshots: cards, the public view, and what is kept when reading fails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOWN_FIRST = ("codex", "claude", "copilot")


def cards(quotas: DataFrame) -> DataFrame:
    """day, provider, name, used, remaining, band, rank, delivered of every window that has a card.

    Of copilot only premium windows; used is clamped to 0..100, what remains is rounded half up; providers come
    in a fixed order, the rest last, windows as delivered.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in SHOWN_FIRST]), F.col("provider")), F.lit(0)), F.lit(len(SHOWN_FIRST) + 1))
    each = quotas.select("day", "provider", rank.cast("int").alias("rank"), F.posexplode("windows").alias("delivered", "w"))
    each = each.where((F.col("provider") != "copilot") | F.col("w.name").rlike("(?i)premium"))
    used = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("w.used")))
    each = each.select("day", "provider", F.col("w.name").alias("name"), used.alias("used"), F.floor(100 - used + 0.5).alias("remaining"), "rank", "delivered")
    band = F.when(F.col("remaining") >= 60, "high").when(F.col("remaining") >= 20, "middle").otherwise("low")
    return each.withColumn("band", band)


def _named(name: str):
    return lambda window: window["name"] == name


def public_view(days: DataFrame, quotas: DataFrame) -> DataFrame:
    """The published quota of codex for each snapshot (day): its status, and of those that are ready the first window
    of five hours and of seven days."""
    codex = quotas.where("provider = 'codex'").drop("provider").withColumnRenamed("day", "d")
    rows = days.join(codex, F.col("day") == F.col("d"), "left")
    status = F.when(F.col("d").isNull(), "auth_required").when(F.col("error") != "", "unavailable").otherwise("ready")
    ready = status == "ready"
    out = ["day", status.alias("status"), F.when(ready, F.unix_millis(F.coalesce("read_at", "as_of"))).alias("fetched_ms")]
    for name, label, seconds in (("5 hours", "five_hour", 18_000), ("7 days", "weekly", 604_800)):
        w = F.try_element_at(F.filter("windows", _named(name)), F.lit(1))
        there = ready & w.isNotNull()
        out += [
            F.when(there, w["used"]).alias(f"{label}_used"), F.when(there, 100 - w["used"]).alias(f"{label}_remaining"),
            F.when(there, F.unix_millis(w["resets_at"])).alias(f"{label}_reset_ms"), F.when(there, F.lit(seconds)).alias(f"{label}_seconds"),
        ]
    return rows.select(*out)


def kept(quotas: DataFrame) -> DataFrame:
    """provider, good_day, error, used of each provider's latest snapshot that was read, and whether the latest of all failed."""
    read = F.col("error") == ""
    return quotas.groupBy("provider").agg(
        F.max(F.when(read, F.col("day"))).alias("good_day"), F.max_by("error", "day").alias("error"),
        F.max_by(F.when(read, F.try_element_at("windows", F.lit(1))["used"]), F.when(read, F.col("day"))).alias("used"),
    )
