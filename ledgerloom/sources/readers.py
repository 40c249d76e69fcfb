"""Readers of landing files: JSON lines with fixed schemas, malformed records fail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .schemas import LANDED, OVERVIEW, QUOTA, REQUEST, SESSION, SUMMARY


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REQUEST).option("mode", "FAILFAST").json(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots of the form {"sessions": [...]}, a row per session."""
    snapshot = spark.read.schema(f"sessions array<{SESSION.simpleString()}>").option("mode", "FAILFAST").json(path)
    return snapshot.select(F.explode("sessions").alias("s")).select("s.*")


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Requests with the fields that the ledger doesn't keep."""
    return spark.read.schema(LANDED).option("mode", "FAILFAST").json(path)


def wanted_requests(
    rows: DataFrame, day: str | None = None, model: str | None = None, agent: str | None = None, provider: str | None = None, account: str | None = None,
    failed: bool = False, search: str | None = None, via: str | None = None,
) -> DataFrame:
    """Requests that a query of the request list asks for; search: text in the model, the error or a session id."""
    for column, value in (("local_day", day), ("model", model), ("agent", agent), ("provider", provider), ("account", account), ("source", via)):
        if value:
            rows = rows.where(F.col(column) == value)
    if failed:
        rows = rows.where((F.col("status") >= 400) | (F.col("error") != ""))
    if search:
        found = [F.contains(F.lower(c), F.lit(search.lower())) for c in ("model", "error", "session", "native_session", "subagent")]
        rows = rows.where(F.array_contains(F.array(*found), True))
    return rows


def supplemented(quotas: DataFrame, secondary: DataFrame, provider: str, by: list[str]) -> DataFrame:
    """quotas, and the secondary feed's rows of provider for every snapshot (by) that lacks it."""
    have = quotas.where(F.col("provider") == provider).select(*by, "provider").distinct()
    return quotas.unionByName(secondary.where(F.col("provider") == provider).join(have, [*by, "provider"], "left_anti").select(*quotas.columns))


def read_quotas(spark: SparkSession, path: str, secondary: str | None = None, provider: str = "claude") -> DataFrame:
    """The primary feed; where it lacks `provider`, that provider's rows of the secondary one."""
    read = lambda p: spark.read.schema(QUOTA).option("mode", "FAILFAST").json(p)
    return read(path) if secondary is None else supplemented(read(path), read(secondary), provider, [])


def read_summary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(series, groups) of summaries: a row for each point, and one for each group with its kind."""
    rows = spark.read.schema(SUMMARY).option("mode", "FAILFAST").json(path)
    series = rows.select("period", F.explode("series").alias("p")).select("period", "p.*")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("groups")) for k in ("agents", "models", "accounts", "callerKeys")])
    groups = rows.select("period", F.explode(kinds).alias("k")).select("period", "k.kind", F.explode("k.groups").alias("g"))
    return series, groups.select("period", "kind", "g.*")


def read_tools(spark: SparkSession, path: str) -> DataFrame:
    """(calls, name, category, tool_calls) of the overview's tools; calls: of all tools."""
    tools = spark.read.schema(OVERVIEW).option("mode", "FAILFAST").json(path).select("tools.*")
    return tools.select("calls", F.explode("top").alias("t")).select("calls", "t.name", "t.category", F.col("t.calls").alias("tool_calls"))


def read_days(spark: SparkSession, path: str, schema: StructType, first: str | None = None, last: str | None = None) -> DataFrame:
    """A table with a folder for each local day, between two days, both included: a filter on its partition column."""
    rows = spark.read.schema(schema).parquet(path)
    if first is not None:
        rows = rows.where(F.col("local_day") >= first)
    return rows if last is None else rows.where(F.col("local_day") <= last)


def read_ledger(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The ledger as it was loaded, between two local days."""
    return read_days(spark, path, REQUEST, first, last)
