"""Results as nested documents, of a folder of tables or a version of a store: rows ready for writers.write_documents.

A list is a row for each of its items with their place, as it may be long; a summary is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataset as D, measures as M, threads as T
from ..operators.ranking import numbered
from ..sources import writers
from ..sources.store import Snapshot
from . import reports

Source = str | Snapshot


def summary(spark: SparkSession, source: Source, scope: D.Scope = D.Scope()) -> DataFrame:
    return writers.summary_document(reports._summary(reports._items(reports.Ledger(spark, source, scope).threads())))


def models(spark: SparkSession, source: Source, scope: D.Scope = D.Scope()) -> DataFrame:
    sums = reports.Ledger(spark, source, scope).measures.groupBy(F.col("model_name").alias("model")).agg(*M.sums())
    rows = sums.select("model", writers.usage().alias("usage"), F.col("usage.total").alias("total"))
    return numbered(rows, F.desc("total"), "model").drop("total")


def projects(spark: SparkSession, source: Source, scope: D.Scope = D.Scope()) -> DataFrame:
    """path and name are empty where a kind has none."""
    kind, part = F.col("project.kind"), lambda c: F.when(F.col("project.kind") == "project", F.col(f"project.{c}")).otherwise("")
    rows = reports.Ledger(spark, source, scope).measures
    sums = rows.groupBy(kind.alias("kind"), part("path").alias("path")).agg(F.min(part("name")).alias("name"), *M.sums())
    rows = sums.select("kind", "path", "name", writers.usage().alias("usage"), F.col("usage.total").alias("total"))
    return numbered(rows, F.desc("total"), "kind", "path").drop("total")


def options(spark: SparkSession, source: Source) -> DataFrame:
    """What filters can be set to: kind of option, position among those of its kind, and the option of that kind."""
    found = None
    for kind, report, fields in (
        ("agents", reports.filter_options_agents, {"agent": "agent", "display_name": "display_name"}),
        ("models", reports.filter_options_models, {"model_name": "model", "provider": "provider_id", "display_name": "provider_name"}),
        ("projects", reports.filter_options_projects, {"kind": "kind", "path": "path", "name": "name"}),
    ):
        option = F.struct(*[F.col(c).alias(name) for c, name in fields.items()])
        rows = report(spark, source).select(F.lit(kind).alias("of"), "position", option.alias(kind[:-1]))
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found


def _threads(t: reports.Threads) -> DataFrame:
    return writers.thread_documents(t.threads, t.usage, T.model_effort(t.routed))


def sessions(spark: SparkSession, source: Source, scope: D.Scope = D.Scope()) -> DataFrame:
    t = reports.Ledger(spark, source, scope).threads()
    items = numbered(reports._items(t), F.desc_nulls_last("last_activity"), *T.KEY)
    return writers.list_documents(items, _threads(t))


def session(spark: SparkSession, source: Source, key: tuple[str, str, str], scope: D.Scope = D.Scope()) -> DataFrame:
    """key: agent, session and thread; KeyError if there's no such thread."""
    t = reports.Ledger(spark, source, scope).threads()
    found = T.detail(t.rolled, T.children(t.threads, t.usage), key)
    return writers.detail_documents(found, _threads(t), t.listed)
