"""The tables that reports read: enriched requests by local day, and session metadata."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators import dataset as D
from ..operators.staging import compilable, shared_dir, staged_path
from . import derived
from .readers import read_days

_loaded: dict[tuple[str, str], Tables] = {}
_ledgers: dict[tuple[str, str], tuple] = {}


class Tables:
    """usage: enriched requests, a folder for each local day; metadata: a row for each (family, session)."""

    def __init__(self, spark: SparkSession, sf_dir: str, path: str):
        self.spark, self.path = spark, path
        rows = ledger(spark, sf_dir)
        metadata = D.merged_metadata(derived.sessions(rows))
        metadata.write.parquet(f"{path}/metadata")
        self.metadata = spark.read.schema(metadata.schema).parquet(f"{path}/metadata")
        usage = D.enriched(rows, self.metadata)
        usage.write.partitionBy("local_day").parquet(f"{path}/usage")
        self.schema = usage.schema

    def usage(self, first: str | None = None, last: str | None = None) -> DataFrame:
        return read_days(self.spark, f"{self.path}/usage", self.schema, first, last)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived ledger, written once in an application, and again if it is gone."""
    compilable(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _ledgers:
        path, schema = _ledgers[key]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:  # no such path
            del _ledgers[key]
    rows, path = derived.ledger(spark, sf_dir, dealt=True), staged_path(spark)
    rows.write.parquet(path)
    _ledgers[key] = path, rows.schema
    return spark.read.schema(rows.schema).parquet(path)


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Those of a folder, loaded from its events once in an application, and again if they are gone."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _loaded:
        try:
            _loaded[key].usage()
        except AnalysisException:  # no such path
            del _loaded[key]
    if key not in _loaded:
        _loaded[key] = Tables(spark, sf_dir, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}")
    return _loaded[key]
