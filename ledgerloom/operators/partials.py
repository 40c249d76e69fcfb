"""Partial sums of a day's requests, merged by reports instead of rows.

They don't depend on session metadata: a later session table changes no partial.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.schemas import REQUEST
from . import dataset as D
from .measures import sums

#: What reports group and filter by.
CELL = ("local_day", "agent", "resolved_id", "actor_id", "role", "provider", "model_name", "effort")


def cells(accepted: DataFrame) -> DataFrame:
    """The sums of accepted requests by day, session, actor, role, provider, model and effort."""
    return accepted.groupBy(*CELL).agg(*sums())


def acts(accepted: DataFrame) -> DataFrame:
    """What the accepted requests of each day say of sessions."""
    return D.session_acts(accepted, "local_day")


@lru_cache(maxsize=4)
def cell_schema(spark: SparkSession) -> StructType:
    return cells(D.accepted(spark.createDataFrame([], REQUEST))).schema


@lru_cache(maxsize=4)
def act_schema(spark: SparkSession) -> StructType:
    return acts(D.accepted(spark.createDataFrame([], REQUEST))).schema
