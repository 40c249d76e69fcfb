"""The table of sessions as users page through it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import Ranged

PAGE = 6
FIELDS = ("last_activity", "project", "total", "cost", "cache_hit_rate")


def natural(text: Column) -> Column:
    """A key that orders digits in a text by their value, however many, and letters as Unicode's root collation does."""
    parts = F.regexp_extract_all(text, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    value = lambda p: F.ltrim(p, F.lit("0"))
    key = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(value(p)).cast("string"), 10, "0"), value(p))).otherwise(p))
    return F.collate(F.array_join(key, ""), "UNICODE")


def sort_key(field: str) -> Column:
    """What sessions are compared by; null for sessions without requests, and for other folders than projects."""
    if field == "project":
        return F.when(F.col("project.kind") == "project", F.when(F.col("project.name") != "", natural(F.col("project.name"))))
    return F.col(field) if field == "last_activity" else F.when(F.col("has_usage_rows"), F.col(field))


class Pages:
    """The sessions in the order of a field, dealt out by range: any page is read from its own range alone."""

    def __init__(self, items: DataFrame, field: str = "last_activity", descending: bool = True, size: int = PAGE):
        if field not in FIELDS:
            raise ValueError(f"no such sort field: {field!r}")
        self.size, key = size, F.col("sort_key")
        order = [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.concat_ws("|", "agent", "session_id", "thread_id")]
        self.rows = Ranged(items.withColumn("sort_key", sort_key(field)), *order)
        self.pages = max(1, -(-self.rows.count // size))

    def page(self, number: int = 1) -> DataFrame:
        """Its sessions with their position; a page beyond the last is the last."""
        number = min(max(1, number), self.pages)
        return self.rows.between((number - 1) * self.size + 1, number * self.size)


def page(items: DataFrame, field: str = "last_activity", descending: bool = True, number: int = 1, size: int = PAGE) -> DataFrame:
    """A page of the sessions with their position; nulls are last either way, a page beyond the last is the last."""
    return Pages(items, field, descending, size).page(number)
