"""Civil days in a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_day(t_ns: Column, zone: str | Column = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_micros(F.floor(t_ns / 1000)), zone), "yyyy-MM-dd")


def civil_date(text: Column) -> Column:
    """A strict yyyy-mm-dd that exists, else null."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def midnight(day: Column, zone: str | Column) -> Column:
    """The instant at which a local day begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def day_end(day: Column, zone: str | Column) -> Column:
    return midnight(F.date_add(day, 1), zone)


def range_days(name: str, today: Column, first: Column | None = None, last: Column | None = None) -> tuple[Column, Column]:
    """First and last day of a named range; `custom` takes two days as text, null unless both exist in this order."""
    if name == "custom":
        a, b = civil_date(first), civil_date(last)
        return F.when(a <= b, a), F.when(a <= b, b)
    year = F.trunc(today, "year")
    return {
        "today": (today, today),
        "yesterday": (F.date_sub(today, 1), F.date_sub(today, 1)),
        "7d": (F.date_sub(today, 6), today),
        "30d": (F.date_sub(today, 29), today),
        "year": (year.cast("date"), F.date_sub(F.add_months(year, 12), 1)),
    }[name]
