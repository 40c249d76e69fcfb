"""A loaded ledger: immutable folders of rows and partial sums by day, session tables, and one manifest.

A version of the ledger is what one file of the manifest says: the folders of each day, the state of each
day, the session table, the revision and what the load has to remember. Everything else is written first,
to folders that nothing names yet; the manifest's file appears as a whole or not at all. So a reader sees
the old version or the new one, and a load that stops anywhere else leaves the old one.

One load writes at a time; readers are free. vacuum() removes what the last versions don't name.
"""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F, types as T
from pyspark.sql.types import StructType

from ..operators import dataset as D, partials as P
from ..operators.staging import compilable
from .schemas import DAY_STATE, REQUEST, SESSION_STATE

#: What a row of the manifest says of a day; the row without a day is about the whole.
_DAYS = T.ArrayType(T.StringType())
FOLDERS = {"rows": T.StringType(), "cells": T.StringType(), "acts": T.StringType(), "held": _DAYS}
WHOLE = {
    "revision": T.LongType(), "usage_batch": T.LongType(), "session_batch": T.LongType(), "sessions": T.StringType(), "metadata": T.StringType(), "identity_available": T.BooleanType(),
    "identity_started": T.BooleanType(), "complete": T.BooleanType(), "summary": T.StringType(), "recent": _DAYS,
}
MANIFEST = StructType([*DAY_STATE.fields, *[T.StructField(n, t) for n, t in (FOLDERS | WHOLE).items()]])
NOTHING = {"revision": 0, "usage_batch": -1, "session_batch": -1, "identity_available": False, "identity_started": False, "complete": False, "recent": []}
_locks: dict[str, threading.RLock] = {}


class DataLoading(Exception):
    """Some day of the ledger hasn't been loaded yet."""


class Snapshot:
    """A version of a store, as reports read it; later loads don't change it."""

    def __init__(self, store: Store, version: int, days: dict[str, dict], whole: dict):
        self.store, self.spark, self.version, self.days, self.whole = store, store.spark, version, days, whole
        self.path = f"{store.path}@{version}"  # what results of this version can be kept by

    def _between(self, kind: str, schema: StructType, first: str | None, last: str | None) -> DataFrame:
        """The folders of the days between two: no other folder is listed."""
        at = [d[kind] for day, d in sorted(self.days.items()) if d[kind] and (first is None or day >= first) and (last is None or day <= last)]
        at = [f"{self.store.path}/{a}" for a in at]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def state(self, first: str = "0000-01-01", last: str = "9999-12-31") -> DataFrame:
        """The state of each day (schemas.DAY_STATE) between two, both included."""
        rows = [tuple(d[f.name] for f in DAY_STATE.fields) for day, d in self.days.items() if first <= day <= last]
        return self.spark.createDataFrame(rows, DAY_STATE)

    def requests(self, first: str | None = None, last: str | None = None) -> DataFrame:
        return self._between("rows", REQUEST, first, last)

    def held(self, days: list[str]) -> DataFrame:
        """Rows of these days that wait for the rest of their day."""
        at = [f"{self.store.path}/{a}" for day in days for a in (self.days.get(day) or {}).get("held") or []]
        return self.spark.read.schema(LANDING).parquet(*at) if at else self.spark.createDataFrame([], LANDING)

    def sessions(self) -> DataFrame:
        return self._table("sessions", SESSION_STATE)

    @cached_property
    def metadata(self) -> DataFrame:
        """Session metadata merged by family, with its project."""
        return self._table("metadata", D.merged_metadata(self.spark.createDataFrame([], SESSION_STATE)).schema)

    def _table(self, name: str, schema: StructType) -> DataFrame:
        at = self.whole.get(name)
        return self.spark.read.schema(schema).parquet(f"{self.store.path}/{at}") if at else self.spark.createDataFrame([], schema)

    def require_loaded(self) -> Snapshot:
        """Reports ask this first: DataLoading until every day has been loaded once."""
        if not self.whole["complete"]:
            raise DataLoading(self.store.path)
        return self

    def usage(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """Enriched requests."""
        return D.enriched(self.require_loaded().requests(first, last), self.metadata)

    def cells(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """Sums of each day by session, actor, role, provider, model and effort, with the project that metadata gives."""
        return D.with_projects(self.require_loaded()._between("cells", P.cell_schema(self.spark), first, last), self.metadata)

    def acts(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """What each day's rows say of sessions."""
        return self.require_loaded()._between("acts", P.act_schema(self.spark), first, last)


#: Rows as they land, with the time of the file that they came in.
LANDING = StructType.fromJson(REQUEST.jsonValue()).add("landed", "timestamp")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        compilable(spark)
        self.spark, self.path = spark, path.rstrip("/")
        self.lock = _locks.setdefault(self.path, threading.RLock())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The latest version, or one that vacuum() has left."""
        try:
            rows = self.spark.read.schema(StructType([*MANIFEST.fields]).add("version", "long")).parquet(f"{self.path}/manifest")
            version = version if version is not None else rows.agg(F.max("version")).first()[0]
        except AnalysisException:  # no such path: nothing was loaded
            version = None
        if version is None:
            return Snapshot(self, 0, {}, dict(NOTHING))
        found = [r.asDict() for r in rows.where(F.col("version") == version).collect()]  # a row for each day
        whole = next(r for r in found if r["day"] is None)
        return Snapshot(self, version, {r["day"]: r for r in found if r["day"] is not None}, {k: whole[k] for k in WHOLE})

    @contextmanager
    def writing(self):
        """One load at a time: the latest version, to go on from."""
        with self.lock:
            yield self.snapshot()

    def fresh(self, name: str) -> str:
        """A folder, under the store's, that nothing names yet."""
        return f"{name}/{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> str:
        at = self.fresh(name)
        df.write.parquet(f"{self.path}/{at}")
        return at

    def write_days(self, df: DataFrame, name: str) -> str:
        """A folder with one for each local_day, to be named by {folder}/day_={day}."""
        at = self.fresh(name)
        df.withColumn("day_", F.col("local_day")).write.partitionBy("day_").parquet(f"{self.path}/{at}")
        return at

    def commit(self, base: Snapshot, days: dict[str, dict] | None = None, **whole) -> Snapshot:
        """The version after base: what days and whole give is new, the rest as in base. One file is written."""
        none = dict.fromkeys(MANIFEST.fieldNames())
        blank = none | {"row_count": 0, "frozen": False, "identity_pending": False, "compaction_pending": False, "metrics_pending": False}
        all_days = {d: blank | base.days.get(d, {}) | (days or {}).get(d, {}) | {"day": d} for d in {*base.days, *(days or {})}}
        new = base.whole | whole
        rows = [none | new, *({k: v for k, v in d.items() if k not in WHOLE} | dict.fromkeys(WHOLE) for d in all_days.values())]
        version = base.version + 1
        table = self.spark.createDataFrame([tuple(r[f] for f in MANIFEST.fieldNames()) for r in rows], MANIFEST)
        table.coalesce(1).withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(f"{self.path}/manifest")
        return Snapshot(self, version, all_days, new)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes all versions but the last `keep`, and the folders that these don't name. Readers of older versions fail."""
        with self.lock:
            latest = self.snapshot().version
            kept = [self.snapshot(v) for v in range(max(1, latest - keep + 1), latest + 1)]
            used = {a for s in kept for d in s.days.values() for a in (d["rows"], d["cells"], d["acts"], *(d["held"] or [])) if a}
            used |= {s.whole[n] for s in kept for n in ("sessions", "metadata") if s.whole.get(n)}
            of = self.spark._jvm.org.apache.hadoop.fs.Path
            fs = of(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
            children = lambda p: [f.getPath() for f in fs.listStatus(of(p))] if fs.exists(of(p)) else []
            gone = [f"manifest/{p.getName()}" for p in children(f"{self.path}/manifest") if p.getName().startswith("version=") and int(p.getName()[8:]) <= latest - keep]
            for name in ("rows", "cells", "acts", "held", "sessions", "metadata"):
                for p in children(f"{self.path}/{name}"):
                    own = f"{name}/{p.getName()}"
                    if own not in used:
                        inside = [f"{own}/{q.getName()}" for q in children(f"{self.path}/{own}")]
                        gone += [q for q in inside if q not in used] if any(q in used for q in inside) else [own]
            for at in gone:
                fs.delete(of(f"{self.path}/{at}"), True)
            return gone
