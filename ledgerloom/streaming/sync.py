"""Landed files into a store, as two streams with commits of their own: usage by day, and session snapshots.

Each micro-batch makes one version of the store, or none if it changes nothing. The manifest says which batches it
has, so a batch that runs again after a crash is skipped if it was committed and starts afresh if it
wasn't; times come from the files, so both give the same.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import local_day
from ..operators import dataset as D, partials as P
from ..sources.schemas import DAY_STATE, REQUEST, SESSION
from ..sources.store import LANDING, Snapshot, Store
from . import load as L


def one_a_request(rows: DataFrame) -> DataFrame:
    """A row that comes twice in a day counts once, as it landed last."""
    last = F.max_by(F.struct(*rows.columns), F.struct("landed", "t_ns", "cost"))
    return rows.groupBy("local_day", "id").agg(last.alias("r")).select("r.*")


def queued(base: Snapshot, days: DataFrame) -> dict[str, dict]:
    """The states of days (day) with a pending identity backfill."""
    return {r["day"]: {"identity_pending": True} for r in days.select("day").distinct().collect()}  # days


def save_days(store: Store, rows: DataFrame, pages: DataFrame | None, number: int = 0, today: str | None = None, zone: str = "UTC", now_ns: int = 0) -> Snapshot:
    """Replaces the days of landed rows (LANDING) that their pages (day, total) show to be whole, all at once with their
    state and the revision; rows of other days are held for later batches. Without pages every day counts as whole.

    number: of the batch; one that the store has is skipped. A whole new pull wins over what an earlier one left
    behind. A day that pages say is empty is saved as such. now_ns: the time of the batch, if later than its rows' files.
    """
    with store.writing() as base:
        if base.whole["usage_batch"] >= number:
            return base
        spark = store.spark
        landed_at = store.write_days(rows.select(*LANDING.fieldNames()), "held")
        staged = spark.read.schema(LANDING).parquet(f"{store.path}/{landed_at}/*") if not rows.isEmpty() else spark.createDataFrame([], LANDING)
        met = staged.groupBy("local_day").agg(F.max(F.unix_micros("landed")).alias("landed")).collect()  # a row for each day
        days = sorted(r["local_day"] for r in met)
        now = max(newest(met), now_ns)
        today = today or spark.range(1).select(local_day(F.lit(now).cast("long"), zone)).first()[0]
        alone, both = one_a_request(staged), one_a_request(staged.unionByName(base.held(days)))
        if pages is None:
            good, saved_days = alone, days
        else:
            pages = pages.where(F.col("day").isin(*days) | (F.col("total") == 0))
            passed = lambda r: {x["day"] for x in L.verified_days(r, pages).where("ok").collect()}
            whole, filled = passed(alone), passed(both)
            saved_days = sorted(whole | filled)
            good = alone.where(F.col("local_day").isin(*whole)).unionByName(both.where(F.col("local_day").isin(*(filled - whole))))
            saved_days = [d for d in saved_days if d in days or (base.days.get(d) or {}).get("row_count") != 0 or (base.days.get(d) or {}).get("last_sync_ns") is None]
        changed = {d: {"held": [*((base.days.get(d) or {}).get("held") or []), f"{landed_at}/day_={d}"]} for d in days if d not in saved_days}
        if not saved_days:
            return store.commit(base, changed, usage_batch=number)
        rows_at = store.write_days(good.select(*REQUEST.fieldNames()), "rows")
        some = spark.read.schema(REQUEST).parquet(*[f"{store.path}/{rows_at}/day_={d}" for d in saved_days if d in days]) if set(saved_days) & set(days) else spark.createDataFrame([], REQUEST)
        accepted = D.accepted(some)
        cells_at, acts_at = store.write_days(P.cells(accepted), "cells"), store.write_days(P.acts(accepted), "acts")
        days_in = lambda at: {r["local_day"] for r in spark.read.schema("local_day string").parquet(f"{store.path}/{at}").distinct().collect()} if full else set()
        full = not accepted.isEmpty()
        kept = {n: days_in(at) for n, at in (("cells", cells_at), ("acts", acts_at))}
        counts = some.groupBy(F.col("local_day").alias("d")).agg(F.count("*").alias("row_count"))
        every = spark.createDataFrame([(d,) for d in saved_days], "day string")
        saved = every.join(L.day_digests(some).withColumnRenamed("day", "x"), F.col("day") == F.col("x"), "left").join(counts, F.col("day") == F.col("d"), "left")
        saved = saved.select("day", F.coalesce("digest", F.lit(L.EMPTY)).alias("fingerprint"), F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"))
        state, started = base.state(), base.whole["identity_started"]
        if base.whole["identity_available"] and not started:  # the first time: every day is to be seen with identities
            state, started = L.requeued(state, state.select("day")), True
        after = L.saved_state(state, saved, now, today, base.whole["identity_available"], zone)
        for r in after.collect():  # a row for each day
            own = {f.name: r[f.name] for f in DAY_STATE.fields}
            if r["day"] in saved_days:
                d = r["day"]
                own |= {"rows": f"{rows_at}/day_={d}" if d in days else None, "cells": f"{cells_at}/day_={d}" if d in kept["cells"] else None, "acts": f"{acts_at}/day_={d}" if d in kept["acts"] else None, "held": []}
            changed[r["day"]] = own | {k: v for k, v in changed.get(r["day"], {}).items() if k == "held"}
        recent = [d for d in base.whole["recent"] if d not in saved_days]
        states = {d: base.days.get(d, {}) | x for d, x in changed.items()} | {d: x for d, x in base.days.items() if d not in changed}
        complete = base.whole["complete"] or _all_loaded(states, today)
        revision = base.whole["revision"] + len(saved_days) + (complete and not base.whole["complete"])
        return store.commit(base, changed, usage_batch=number, revision=revision, recent=recent, complete=complete, identity_started=started)


def newest(met: list) -> int:
    """The time of the newest file, in nanoseconds; 0 if none has one."""
    return max((r["landed"] * 1000 for r in met if r["landed"] is not None), default=0)


def _all_loaded(states: dict[str, dict], today: str) -> bool:
    """Whether every day from the first to today has been loaded."""
    loaded = {d for d, x in states.items() if x.get("last_sync_ns") is not None}
    at, last = date.fromisoformat(min(states)), date.fromisoformat(today)
    while at <= last:
        if at.isoformat() not in loaded:
            return False
        at += timedelta(days=1)
    return all(d in loaded for d in states if d <= today)


def save_sessions(store: Store, snapshot: DataFrame, now_ns: int, number: int = 0) -> Snapshot:
    """Merges a snapshot of sessions (SESSION) into the session table, queues the days of changed identities, and raises
    the revision if the snapshot says anything new; all at once. number: as in save_days."""
    with store.writing() as base:
        if base.whole["session_batch"] >= number:
            return base
        spark = store.spark
        new = snapshot.select(*SESSION.fieldNames()).dropDuplicates(["agent", "id"])
        old, new_at = base.sessions(), store.write(new, "sessions")
        new = spark.read.schema(SESSION).parquet(f"{store.path}/{new_at}")
        table_at = store.write(L.merged_sessions(old, new, now_ns), "sessions")
        metadata_at = store.write(D.merged_metadata(spark.read.parquet(f"{store.path}/{table_at}")), "metadata")
        days = queued(base, L.days_of_sessions(base.requests(), L.changed_sessions(old, new)).withColumnRenamed("local_day", "day")) if base.whole["identity_started"] else {}
        changed = not L.snapshot_changes(old, new).isEmpty()
        return store.commit(base, days, session_batch=number, sessions=table_at, metadata=metadata_at, identity_available=L.tells_identities(new), revision=base.whole["revision"] + changed)


def note_summary(store: Store, fingerprint: str, today: str) -> Snapshot:
    """Remembers the fingerprint of the summary; if it is another than before, today and the day before are to be pulled
    until a save of theirs succeeds."""
    with store.writing() as base:
        before, recent = base.whole["summary"], set(base.whole["recent"])
        if before is not None and before != fingerprint:
            recent |= {today, (date.fromisoformat(today) - timedelta(days=1)).isoformat()}
        recent = sorted(d for d in recent if d <= today)
        if before == fingerprint and recent == base.whole["recent"]:
            return base
        return store.commit(base, summary=fingerprint, recent=recent)


def decisions(snapshot: Snapshot, digests: DataFrame, today: str, digests_available: bool = True, zone: str = "UTC") -> DataFrame:
    """What of the days of a store has to be pulled (load.refresh_decisions)."""
    w = snapshot.whole
    return L.refresh_decisions(snapshot.state(), digests, today, bool(w["identity_available"]), w["recent"], digests_available, zone)


def usage_stream(spark: SparkSession, landing: str, path: str, checkpoint: str, pages: Callable[[], DataFrame] | None = None, once: bool = True, today: str | None = None, zone: str = "UTC"):
    """Landed JSON requests as a stream into the store at path; pages gives (day, total) of every page of each day's
    latest pull as they are when a batch runs (load.proven_pages makes them of landed page manifests)."""
    source = spark.readStream.schema(REQUEST).json(landing).select("*", F.col("_metadata.file_modification_time").alias("landed"))
    store = Store(spark, path)
    writer = source.writeStream.foreachBatch(lambda batch, number: save_days(store, batch, pages() if pages else None, number, today, zone)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def session_stream(spark: SparkSession, landing: str, path: str, checkpoint: str, once: bool = True):
    """Landed snapshots {"sessions": [...]} as a stream into the store at path, a file at a time, in their order."""
    kind = f"sessions array<{SESSION.simpleString()}>"
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(landing).select("sessions", F.col("_metadata.file_modification_time").alias("landed"))
    store = Store(spark, path)

    def save(batch: DataFrame, number: int) -> None:
        landed = batch.agg(F.max(F.unix_micros("landed")).alias("landed")).collect()
        save_sessions(store, batch.select(F.explode("sessions").alias("s")).select("s.*"), newest(landed), number)

    writer = source.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
