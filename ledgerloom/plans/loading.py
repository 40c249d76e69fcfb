"""Reports on the load job, over snapshots derived from the ledger."""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..operators.staging import shared_dir
from ..sources import derived
from ..sources.store import LANDING, Store
from ..sources.tables import ledger as ledger_of
from ..streaming import load as L, pages, sync
from . import reports


def _ends(rows: DataFrame) -> tuple[date, date]:
    """The first and last day of a ledger; a fixed one if it is empty."""
    a, b = rows.agg(F.min("local_day"), F.max("local_day")).first()
    return (date.fromisoformat(a), date.fromisoformat(b)) if a else (date(2024, 1, 1), date(2024, 1, 1))


def _day(at: date, after: int) -> str:
    return (at + timedelta(days=after)).isoformat()


def _changed(rows: DataFrame) -> DataFrame:
    """A later snapshot: every cost of the third and 29th day is higher, and the twelfth has lost a twentieth of its rows."""
    first, _ = _ends(rows)
    rows = rows.where((F.col("local_day") != _day(first, 11)) | (F.col("id") % 20 != 0))
    return rows.withColumn("cost", F.when(F.col("local_day").isin(_day(first, 2), _day(first, 28)), F.col("cost") + 1).otherwise(F.col("cost")))


def day_digest_changes(spark, sf_dir) -> DataFrame:
    """Days whose totals differ between two snapshots."""
    rows = ledger_of(spark, sf_dir)
    old, new = L.day_digests(rows), L.day_digests(_changed(rows)).select(F.col("day").alias("d"), F.col("digest").alias("now"))
    return old.join(new, F.col("day") == F.col("d")).where("digest <> now").select("day")


def refresh_decision(spark, sf_dir) -> DataFrame:
    """What to pull of the later snapshot, for a state in which every rule fits some day; where upstream serves digests, but
    not of every day, and where it serves none."""
    rows = ledger_of(spark, sf_dir)
    last = _ends(rows)[1]
    day = F.dayofmonth(F.to_date("day"))
    end = F.unix_micros(F.to_timestamp(F.date_add(F.to_date("day"), 1))) * 1000
    state = L.day_digests(rows).select(
        "day", F.when(day % 11 != 0, F.col("digest")).alias("fingerprint"), F.lit(0).cast("long").alias("row_count"),
        F.when(day % 7 == 0, end - 1).when(day % 13 == 0, F.lit(None)).otherwise(end + 1).cast("long").alias("last_sync_ns"), (day % 5 == 0).alias("frozen"),
        (day % 9 == 0).alias("identity_pending"), (day % 16 == 0).alias("compaction_pending"), (day % 17 == 0).alias("metrics_pending"),
    )
    digests = L.day_digests(_changed(rows)).where(F.dayofmonth(F.to_date("day")) % 6 != 1)
    with_, without = (L.refresh_decisions(state, digests, _day(last, 1), True, [_day(last, 0), _day(last, 1)], served).withColumn("served", F.lit(served)) for served in (True, False))
    return with_.unionByName(without)


def _snapshots(spark, sf_dir, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Session metadata before and after: one in five gone, one in seven with a new root, one in eleven new, one in thirteen
    without any identity, one in seventeen with another title."""
    s = derived.sessions(rows).withColumn("h", F.conv(F.substring(F.md5(F.concat("agent", "id").cast("binary")), 1, 4), 16, 10).cast("long"))
    old = s.where("h % 11 <> 0").withColumns({"first_seen_ns": F.col("start_ns"), "last_seen_ns": F.col("last_ns"), "disappeared": F.col("h") % 3 == 0}).drop("h")
    moved, bare = F.col("h") % 7 == 0, F.col("h") % 13 == 0
    identity = {c: F.when(bare, "").otherwise(F.when(moved, "moved").otherwise(F.col(c)) if c == "root_session" else F.col(c)) for c in L.IDENTITY}
    new = s.where("h % 5 <> 0").withColumns(identity | {"title": F.when(F.col("h") % 17 == 0, "edited").otherwise(F.col("title"))}).drop("h")
    return old, new


def snapshot_merge(spark, sf_dir) -> DataFrame:
    old, new = _snapshots(spark, sf_dir, ledger_of(spark, sf_dir))
    out = L.merged_sessions(old, new, 1_800_000_000_000_000_000)
    return out.select("agent", "id", "title", "role", "parent_session", "root_session", "disappeared", F.expr("first_seen_ns div 1000000").alias("first_seen_ms"), F.expr("last_seen_ns div 1000000").alias("last_seen_ms"))


def session_changes(spark, sf_dir) -> DataFrame:
    """What the later snapshot says anew of each session."""
    return L.snapshot_changes(*_snapshots(spark, sf_dir, ledger_of(spark, sf_dir)))


def changed_session_days(spark, sf_dir) -> DataFrame:
    rows = ledger_of(spark, sf_dir)
    return L.days_of_sessions(rows, L.changed_sessions(*_snapshots(spark, sf_dir, rows)))


def _state(spark, sf_dir) -> DataFrame:
    """States of every day but each eighth, and of a day long before; some never loaded, some with a backfill to do."""
    day = F.dayofmonth(F.to_date("day"))
    rows = L.day_digests(ledger_of(spark, sf_dir)).where(day % 8 != 0)
    rows = rows.unionByName(rows.agg(F.min("day").alias("day"), F.min("digest").alias("digest")).where("day IS NOT NULL").select(F.date_format(F.date_sub(F.to_date("day"), 7), "yyyy-MM-dd").alias("day"), "digest"))
    return rows.select(
        "day", F.when(day % 7 != 0, F.col("digest")).alias("fingerprint"), day.cast("long").alias("row_count"), F.when(day % 7 != 0, F.lit(1_700_000_000_000_000_000)).cast("long").alias("last_sync_ns"),
        (day % 5 == 0).alias("frozen"), (day % 3 == 0).alias("identity_pending"), (day % 4 == 0).alias("compaction_pending"), (day % 6 == 0).alias("metrics_pending"),
    )


def candidate_days(spark, sf_dir) -> DataFrame:
    series = L.day_digests(ledger_of(spark, sf_dir)).where("dayofmonth(to_date(day)) > 9").select("day")
    return L.candidate_days(series, _state(spark, sf_dir), _day(_ends(ledger_of(spark, sf_dir))[1], 3))


def verified_days(spark, sf_dir) -> DataFrame:
    """Days as landed, with one row too few on some, against pages whose total moved on others."""
    rows = ledger_of(spark, sf_dir)
    day = F.dayofmonth(F.to_date("day"))
    said = rows.groupBy(F.col("local_day").alias("day")).agg(F.count("*").alias("n"), F.min("id").alias("least"))
    pages = said.select("day", F.explode(F.array(F.col("n"), F.col("n") + F.when(day % 6 == 0, 1).otherwise(0))).alias("total"))
    short = said.where(day % 4 == 0).select(F.col("least").alias("i"))
    return L.verified_days(rows.join(short, F.col("id") == F.col("i"), "left_anti"), pages)


def backfill_flags(spark, sf_dir) -> DataFrame:
    """Days and their pending backfills before changed sessions, after these queued their days, and after a save of even days."""
    state, rows = _state(spark, sf_dir), ledger_of(spark, sf_dir)
    changed = derived.sessions(rows).where("agent = 'codex' AND role = 'subagent' AND id LIKE '%7'").select("id")
    last = _ends(rows)[1]
    queued = L.requeued(state, L.days_of_sessions(rows, changed).select(F.col("local_day").alias("day")))
    done = L.day_digests(rows).where("dayofmonth(to_date(day)) % 2 = 0").select("day", F.col("digest").alias("fingerprint"), F.lit(1).cast("long").alias("row_count"))
    after = L.saved_state(queued, done, 4_000_000_000_000_000_000, _day(last, 3), True)
    out = None
    for step, df in (("before", state), ("queued", queued), ("saved", after)):
        one = L.day_counts(df).withColumn("step", F.lit(step))
        out = one if out is None else out.unionByName(one)
    return out


def day_states(spark, sf_dir) -> DataFrame:
    """The state of each day after even days were saved without identities."""
    rows = ledger_of(spark, sf_dir)
    counts = rows.groupBy(F.col("local_day").alias("d")).agg(F.count("*").alias("row_count"))
    done = L.day_digests(rows).where("dayofmonth(to_date(day)) % 2 = 0").join(counts, F.col("day") == F.col("d")).select("day", F.col("digest").alias("fingerprint"), "row_count")
    after = L.saved_state(_state(spark, sf_dir), done, 4_000_000_000_000_000_000, _day(_ends(rows)[1], 3), False)
    return after.select("day", F.col("fingerprint").isNotNull().alias("loaded"), "row_count", "last_sync_ns", "frozen", "identity_pending", "compaction_pending", "metrics_pending")


_stories: dict[tuple[str, str], tuple[Store, list]] = {}


def story(spark, sf_dir) -> tuple[Store, list]:
    """A store that was loaded from the ledger step by step, and the version after each: sessions; all days; a later
    snapshot of sessions; three days again, the last of them short of a row; a summary; another one; the day before
    the last, short of a row; the last day. Kept for the application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _stories:
        return _stories[key]
    ledger = ledger_of(spark, sf_dir)
    first, last = _ends(ledger)
    today = _day(last, 0)
    landed = F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit(_day(last, 1)))) + 43_200)
    rows, later = (x.withColumns({"landed": landed, "requested": F.lit(""), "served": F.lit("")}).select(*LANDING.fieldNames()) for x in (ledger, _changed(ledger)))
    totals = lambda x, short: x.groupBy(F.col("local_day").alias("day")).agg(F.count("*").alias("n")).select("day", (F.col("n") + F.when(F.col("day") == short, 1).otherwise(0)).alias("total"))
    some = lambda x, *days: x.where(F.col("local_day").isin(*days))
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    old, new = _snapshots(spark, sf_dir, ledger)
    now = lambda hours: int((date.toordinal(last) - 719_163) * 86_400 + hours * 3_600) * 10**9
    again = some(later, _day(first, 2), _day(first, 11), _day(first, 28))
    fingerprint = lambda x: L.summary_fingerprint(x.groupBy("local_day", "agent", "model").agg(F.sum("input").alias("input"), F.sum(F.col("cost").cast("decimal(38,10)")).alias("cost")), ["local_day", "agent", "model", "input", "cost"]).first()[0]
    steps = [sync.save_sessions(store, old, now(37), 0), sync.save_days(store, rows, totals(rows, None), 0, today), sync.save_sessions(store, new, now(38), 1)]
    steps += [sync.save_days(store, again, totals(again, _day(first, 28)), 1, today), sync.note_summary(store, fingerprint(ledger), today), sync.note_summary(store, fingerprint(_changed(ledger)), today)]
    for n, (day, short) in enumerate(((_day(last, -1), _day(last, -1)), (today, None)), 2):
        steps.append(sync.save_days(store, some(rows, day), totals(some(rows, day), short), n, today))
    _stories[key] = store, steps
    return store, steps


def load_story(spark, sf_dir) -> DataFrame:
    """The state of each day after each step of a load: rows, backfill, frozen, waiting rows, whether the summary asks for
    it, and the revision."""
    _, steps = story(spark, sf_dir)
    out = None
    for n, s in enumerate(steps):
        waits = sorted(d for d, x in s.days.items() if x["held"])
        one = s.state().select(F.lit(n).alias("step"), "day", "row_count", "identity_pending", "frozen", F.col("day").isin(*waits).alias("waits"), F.col("day").isin(*s.whole["recent"]).alias("recent"), F.lit(s.whole["revision"]).cast("long").alias("revision"), F.lit(s.whole["complete"]).alias("complete"))
        out = one if out is None else out.unionByName(one)
    return out


def reports_after_reload(spark, sf_dir) -> DataFrame:
    """Reports on the store after days were replaced and sessions merged, from its partial sums: by model, project, day, and
    session."""
    snapshot = story(spark, sf_dir)[1][-1]
    sums = ["calls", "errors", "input", "output", "decode_n", "cost", "total", "output_speed"]
    by = lambda report, df, *key: df.select(F.lit(report).alias("report"), F.concat_ws("|", *key).alias("key"), *sums)
    sessions = reports.session_totals(spark, snapshot)
    of_session = by("session", sessions, "agent", "id", "title", "role", "root_session", "kind", "path", F.col("first_usage_ms").cast("string"), F.col("last_usage_ms").cast("string"))
    out = by("model", reports.model_distribution(spark, snapshot), "model_name").unionByName(by("project", reports.project_distribution(spark, snapshot), "kind", "path"))
    return out.unionByName(by("day", reports.usage_by_day(spark, snapshot), "local_day")).unionByName(of_session)


def stored_threads(spark, sf_dir) -> DataFrame:
    """Usage of threads, which needs the rows themselves, on the store after its days were replaced."""
    return reports.thread_usage(spark, story(spark, sf_dir)[1][-1])


def _pages(spark, sf_dir) -> DataFrame:
    """Pages of each day, some days with a page that is missing, overlaps, is short or names another total, or with an
    earlier or a later pull that lacks a page."""
    each = ledger_of(spark, sf_dir).groupBy(F.col("local_day").alias("day"), F.floor(F.col("id") / 1000).alias("n")).agg(F.count("*").alias("count"))
    of_day = W.partitionBy("day")  # a row for each page
    upto = of_day.orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = each.select("day", (F.sum("count").over(upto) - F.col("count")).alias("offset"), "count", F.sum("count").over(of_day).alias("total"), F.row_number().over(of_day.orderBy("n")).alias("nth"))
    kind, second = F.dayofmonth(F.to_date("day")) % 7, F.col("nth") == 2
    pulls = whole.withColumn("pull", F.explode(F.when(kind.isin(5, 6), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    lacking = second & ((kind == 1) | ((kind == 5) & (F.col("pull") == 1)) | ((kind == 6) & (F.col("pull") == 2)))
    change = lambda k, by: F.when(second & (kind == k), by).otherwise(0)
    return pulls.where(~lacking).select("day", F.col("pull").cast("long").alias("pull"), (F.col("offset") + change(2, -1)).alias("offset"), (F.col("count") + change(4, -1)).alias("count"), (F.col("total") + change(3, 1)).alias("total"))


def landed_pages(spark, sf_dir) -> DataFrame:
    """The pages of each day's latest pull, and the total of those that prove their day."""
    seen = _pages(spark, sf_dir)
    last = pages.latest_pulls(seen).groupBy("day").agg(F.max("pull").alias("pull"), F.count("*").alias("pages"))
    return last.join(pages.proven_pulls(seen).select("day", "total"), "day", "left")


QUERIES = {f.__name__: f for f in (landed_pages, day_digest_changes, refresh_decision, snapshot_merge, session_changes, changed_session_days, candidate_days, verified_days, backfill_flags, day_states, load_story, reports_after_reload, stored_threads)}
