"""The rules of the incremental load by local day: what is verified, pulled again, merged and remembered.

State is a table with a row per day (schemas.DAY_STATE). What has to be pulled again follows from day digests,
backfills and changed summaries. streaming/sync.py applies the rules to landed files and a store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_end
from ..sources.store import DataLoading

FREEZE_DAYS = 7
DIGEST_COLUMNS = ("calls", "input", "cost", "unpriced")
#: The digest of a day without requests.
EMPTY = ""


def day_digests(rows: DataFrame, key: str = "local_day") -> DataFrame:
    """(day, digest): sha256 of a day's totals; numbers as exact text in a fixed order."""
    totals = rows.groupBy(F.col(key).alias("day")).agg(
        F.count("*").alias("calls"), F.sum("input").alias("input"), F.sum(F.col("cost").cast("decimal(38,10)")).alias("cost"),
        F.count_if((F.col("input") + F.col("output") > 0) & ~F.col("priced")).alias("unpriced"),
    )
    text = F.to_json(F.struct("day", *[F.col(c).cast("string").alias(c) for c in DIGEST_COLUMNS]))
    return totals.select("day", F.sha2(text.cast("binary"), 256).alias("digest"))


def summary_fingerprint(groups: DataFrame, columns: list[str]) -> DataFrame:
    """One sha256 of all groups, whatever their order: the sum of their digests' parts, then hashed."""
    each = F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256)
    part = lambda n: F.sum(F.conv(F.substring(each, 1 + 12 * n, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return groups.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[part(n) for n in range(5)]).cast("binary"), 256).alias("fingerprint"))


def proven_pages(pages: DataFrame) -> DataFrame:
    """(day, total) of the days whose pages, as landed (day, offset, count, total), cover 0 to the total with no gap and
    no overlap, all of them naming one total.

    Every page starts one step up and ends one step down: the steps at each offset cancel out but for one up at 0
    and one down at the total exactly if every row is covered once. No task sees all pages of a day.
    """
    said = pages.groupBy("day").agg(F.min("total").alias("total"), F.max("total").alias("high"), F.min("count").alias("least"), F.max("count").alias("most"))
    step = lambda at, up: F.struct(at.alias("at"), F.lit(up).alias("up"))
    edges = pages.where("count > 0").select("day", F.explode(F.array(step(F.col("offset"), 1), step(F.col("offset") + F.col("count"), -1))).alias("e"))
    edges = edges.groupBy("day", F.col("e.at").alias("at")).agg(F.sum("e.up").alias("up")).where("up <> 0")
    ends = edges.groupBy(F.col("day").alias("d")).agg(F.count("*").alias("n"), F.count_if((F.col("at") == 0) & (F.col("up") == 1)).alias("starts"), F.max(F.when(F.col("up") == -1, F.col("at"))).alias("end"))
    found = said.join(ends, F.col("day") == F.col("d"), "left")
    whole = F.when(F.col("total") == 0, F.col("d").isNull() & (F.col("most") == 0)).otherwise((F.col("n") == 2) & (F.col("starts") == 1) & (F.col("end") == F.col("total")))
    return found.where((F.col("total") == F.col("high")) & (F.col("least") >= 0) & F.coalesce(whole, F.lit(False))).select("day", "total")


def verified_days(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(day, ok): whether a day's landed rows are as many as all its pages said. pages: (day, total)."""
    said = pages.groupBy("day").agg(F.min("total").alias("low"), F.max("total").alias("high"))
    found = rows.groupBy(F.col("local_day").alias("d")).agg(F.count("*").alias("n"))
    return said.join(found, F.col("day") == F.col("d"), "left").select("day", ((F.col("low") == F.col("high")) & (F.coalesce("n", F.lit(0)) == F.col("low"))).alias("ok"))


def refresh_decisions(state: DataFrame, digests: DataFrame, today: str | Column, identity_available: bool, recent: list[str], digests_available: bool = True, zone: str = "UTC", horizon: int = FREEZE_DAYS) -> DataFrame:
    """(day, decision, frozen) for every day of the state, the first rule that fits winning.

    digests: (day, digest) as upstream has them now; a day without one can't have changed. digests_available: whether
    upstream serves digests at all; if not, every day that isn't frozen is pulled. recent: days to pull because
    the summary changed, until they are saved.
    """
    today = F.lit(today) if isinstance(today, str) else today
    d = digests.select(F.col("day").alias("dd"), "digest")
    s = state.join(d, F.col("day") == F.col("dd"), "left").drop("dd")
    date = F.to_date("day")
    old = date < F.date_sub(F.to_date(today), horizon)
    ended = F.col("last_sync_ns") > F.unix_micros(day_end(date, zone)) * 1000
    served = F.lit(digests_available)
    freeze = old & F.coalesce(ended, F.lit(False))
    decision = (
        F.when(F.col("compaction_pending"), "pull: compaction").when(F.col("metrics_pending"), "pull: metrics")
        .when(F.lit(identity_available) & F.col("identity_pending"), "pull: identity").when(F.col("fingerprint").isNull(), "pull: never loaded")
        .when(served & (F.col("digest") != F.col("fingerprint")), "pull: changed").when(F.col("frozen"), "skip: frozen").when(freeze, "skip: freeze")
        .when(F.col("last_sync_ns").isNull() | ~served, "pull: unverified").when(F.col("day").isin(*recent), "pull: recent").when(old, "pull: old").otherwise("skip: same")
    )
    return s.select("day", decision.alias("decision"), ((decision == "skip: freeze") | (F.startswith(decision, F.lit("skip")) & F.col("frozen"))).alias("frozen"))


IDENTITY = ("role", "parent_session", "root_session")


def _told(side: str) -> Column:
    """Whether a session of a snapshot says anything of its identity."""
    blank = lambda c: F.coalesce(F.col(f"{side}.{c}"), F.lit("")) == ""
    return ~(blank(IDENTITY[0]) & blank(IDENTITY[1]) & blank(IDENTITY[2]))


def _same(columns: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for c in columns:
        text = c not in ("start_ns", "last_ns")
        side = lambda x, c=c, text=text: F.coalesce(f"{x}.{c}", F.lit("")) if text else F.col(f"{x}.{c}")
        out &= side("o").eqNullSafe(side("n"))
    return out


def _both(old: DataFrame, new: DataFrame, how: str) -> DataFrame:
    return old.alias("o").join(new.alias("n"), (F.col("o.agent") == F.col("n.agent")) & (F.col("o.id") == F.col("n.id")), how)


def tells_identities(new: DataFrame) -> bool:
    """Whether a snapshot says anything of the identity of any codex session."""
    return not new.alias("n").where((F.col("n.agent") == "codex") & _told("n")).isEmpty()


def merged_sessions(old: DataFrame, new: DataFrame, now_ns: int | Column) -> DataFrame:
    """The session table after a snapshot: what the snapshot lacks has disappeared, what it has is updated; role, parent
    and root of a session only if it comes with any of them; the first time seen stays."""
    now = F.lit(now_ns) if isinstance(now_ns, int) else now_ns
    here, had = F.col("n.id").isNotNull(), F.col("o.id").isNotNull()
    take = lambda c: F.when(here, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    known = lambda c: F.when(here & (_told("n") | ~had), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return _both(old, new, "full").select(
        F.coalesce("n.agent", "o.agent").alias("agent"), F.coalesce("n.id", "o.id").alias("id"), *[take(c) for c in ("cwd", "title", "nickname", "start_ns", "last_ns")],
        *[known(c) for c in IDENTITY], F.coalesce("o.first_seen_ns", now).alias("first_seen_ns"),
        F.when(here, now).otherwise(F.col("o.last_seen_ns")).alias("last_seen_ns"), (~here).alias("disappeared"),
    )


def snapshot_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(agent, id, change): sessions of which a snapshot says something new. new, back (had disappeared), gone (newly
    missing), moved (another identity) or edited (title, nickname, cwd or times)."""
    here, had, was_gone = F.col("n.id").isNotNull(), F.col("o.id").isNotNull(), F.coalesce("o.disappeared", F.lit(False))
    change = (
        F.when(~had, "new").when(~here & ~was_gone, "gone").when(here & was_gone, "back").when(here & _told("n") & ~_same(IDENTITY), "moved")
        .when(here & ~_same(("cwd", "title", "nickname", "start_ns", "last_ns")), "edited")
    )
    return _both(old, new, "full").select(F.coalesce("n.agent", "o.agent").alias("agent"), F.coalesce("n.id", "o.id").alias("id"), change.alias("change")).where("change IS NOT NULL")


def changed_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id): of codex sessions that come with an identity that is new or another than before, the session itself and its
    parents and roots, before and now."""
    joined = _both(old, new.where("agent = 'codex'"), "right")
    moved = joined.where(_told("n") & (F.col("o.id").isNull() | ~_same(IDENTITY)))
    ids = F.array("n.id", "o.parent_session", "o.root_session", "n.parent_session", "n.root_session")
    return moved.select(F.explode(ids).alias("id")).where("id <> ''").distinct()


def days_of_sessions(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """Days on which codex requests name a changed session (id) in any of the four columns that can hold one."""
    ids = F.explode(F.array_distinct(F.array("session", "native_session", "subagent", "parent_agent")))
    each = rows.where("agent = 'codex'").select("local_day", ids.alias("sid")).where("sid <> ''").distinct()
    return each.join(changed.select(F.col("id").alias("sid")).distinct(), "sid", "left_semi").select("local_day").distinct()


def day_counts(state: DataFrame) -> DataFrame:
    """One row: days, those never loaded, those frozen and those of each backfill that is pending."""
    flags = ("frozen", "identity_pending", "compaction_pending", "metrics_pending")
    return state.agg(F.count("*").alias("days"), F.count_if(F.col("last_sync_ns").isNull()).alias("never_loaded"), *[F.count_if(f).alias(f) for f in flags])


def all_days_loaded(state: DataFrame, expected: int) -> bool:
    row = day_counts(state).first()
    return row["days"] == expected and row["never_loaded"] == 0


def require_loaded(state: DataFrame, expected: int) -> None:
    """Reports ask this first: DataLoading until every day has been loaded once."""
    if not all_days_loaded(state, expected):
        raise DataLoading(expected)


def candidate_days(series: DataFrame, state: DataFrame, today: str | Column) -> DataFrame:
    """(day): every day from the first of the series (day) or today, whichever is earlier, to today, and every day
    that has a state, which includes those with a pending backfill."""
    today = F.to_date(F.lit(today) if isinstance(today, str) else today)
    ends = series.where("day IS NOT NULL").agg(F.least(F.min(F.to_date("day")), today).alias("first"))
    days = ends.select(F.explode(F.sequence(F.coalesce("first", today), today)).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    return days.unionByName(state.select("day")).distinct()


def requeued(state: DataFrame, days: DataFrame, flag: str = "identity_pending") -> DataFrame:
    """The state with the flag of a backfill set for days (day); days without a state get one."""
    d = days.select(F.col("day").alias("d")).distinct()
    joined = state.join(d, F.col("day") == F.col("d"), "full")
    value = lambda c: (F.coalesce(c, F.lit(False)) | F.col("d").isNotNull() if c == flag else F.coalesce(c, F.lit(False))).alias(c)
    flags = ("frozen", "identity_pending", "compaction_pending", "metrics_pending")
    return joined.select(F.coalesce("day", "d").alias("day"), "fingerprint", F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"), "last_sync_ns", *[value(c) for c in flags])


def saved_state(state: DataFrame, saved: DataFrame, now_ns: int | Column, today: str | Column, identity_available: bool, zone: str = "UTC", horizon: int = FREEZE_DAYS) -> DataFrame:
    """The state after days were saved: (day, fingerprint, row_count) of each.

    A saved day's flags are cleared, that of identities only if these were available; it is frozen if it is older
    than the horizon and its end has passed. Days that failed keep their state.
    """
    now = F.lit(now_ns).cast("long") if isinstance(now_ns, int) else now_ns
    today = F.lit(today) if isinstance(today, str) else today
    new = saved.select(F.col("day").alias("d"), F.col("fingerprint").alias("f"), F.col("row_count").alias("n"))
    joined = state.join(new, F.col("day") == F.col("d"), "full")
    done, date = F.col("d").isNotNull(), F.to_date(F.coalesce("day", "d"))
    freeze = (date < F.date_sub(F.to_date(today), horizon)) & (now > F.unix_micros(day_end(date, zone)) * 1000)
    kept = lambda c: F.coalesce(c, F.lit(False))
    return joined.select(
        F.coalesce("day", "d").alias("day"), F.when(done, F.col("f")).otherwise(F.col("fingerprint")).alias("fingerprint"),
        F.when(done, F.col("n")).otherwise(F.col("row_count")).alias("row_count"), F.when(done, now).otherwise(F.col("last_sync_ns")).alias("last_sync_ns"),
        F.when(done, freeze).otherwise(kept("frozen")).alias("frozen"),
        F.when(done & F.lit(identity_available), False).otherwise(kept("identity_pending")).alias("identity_pending"),
        *[(kept(c) & ~done).alias(c) for c in ("compaction_pending", "metrics_pending")],
    )
