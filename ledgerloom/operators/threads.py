"""Threads of sessions: which thread a request belongs to, and roll-ups over subagents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.request import SUBAGENT_KINDS
from .measures import ADDITIVE, sums
from .scans import latest_before
from .staging import staged

KEY = ["agent", "session_id", "thread_id"]
#: The order of rows within the data set.
ORDER = ("t_ns", "agent", "resolved_id", "subagent", "provider", "model", "effort", "id")
#: What is read of rows besides; they are written again with their threads.
NEEDED = (*ORDER, "session", "role", "kind", "parent_agent", "project", "compaction", "model_name", *ADDITIVE)


def routed(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows of known sessions with their thread (session_id, thread_id), bucket and activity session.

    Requests of unknown role follow the latest thread that an earlier row gave to their session id, else
    the one that the sessions give; a scan in order finds it, in parts where an id has many rows.
    """
    s = sessions.select(F.col("agent").alias("sa"), F.col("id").alias("si"), F.col("role").alias("s_role"), F.col("project").alias("s_project"))
    rows = rows.join(s, (F.col("agent") == F.col("sa")) & (F.col("resolved_id") == F.col("si"))).drop("sa", "si")
    codex = sessions.where(F.col("agent") == "codex")
    names = {"id": "actor", "root_session": "a_root", "parent_session": "a_parent", "title": "a_title", "nickname": "a_nick", "project": "a_project"}
    actor = codex.select(*[F.col(c).alias(n) for c, n in names.items()])
    is_codex, role = F.col("agent") == "codex", F.col("role")
    sub = is_codex & (role == "subagent")
    rows = rows.join(actor, sub & (F.col("subagent") == F.col("actor")), "left")
    root = F.coalesce("a_root", F.lit(""))
    anchor = F.when(F.col("session") != "", F.col("session")).when(root != "", root).otherwise(F.col("subagent"))
    # requests that look a thread up: by their session id
    lost = F.when(F.col("session") != "", F.col("session")).otherwise(F.col("resolved_id"))
    seeks = F.when(is_codex & (role == "unknown"), lost).when(is_codex & (role == "") & (F.col("s_role") != ""), F.col("resolved_id"))
    rows = rows.withColumns({"anchor": F.when(sub, anchor), "seeks": seeks, "ord": F.struct(*ORDER)})
    told = F.when(sub, F.array_distinct(F.array("anchor", "subagent"))).when(F.col("seeks").isNotNull(), F.array("seeks"))
    looks = rows.select("id", "ord", "anchor", "seeks", F.explode(told).alias("of"))
    start = codex.select(F.col("id").alias("of"), F.when((F.col("role") == "subagent") & (F.col("root_session") != ""), F.col("root_session")).otherwise(F.col("id")).alias("start"))
    named = codex.where((F.col("role") == "subagent") & (F.col("root_session") != "")).select(F.col("root_session").alias("of"), F.col("root_session").alias("start"))
    start = named.unionByName(start.join(named.select("of"), "of", "left_anti")).distinct()
    seen = latest_before(looks, "of", "ord", "anchor").where(F.col("seeks").isNotNull())
    seen = seen.join(start, "of", "left").select(F.col("id").alias("seeker"), F.coalesce("latest", "start").alias("mapped"))
    # only rows that seek are dealt out by their ids; the others stay where they are
    sought = rows.where(F.col("seeks").isNotNull()).join(seen, F.col("id") == F.col("seeker"), "left").drop("seeker")
    rows = rows.where(F.col("seeks").isNull()).withColumn("mapped", F.lit(None).cast(seen.schema["mapped"].dataType)).unionByName(sought)
    claude_sub = (F.col("agent") == "claude") & (F.col("subagent") != "")
    is_main, sought, own = is_codex & (role == "main"), F.col("seeks").isNotNull(), F.col("resolved_id")
    session_id = F.when(is_main, F.col("session")).when(sub, F.col("anchor")).when(sought, F.coalesce("mapped", "seeks")).otherwise(own)
    thread_id = F.when(claude_sub | sub, F.col("subagent")).when(is_main, F.col("session")).when(sought, F.col("seeks")).otherwise(own)
    legacy = is_codex & (role == "") & F.col("kind").isin(*SUBAGENT_KINDS)
    bucket = F.when(F.col("seeks").isNotNull(), "unknown").when(legacy, "legacy").otherwise("own")
    return rows.withColumns({"session_id": session_id, "thread_id": thread_id, "bucket": bucket, "claude_sub": claude_sub, "codex_sub": sub})


def _claims(rows: DataFrame, n: int, type_, session, thread, order=None, title="", nickname="", project=None, parent="") -> DataFrame:
    """What rows say of a thread. n and order tell which claim comes first; blank fields say nothing."""
    column = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.struct(F.lit("").alias("kind"), F.lit("").alias("path"), F.lit("").alias("name"))
    start = F.struct(*[F.lit(0).cast("long").alias(c) if c in ("t_ns", "id") else F.lit("").alias(c) for c in ORDER])
    return rows.select(
        "agent",
        session.alias("session_id"),
        thread.alias("thread_id"),
        column(type_).alias("type"),
        column(title).alias("title"),
        column(nickname).alias("nickname"),
        (none if project is None else project).alias("project"),
        column(parent).alias("parent"),
        F.struct(F.lit(n).alias("n"), (start if order is None else order).alias("o")).alias("ord"),
    )


def _claimed(routed_rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """All claims: of the sessions, of the roots they name, and of the rows."""
    session, thread, order, blank = F.col("session_id"), F.col("thread_id"), F.col("ord"), F.lit("")
    root, own = F.col("root_session"), F.col("id")
    is_codex = F.col("agent") == "codex"
    is_sub = is_codex & (F.col("role") == "subagent")
    kind = F.when(is_sub, "subagent").when(is_codex & (F.col("role") == "unknown"), "unknown").otherwise("main")
    above = F.when(is_sub & (root != ""), root).otherwise(own)
    parent = F.when(is_sub, F.col("parent_session")).otherwise("")
    of_sessions = _claims(sessions, 0, kind, above, own, title=F.col("title"), nickname=F.col("nickname"), project=F.col("project"), parent=parent)
    of_roots = _claims(sessions.where(is_sub & (root != "")), 1, "main", root, root).distinct()

    title, nickname = F.coalesce("a_title", blank), F.coalesce("a_nick", blank)
    project = F.when(F.col("claude_sub"), F.col("s_project")).when(F.col("actor").isNotNull(), F.col("a_project")).otherwise(F.col("project"))
    of_subs = _claims(routed_rows.where("claude_sub OR codex_sub"), 2, "subagent", session, thread, order, title, nickname, project)
    anchored = F.col("codex_sub") & (session != thread)
    of_mains = _claims(routed_rows.where(is_codex & ((F.col("role") == "main") | anchored)), 2, "main", session, session, order)
    of_lost = _claims(routed_rows.where("seeks IS NOT NULL AND mapped IS NULL"), 2, "unknown", session, thread, order)
    return of_sessions.unionByName(of_roots).unionByName(of_subs).unionByName(of_mains).unionByName(of_lost)


def threads(routed_rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """A row per thread: type, title, nickname, project, parent. What comes first in order wins."""
    first = lambda c: F.coalesce(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("ord"))), F.lit(""))
    found = F.col("project.kind") != "unknown"
    project = F.min_by(F.when(found, F.col("project")), F.when(found, F.col("ord")))
    out = _claimed(routed_rows, sessions).groupBy(*KEY).agg(
        F.min_by("type", "ord").alias("type"),
        F.max(F.col("type") == "main").alias("a_main"),
        first("title").alias("title"),
        first("nickname").alias("nickname"),
        F.coalesce(project, F.min_by("project", "ord")).alias("project"),
        first("parent").alias("parent"),
    )
    out = out.withColumn("type", F.when((F.col("type") == "unknown") & F.col("a_main"), "main").otherwise(F.col("type"))).drop("a_main")
    given = parents(routed_rows).select(*[F.col(k).alias(f"g_{k}") for k in KEY], F.col("parent").alias("given"))
    same = [F.col(k) == F.col(f"g_{k}") for k in KEY]
    return out.join(given, same, "left").withColumn("parent", F.coalesce("given", "parent")).drop("given", *[f"g_{k}" for k in KEY])


def parents(routed_rows: DataFrame) -> DataFrame:
    """(thread, parent, n_parents) of threads whose rows name a parent; several different ones leave it blank."""
    named = F.when(F.col("codex_sub"), F.array(F.coalesce("a_parent", F.lit("")), F.col("parent_agent"))).otherwise(F.array("parent_agent"))
    rows = routed_rows.where("claude_sub OR codex_sub").select(*KEY, F.explode(named).alias("p")).where(F.col("p") != "").distinct()
    out = rows.groupBy(*KEY).agg(F.count("*").alias("n_parents"), F.min("p").alias("p"))
    return out.select(*KEY, F.when(F.col("n_parents") == 1, F.col("p")).otherwise("").alias("parent"), "n_parents")


def usage(routed_rows: DataFrame) -> DataFrame:
    """Measures per thread and bucket, with first and last time."""
    return routed_rows.groupBy(*KEY, "bucket").agg(*sums(), F.min("t_ns").alias("first_usage"), F.max("t_ns").alias("last_usage"))


def model_effort(routed_rows: DataFrame) -> DataFrame:
    """Own measures per thread, model and effort; compaction tokens of codex threads: null if unknown for any row."""
    own = routed_rows.where("bucket = 'own'")
    used = F.when(F.col("compaction"), F.col("input") + F.col("cache_read") + F.col("cache_write") + F.col("output")).otherwise(0)
    tokens = F.when((F.first("agent") == "codex") & ~F.bool_or(F.col("compaction").isNull()), F.sum(used))
    found = own.groupBy(*KEY, "model_name", "effort").agg(*sums(), tokens.alias("compaction_tokens"))
    order = W.partitionBy(*KEY).orderBy((F.col("input") + F.col("output")).desc(), "model_name", "effort")
    return found.withColumn("place", F.row_number().over(order))


def descendants(all_threads: DataFrame) -> DataFrame:
    """(agent, session_id, top, thread_id): each subagent with all subagents below it, by parent ids.

    Pairs up to a distance of 2**k join the threads that are 2**k below, so depth doubles with each round; without
    cycles every pair is made once. Cycles end as soon as a round finds no new pair.
    """
    of = ["agent", "session_id"]
    subs = all_threads.where("type = 'subagent'").select(*KEY, "parent")
    known = subs.select(*of, F.col("thread_id").alias("parent"))
    jump = staged(subs.where("parent <> ''").join(known, [*of, "parent"], "left_semi").select(*of, "thread_id", F.col("parent").alias("up")))
    every = jump.select(*of, F.col("up").alias("top"), "thread_id")
    while not jump.isEmpty():
        above = every.select(*of, "top", F.col("thread_id").alias("up"))
        new = jump.join(above, [*of, "up"]).select(*of, "top", "thread_id").distinct()
        new = staged(new.join(every, [*of, "top", "thread_id"], "left_anti"))
        if new.isEmpty():
            break
        every = every.unionByName(new)
        further = jump.select(*of, F.col("thread_id").alias("up"), F.col("up").alias("further"))
        jump = staged(jump.join(further, [*of, "up"]).select(*of, "thread_id", F.col("further").alias("up")))
    return every.where("top <> thread_id")


def children(all_threads: DataFrame, by_bucket: DataFrame) -> DataFrame:
    """(agent, session_id, top, thread_id, last_usage, place): the threads below each, that used last first.

    Below a main thread are all subagents of its session, below a subagent those that descend from it.
    """
    subs = all_threads.where("type = 'subagent'").select(*KEY)
    flat = subs.join(all_threads.where("type = 'main'").select("agent", "session_id", F.col("thread_id").alias("top")), ["agent", "session_id"])
    pairs = flat.select("agent", "session_id", "top", "thread_id").unionByName(descendants(all_threads).join(subs, KEY).select("agent", "session_id", "top", "thread_id"))
    used = by_bucket.where("bucket = 'own'").groupBy(*KEY).agg(F.max("last_usage").alias("last_usage"))
    order = W.partitionBy("agent", "session_id", "top").orderBy(F.desc_nulls_last("last_usage"), "thread_id")
    return pairs.join(used, KEY, "left").withColumn("place", F.row_number().over(order))


def detail(rolled: DataFrame, below: DataFrame, key: tuple[str, str, str]) -> DataFrame:
    """The roll-ups of a thread (place 0) and of the threads below it, in their order; KeyError if there's no such thread."""
    agent, session, thread = key
    of = lambda df, column: df.where((F.col("agent") == agent) & (F.col("session_id") == session) & (F.col(column) == thread))
    own = of(rolled, "thread_id").withColumn("place", F.lit(0))
    if own.isEmpty():
        raise KeyError(key)
    return own.unionByName(rolled.join(of(below, "top").select(*KEY, "place"), KEY))


def rollups(all_threads: DataFrame, by_bucket: DataFrame) -> DataFrame:
    """Per thread: measures of itself (self_), its subagents (sub_), unknown requests (unknown_), all (no prefix), and n_children."""
    own = by_bucket.groupBy(*KEY).agg(*[c for b in ("own", "unknown") for c in sums(ADDITIVE, F.col("bucket") == b, f"{b}_")])
    t = all_threads.select(*KEY, "type").join(own, KEY, "left")
    t = t.select(*KEY, "type", *[F.coalesce(f"{b}_{n}", F.lit(0)).alias(f"{b}_{n}") for b in ("own", "unknown") for n in ADDITIVE])
    t = staged(t)
    subs = t.where("type = 'subagent'")
    flat = subs.join(t.where("type = 'main'").select("agent", "session_id", F.col("thread_id").alias("top")), ["agent", "session_id"])
    below = descendants(all_threads).join(subs, KEY)
    cols = ["agent", "session_id", "top", *[f"{b}_{n}" for b in ("own", "unknown") for n in ADDITIVE]]
    children = flat.select(*cols).unionByName(below.select(*cols)).groupBy("agent", "session_id", "top").agg(F.count("*").alias("n_children"), *[F.sum(f"{b}_{n}").alias(f"child_{b}_{n}") for b in ("own", "unknown") for n in ADDITIVE])
    legacy = by_bucket.where("bucket = 'legacy'").groupBy("agent", "session_id").agg(*sums(prefix="legacy_"))
    children = children.withColumnRenamed("top", "thread_id")
    t = t.join(children, KEY, "left").join(legacy, ["agent", "session_id"], "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    is_unknown, is_main = F.col("type") == "unknown", F.col("type") == "main"
    out = [*KEY, "type", z("n_children").alias("n_children")]
    for n in ADDITIVE:
        kind = "decimal(38,10)" if n == "cost" else "long"
        own_, unk = F.col(f"own_{n}"), F.col(f"unknown_{n}")
        me = F.when(is_unknown, 0).otherwise(own_)
        sub = F.when(is_unknown, 0).otherwise(z(f"child_own_{n}") + F.when(is_main, z(f"legacy_{n}")).otherwise(0))
        lost = unk + F.when(is_unknown, 0).otherwise(z(f"child_unknown_{n}"))
        out += [me.cast(kind).alias(f"self_{n}"), sub.cast(kind).alias(f"sub_{n}"), lost.cast(kind).alias(f"unknown_{n}"), (me + sub + lost).cast(kind).alias(n)]
    return t.select(*out)


def session_items(all_threads: DataFrame, routed_rows: DataFrame, sessions: DataFrame, rolled: DataFrame) -> DataFrame:
    """The list of sessions: threads at the top with their roll-up, last activity and number of subagents."""
    mains = all_threads.where("type = 'main' AND thread_id = session_id").select("agent", "session_id").distinct()
    hidden = all_threads.where("type = 'subagent'").join(mains, ["agent", "session_id"], "left_semi").select(*KEY)
    top = rolled.join(hidden, KEY, "left_anti")
    labels = all_threads.select(*KEY, "title", "nickname", "project", "parent")
    active = F.when(F.col("seeks").isNotNull() | F.col("codex_sub"), F.col("session_id")).otherwise(F.col("resolved_id"))
    activity = routed_rows.groupBy("agent", active.alias("session_id")).agg(F.max("t_ns").alias("row_time"), F.countDistinct(F.when(F.col("claude_sub"), F.col("subagent"))).alias("n_claude"))
    codex = sessions.where((F.col("agent") == "codex") & (F.col("role") == "subagent"))
    child_last = codex.groupBy("agent", F.col("root_session").alias("thread_id")).agg(F.max("last_ns").alias("child_last"))
    own = sessions.select("agent", F.col("id").alias("thread_id"), F.col("last_ns").alias("own_last"), F.col("has_rows").alias("own_rows"))
    confirmed = (
        sessions.where((F.col("agent") == "codex") & (F.col("role") == "main")).select(F.col("id").alias("thread_id"))
        .unionByName(codex.where("root_session <> ''").select(F.col("root_session").alias("thread_id")))
        .unionByName(routed_rows.where((F.col("agent") == "codex") & ((F.col("role") == "main") | (F.col("codex_sub") & (F.col("session_id") != F.col("thread_id"))))).select(F.col("session_id").alias("thread_id")))
        .distinct().withColumns({"agent": F.lit("codex"), "confirmed": F.lit(True)})
    )
    top = top.join(labels, KEY).join(activity, ["agent", "session_id"], "left").join(child_last, ["agent", "thread_id"], "left").join(own, ["agent", "thread_id"], "left").join(confirmed, ["agent", "thread_id"], "left")
    last = F.coalesce("row_time", F.when((F.col("agent") == "codex") & (F.col("type") == "main"), F.col("child_last")), "own_last")
    count = F.when(F.col("agent") != "codex", F.coalesce("n_claude", F.lit(0))).when((F.col("type") == "main") & F.col("confirmed"), F.col("n_children"))
    return top.withColumns({"last_activity": last, "has_usage_rows": F.col("row_time").isNotNull() | F.coalesce("own_rows", F.lit(False)), "subagent_count": count.cast("long")})
