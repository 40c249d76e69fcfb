"""From ledger and session metadata to enriched rows and sessions, the parents of all reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, request as R
from ..functions.dates import local_day
from .measures import ADDITIVE, sums, with_measures
from .staging import staged

#: More models than these are looked up instead of being tried one by one.
MANY = 32
KINDS = ("project", "workspace", "projectless", "unknown")


@dataclass(frozen=True)
class Scope:
    """What a report covers: local days (both included) and filters; empty filters cover all."""

    first: str = "0000-01-01"
    last: str = "9999-12-31"
    agents: tuple[str, ...] = ()
    models: tuple[tuple[str, str], ...] = ()
    projects: tuple[tuple[str, str], ...] = ()
    zone: str = "UTC"
    known: frozenset = field(default=frozenset(KINDS), repr=False)

    def __post_init__(self):
        """Blank values go, the rest is sorted and distinct; agents count by family."""
        family = {"claude-desktop": "claude"}
        clean = lambda xs: tuple(sorted(set(xs)))
        object.__setattr__(self, "agents", clean(family.get(a, a) for a in self.agents if a.strip()))
        object.__setattr__(self, "models", clean(m for m in self.models if m[1].strip()))
        for kind, path in self.projects:
            if kind not in self.known or (kind == "project") != bool(path):
                raise ValueError(f"no such project selection: {kind!r} {path!r}")
        object.__setattr__(self, "projects", clean(self.projects))
        if self.first > self.last:
            raise ValueError("the first day is after the last")

    def has_project(self, project: Column) -> Column:
        if not self.projects:
            return F.lit(True)
        found = F.lit(False)
        for kind, path in self.projects:
            one = project["kind"] == kind
            found |= one & (project["path"] == path) if kind == "project" else one
        return found


def merged_metadata(sessions: DataFrame, home: str = paths.HOME) -> DataFrame:
    """One row per (family, id) with its project: agents of one family share sessions, `claude` names them."""
    fam = R.family(F.col("agent"))
    rows = sessions.withColumn("family", fam)
    own = F.max_by(F.struct("cwd", "title", "nickname"), F.struct((F.col("agent") == "claude").alias("first"), F.col("agent")))
    codex = F.col("family") == "codex"
    kept = lambda c: F.max(F.when(codex, F.col(c)).otherwise("")).alias(c)
    out = rows.groupBy("family", "id").agg(own.alias("own"), F.min("start_ns").alias("start_ns"), F.max("last_ns").alias("last_ns"), kept("role"), kept("parent_session"), kept("root_session"))
    out = out.select(F.col("family").alias("agent"), "id", "own.cwd", "own.title", "own.nickname", "start_ns", "last_ns", "role", "parent_session", "root_session")
    return paths.with_project(out, home)


def accepted(ledger: DataFrame) -> DataFrame:
    """Accepted requests with family, identity and a column for each measure; nothing of session metadata."""
    rows = ledger.where(~R.rejected()).withColumn("agent", R.family(F.col("agent")))
    rows = rows.withColumn("i", R.identity(F.col("agent"))).where(F.col("i.resolved_id") != "")
    rows = rows.withColumns({"resolved_id": F.col("i.resolved_id"), "actor_id": F.col("i.actor_id"), "role": F.col("i.role"), "model_name": R.model_name()}).drop("i")
    return with_measures(rows)


def with_projects(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Rows with the project of their session or else of their actor, and whether each has metadata."""
    of = lambda n: metadata.select(F.col("agent").alias(f"a{n}"), F.col("id").alias(f"i{n}"), F.col("project").alias(f"p{n}"))
    rows = rows.join(of(1), (F.col("agent") == F.col("a1")) & (F.col("resolved_id") == F.col("i1")), "left")
    rows = rows.join(of(2), (F.col("agent") == F.col("a2")) & (F.col("actor_id") == F.col("i2")), "left")
    rows = rows.withColumns({"matched": F.col("i1").isNotNull(), "actor_matched": F.col("i2").isNotNull(), "project": F.coalesce("p1", "p2", paths.unknown())})
    return rows.drop("a1", "i1", "p1", "a2", "i2", "p2")


def enriched(ledger: DataFrame, metadata: DataFrame) -> DataFrame:
    """Accepted requests with family, identity, project and a column for each measure: the table that reports scan."""
    return with_projects(accepted(ledger), metadata)


def in_scope(rows: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Enriched rows in scope; all filters are on plain columns and reach the scan."""
    rows = rows.where(F.col("local_day").between(scope.first, scope.last))
    if scope.agents:
        rows = rows.where(F.col("agent").isin(*scope.agents))
    if len(scope.models) > MANY:
        named = rows.sparkSession.createDataFrame(list(scope.models), "provider string, model_name string")
        rows = rows.join(F.broadcast(named), ["provider", "model_name"], "left_semi")  # the caller's list
    elif scope.models:
        wanted = F.lit(False)
        for provider, model in scope.models:
            wanted |= (F.col("provider") == provider) & (F.col("model_name") == model)
        rows = rows.where(wanted)
    return rows.where(scope.has_project(F.col("project"))) if scope.projects else rows


def usage_rows(ledger: DataFrame, metadata: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Accepted requests in scope with family, identity, project and measures."""
    return in_scope(enriched(ledger, metadata), scope)


def order() -> Column:
    """The order of rows within the data set: by time, then by id."""
    return F.struct("t_ns", "id")


def session_acts(rows: DataFrame, *by: str) -> DataFrame:
    """What accepted rows say of each session that they name, for each value of `by`: the first event of all, the first
    that tells a role, the first that tells or names one, each with its place in the order, times and sums."""
    codex = F.col("agent") == "codex"
    kind = F.when(~codex | (F.col("role") == ""), "blank").otherwise(F.col("role"))
    blank, actor, session = F.lit(""), F.col("actor_id"), F.col("session")

    def event(of: Column, kind: Column, sub: int, parent: Column, root: Column) -> Column:
        """What a row says of a session; sub: 1 if it is the session's own request."""
        parts = {"sid": of, "kind": kind, "sub": F.lit(sub), "parent": parent, "root": root, "acts": F.lit(sub == 1)}
        return F.struct(*[c.alias(n) for n, c in parts.items()])

    parent = F.when(kind == "subagent", F.col("parent_agent")).otherwise(blank)
    root = F.when(kind == "main", actor).when(kind == "subagent", session).otherwise(blank)
    acting = event(actor, kind, 1, parent, root)
    naming = F.when(codex & (F.col("role") == "subagent") & (session != ""), event(session, F.lit("root"), 0, blank, session))
    ev = rows.withColumn("ev", F.explode(F.array_compact(F.array(acting, naming)))).where(F.col("ev.sid") != "")
    ev = ev.withColumns({"sid": F.col("ev.sid"), "ord": F.struct("t_ns", "id", "ev.sub"), "of": F.struct("ev.kind", "ev.parent", "ev.root", "resolved_id")})
    key, acts = [*by, "agent", "sid"], F.col("ev.acts")

    def told(*kinds: str) -> Column:
        wanted = F.col("ev.kind").isin(*kinds)
        return F.min(F.when(wanted, F.struct("ord", "of")))  # the order is total: the first has no equal

    counted = acts & ~(codex & (F.col("ev.kind") == "unknown"))
    # apart: the least of structs sorts its rows, which are to be narrow, while sums are hashed
    firsts = ev.groupBy(*key).agg(F.min(F.struct("ord", "of")).alias("first_event"), told("main", "subagent").alias("told"), told("main", "subagent", "root").alias("told_or_named"))
    summed = ev.groupBy(*key).agg(F.max(acts).alias("has_rows"), F.min(F.when(counted, F.col("t_ns"))).alias("first_usage"), F.max(F.when(counted, F.col("t_ns"))).alias("last_usage"), *sums(ADDITIVE, counted))
    summed = summed.withColumnsRenamed({k: f"s_{k}" for k in key})
    same = [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in key]
    return firsts.join(summed, same).drop(*[f"s_{k}" for k in key])


def merged_acts(acts: DataFrame) -> DataFrame:
    """Those of several days as one."""
    least = [F.min(c).alias(c) for c in ("first_event", "told", "told_or_named")]
    return acts.groupBy("agent", "sid").agg(*least, F.max("has_rows").alias("has_rows"), F.min("first_usage").alias("first_usage"), F.max("last_usage").alias("last_usage"), *sums())


def acting_sessions(acts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Sessions that rows name, with role, root, project and totals.

    A codex session's role comes from its metadata if that says main or subagent, otherwise from the
    first row that tells; a session that subagent rows name as their root first of all is main.
    """
    grouped = acts.withColumns({c: F.col(f"{c}.of") for c in ("first_event", "told", "told_or_named")})
    of = metadata.select(F.col("agent").alias("fa"), F.col("id").alias("fi"), F.col("project").alias("f_project"))
    grouped = grouped.join(of, (F.col("agent") == F.col("fa")) & (F.col("first_event.resolved_id") == F.col("fi")), "left").drop("fa", "fi")
    names = {"agent": "ma", "id": "mi", "project": "m_project", "role": "mr", "parent_session": "mp", "root_session": "mroot"}
    meta = metadata.select(*[F.col(c).alias(n) for c, n in names.items()], "title", "nickname", "start_ns", "last_ns")
    s = grouped.join(meta, (F.col("agent") == F.col("ma")) & (F.col("sid") == F.col("mi")), "left")
    known = F.col("mi").isNotNull()
    first, mr = F.col("first_event.kind"), F.coalesce("mr", F.lit(""))
    start = F.when(first == "unknown", F.when(known, mr).otherwise("unknown")).otherwise("")
    by_row = F.when(start == "unknown", F.col("told_or_named")).otherwise(F.col("told"))
    made = lambda kind: F.when(kind == "root", "main").otherwise(kind)
    of = lambda r, p, root: F.struct(r.alias("role"), p.alias("parent_session"), root.alias("root_session"))
    mp, mroot = F.coalesce("mp", F.lit("")), F.coalesce("mroot", F.lit(""))
    told_role = of(made(by_row["kind"]), F.when(by_row["kind"] == "subagent", by_row["parent"]).otherwise(mp), by_row["root"])
    role = (
        F.when(F.col("agent") != "codex", of(F.lit(""), F.lit(""), F.lit("")))
        .when(first == "root", of(F.lit("main"), mp, F.col("sid")))
        .when(mr.isin("main", "subagent"), of(mr, mp, mroot))
        .when(by_row.isNotNull(), told_role)
        .otherwise(of(start, mp, mroot))
    )
    project = F.when(known, F.col("m_project")).when(first != "root", F.coalesce("f_project", paths.unknown())).otherwise(paths.unknown())
    return s.withColumn("r", role).select(
        "agent", F.col("sid").alias("id"), known.alias("matched"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("nickname", F.lit("")).alias("nickname"),
        "r.role", "r.parent_session", "r.root_session", project.alias("project"), "last_ns", F.col("has_rows"), "first_usage", "last_usage", *ADDITIVE,
    )


def row_sessions(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """acting_sessions of rows that weren't summed up before."""
    return acting_sessions(session_acts(rows), metadata)


def _bare(meta: DataFrame) -> DataFrame:
    """Metadata rows as sessions without requests."""
    zero = {n: F.lit(0).cast("decimal(38,10)" if n == "cost" else "long") for n in ADDITIVE}
    return meta.select(
        "agent", "id", F.lit(True).alias("matched"), "title", "nickname", "role", "parent_session", "root_session",
        "project", "last_ns", F.lit(False).alias("has_rows"),
        F.lit(None).cast("long").alias("first_usage"), F.lit(None).cast("long").alias("last_usage"), *[c.alias(n) for n, c in zero.items()],
    )


def metadata_only(known: DataFrame, metadata: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Sessions of other agents than codex that were last active in range and have no rows in scope."""
    rest = metadata.where((F.col("agent") != "codex") & F.col("last_ns").isNotNull())
    rest = rest.where(local_day(F.col("last_ns"), scope.zone).between(scope.first, scope.last))
    if scope.agents:
        rest = rest.where(F.col("agent").isin(*scope.agents))
    if scope.models:
        rest = rest.where(F.lit(False))
    rest = _bare(rest.join(known.select("agent", "id"), ["agent", "id"], "left_anti"))
    return rest.where(scope.has_project(F.col("project")))


def sessions(rows: DataFrame, metadata: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """All sessions of the data set: those with rows, metadata-only ones and roots that only children name."""
    return all_sessions(row_sessions(rows, metadata), metadata, scope)


def all_sessions(of_rows: DataFrame, metadata: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Sessions that rows name, metadata-only ones and roots that only children name."""
    of_rows = staged(of_rows)
    every = of_rows.unionByName(metadata_only(of_rows, metadata, scope))
    roots = every.where((F.col("agent") == "codex") & (F.col("role") == "subagent") & (F.col("root_session") != "")).select(F.col("root_session").alias("root")).distinct()
    named = every.join(roots, (F.col("agent") == "codex") & (F.col("id") == F.col("root")), "left")
    raised = F.col("root").isNotNull() & F.col("role").isin("", "unknown")
    named = named.withColumns({"root_session": F.when(raised, F.col("id")).otherwise(F.col("root_session")), "role": F.when(raised, "main").otherwise(F.col("role"))}).drop("root")
    missing = roots.join(every.where(F.col("agent") == "codex").select("id"), F.col("root") == F.col("id"), "left_anti")
    extra = metadata.where(F.col("agent") == "codex").join(missing, F.col("id") == F.col("root"), "left_semi")
    extra = _bare(extra.withColumns({"role": F.lit("main"), "root_session": F.col("id"), "last_ns": F.lit(None).cast("long")}))
    return named.unionByName(extra)
