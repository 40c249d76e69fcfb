"""The reports, each a query over the test tables' derived ledger, and the views they are made of."""

from __future__ import annotations

from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions import dates, paths, request as R
from ..operators import dataset as D, measures as M, tables as S, threads as T
from ..operators.ranking import nearest_rank, numbered
from ..operators.staging import staged
from ..sources import derived
from ..sources.store import Snapshot
from ..sources.tables import tables

VIEW = ("calls", "errors", "retried", "input", "output", "cache_read", "cache_write", "cache_write_1h", "reasoning", "unpriced", "decode_n", "cost", "total", "cache_hit_rate", "output_speed")


class Ledger:
    """The tables of one data set and scope, made on demand."""

    def __init__(self, spark: SparkSession, source: str | Snapshot, scope: D.Scope = D.Scope()):
        """source: a folder of test tables, or a version of a store; reports on it merge its partial sums."""
        self.stored = None if isinstance(source, str) else source
        loaded = self.stored or tables(spark, source)
        self.scope, self.path, self.metadata = scope, loaded.path, loaded.metadata
        self.rows = D.in_scope(loaded.usage(scope.first, scope.last), scope)

    @property
    def measures(self) -> DataFrame:
        """What sums by session, model, effort, project or day are made of: the rows, or the partial sums of each day."""
        return D.in_scope(self.stored.cells(self.scope.first, self.scope.last), self.scope) if self.stored else self.rows

    def sessions(self) -> DataFrame:
        s = self.scope
        if self.stored and not (s.agents or s.models or s.projects):
            return D.all_sessions(D.acting_sessions(D.merged_acts(self.stored.acts(s.first, s.last)), self.metadata), self.metadata, s)
        return D.sessions(self.rows, self.metadata, s)

    def threads(self) -> Threads:
        return Threads.of(self)


class Threads:
    """The threads of a scope as tables; those of the last scopes asked for are kept."""

    KEPT = 8
    _kept: dict[tuple, Threads] = {}

    @classmethod
    def of(cls, ledger: Ledger) -> Threads:
        key = (ledger.path, ledger.scope)
        if key not in cls._kept:
            while len(cls._kept) >= cls.KEPT:
                cls._kept.pop(next(iter(cls._kept)))
            cls._kept[key] = cls(ledger)
        return cls._kept[key]

    def __init__(self, ledger: Ledger):
        self.rows = ledger.rows
        self.sessions = staged(ledger.sessions())
        self.routed = staged(T.routed(self.rows.select(*T.NEEDED), self.sessions))
        self.threads = staged(T.threads(self.routed, self.sessions))
        self.usage = staged(T.usage(self.routed))

    @cached_property
    def rolled(self) -> DataFrame:
        return staged(T.rollups(self.threads, self.usage))

    def rollups(self) -> DataFrame:
        return self.rolled

    @cached_property
    def listed(self) -> DataFrame:
        return staged(T.session_items(self.threads, self.routed, self.sessions, self.rolled))

    def items(self) -> DataFrame:
        return self.listed


def _by(rows: DataFrame, *keys) -> DataFrame:
    out = M.derived(rows.groupBy(*keys).agg(*M.sums()))
    names = [k if isinstance(k, str) else None for k in keys]
    return out.select(*[n for n in names if n], *VIEW)


def model_distribution(spark, sf_dir, scope=D.Scope()) -> DataFrame:
    return _by(Ledger(spark, sf_dir, scope).measures, "model_name").orderBy(F.desc("total"), "model_name")


def project_distribution(spark, sf_dir, scope=D.Scope()) -> DataFrame:
    rows = Ledger(spark, sf_dir, scope).measures
    kind = F.col("project.kind")
    rows = rows.withColumns({"kind": kind, "path": F.when(kind == "project", F.col("project.path")).otherwise("")})
    return _by(rows, "kind", "path").orderBy(F.desc("total"), "kind", "path")


def request_metrics(spark, sf_dir) -> DataFrame:
    rows = Ledger(spark, sf_dir).measures
    out = M.metric_view(rows.groupBy("agent").agg(*M.sums(M.METRICS)))
    return out.select("agent", "rm_calls", "rm_errors", "rm_retried", "rm_samples", "rm_ttft_n", "metric_speed", "mean_ttft_s")


def usage_by_day(spark, sf_dir) -> DataFrame:
    """Every day from the first to the last, also those without requests."""
    rows = Ledger(spark, sf_dir).measures
    ends = rows.agg(F.min(F.to_date("local_day")).alias("a"), F.max(F.to_date("local_day")).alias("b"))
    days = ends.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("local_day"))
    sums = rows.groupBy("local_day").agg(*M.sums())
    full = days.join(sums, "local_day", "left").select("local_day", *[F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in sums.dtypes if c != "local_day"])
    return M.derived(full).select("local_day", *VIEW)


def usage_shares(spark, sf_dir) -> DataFrame:
    """One pass over the rows for shares by agent, by provider and model, by account, caller key and source."""
    rows = Ledger(spark, sf_dir).rows
    keys = ("agent", "provider", "model_name", "account", "caller", "source")
    total = F.sum(F.col("input") + F.col("cache_read") + F.col("cache_write") + F.col("output"))
    sets = [[F.col(c) for c in names] for names in (("agent",), ("provider", "model_name"), ("account",), ("caller",), ("source",))]
    by = rows.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        *[F.grouping(k).alias(f"no_{k}") for k in keys], F.sum("calls").alias("calls"), total.alias("total"), F.round(F.sum("cost").cast("double"), 6).alias("cost"), F.sum("unpriced").alias("unpriced")
    )
    of = F.when(F.col("no_agent") == 0, "agent").when(F.col("no_model_name") == 0, "model").when(F.col("no_account") == 0, "account").when(F.col("no_caller") == 0, "caller").otherwise("source")
    out = by.select(of.alias("dimension"), F.coalesce("agent", "provider", "account", "caller", "source").alias("key"), F.coalesce("model_name", F.lit("")).alias("model"), "calls", "total", "cost", "unpriced")
    whole = F.sum("total").over(W.partitionBy("dimension"))
    return out.withColumn("share", M.ratio(F.col("total") * 1.0, whole))


def _ms(name: str):
    return F.expr(f"{name} div 1000000").alias(name.removesuffix("_ns") + "_ms")


def _session_view(s: DataFrame) -> DataFrame:
    return M.derived(s).select(
        "agent", "id", "matched", "title", "nickname", "role", "parent_session", "root_session", F.col("project.kind").alias("kind"),
        F.col("project.path").alias("path"), F.col("project.name").alias("name"), _ms("last_ns"), "has_rows", _ms("first_usage"), _ms("last_usage"), *VIEW,
    )


def session_totals(spark, sf_dir) -> DataFrame:
    return numbered(_session_view(Ledger(spark, sf_dir).sessions()), "agent", "id")


def session_model_effort(spark, sf_dir) -> DataFrame:
    rows = Ledger(spark, sf_dir).measures.where("NOT (agent = 'codex' AND role = 'unknown')").where("actor_id <> ''")
    by = _by(rows.withColumnRenamed("actor_id", "session_id"), "agent", "session_id", "model_name", "effort")
    return by.withColumn("place", F.row_number().over(W.partitionBy("agent", "session_id").orderBy("model_name", "effort")))


def _label(rows: DataFrame, keys: list[str], key: str, name: str, label: str) -> DataFrame:
    """The first name by time that isn't blank or the key itself, else the key."""
    named = (F.col(name) != "") & (F.col(name) != F.col(key))
    first = F.min_by(F.when(named, F.col(name)), F.when(named, F.struct("t_ns", "agent", "resolved_id", "subagent", "provider", "model", "effort", "id")))
    return rows.where(F.col(key) != "").groupBy(*keys).agg(F.coalesce(first, F.first(key)).alias(label))


def filter_options_agents(spark, sf_dir) -> DataFrame:
    ledger = Ledger(spark, sf_dir)
    of_rows = _label(ledger.rows, ["agent"], "agent", "agent_name", "display_name")
    rest = ledger.sessions().where("agent <> ''").select("agent").distinct().join(of_rows, "agent", "left")
    return numbered(rest.select("agent", F.coalesce("display_name", "agent").alias("display_name")), "agent")


def filter_options_models(spark, sf_dir) -> DataFrame:
    return numbered(_label(Ledger(spark, sf_dir).rows, ["provider", "model_name"], "provider", "provider_name", "display_name"), "provider", "model_name")


def filter_options_projects(spark, sf_dir) -> DataFrame:
    s = Ledger(spark, sf_dir).sessions()
    kind = F.col("project.kind")
    only = lambda c: F.when(kind == "project", F.col(f"project.{c}")).otherwise("").alias(c)
    rank = F.when(F.col("kind") == "project", 0).when(F.col("kind") == "workspace", 1).when(F.col("kind") == "projectless", 2).otherwise(3)
    return s.select(kind.alias("kind"), only("path"), only("name")).distinct().transform(lambda df: numbered(df.withColumn("kind_order", rank), "kind_order", "path"))


def agent_filter(spark, sf_dir) -> DataFrame:
    return model_distribution(spark, sf_dir, D.Scope(agents=("claude-desktop", "gemini")))


def _span(spark, sf_dir, after: int, before: int) -> tuple[str, str]:
    """So many days after the first day of the ledger and after its last; the whole ledger if it is empty."""
    ends = tables(spark, sf_dir).usage().agg(F.min("local_day"), F.max("local_day")).first()
    if ends[0] is None:
        return D.Scope.first, D.Scope.last
    a, b = ((date.fromisoformat(d) + timedelta(days=n)).isoformat() for d, n in zip(ends, (after, before), strict=True))
    return min(a, b), max(a, b)


def day_range(spark, sf_dir) -> DataFrame:
    """All but the first and last days of the ledger: a filter on the table's partitions."""
    return model_distribution(spark, sf_dir, D.Scope(*_span(spark, sf_dir, 4, -10)))


def model_pair_filter(spark, sf_dir) -> DataFrame:
    return project_distribution(spark, sf_dir, D.Scope(models=(("p1", "m3"), ("p2", R.UNNAMED_MODEL))))


def project_filter(spark, sf_dir) -> DataFrame:
    return model_distribution(spark, sf_dir, D.Scope(projects=(("project", "/work/alpha"), ("workspace", ""))))


def session_identity(spark, sf_dir) -> DataFrame:
    rows = derived.ledger(spark, sf_dir).withColumn("agent", R.family(F.col("agent")))
    return rows.select("id", "agent", R.identity(F.col("agent")).alias("i"), R.rejected().alias("rejected")).select("id", "agent", "i.resolved_id", "i.actor_id", "i.role", "rejected")


def project_classification(spark, sf_dir) -> DataFrame:
    s = derived.sessions(derived.ledger(spark, sf_dir))
    messy = F.concat("cwd", F.when(F.col("cwd") == "", "").otherwise("//./x/.."))
    s = paths.with_project(s).select("agent", "id", paths.clean(F.col("cwd")).alias("cleaned"), paths.clean(messy).alias("messy"), "project")
    return s.select("agent", "id", "cleaned", "messy", "project.kind", "project.path", "project.name")


def decode_samples(spark, sf_dir) -> DataFrame:
    return derived.ledger(spark, sf_dir).select("id", R.decode_sample().alias("s")).where("s IS NOT NULL").select("id", F.col("s.tokens").alias("tokens"), F.col("s.ms").alias("window_ms"))


def request_decode_samples(spark, sf_dir) -> DataFrame:
    rows = derived.ledger(spark, sf_dir)
    return rows.select("id", R.request_decode_sample(R.family(F.col("agent"))).alias("s")).where("s IS NOT NULL").select("id", F.col("s.tokens").alias("tokens"), F.col("s.ms").alias("window_ms"))


def metadata_merge(spark, sf_dir) -> DataFrame:
    return tables(spark, sf_dir).metadata.drop("project")


def metadata_only_sessions(spark, sf_dir) -> DataFrame:
    ledger = Ledger(spark, sf_dir, D.Scope(*_span(spark, sf_dir, 4, 0)))
    return _session_view(D.metadata_only(D.row_sessions(ledger.rows, ledger.metadata), ledger.metadata, ledger.scope)).select("agent", "id", "title", "kind", "path", "name", "last_ms", "has_rows")


def supplemental_roots(spark, sf_dir) -> DataFrame:
    """Sessions without rows that only their children name, for two models on one day."""
    day = _span(spark, sf_dir, 9, 0)[0]
    ledger = Ledger(spark, sf_dir, D.Scope(day, day, models=(("p1", "m3"), ("p0", "m1"))))
    every = ledger.sessions()
    return _session_view(every).where("agent = 'codex' AND NOT has_rows").select("agent", "id", "role", "root_session", "kind", "path", "last_ms")


def thread_usage(spark, sf_dir) -> DataFrame:
    t = Ledger(spark, sf_dir).threads()
    return M.derived(t.usage).select(*T.KEY, "bucket", _ms("first_usage"), _ms("last_usage"), *VIEW)


def thread_parents(spark, sf_dir) -> DataFrame:
    t = Ledger(spark, sf_dir).threads()
    return t.threads.select(*T.KEY, "type", "title", "nickname", F.col("project.kind").alias("kind"), F.col("project.path").alias("path"), "parent")


def thread_descendants(spark, sf_dir) -> DataFrame:
    return T.descendants(Ledger(spark, sf_dir).threads().threads)


def compaction_tokens(spark, sf_dir) -> DataFrame:
    return T.model_effort(Ledger(spark, sf_dir).threads().routed).select(*T.KEY, "model_name", "effort", "calls", "compaction_tokens", "place")


def _items(t: Threads) -> DataFrame:
    return t.items()


def session_list(spark, sf_dir) -> DataFrame:
    """Sessions by last activity, latest first."""
    items = numbered(_items(Ledger(spark, sf_dir).threads()), F.desc_nulls_last("last_activity"), *T.KEY)
    return M.derived(items).select("position", *T.KEY, "type", "title", _ms("last_activity"), "has_usage_rows", "subagent_count", "self_calls", "sub_calls", "unknown_calls", "self_input", "sub_input", "unknown_input", "self_output", "sub_output", "unknown_output", *VIEW)


def session_detail(spark, sf_dir) -> DataFrame:
    """Every thread with its roll-up, a row for each thread below it or itself."""
    t = Ledger(spark, sf_dir).threads()
    rolled = M.derived(t.rollups()).select(*T.KEY, "type", "n_children", "self_calls", "sub_calls", "unknown_calls", *VIEW)
    return rolled


def _summary(items: DataFrame) -> DataFrame:
    used = F.when(F.col("input") + F.col("output") > 0, F.col("input") + F.col("output"))
    ranks = nearest_rank(items.select(used.alias("used")), "used", median=50, p90=90).first()  # two numbers
    out = items.agg(*M.sums(), F.count("*").alias("sessions"), F.count_if(F.col("unpriced") > 0).alias("unpriced_sessions"))
    return M.metric_view(M.derived(out)).withColumns({n: F.lit(ranks[n]).cast("long") for n in ("median", "p90")})


def summary(spark, sf_dir) -> DataFrame:
    return _summary(_items(Ledger(spark, sf_dir).threads())).select("sessions", "unpriced_sessions", "median", "p90", "metric_speed", "mean_ttft_s", *VIEW)


def public_summary(spark, sf_dir) -> DataFrame:
    """Usage as published for codex: prompt tokens include the cache, the cost comes with its completeness."""
    s = _summary(_items(Ledger(spark, sf_dir, D.Scope(agents=("codex",))).threads()))
    empty, whole = (F.col("total") == 0) & (F.col("sessions") == 0), F.col("unpriced") == 0
    return s.select(
        (F.col("input") + F.col("cache_read") + F.col("cache_write")).alias("input_tokens"), F.col("cache_read").alias("cached_tokens"), F.col("input").alias("uncached_input_tokens"),
        F.col("output").alias("output_tokens"), F.col("reasoning").alias("reasoning_tokens"), (F.col("output") - F.col("reasoning")).alias("other_output_tokens"), F.col("total").alias("total_tokens"),
        "cache_hit_rate", F.when(empty, 0.0).when(whole | (F.col("cost") > 0), F.col("cost")).alias("estimated_cost"),
        F.when(empty | whole, "complete").when(F.col("cost") > 0, "partial").otherwise("unknown").alias("cost_status"),
        F.col("sessions").alias("session_count"), (F.col("sessions") - F.col("unpriced_sessions")).alias("complete_sessions"),
    )


def _shares(spark, sf_dir, measure: str) -> DataFrame:
    """The five models of most tokens or cost and the rest together."""
    by = _by(Ledger(spark, sf_dir).measures, "model_name")
    rank = F.row_number().over(W.orderBy(F.desc(measure), "model_name"))
    ranked = by.withColumn("label", F.when(rank <= 5, F.col("model_name")).otherwise("__other__"))
    out = ranked.groupBy("label").agg(F.sum("total").alias("total"), F.round(F.sum("cost"), 6).alias("cost"), F.sum("unpriced").alias("unpriced"))
    whole = F.sum(measure).over(W.partitionBy())
    return out.withColumn("percent", F.round(F.when(whole > 0, F.col(measure) * 100.0 / whole).otherwise(0.0), 6))


def share_top5_other(spark, sf_dir) -> DataFrame:
    return _shares(spark, sf_dir, "total")


def share_top5_cost(spark, sf_dir) -> DataFrame:
    return _shares(spark, sf_dir, "cost")


def _series(spark, sf_dir, name: str, keep: int) -> DataFrame:
    """Counts per day and label of the `keep` most frequent labels; others are one."""
    prefix, modulus = {"skill": ("skill-", 17), "tool": ("t", 13)}[name]
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    label = F.concat(F.lit(prefix), (F.get_json_object("props", "$.k").cast("long") % modulus).cast("string"))
    each = ev.groupBy(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("local_day"), label.alias("name")).agg(F.count("*").alias("n"))
    total = each.groupBy("name").agg(F.sum("n").alias("total")).withColumn("rank", F.row_number().over(W.orderBy(F.desc("total"), "name")))
    top = total.select("name", F.when(F.col("rank") <= keep, F.col("name")).otherwise("__other__").alias("label"), F.least("rank", F.lit(keep + 1)).alias("rank"))
    return each.join(top, "name").groupBy("local_day", "label", "rank").agg(F.sum("n").alias("n"))


def series_top10_other(spark, sf_dir) -> DataFrame:
    """Every day and label, with zeros where a label has no event."""
    found = _series(spark, sf_dir, "skill", 10)
    found = found.groupBy("local_day").pivot("label").agg(F.sum("n")).fillna(0)
    labels = [c for c in found.columns if c != "local_day"]
    return found.unpivot("local_day", labels, "label", "n")


def running_stack(spark, sf_dir) -> DataFrame:
    upper = F.sum("n").over(W.partitionBy("local_day").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return _series(spark, sf_dir, "skill", 10).withColumn("upper", upper).withColumn("lower", F.col("upper") - F.col("n"))


def tool_usage(spark, sf_dir) -> DataFrame:
    """The eight tools of most calls and the rest of all calls."""
    by = _series(spark, sf_dir, "tool", 8).groupBy("label", "rank").agg(F.sum("n").alias("calls"))
    top = by.where("rank <= 8").select("label", "calls")
    rest = by.agg((F.sum("calls") - F.sum(F.when(F.col("rank") <= 8, F.col("calls")).otherwise(0))).alias("calls")).select(F.lit("__other__").alias("label"), "calls")
    return top.unionByName(rest)


def skill_labels(spark, sf_dir) -> DataFrame:
    """Keys as labels: words at hyphens begin with a capital, name spaces are parted by a colon."""
    found = _series(spark, sf_dir, "skill", 17).select(F.col("label").alias("name")).distinct()
    found = found.unionByName(found.select(F.concat(F.lit("pack-x:"), "name").alias("name")))
    words = lambda part: F.transform(F.split(part, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000)))
    return found.select("name", F.array_join(F.transform(F.split("name", ":"), lambda part: F.array_join(words(part), " ")), ": ").alias("label"))


def skills_of_day(spark, sf_dir) -> DataFrame:
    """The series of each day, the most frequent first."""
    order = W.partitionBy("local_day").orderBy(F.desc("n"), "label")
    return _series(spark, sf_dir, "skill", 10).withColumn("place", F.row_number().over(order))


def tool_usage_days(spark, sf_dir, days: int = 7) -> DataFrame:
    """Calls by tool in the last days of the events; only 1, 7 and 30 days can be asked for."""
    if days not in (1, 7, 30):
        raise ValueError(f"not 1, 7 or 30 days: {days}")
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_date("ts").alias("d"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    last = ev.agg(F.max("d").alias("last"))
    recent = ev.join(F.broadcast(last), F.col("d") > F.date_sub("last", days))
    return recent.groupBy(F.concat(F.lit("t"), (F.col("k") % 13).cast("string")).alias("name")).agg(F.count("*").alias("calls"))


def session_page(spark, sf_dir) -> DataFrame:
    """Sessions by cost, largest first and those without rows last; page 2 of six."""
    s = _session_view(Ledger(spark, sf_dir).sessions())
    s = s.select("agent", "id", "has_rows", F.when(F.col("has_rows"), F.col("cost")).alias("sort_cost"))
    order = [F.desc_nulls_last("sort_cost"), "agent", "id"]
    n = F.row_number().over(W.orderBy(*order))  # two pages
    return s.orderBy(*order).limit(12).withColumn("position", n).where("position >= 7")


def session_table(spark, sf_dir) -> DataFrame:
    """The first and the last page of the sessions by each field, in both directions."""
    t = Ledger(spark, sf_dir).threads()
    items, out = M.derived(_items(t)), None
    for field in S.FIELDS:
        for descending in (True, False):
            pages = S.Pages(items, field, descending)
            for number in (1, 10**6):
                rows = pages.page(number).select(F.lit(field).alias("field"), F.lit(descending).alias("descending"), F.lit(number > 1).alias("last_page"), *T.KEY, "position")
                out = rows if out is None else out.unionByName(rows)
    return out


def thread_children(spark, sf_dir) -> DataFrame:
    t = Ledger(spark, sf_dir).threads()
    return T.children(t.threads, t.usage).select("agent", "session_id", "top", "thread_id", _ms("last_usage"), "place")


def thread_detail(spark, sf_dir) -> DataFrame:
    """The thread with most threads below it, and these."""
    t = Ledger(spark, sf_dir).threads()
    most = t.rolled.orderBy(F.desc("n_children"), *T.KEY).select(*T.KEY).first()
    found = T.detail(M.derived(t.rolled), T.children(t.threads, t.usage), tuple(most))
    return found.select("place", *T.KEY, "type", "n_children", "self_calls", "sub_calls", "unknown_calls", *VIEW)


def view_violations(spark, sf_dir) -> DataFrame:
    """How many groups by agent and model break each rule of a published view."""
    view = _by(Ledger(spark, sf_dir).rows, "agent", "model_name")
    whole = [c for c in VIEW if c not in ("cost", "cache_hit_rate", "output_speed")]
    safe = F.forall(F.array(*[F.col(c).cast("long") for c in whole]), lambda x: x.isNotNull() & (x >= 0) & (x <= (1 << 53) - 1))
    amount = lambda c: ~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) < float("inf"))
    rules = {
        "count that isn't a safe integer": ~safe, "ratio out of 0 to 1": F.col("cache_hit_rate").isNotNull() & ~(amount("cache_hit_rate") & (F.col("cache_hit_rate") <= 1)),
        "cost that isn't finite": F.col("cost").isNull() | ~amount("cost"), "speed that isn't finite": F.col("output_speed").isNotNull() & ~amount("output_speed"),
        "blank label": (F.col("agent") == "") | (F.trim("model_name") == ""), "control character": F.col("model_name").rlike("[\\x00-\\x1f]"), "checked": F.lit(True),
    }
    return view.agg(*[F.count_if(c).alias(n) for n, c in rules.items()]).unpivot([], list(rules), "rule", "n")


def kpi_ratios(spark, sf_dir) -> DataFrame:
    by = _by(Ledger(spark, sf_dir).rows, "agent")
    return by.select(
        "agent", F.round(F.col("total") * 100.0 / F.sum("total").over(W.partitionBy()), 6).alias("token_share"), F.round((F.col("calls") - F.col("errors")) / F.col("calls"), 9).alias("success_rate"),
        F.round(F.try_divide(F.col("cost") * 1000000, F.col("total")), 6).alias("cost_per_million"),
    )


ZONES = ("America/New_York", "America/Havana", "Australia/Lord_Howe", "America/Sao_Paulo", "Asia/Tokyo", "UTC")


def range_resolution(spark, sf_dir) -> DataFrame:
    """What each named range is, as of every day of the ledger."""
    days = derived.ledger(spark, sf_dir).select(dates.civil_date(F.col("local_day")).alias("today")).distinct()
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    ranges = []
    first, last = text(F.date_sub("today", 10)), F.when(F.dayofmonth("today") % 5 == 0, "2024-02-30").otherwise(text(F.date_sub("today", 2)))
    for name in ("today", "yesterday", "7d", "30d", "year", "custom"):
        a, b = dates.range_days(name, F.col("today"), first, last)
        ranges.append(F.struct(F.lit(name).alias("range"), text(a).alias("first_day"), text(b).alias("last_day"), F.unix_millis(dates.midnight(a, "UTC")).alias("start_ms"), F.unix_millis(dates.day_end(b, "UTC")).alias("end_ms")))
    return days.select(text(F.col("today")).alias("today"), F.explode(F.array(*ranges)).alias("r")).select("today", "r.*").where("first_day IS NOT NULL")


def local_midnight(spark, sf_dir) -> DataFrame:
    """Where each day of the ledger begins in several zones."""
    days = derived.ledger(spark, sf_dir).select("local_day").distinct()
    each = days.select("local_day", F.explode(F.array(*[F.lit(z) for z in ZONES])).alias("zone"))
    return each.select("local_day", "zone", F.unix_millis(dates.midnight(F.to_date("local_day"), F.col("zone"))).alias("start_ms"))


def local_days(spark, sf_dir) -> DataFrame:
    """Requests by civil day in several zones."""
    rows = derived.ledger(spark, sf_dir).select("t_ns", F.explode(F.array(*[F.lit(z) for z in ZONES])).alias("zone"))
    return rows.groupBy("zone", dates.local_day(F.col("t_ns"), F.col("zone")).alias("day")).agg(F.count("*").alias("n"))


def quality_violations(spark, sf_dir) -> DataFrame:
    """How many requests break each rule of a valid row."""
    rows = derived.ledger(spark, sf_dir)
    rules = {
        "blank session": F.col("session") == "", "blank model": F.col("model") == "", "no time to first token": F.col("ttft_ms") <= 0, "reasoning above output": F.col("reasoning") > F.col("output"),
        "negative tokens": (F.col("input") < 0) | (F.col("output") < 0), "unknown compaction": F.col("compaction").isNull(), "cost of an unpriced request": ~F.col("priced") & (F.col("cost") > 0),
    }
    counts = rows.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return counts.unpivot([], list(rules), "rule", "n")


QUERIES = {
    f.__name__: f
    for f in (
        model_distribution, project_distribution, request_metrics, usage_by_day, usage_shares, session_totals, session_model_effort, filter_options_agents, filter_options_models,
        filter_options_projects, agent_filter, model_pair_filter, project_filter, session_identity, project_classification, decode_samples, request_decode_samples, metadata_merge,
        metadata_only_sessions, supplemental_roots, thread_usage, thread_parents, thread_descendants, compaction_tokens, session_list, session_detail, summary, public_summary,
        share_top5_other, share_top5_cost, skills_of_day, tool_usage_days, session_table, thread_children, thread_detail, view_violations, day_range, series_top10_other, running_stack, tool_usage, skill_labels, session_page, kpi_ratios, range_resolution, local_midnight, local_days, quality_violations,
    )
}
