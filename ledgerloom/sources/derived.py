"""The ledger and session metadata as derived from the `events` table, by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def ledger(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """One request for each event; dealt: by tasks of their own number, as a file of few row groups is read by few."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("e"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("u"), F.col("event_type").alias("et"),
        F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    if dealt:
        ev = ev.repartition("e")
    e, u, et, v, k = (F.col(c) for c in ("e", "u", "et", "v", "k"))
    g = F.floor(u / 10)
    whole = lambda x: F.floor(x).cast("long")
    ev = ev.withColumns(
        {
            "agent": F.when(u % 5 == 0, "claude").when(u % 5 == 1, "claude-desktop").when(u % 5 == 4, "gemini").otherwise("codex"),
            "provider": F.when((k % 3 == 0) & (et == "error") & (k < 30), "").otherwise(_text("p", k % 3)),
            "ms": 200 + k * 100,
            "ttft_ms": F.when(k % 11 == 0, F.lit(0)).otherwise(100 + k * 3).cast("long"),
        }
    )
    agent, ttft = F.col("agent"), F.col("ttft_ms")
    role = F.when((agent != "codex") | (u % 10 == 2), "").when(e % 20 == 0, "unknown").when(e % 4 == 1, "subagent").otherwise("main")
    ev = ev.withColumn("session_role", role)
    role = F.col("session_role")
    spawned = (agent == "claude") & (k % 5 == 1)
    return ev.select(
        e.alias("id"), (F.unix_micros("ts") * 1000).alias("t_ns"), F.date_format("ts", "yyyy-MM-dd").alias("local_day"),
        "agent", F.when(k % 4 == 0, "").otherwise(F.upper("agent")).alias("agent_name"),
        "provider", F.when(k % 5 == 0, "").otherwise(F.upper("provider")).alias("provider_name"),
        F.when(k % 50 == 0, "").otherwise(_text("m", k % 7)).alias("model"),
        F.when(u % 3 == 0, "low").when(u % 3 == 1, "medium").otherwise("high").alias("effort"),
        F.when((agent == "codex") & (role == ""), F.when(k % 4 == 0, "collab_spawn").when(k % 4 == 1, "thread_spawn").when(k % 4 == 2, "review").otherwise("agent_job")).otherwise("").alias("kind"),
        F.when((k == 97) | ((role == "subagent") & (k % 16 == 15)), "").otherwise(_text("s", g)).alias("session"),
        "session_role",
        F.when(agent.isin("claude", "claude-desktop") & (k % 2 == 0), _text("s", g)).otherwise("").alias("native_session"),
        F.when((role == "subagent") & (k != 96), _text("a", u)).when(spawned, _text("w", k % 4)).otherwise("").alias("subagent"),
        F.when(role == "subagent", F.when(k % 8 == 0, _text("a", u - u % 10 + 7)).otherwise(""))
        .when(spawned, F.when(k % 4 == 1, "w0").when((k % 4 == 2) & (k > 50), "w1").when(k % 4 == 2, "w3").otherwise("")).otherwise("").alias("parent_agent"),
        F.when(e % 3 == 0, "log").otherwise("gateway").alias("source"),
        F.when(et == "error", F.when(k % 2 == 0, 500).otherwise(429)).otherwise(200).cast("int").alias("status"),
        ((et == "error") & (k % 10 == 0)).alias("rejected"),
        F.when((et == "purchase") & (k == 13), "stream closed").otherwise("").alias("error"),
        (1 + k % 3).cast("int").alias("tries"),
        F.when(k == 95, F.lit(0)).otherwise(whole(v * 100)).cast("long").alias("input"),
        F.when(k == 95, F.lit(0)).otherwise(whole(v * 40)).cast("long").alias("output"),
        F.when(k % 6 == 0, F.lit(0)).otherwise(k * 50).cast("long").alias("cache_read"),
        ((k % 10) * 20).alias("cache_write"), ((k % 5) * 4).alias("cache_write_1h"),
        F.when(k % 4 == 0, whole(v * 10)).otherwise(F.lit(0)).cast("long").alias("reasoning"),
        "ms", "ttft_ms",
        F.when(k % 8 == 0, ttft + k * 10).otherwise(F.lit(0)).cast("long").alias("first_text_ms"),
        F.when(k % 4 == 0, ttft + 10).otherwise(F.lit(0)).cast("long").alias("first_reasoning_ms"),
        F.when(k % 5 == 0, F.lit(0)).when(k % 5 == 1, whole(F.col("ms") / 10)).otherwise(F.col("ms") - ttft).cast("long").alias("flow_ms"),
        (k % 12 == 0).alias("reasoning_hidden"), (k % 9 == 0).alias("handed_on"),
        F.when((agent != "codex") | ((g % 3 == 0) & (k % 10 == 3)), F.lit(None)).otherwise(k % 4 == 1).cast("boolean").alias("compaction"),
        (F.floor(v * 1000) / 100000.0).alias("cost"), (k % 10 != 9).alias("priced"), u.alias("user_id"),
        _text("acc", u % 4).alias("account"), _text("key", u % 6).alias("caller"),
    )


def sessions(rows: DataFrame) -> DataFrame:
    """Session metadata of a derived ledger."""
    u, g = F.col("user_id"), F.floor(F.col("user_id") / 10)
    rows = rows.withColumn("g", g)
    span = (F.min("t_ns").alias("start_ns"), F.max("t_ns").alias("last_ns"))
    empty = F.lit("")
    gc = F.col("g")
    one = rows.where((F.col("agent") != "codex") & (gc % 7 != 6)).groupBy("agent", "g").agg(*span).select("agent", _text("s", gc).alias("id"), "g", "start_ns", "last_ns", empty.alias("role"), empty.alias("parent_session"), empty.alias("root_session"))
    role = F.when(gc % 4 == 0, "").when(gc % 4 == 1, "unknown").otherwise("main")
    two = rows.where((F.col("agent") == "codex") & (gc % 7 != 6)).groupBy("agent", "g").agg(*span).select("agent", _text("s", gc).alias("id"), "g", "start_ns", "last_ns", role.alias("role"), empty.alias("parent_session"), F.when(role == "main", _text("s", gc)).otherwise("").alias("root_session"))
    role = F.when((u % 10 == 8) & (gc % 2 == 0), "unknown").otherwise("subagent")
    three = rows.where((F.col("agent") == "codex") & (u % 10 != 2)).groupBy("agent", "user_id", "g").agg(*span).select(
        "agent", _text("a", u).alias("id"), "g", "start_ns", "last_ns", role.alias("role"),
        F.when(role == "unknown", "").when(u % 10 == 7, _text("s", gc)).when(u % 10 == 3, _text("a", u - u % 10 + 7)).otherwise("").alias("parent_session"),
        F.when((role == "unknown") | (gc % 5 == 4), "").otherwise(_text("s", gc)).alias("root_session"),
    )
    four = rows.where(gc % 2 == 0).groupBy("g").agg(*span).select(F.lit("gemini").alias("agent"), _text("idle", gc).alias("id"), "g", "start_ns", "last_ns", empty.alias("role"), empty.alias("parent_session"), empty.alias("root_session"))
    every = one.unionByName(two).unionByName(three).unionByName(four)
    cwd = (
        F.when(gc % 6 == 0, "").when(gc % 6 == 1, _text("/tmp/claude-501/w", gc)).when(gc % 6 == 2, "/work/alpha")
        .when(gc % 6 == 3, F.when(F.col("agent") == "claude-desktop", "/work/desk").otherwise("/work/beta"))
        .when(gc % 6 == 4, "/var/folders/x/y/T/magpie-claude-work-9/c").otherwise(_text("/work/p", gc))
    )
    return every.select("agent", "id", cwd.alias("cwd"), _text("T", F.col("id")).alias("title"), F.when(F.col("role") == "subagent", _text("N", F.col("id"))).otherwise("").alias("nickname"), "start_ns", "last_ns", "role", "parent_session", "root_session")


def quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of quotas for each day: a row for each provider, its windows in the order delivered."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day"), (F.col("user_id") % 4).alias("p"), F.get_json_object("props", "$.k").cast("long").alias("k")
    )
    by = ev.groupBy("day", "p").agg(F.sum("k").alias("s"), F.count("*").alias("n"))
    s, n, start = F.col("s"), F.col("n"), F.to_timestamp("day")
    after = lambda seconds: F.timestamp_seconds(F.unix_seconds(start) + seconds)
    provider = F.when(F.col("p") == 0, "gemini").when(F.col("p") == 1, "copilot").when(F.col("p") == 2, "codex").otherwise("claude")
    by = by.select("day", provider.alias("provider"), "s", "n").where(~((F.col("provider") == "codex") & (n % 11 == 0)))
    copilot = F.col("provider") == "copilot"
    window = lambda name, other, used, open_: F.struct(
        open_.alias("unlimited"), F.when(copilot, name).otherwise(other).alias("name"), used.cast("double").alias("used"), F.when(s % 4 != 0, after(s % 90000)).alias("resets_at")
    )
    windows = F.array(window("chat", "5 hours", s % 131 - 10, copilot), window("Premium requests", "7 days", s % 97, F.lit(False)), window("completions", "5 hours", F.lit(1), copilot))
    return by.select(
        "day", "provider", F.when(n % 7 == 0, "reading failed").otherwise("").alias("error"),
        F.when(n % 3 != 0, after(s % 86400)).alias("read_at"), F.when(n % 5 != 0, after(n % 86400)).alias("as_of"), windows.alias("windows"),
    )


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of (data_revision, status_revision), in the order of their ids; some numbers fall back."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    e, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    return ev.select(
        (F.col("user_id") % 10).alias("feed"), e.alias("id"), (F.floor(e / 97) - F.when(k % 25 == 3, 2).otherwise(0)).alias("data_revision"), F.floor(e / 1000).alias("status_revision")
    )
