"""Expressions on single requests: what kind of row it is, whose it is, what it measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label of a blank model name; must equal what users of the ledger know.
UNNAMED_MODEL = "未知模型"
SUBAGENT_KINDS = ("collab_spawn", "thread_spawn", "agent_job")


def family(agent: Column) -> Column:
    return F.when(agent.isin("claude", "claude-desktop"), "claude").otherwise(agent)


def rejected() -> Column:
    return F.col("rejected") | ((F.col("provider") == "") & (F.col("status") >= 400))


def failed() -> Column:
    return (F.col("status") >= 400) | (F.col("error") != "")


def unpriced() -> Column:
    return (F.col("input") + F.col("output") > 0) & ~F.col("priced")


def retried() -> Column:
    return ~failed() & (F.col("tries") > 1)


def model_name() -> Column:
    return F.when(F.trim("model") == "", UNNAMED_MODEL).otherwise(F.col("model"))


def identity(fam: Column) -> Column:
    """struct(resolved_id, actor_id, role) of a request."""
    s, n, a, r = (F.col(c) for c in ("session", "native_session", "subagent", "session_role"))
    native = F.when(n != "", n).otherwise(s)
    of = lambda x, y, z: F.struct(x.alias("resolved_id"), y.alias("actor_id"), F.lit(z).alias("role"))
    return (
        F.when((fam != "codex") | (r == ""), of(native, native, ""))
        .when((r == "main") & (s == ""), of(F.lit(""), F.lit(""), "unknown"))
        .when(r == "main", of(s, s, "main"))
        .when((r == "subagent") & (a == ""), of(s, s, "unknown"))
        .when((r == "subagent") & (s == ""), of(a, a, "subagent"))
        .when(r == "subagent", of(s, a, "subagent"))
        .otherwise(of(s, s, "unknown"))
    )


def _sample(ok: Column, tokens: Column, window: Column) -> Column:
    ok &= (tokens > 0) & (window >= 100) & (tokens * 1000 <= window * 10000)
    ok &= ~((F.col("flow_ms") > 0) & (F.col("flow_ms") * 4 < window))
    return F.when(ok, F.struct(tokens.alias("tokens"), window.alias("ms")))


def decode_sample() -> Column:
    """struct(tokens, ms) over which a request's output speed is measured; null if it tells none."""
    thinking = F.col("reasoning") > 0
    tokens = F.when(thinking, F.col("output") - F.col("reasoning")).otherwise(F.col("output"))
    start = F.when(thinking, F.col("first_text_ms")).otherwise(F.col("ttft_ms"))
    window = F.col("ms") - start
    late = thinking & (tokens * (F.col("first_text_ms") - F.col("ttft_ms")) > F.col("reasoning") * 20 * window)
    return _sample(~failed() & (F.col("ttft_ms") > 0) & (start > 0) & ~late, tokens, window)


def request_decode_sample(fam: Column) -> Column:
    """The stricter sample of the request metrics: hidden reasoning, first reasoning, logged requests."""
    thinking, text = F.col("reasoning") > 0, F.col("first_text_ms") > 0
    other = (F.col("first_reasoning_ms") >= F.col("ttft_ms")) & (F.col("flow_ms") > 0) & (F.col("reasoning") <= F.col("output"))
    tokens = F.when(thinking & text, F.col("output") - F.col("reasoning")).otherwise(F.col("output"))
    start = F.when(thinking & text, F.col("first_text_ms")).when(thinking, F.col("first_reasoning_ms")).otherwise(F.col("ttft_ms"))
    window = F.col("ms") - start
    ok = ~failed() & (F.col("ttft_ms") > 0) & ~(F.col("reasoning_hidden") & ~text) & (~thinking | text | other) & (start > 0)
    ok &= ~(thinking & text & (tokens * (F.col("first_text_ms") - F.col("ttft_ms")) > F.col("reasoning") * 20 * window))
    ok &= ~((F.col("source") == "log") & (fam == "codex") & ((window < 1000) | (tokens < 100)))
    return _sample(ok, tokens, window)
