"""Schemas of the landing files and of the ledger tables."""

from pyspark.sql import types as T

_text = ("agent", "agent_name", "provider", "provider_name", "model", "requested", "served", "effort", "kind",
         "session", "session_role", "native_session", "subagent", "parent_agent", "source")
_long = ("input", "output", "cache_read", "cache_write", "cache_write_1h", "reasoning", "ms", "ttft_ms", "first_text_ms", "first_reasoning_ms", "flow_ms")

#: One row per LLM request. Empty strings mean "absent"; compaction has three states.
REQUEST = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("t_ns", T.LongType()), T.StructField("local_day", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in _text]
    + [T.StructField("status", T.IntegerType()), T.StructField("rejected", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("tries", T.IntegerType())]
    + [T.StructField(c, T.LongType()) for c in _long]
    + [T.StructField(c, T.BooleanType()) for c in ("reasoning_hidden", "handed_on", "compaction")]
    + [T.StructField("cost", T.DoubleType()), T.StructField("priced", T.BooleanType())]
)

#: What the wire has besides and the ledger doesn't keep.
LANDED = T.StructType(
    [*REQUEST.fields, T.StructField("account", T.StringType()), T.StructField("caller", T.StringType())]
    + [T.StructField("route_id", T.IntegerType()), T.StructField("rid", T.StringType()), T.StructField("response_id", T.StringType())]
)

#: A page of a pull of one day's requests.
PAGE = T.StructType(
    [T.StructField("day", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("pull", "offset", "total")] + [T.StructField("rows", T.ArrayType(REQUEST))]
)

#: One row per (agent, id).
SESSION = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("agent", "id", "cwd", "title", "nickname")]
    + [T.StructField(c, T.LongType()) for c in ("start_ns", "last_ns")]
    + [T.StructField(c, T.StringType()) for c in ("role", "parent_session", "root_session")]
)

#: The session table: what snapshots have said of each session so far.
SESSION_STATE = T.StructType([*SESSION.fields, T.StructField("first_seen_ns", T.LongType()), T.StructField("last_seen_ns", T.LongType()), T.StructField("disappeared", T.BooleanType())])

#: One row per day of the ledger: what was loaded and what is still to be pulled again.
DAY_STATE = T.StructType(
    [T.StructField("day", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("row_count", T.LongType()), T.StructField("last_sync_ns", T.LongType())]
    + [T.StructField(c, T.BooleanType()) for c in ("frozen", "identity_pending", "compaction_pending", "metrics_pending")]
)

_window = T.StructType([T.StructField("unlimited", T.BooleanType()), T.StructField("name", T.StringType()), T.StructField("used", T.DoubleType()), T.StructField("resets_at", T.TimestampType())])
_totals = [T.StructField(c, T.LongType()) for c in ("calls", "errors", "input", "output", "cache_read", "cache_write", "reasoning")]
_totals += [T.StructField("cost", T.DoubleType()), T.StructField("unpriced", T.LongType())]
_group = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("id", "provider", "model", "account", "agent", "name")] + _totals))
_point = T.StructType([T.StructField("label", T.StringType()), T.StructField("time", T.TimestampType()), *_totals])
#: A summary of a period: its series by day and its groups of each kind.
SUMMARY = T.StructType(
    [T.StructField("period", T.StringType()), T.StructField("since", T.TimestampType()), T.StructField("bucket", T.StringType()), T.StructField("series", T.ArrayType(_point))]
    + [T.StructField(c, _group) for c in ("agents", "models", "accounts", "callerKeys")]
    + _totals
)
_tool = T.StructType([T.StructField("name", T.StringType()), T.StructField("category", T.StringType()), T.StructField("calls", T.LongType())])
_week = T.StructType([T.StructField("start", T.StringType()), T.StructField("calls", T.MapType(T.StringType(), T.LongType()))])
#: An overview of sessions; only the block of tools is used.
OVERVIEW = T.StructType(
    [T.StructField("tools", T.StructType([T.StructField("calls", T.LongType()), T.StructField("sessions", T.LongType()), T.StructField("top", T.ArrayType(_tool)), T.StructField("weeks", T.ArrayType(_week))]))]
)

#: One row per provider, its windows in the order delivered.
QUOTA = T.StructType(
    [
        T.StructField("provider", T.StringType()), T.StructField("state", T.StringType()), T.StructField("read_at", T.TimestampType()),
        T.StructField("as_of", T.TimestampType()), T.StructField("windows", T.ArrayType(_window)),
    ]
)
