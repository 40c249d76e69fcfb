"""Nested documents against the flat reports of the same tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import threads as T
from ledgerloom.plans import documents, reports
from ledgerloom.sources import writers

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
SAME = [c for c in reports.VIEW if c != "decode_n"]


def written(df, path):
    """The documents of df as they are written."""
    writers.write_documents(df, str(path))
    return [json.loads(line) for f in path.glob("part-*") for line in f.read_text().splitlines()]


def flat(usage):
    return [usage[c] for c in SAME] + [usage["speed_samples"]]


def view(row):
    return [row[c] for c in SAME] + [row["decode_n"]]


def test_summary_and_distributions(spark, tmp_path):
    (one,), want = written(documents.summary(spark, SF), tmp_path / "s"), reports.summary(spark, SF).first()
    assert flat(one["usage"]) == view(want) and (one["session_count"], one["session_median"], one["session_p90"]) == (want["sessions"], want["median"], want["p90"])
    assert (one["request_metrics"]["output_speed"], one["request_metrics"]["mean_ttft_seconds"]) == (want["metric_speed"], want["mean_ttft_s"])
    got = sorted(written(documents.models(spark, SF), tmp_path / "m"), key=lambda d: d["position"])
    assert [(d["model"], flat(d["usage"])) for d in got] == [(r["model_name"], view(r)) for r in reports.model_distribution(spark, SF).collect()]
    got = sorted(written(documents.projects(spark, SF), tmp_path / "p"), key=lambda d: d["position"])
    assert [(d["kind"], d["path"], flat(d["usage"])) for d in got] == [(r["kind"], r["path"], view(r)) for r in reports.project_distribution(spark, SF).collect()]
    assert all(bool(d["name"]) == (d["kind"] == "project") for d in got)
    got = written(documents.options(spark, SF), tmp_path / "o")
    models = [d["model"] for d in sorted(got, key=lambda d: d["position"]) if d["of"] == "models"]
    assert [(m["model"], m["provider_id"], m["provider_name"]) for m in models] == [(r["model_name"], r["provider"], r["display_name"]) for r in reports.filter_options_models(spark, SF).orderBy("position").collect()]
    assert {d["of"] for d in got} == {"agents", "models", "projects"} and all(d["agent"] is None for d in got if d["of"] != "agents")


def test_session_list_and_details(spark, tmp_path):
    got = sorted(written(documents.sessions(spark, SF), tmp_path / "l"), key=lambda d: d["position"])
    want = reports.session_list(spark, SF).orderBy("position").collect()
    assert [tuple(d["thread"]["key"].values()) for d in got] == [tuple(r[k] for k in T.KEY) for r in want]
    for d, r in zip(got, want):
        assert flat(d["inclusive_usage"]) == view(r) and (d["last_activity_ms"], d["subagent_count"], d["has_usage_rows"]) == (r["last_activity_ms"], r["subagent_count"], r["has_usage_rows"])
        assert [d[n]["calls"] for n in ("self_usage", "subagent_usage", "unknown_usage")] == [r["self_calls"], r["sub_calls"], r["unknown_calls"]]
        t = d["thread"]
        assert t["parent_thread_id"] != "" and isinstance(t["model_effort"], list) and [e["place"] for e in t["model_effort"]] == list(range(1, len(t["model_effort"]) + 1))
        assert sum(e["usage"]["total"] for e in t["model_effort"]) == t["usage"]["total"]
        assert (t["first_usage_ms"] == 0) == (t["usage"]["calls"] == 0) and t["first_usage_ms"] <= t["last_usage_ms"]
    flat_rows = reports.thread_detail(spark, SF).orderBy("place").collect()
    key = tuple(flat_rows[0][k] for k in T.KEY)
    found = sorted(written(documents.session(spark, SF, key), tmp_path / "d"), key=lambda d: d["place"])
    assert [(d["place"], *d["thread"]["key"].values()) for d in found] == [(r["place"], *(r[k] for k in T.KEY)) for r in flat_rows]
    assert flat(found[0]["inclusive_usage"]) == view(flat_rows[0]) and len(found) > 1
    assert all(d["inclusive_usage"] is None and d["last_activity_ms"] is None for d in found[1:])
    listed = {tuple(d["thread"]["key"].values()): d["last_activity_ms"] for d in got}
    assert found[0]["last_activity_ms"] == listed.get(key, found[0]["thread"]["last_usage_ms"] or None)
    with pytest.raises(KeyError):
        documents.session(spark, SF, ("codex", "no", "such"))


def test_a_thread_without_use_has_zeros_and_an_empty_list(spark):
    t = reports.Ledger(spark, SF).threads()
    one = t.threads.limit(1).select(*[F.lit("quiet").alias(k) for k in T.KEY], *[c for c in t.threads.columns if c not in T.KEY]).withColumns({"parent": F.lit(""), "title": F.lit(None).cast("string")})
    d = writers.thread_documents(one, t.usage, T.model_effort(t.routed)).first()["thread"]
    assert (d["parent_thread_id"], d["title"], d["first_usage_ms"], d["last_usage_ms"], d["model_effort"]) == (None, "", 0, 0, [])
    assert d["usage"]["calls"] == 0 and d["usage"]["cost"] == 0.0 and d["usage"]["cache_hit_rate"] is None
