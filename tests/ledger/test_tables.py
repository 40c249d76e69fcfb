"""Scans of the tables, positions, pages, details, readers and nested results."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import quotas as Q, ranking, tables as S, threads as T
from ledgerloom.plans import reports
from ledgerloom.operators import dataset as D, measures as M
from ledgerloom.sources import derived, readers, writers

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@needs_tables
@pytest.mark.parametrize("name", ["model_distribution", "project_distribution", "request_metrics", "usage_shares", "session_model_effort", "day_range", "share_top5_other", "kpi_ratios", "agent_filter"])
def test_a_report_scans_the_usage_table_once(spark, name):
    text = plan(reports.QUERIES[name](spark, SF))
    assert len(re.findall(r"^Location: .*/usage\]", text, re.M)) <= 1 and "events.parquet" not in text


@needs_tables
def test_days_prune_partitions_and_columns(spark):
    text = plan(reports.day_range(spark, SF))
    assert re.search(r"PartitionFilters: \[.*local_day.*2024-01-", text)
    assert "reasoning_hidden" not in re.search(r"ReadSchema: (.*)", text)[1]


def test_positions_are_those_of_a_global_sort(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 3).alias("g")).repartition(7)
    got = ranking.numbered(df, F.desc("g"), "x").orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, 1001))
    assert [(r["g"], r["x"]) for r in got] == sorted(((r["g"], r["x"]) for r in got), key=lambda p: (-p[0], p[1]))
    assert ranking.numbered(df.limit(0), "x").count() == 0


@pytest.mark.parametrize(("values", "median", "p90"), [([4, 5, 8, 10, 18, 40], 8, 40), ([1], 1, 1), ([3, 1, None, 2], 2, 3), ([None], None, None), ([5] * 10, 5, 5)])
def test_nearest_ranks(spark, values, median, p90):
    got = ranking.nearest_rank(spark.createDataFrame([(v,) for v in values], "v long"), "v", median=50, p90=90).first()
    assert (got["median"], got["p90"]) == (median, p90)


def items(spark, rows):
    names = "agent string, session_id string, thread_id string, last_activity long, has_usage_rows boolean, total long, cost double, cache_hit_rate double, project struct<kind:string,path:string,name:string>"
    return spark.createDataFrame([("a", s, s, last, used, total, 1.0, 0.5, ("project" if name else "projectless", "", name)) for s, last, used, total, name in rows], names)


def test_pages_of_sessions(spark):
    df = items(spark, [(f"s{i:02}", i if i else None, i != 3, 100 - i, f"p{i}" if i != 5 else "") for i in range(14)])
    ids = lambda *a: [r["session_id"] for r in S.page(df, *a).orderBy("position").collect()]
    assert ids("last_activity", True, 1)[0] == "s13" and ids("last_activity", True, 3) == ["s01", "s00"]
    assert ids("last_activity", False, 99) == ["s13", "s00"] and ids("last_activity", True, 0) == ids("last_activity", True, 1)
    assert ids("total", True, 1)[:4] == ["s00", "s01", "s02", "s04"] and ids("total", False, 3)[-1] == "s03"
    assert ids("project", False, 1) == ["s00", "s01", "s02", "s03", "s04", "s06"] and ids("project", True, 1)[0] == "s13"
    assert S.page(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.page(df, "title")


@needs_tables
def test_details_of_a_thread(spark):
    t = reports.Ledger(spark, SF).threads()
    below = T.children(t.threads, t.usage)
    key = tuple(t.rolled.orderBy(F.desc("n_children"), *T.KEY).select(*T.KEY).first())
    got = T.detail(t.rolled, below, key).orderBy("place").collect()
    assert (got[0]["agent"], got[0]["session_id"], got[0]["thread_id"]) == key and len(got) == 1 + got[0]["n_children"]
    with pytest.raises(KeyError):
        T.detail(t.rolled, below, ("codex", "none", "none"))
    with pytest.raises(ValueError):
        reports.tool_usage_days(spark, SF, 8)


@needs_tables
def test_nested_documents_keep_nulls(spark, tmp_path):
    t = reports.Ledger(spark, SF).threads()
    measures = ("calls", "total", "cost", "cache_hit_rate")
    docs = writers.session_documents(M.derived(t.listed), M.derived(T.model_effort(t.routed)), measures)
    writers.write_documents(docs, str(tmp_path / "out"))
    rows = [json.loads(line) for f in (tmp_path / "out").glob("part-*") for line in f.read_text().splitlines()]
    assert len(rows) == t.listed.count() and all(set(r) == set(docs.columns) for r in rows)
    counts = {(r["agent"], r["session_id"], r["thread_id"]): r["subagent_count"] for r in t.listed.collect()}
    assert {tuple(r["key"].values()): r["subagent_count"] for r in rows} == counts
    for r in rows:
        order = [e["place"] for e in r["model_efforts"]]
        assert order == sorted(order) and isinstance(r["model_efforts"], list) and set(r["usage"]) == set(measures)


def test_readers_of_landing_files(spark, tmp_path):
    write = lambda name, *objects: (tmp_path / name).write_text("\n".join(map(json.dumps, objects)))
    at = lambda name: str(tmp_path / name)
    write("r.json", {"id": 1, "account": "x", "compaction": False, "status": 500, "error": "", "model": "Big"}, {"id": 2, "account": "y", "status": 200, "error": "", "model": "m", "local_day": "2026-01-01"})
    rows = readers.read_landed(spark, at("r.json"))
    assert [r["compaction"] for r in rows.orderBy("id").collect()] == [False, None]
    wanted = lambda **q: [r["id"] for r in readers.wanted_requests(rows, **q).orderBy("id").collect()]
    assert wanted(account="x") == [1] and wanted(failed=True) == [1] and wanted(search="BIG") == [1] and wanted(day="2026-01-01") == [2] and wanted() == [1, 2]
    write("s.json", {"period": "all", "series": [{"label": "a", "calls": 2}], "agents": [{"id": "codex", "calls": 2}], "accounts": [{"id": "k", "calls": 1}]})
    series, groups = readers.read_summary(spark, at("s.json"))
    assert [(r["label"], r["calls"]) for r in series.collect()] == [("a", 2)] and sorted((r["kind"], r["id"]) for r in groups.collect()) == [("accounts", "k"), ("agents", "codex")]
    write("o.json", {"tools": {"calls": 9, "top": [{"name": "t1", "category": "c", "calls": 5}]}})
    assert [tuple(r) for r in readers.read_tools(spark, at("o.json")).collect()] == [(9, "t1", "c", 5)]
    write("q.json", {"provider": "codex", "windows": [{"name": "5 hours", "used": 120.0}]})
    write("q2.json", {"provider": "claude", "windows": []}, {"provider": "codex", "windows": []})
    assert sorted(r["provider"] for r in readers.read_quotas(spark, at("q.json"), at("q2.json")).collect()) == ["claude", "codex"]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        (tmp_path / "bad.json").write_text("{")
        readers.read_landed(spark, at("bad.json")).collect()


def test_cards_and_public_quota(spark):
    w = lambda name, used: (False, name, float(used), None)
    rows = [("d", "zed", "", None, None, [w("5 hours", 50)]), ("d", "codex", "", None, None, [w("5 hours", -4), w("7 days", 41.5), w("5 hours", 1)]), ("d", "copilot", "", None, None, [w("chat", 1), w("PREMIUM x", 300)]), ("e", "codex", "no", None, None, [])]
    df = spark.createDataFrame(rows, "day string, provider string, error string, read_at timestamp, as_of timestamp, windows array<struct<unlimited:boolean,name:string,used:double,resets_at:timestamp>>")
    got = [(r["provider"], r["name"], r["used"], r["remaining"], r["band"]) for r in Q.cards(df).orderBy("rank", "delivered").collect()]
    assert got == [("codex", "5 hours", 0, 100, "high"), ("codex", "7 days", 41.5, 59, "middle"), ("codex", "5 hours", 1, 99, "high"), ("copilot", "PREMIUM x", 100, 0, "low"), ("zed", "5 hours", 50, 50, "middle")]
    view = {r["day"]: r.asDict() for r in Q.public_view(spark.createDataFrame([("d",), ("e",), ("f",)], "day string"), df).collect()}
    assert [view[d]["status"] for d in "def"] == ["ready", "unavailable", "auth_required"]
    assert view["d"]["five_hour_used"] == -4 and view["d"]["weekly_remaining"] == 58.5 and view["e"]["five_hour_used"] is None
    kept = {r["provider"]: r.asDict() for r in Q.kept(df).collect()}
    assert kept["codex"]["good_day"] == "d" and kept["codex"]["error"] == "no" and kept["codex"]["used"] == -4


def test_enriching_then_scoping_is_what_usage_rows_gives(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    rows = derived.ledger(spark, SF)
    meta = D.merged_metadata(derived.sessions(rows))
    scope = D.Scope("2024-01-05", "2024-01-09", agents=("codex",), projects=(("workspace", ""),))
    a = D.usage_rows(rows, meta, scope).select("id").collect()
    b = reports.Ledger(spark, SF, scope).rows.select("id").collect()
    assert sorted(a) == sorted(b)


@needs_tables
def test_tables_that_are_gone_are_loaded_again(spark):
    import shutil

    from ledgerloom.sources.tables import tables

    first = tables(spark, SF)
    assert tables(spark, SF) is first
    shutil.rmtree(first.path.removeprefix("file:"))
    again = tables(spark, SF)
    assert again.path != first.path and again.usage().count() > 0
