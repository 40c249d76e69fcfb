"""Boundary cases of the request functions, paths, dates and the load job."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, paths, request as R
from ledgerloom.sources.schemas import REQUEST
from ledgerloom.sources.store import Store
from ledgerloom.streaming import load as L, sync

BASE = {"status": 200, "error": "", "output": 100, "reasoning": 0, "ms": 1200, "ttft_ms": 200, "first_text_ms": 0, "first_reasoning_ms": 0, "flow_ms": 0, "reasoning_hidden": False, "source": "gateway", "agent": "codex"}


def frame(spark, **changes):
    row = {f.name: None for f in REQUEST.fields} | BASE | changes
    return spark.createDataFrame([tuple(row[f.name] for f in REQUEST.fields)], REQUEST)


@pytest.mark.parametrize(
    ("changes", "sample"),
    [
        ({}, (100, 1000)), ({"status": 400}, None), ({"error": "x"}, None), ({"ttft_ms": 0}, None), ({"ms": 299}, None), ({"ms": 300, "output": 1}, (1, 100)),
        ({"output": 10001}, None), ({"output": 10000}, (10000, 1000)), ({"flow_ms": 249}, None), ({"flow_ms": 250}, (100, 1000)),
        ({"reasoning": 40, "first_text_ms": 400}, (60, 800)), ({"reasoning": 40}, None), ({"reasoning": 100, "first_text_ms": 400}, None), ({"reasoning": 1, "first_text_ms": 1000}, None),
    ],
)
def test_decode_sample(spark, changes, sample):
    got = frame(spark, **changes).select(R.decode_sample().alias("s")).first()["s"]
    assert (got and tuple(got)) == sample


@pytest.mark.parametrize(
    ("changes", "sample"),
    [
        ({}, (100, 1000)), ({"reasoning_hidden": True}, None), ({"reasoning": 10}, None), ({"reasoning": 10, "first_reasoning_ms": 300, "flow_ms": 900}, (100, 900)),
        ({"reasoning": 10, "first_reasoning_ms": 199, "flow_ms": 900}, None), ({"reasoning": 101, "first_reasoning_ms": 300, "flow_ms": 900}, None),
        ({"source": "log", "ms": 1199}, None), ({"source": "log", "output": 99}, None), ({"source": "log"}, (100, 1000)),
    ],
)
def test_request_decode_sample(spark, changes, sample):
    got = frame(spark, **changes).select(R.request_decode_sample(F.col("agent")).alias("s")).first()["s"]
    assert (got and tuple(got)) == sample


@pytest.mark.parametrize(
    ("path", "kind"),
    [
        ("", "projectless"), ("/work/a", "project"), ("/tmp/claude-1", "workspace"), ("/tmp/claude-", "project"), ("/private/tmp/magpie-claude-work-x/y", "workspace"), ("/tmp/x/claude-1", "project"),
        ("/home/user/Documents/Codex/2026-02-28/slug", "workspace"), ("/home/user/Documents/Codex/2026-02-30/slug", "project"), ("/home/user/Documents/Codex/2026-02-28", "project"),
        ("/var/folders/a/b/T/magpie-claude-work-1", "workspace"), ("/var/folders/a/b/U/magpie-claude-work-1", "project"), ("/tmp/./a/../claude-1/", "workspace"),
    ],
)
def test_projects(spark, path, kind):
    got = paths.with_project(spark.createDataFrame([(path,)], "cwd string")).first()["project"]
    assert got["kind"] == kind


@pytest.mark.parametrize(("path", "tidy"), [("/a//b/./c/../d/", "/a/b/d"), ("/..", "/"), ("../x", "../x"), ("a/../..", ".."), ("", "."), ("/", "/")])
def test_clean(spark, path, tidy):
    assert spark.createDataFrame([(path,)], "p string").select(paths.clean(F.col("p"))).first()[0] == tidy


@pytest.mark.parametrize(
    ("day", "zone", "utc"),
    [
        ("2026-03-08", "America/New_York", "2026-03-08 05:00:00"), ("2026-03-09", "America/New_York", "2026-03-09 04:00:00"), ("2026-11-01", "America/Havana", "2026-11-01 04:00:00"),
        ("2018-11-04", "America/Sao_Paulo", "2018-11-04 03:00:00"), ("2026-01-01", "UTC", "2026-01-01 00:00:00"),
    ],
)
def test_midnight(spark, day, zone, utc):
    got = spark.createDataFrame([(day,)], "d string").select(F.date_format(dates.midnight(F.to_date("d"), zone), "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert got == utc


@pytest.mark.parametrize(("text", "ok"), [("2026-02-28", True), ("2026-02-30", False), ("2026-2-3", False), ("x", False)])
def test_civil_date(spark, text, ok):
    assert (spark.createDataFrame([(text,)], "d string").select(dates.civil_date(F.col("d"))).first()[0] is not None) == ok


def landing(spark, path):
    """land(name, rows, pages): a file of requests lands, and a new stream loads it into the store, which it gives."""

    def land(name, rows, pages=None):
        full = [tuple(({f.name: None for f in REQUEST.fields} | r)[f.name] for f in REQUEST.fields) for r in rows]
        spark.createDataFrame(full, REQUEST).write.json(str(path / "landing" / name))
        manifest = (lambda: spark.createDataFrame(pages, "day string, total long")) if pages else None
        sync.usage_stream(spark, str(path / "landing" / "*"), str(path / "store"), str(path / "mark"), manifest, today="2026-01-02").awaitTermination()
        return Store(spark, str(path / "store")).snapshot()

    return land


def test_stream_replaces_only_landed_days(spark, tmp_path):
    land, days = landing(spark, tmp_path), lambda s: sorted((r["local_day"], r["id"], r["cost"]) for r in s.requests().collect())
    first = days(land("a", [{"id": 1, "local_day": "2026-01-01", "cost": 1.0}, {"id": 2, "local_day": "2026-01-02", "cost": 1.0}]))
    assert [x[1] for x in first] == [1, 2]
    second = days(land("b", [{"id": 3, "local_day": "2026-01-02", "cost": 2.0}]))
    assert [(x[0], x[1]) for x in second] == [("2026-01-01", 1), ("2026-01-02", 3)]


def test_verified_days(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "local_day string")
    pages = spark.createDataFrame([("a", 2), ("a", 2), ("b", 1), ("b", 2), ("c", 1)], "day string, total long")
    assert {r["day"]: r["ok"] for r in L.verified_days(rows, pages).collect()} == {"a": True, "b": False, "c": False}


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n long")
    a, b = (L.summary_fingerprint(d, ["k", "n"]).first()[0] for d in (df, df.orderBy(F.desc("k"))))
    c = L.summary_fingerprint(df.withColumn("n", F.col("n") + 1), ["k", "n"]).first()[0]
    assert a == b != c


def test_stream_holds_days_back_until_all_rows_are_there(spark, tmp_path):
    one, two = "2026-01-01", "2026-01-02"
    row = lambda day, i: {"id": i, "local_day": day, "cost": 1.0}
    land = landing(spark, tmp_path)
    seen = lambda s: (sorted((r["local_day"], r["id"]) for r in s.requests().collect()), {d: x["row_count"] for d, x in s.days.items() if x["last_sync_ns"] is not None})
    assert seen(land("a", [row(one, 1), row(two, 2)], [(one, 1), (two, 3)])) == ([(one, 1)], {one: 1})
    assert seen(land("b", [row(two, 3), row(two, 4), row(one, 9)], [(one, 2), (one, 3), (two, 3)])) == ([(one, 1), (two, 2), (two, 3), (two, 4)], {one: 1, two: 3})
    assert seen(land("c", [row(one, 5), row(one, 6)], [(one, 2)]))[0][:2] == [(one, 5), (one, 6)]
