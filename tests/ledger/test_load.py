"""The load: what a short page, a moved total, a split day, a failed day and a restart leave behind."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import dataset as D
from ledgerloom.plans import loading, reports
from ledgerloom.sources import derived, store as stores
from ledgerloom.sources.schemas import DAY_STATE, REQUEST
from ledgerloom.sources.store import LANDING, DataLoading, Store
from ledgerloom.streaming import load as L, sync

ONE, TWO = "2026-01-01", "2026-01-02"


def requests(spark, rows):
    full = [tuple(({f.name: None for f in REQUEST.fields} | r)[f.name] for f in REQUEST.fields) for r in rows]
    return spark.createDataFrame(full, REQUEST)


class Landing:
    """Files that land, and streams that start anew for each."""

    def __init__(self, spark, path):
        self.spark, self.at, self.n, self.store = spark, lambda name: str(path / name), 0, Store(spark, str(path / "store"))

    def __call__(self, rows, pages, today=TWO):
        """(ledger as (day, id, cost), state by day, revision) after rows landed."""
        requests(self.spark, rows).write.json(self.at(f"landing/{self.n}"))
        self.n += 1
        manifest = lambda: self.spark.createDataFrame(pages, "day string, total long")
        sync.usage_stream(self.spark, self.at("landing/*"), self.store.path, self.at("mark"), manifest, today=today).awaitTermination()
        return self.seen()

    def sessions(self, rows):
        with open(self.at(f"snapshots-{self.n}.json"), "w") as f:
            f.write(json.dumps({"sessions": [dict(zip(("agent", "id", "role", "root_session", "title"), r, strict=True)) | {"cwd": "", "nickname": "", "parent_session": ""} for r in rows]}))
        self.n += 1
        sync.session_stream(self.spark, self.at("snapshots-*.json"), self.store.path, self.at("mark-s")).awaitTermination()
        return {(r["agent"], r["id"]): r.asDict() for r in self.store.snapshot().sessions().collect()}

    def seen(self, version=None):
        s = self.store.snapshot(version)
        return sorted((r["local_day"], r["id"], r["cost"]) for r in s.requests().collect()), {r["day"]: r.asDict() for r in s.state().collect()}, s.whole["revision"]


def row(day, i, cost=1.0, **more):
    text = {c: "" for c in ("provider", "model", "effort", "session", "session_role", "native_session", "subagent", "parent_agent", "kind", "error", "source")}
    numbers = {c: 1 for c in ("t_ns", "input", "output", "cache_read", "cache_write", "cache_write_1h", "reasoning", "ms", "ttft_ms", "first_text_ms", "first_reasoning_ms", "flow_ms", "tries")}
    return text | numbers | {"id": i, "local_day": day, "cost": cost, "agent": "codex", "session": "s", "status": 200, "rejected": False, "priced": True, "handed_on": False, "reasoning_hidden": False} | more


def test_a_short_page_and_a_moved_total_change_nothing(spark, tmp_path):
    land = Landing(spark, tmp_path)
    ledger, state, revision = land([row(ONE, 1), row(ONE, 2)], [(ONE, 2)])
    assert [x[1] for x in ledger] == [1, 2] and state[ONE]["row_count"] == 2 and revision == 1 and state[ONE]["fingerprint"] and land.store.snapshot().days[ONE]["held"] == []
    ledger, after, revision = land([row(ONE, 3)], [(ONE, 3)])  # one of three rows came
    assert [x[1] for x in ledger] == [1, 2] and after == state and revision == 1
    ledger, after, revision = land([row(ONE, 4), row(ONE, 5)], [(ONE, 3), (ONE, 4)])  # the total moved between pages
    assert [x[1] for x in ledger] == [1, 2] and after == state and revision == 1


def test_a_split_day_waits_for_its_rest_while_others_are_saved(spark, tmp_path):
    land = Landing(spark, tmp_path)
    land([row(ONE, i) for i in range(5)], [(ONE, 5)])
    ledger, state, revision = land([row(ONE, 9), row(TWO, 1)], [(ONE, 2), (TWO, 1)])
    assert [x[:2] for x in ledger] == [(ONE, i) for i in range(5)] + [(TWO, 1)] and state[ONE]["row_count"] == 5 and revision == 3  # a day, a day, all days loaded
    ledger, state, revision = land([row(ONE, 10)], [(ONE, 2)])
    assert [x[:2] for x in ledger] == [(ONE, 9), (ONE, 10), (TWO, 1)] and state[ONE]["row_count"] == 2 and revision == 4


def test_a_row_counts_as_it_landed_last(spark):
    rows = requests(spark, [row(ONE, 1, 5.0), row(ONE, 1, 1.0)]).withColumn("landed", F.when(F.col("cost") == 5, F.to_timestamp(F.lit("2026-01-02 00:00:00"))).otherwise(F.to_timestamp(F.lit("2026-01-03 00:00:00"))))
    assert [r["cost"] for r in sync.one_a_request(rows).collect()] == [1.0]


def state(spark, *rows):
    return spark.createDataFrame([(d, f, 1, s, z, i, c, m) for d, f, s, z, i, c, m in rows], DAY_STATE)


def test_flags_are_set_for_changed_sessions_and_cleared_by_a_save(spark):
    old = state(spark, (ONE, "x", 1, False, False, True, True), (TWO, None, None, False, True, False, False))
    queued = L.requeued(old, spark.createDataFrame([(ONE,), ("2026-01-05",)], "day string"))
    got = {r["day"]: (r["identity_pending"], r["row_count"]) for r in queued.collect()}
    assert got == {ONE: (True, 1), TWO: (True, 1), "2026-01-05": (True, 0)}
    saved = spark.createDataFrame([(ONE, "y", 7)], "day string, fingerprint string, row_count long")
    for available in (True, False):
        after = {r["day"]: r.asDict() for r in L.saved_state(queued, saved, 1_800_000_000 * 10**9, "2026-02-01", available).collect()}
        assert after[ONE]["fingerprint"] == "y" and after[ONE]["row_count"] == 7 and after[ONE]["frozen"]
        assert after[ONE]["identity_pending"] is (not available) and not after[ONE]["compaction_pending"] and not after[ONE]["metrics_pending"]
        assert after[TWO]["last_sync_ns"] is None and after[TWO]["identity_pending"] and not after[TWO]["frozen"]


def test_reports_wait_until_all_days_are_loaded(spark, tmp_path):
    land = Landing(spark, tmp_path)
    with pytest.raises(DataLoading):
        reports.model_distribution(spark, land.store.snapshot())
    land([row(ONE, 1)], [(ONE, 1)])
    with pytest.raises(DataLoading):  # the second day is missing
        reports.usage_by_day(spark, land.store.snapshot())
    _, state, revision = land([row(ONE, 2)], [(ONE, 1), (TWO, 0)])  # it has no requests
    assert state[TWO]["row_count"] == 0 and state[TWO]["last_sync_ns"] is not None and revision == 4
    assert [r["calls"] for r in reports.model_distribution(spark, land.store.snapshot()).collect()] == [1]
    assert reports.session_totals(spark, land.store.snapshot()).count() == 1
    assert L.day_counts(land.store.snapshot().state()).first()["never_loaded"] == 0


def shot(snapshot):
    """What a reader of a version sees."""
    days = sorted((r["local_day"], r["id"], r["cost"]) for r in snapshot.requests().collect())
    cells = sorted((r["local_day"], r["calls"], str(r["cost"])) for r in snapshot._between("cells", stores.P.cell_schema(snapshot.spark), None, None).groupBy("local_day").agg(F.sum("calls").alias("calls"), F.sum("cost").alias("cost")).collect())
    return days, cells, sorted(map(str, snapshot.days.values())), snapshot.whole


def landed(spark, rows, at="2026-01-03 10:00:00"):
    return requests(spark, rows).withColumn("landed", F.to_timestamp(F.lit(at))).select(*LANDING.fieldNames())


def test_a_load_that_stops_leaves_the_old_version_and_runs_again(spark, tmp_path, monkeypatch):
    """Stopped after each write, and before the manifest's; the same batch then gives what it would have given at once."""
    pages = spark.createDataFrame([(ONE, 2), (TWO, 1)], "day string, total long")
    first, second = [row(ONE, 1), row(ONE, 2), row(TWO, 3)], [row(ONE, 1, 5.0), row(ONE, 2, 5.0), row(TWO, 9)]
    store, done = Store(spark, str(tmp_path / "stopped")), Store(spark, str(tmp_path / "plain"))
    for s in (store, done):
        sync.save_days(s, landed(spark, first), pages, 0, TWO)
    before = shot(store.snapshot())
    real = Store.write_days
    for stop in ("held", "rows", "cells", "acts", "manifest"):

        def breaks(self, df, name, stop=stop):
            out = real(self, df, name)
            if name == stop:  # the files are there, nothing names them
                raise RuntimeError("stopped")
            return out

        monkeypatch.setattr(Store, "write_days", breaks)
        if stop == "manifest":
            monkeypatch.setattr(Store, "commit", lambda *a, **b: 1 / 0)
        with pytest.raises((RuntimeError, ZeroDivisionError)):
            sync.save_days(store, landed(spark, second, "2026-01-04 10:00:00"), pages, 1, TWO)
        monkeypatch.undo()
        assert shot(Store(spark, store.path).snapshot()) == before
    for s in (store, done):
        sync.save_days(s, landed(spark, second, "2026-01-04 10:00:00"), pages, 1, TWO)
    again = sync.save_days(store, landed(spark, second, "2026-01-05 10:00:00"), pages, 1, TWO)  # committed: skipped
    plain, stopped = (shot(s.snapshot()) for s in (done, store))
    state = lambda s: sorted(map(str, s.snapshot().state().collect()))
    assert again.version == 2 and stopped[:2] == plain[:2] and state(store) == state(done) and stopped[3] == plain[3]
    assert [x[2] for x in stopped[0]] == [5.0, 5.0, 1.0] and [x[:2] for x in stopped[1]] == [(ONE, 2), (TWO, 1)]


def test_readers_keep_their_version_until_it_is_vacuumed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for n in range(4):
        sync.save_days(store, landed(spark, [row(ONE, 1, float(n)), row(TWO, 2, 7.0)] if n == 0 else [row(ONE, 1, float(n))]), None, n, TWO)
        if n == 1:
            old = store.snapshot()
    assert [r["cost"] for r in old.requests(ONE, ONE).collect()] == [1.0]
    assert all(old.days[TWO]["rows"] in f for f in old.requests(TWO, TWO).inputFiles())  # one day is read
    assert [r["day"] for r in old.state(TWO).collect()] == [TWO] and old.state("2026-01-03").count() == 0
    gone = store.vacuum(keep=2)
    assert any(g.startswith("manifest/") for g in gone) and old.days[ONE]["rows"].partition("/day_")[0] in {g.partition("/day_")[0] for g in gone}
    assert [(r["id"], r["cost"]) for r in store.snapshot(3).requests().collect()] == [(1, 2.0), (2, 7.0)]
    assert [(r["id"], r["cost"]) for r in Store(spark, store.path).snapshot().requests().collect()] == [(1, 3.0), (2, 7.0)]
    with pytest.raises(Exception):
        old.requests(ONE, ONE).collect()


def test_the_session_stream_queues_days_which_the_usage_stream_clears(spark, tmp_path):
    """Over restarts: each call starts new streams on a new store object."""
    land = Landing(spark, tmp_path)
    mine = dict(session="a", session_role="main")
    table = land.sessions([("codex", "a", "main", "r0", "one"), ("codex", "b", "", "", "two"), ("gemini", "a", "", "", "g")])
    assert table["codex", "a"]["root_session"] == "r0" and land.store.snapshot().whole["identity_available"]
    _, state, revision = land([row(ONE, 1, **mine), row(TWO, 2, session="r0", session_role="main"), row(TWO, 3, session="a", agent="gemini")], [(ONE, 1), (TWO, 2)])
    assert not any(s["identity_pending"] for s in state.values()) and revision == 4  # sessions, two days, complete
    # nothing new but what comes without identity: roles stay, no day is queued
    table = land.sessions([("codex", "a", "", "", "one"), ("codex", "b", "", "", "two"), ("gemini", "a", "", "", "g")])
    assert table["codex", "a"]["role"] == "main" and land.seen()[2] == 4 and not land.store.snapshot().whole["identity_available"]
    # a title alone raises the revision; one session gone too
    table = land.sessions([("codex", "a", "", "", "another"), ("codex", "b", "", "", "two")])
    assert table["gemini", "a"]["disappeared"] and land.seen()[2] == 5 and not any(s["identity_pending"] for s in land.seen()[1].values())
    # a moved root queues the days of the session, of its old root and of its new one
    table = land.sessions([("codex", "a", "main", "r1", "another"), ("codex", "b", "", "", "two"), ("gemini", "a", "", "", "g")])
    assert table["codex", "a"]["root_session"] == "r1" and not table["gemini", "a"]["disappeared"]
    _, state, revision = land.seen()
    assert {d: s["identity_pending"] for d, s in state.items()} == {ONE: True, TWO: True} and revision == 6
    digests = L.day_digests(land.store.snapshot().requests())
    want = lambda: {r["day"]: r["decision"] for r in sync.decisions(land.store.snapshot(), digests, TWO).collect()}
    assert want() == {ONE: "pull: identity", TWO: "pull: identity"}
    _, state, _ = land([row(ONE, 1, **mine)], [(ONE, 2)])  # short: the flag stays
    assert state[ONE]["identity_pending"]
    _, state, _ = land([row(ONE, 1, **mine)], [(ONE, 1)])
    assert {d: s["identity_pending"] for d, s in state.items()} == {ONE: False, TWO: True} and want() == {ONE: "skip: same", TWO: "pull: identity"}


def test_a_changed_summary_is_remembered_until_its_days_are_saved(spark, tmp_path):
    land = Landing(spark, tmp_path)
    land([row(ONE, 1), row(TWO, 2)], [(ONE, 1), (TWO, 1)])
    digests = L.day_digests(land.store.snapshot().requests())
    want = lambda: {r["day"]: r["decision"] for r in sync.decisions(Store(spark, land.store.path).snapshot(), digests, TWO).collect()}
    groups = lambda *rows: L.summary_fingerprint(spark.createDataFrame(rows, "k string, n long"), ["k", "n"]).first()[0]
    assert groups(("a", 1), ("b", 2)) == groups(("b", 2), ("a", 1)) != groups(("a", 1), ("b", 3))
    sync.note_summary(land.store, groups(("a", 1)), TWO)
    assert want() == {ONE: "skip: same", TWO: "skip: same"}
    sync.note_summary(land.store, groups(("a", 2)), TWO)
    assert want() == {ONE: "pull: recent", TWO: "pull: recent"}
    land([row(ONE, 1)], [(ONE, 2)])  # a failed save
    sync.note_summary(land.store, groups(("a", 2)), TWO)  # after a restart nothing has changed again
    assert want() == {ONE: "pull: recent", TWO: "pull: recent"}
    land([row(TWO, 2)], [(TWO, 1)])
    assert want() == {ONE: "pull: recent", TWO: "skip: same"}
    land([row(ONE, 1)], [(ONE, 1)])
    assert want() == {ONE: "skip: same", TWO: "skip: same"}


def test_pages_prove_a_day(spark):
    pages = {
        "whole": [(0, 500, 1200), (500, 500, 1200), (1000, 200, 1200)], "gap": [(0, 500, 1200), (600, 600, 1200)], "overlap": [(0, 500, 1000), (400, 600, 1000)], "repeated": [(0, 500, 1000), (0, 500, 1000)],
        "moved": [(0, 500, 1000), (500, 500, 1001)], "short": [(0, 500, 1000)], "late": [(1, 999, 1000)], "empty": [(0, 0, 0)], "odd": [(0, -5, 10), (-5, 15, 10)], "gap and repeat": [(0, 500, 1000), (0, 500, 1000), (500, 500, 1000)],
    }
    rows = [(d, *p) for d, ps in pages.items() for p in ps]
    got = {(r["day"], r["total"]) for r in L.proven_pages(spark.createDataFrame(rows, "day string, offset long, count long, total long")).collect()}
    assert got == {("whole", 1200), ("empty", 0)}


def test_reports_on_a_store_equal_those_on_the_rows(spark):
    """After days were replaced and sessions merged: partial sums give what the rows give."""
    snapshot = loading.story(spark, "/root/testdata/sf0.001")[1][-1]
    whole = type("Rows", (), {"path": "rows", "metadata": snapshot.metadata, "usage": snapshot.usage, "cells": lambda self, a, b: snapshot.usage(a, b)})()
    for scope in (D.Scope(), D.Scope("2024-01-05", "2024-01-20", agents=("codex",), projects=(("project", "/work/alpha"), ("workspace", "")))):
        for report in (reports.model_distribution, reports.project_distribution):
            assert sorted(map(str, report(spark, snapshot, scope).collect())) == sorted(map(str, report(spark, whole, scope).collect()))
    rows = D.in_scope(snapshot.usage())
    merged = reports.Ledger(spark, snapshot).sessions()
    assert sorted(map(str, merged.collect())) == sorted(map(str, D.sessions(rows, snapshot.metadata).collect()))
    assert derived.ledger(spark, "/root/testdata/sf0.001").count() >= rows.count() > 0


def test_candidates_go_from_the_first_day_to_today(spark):
    old = state(spark, ("2025-12-01", "x", 1, True, False, False, False))
    days = lambda series, today: sorted(r["day"] for r in L.candidate_days(spark.createDataFrame([(d,) for d in series], "day string"), old, today).collect())
    assert days([TWO, None], "2026-01-03") == ["2025-12-01", TWO, "2026-01-03"]
    assert days([], "2026-01-03") == ["2025-12-01", "2026-01-03"]
    assert days(["2026-01-09"], "2026-01-03") == ["2025-12-01", "2026-01-03"]
