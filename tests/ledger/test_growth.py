"""What keeps the tables' work in proportion to the rows, and spread over tasks."""

import re

from ledgerloom.operators import dataset as D, threads as T
from ledgerloom.plans import reports
from ledgerloom.sources import derived, tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ledger_is_derived_once_and_dealt_out(spark, monkeypatch):
    tables.ledger(spark, SF)
    monkeypatch.setattr(derived, "ledger", None)  # not asked again
    assert tables.ledger(spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()
    monkeypatch.undo()
    assert "hashpartitioning(e#" in plan(derived.ledger(spark, SF, dealt=True))
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_sums_of_sessions_are_hashed(spark):
    acts = plan(D.session_acts(tables.tables(spark, SF).usage()))
    assert not re.search(r"SortAggregate.*sum\(", acts) and re.search(r"HashAggregate.*sum\(", acts)


def test_only_seeking_rows_are_dealt_out_by_id(spark):
    rows = reports.Ledger(spark, SF).rows
    t = reports.Ledger(spark, SF).threads()
    assert "Union" in plan(T.routed(rows, t.sessions))
    assert set(T.NEEDED) <= set(t.routed.columns) and "ttft_ms" not in t.routed.columns
    assert t.routed.where("seeks IS NOT NULL").count() > 0 and t.routed.where("seeks IS NULL AND mapped IS NOT NULL").isEmpty()
