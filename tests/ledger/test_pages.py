"""Pages that land in any batches: what proves a day, what holds it back, over restarts."""

import json

import pytest

from ledgerloom.sources.store import Store
from ledgerloom.streaming import pages as P

from test_load import ONE, TWO, row


class Land:
    """Page files; a new stream takes each group of them."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n, self.store = spark, path, 0, Store(spark, str(path / "store"))

    def __call__(self, *pages):
        """{day: (ids, row_count)} after pages (day, pull, offset, total, rows) landed."""
        for day, pull, offset, total, rows in pages:
            (self.path / f"page-{self.n}.json").write_text(json.dumps({"day": day, "pull": pull, "offset": offset, "total": total, "rows": rows}))
            self.n += 1
        P.page_stream(self.spark, str(self.path / "page-*.json"), self.store.path, str(self.path / "mark"), today=TWO).awaitTermination()
        s = self.store.snapshot()
        ids = {}
        for r in s.requests().collect():
            ids.setdefault(r["local_day"], []).append(r["id"])
        return {day: (sorted(ids.get(day, [])), d["row_count"]) for day, d in s.days.items()}


def some(day, *ids):
    return [row(day, i) for i in ids]


def test_a_day_is_saved_once_its_latest_pull_is_whole(spark, tmp_path):
    land = Land(spark, tmp_path)
    assert land((ONE, 1, 0, 3, some(ONE, 1, 2))) == {}  # the rest is missing
    assert land((ONE, 1, 2, 3, some(ONE, 3)), (TWO, 1, 0, 2, some(TWO, 7))) == {ONE: ([1, 2, 3], 3)}
    revision = land.store.snapshot().whole["revision"]
    assert land((ONE, 2, 0, 2, some(ONE, 1))) == {ONE: ([1, 2, 3], 3)}  # a new pull has begun; the day keeps what it had
    assert land((ONE, 1, 0, 3, some(ONE, 1, 2))) == {ONE: ([1, 2, 3], 3)}  # a page of the older pull
    assert land.store.snapshot().whole["revision"] == revision
    assert land((TWO, 1, 1, 2, some(TWO, 8)), (ONE, 2, 1, 2, some(ONE, 4))) == {ONE: ([1, 4], 2), TWO: ([7, 8], 2)}
    assert land((TWO, 2, 0, 0, [])) == {ONE: ([1, 4], 2), TWO: ([], 0)}  # now empty


DEFECTS = [
    [(2, 0, 3, [1]), (2, 2, 3, [3])],  # a gap
    [(2, 0, 3, [1, 2]), (2, 1, 3, [2, 3])],  # an overlap
    [(2, 0, 2, [1, 2]), (2, 0, 2, [1, 2])],  # a page twice
    [(2, 0, 3, [1, 2]), (2, 2, 4, [3])],  # the total moved
    [(2, 0, 3, [1, 2, 2])],  # a row twice
    [(2, 0, None, [1])], [(2, None, 1, [1])], [(2, 0, 1, None)], [(None, 0, 1, [1])], [(2, 0, 2, [1, "other day"])],
]


def test_what_holds_a_day_back(spark, tmp_path):
    """Each defect in a day of its own: all days keep what they had, and a later pull replaces it."""
    land, days = Land(spark, tmp_path), [f"2026-01-{n + 1:02}" for n in range(len(DEFECTS))]
    before = {d: ([9], 1) for d in days}
    assert land(*[(d, 1, 0, 1, some(d, 9)) for d in days]) == before
    rows = lambda d, ids: None if ids is None else [row("2025-01-01" if i == "other day" else d, 5 if i == "other day" else i) for i in ids]
    pages = [(d, *p[:3], rows(d, p[3])) for d, ps in zip(days, DEFECTS, strict=True) for p in ps]
    assert land(*pages, (None, 2, 0, 1, some(ONE, 1))) == before and land.store.snapshot().whole["usage_batch"] == 1
    assert land(*[(d, 3, 0, 1, some(d, 5)) for d in days]) == {d: ([5], 1) for d in days}


def test_a_batch_that_was_cut_short_gives_the_same(spark, tmp_path, monkeypatch):
    land = Land(spark, tmp_path)
    land((ONE, 1, 0, 2, some(ONE, 1)))
    monkeypatch.setattr(Store, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(Exception, match="stopped"):
        land((ONE, 1, 1, 2, some(ONE, 2)))
    monkeypatch.undo()
    assert land.store.snapshot().days == {}
    assert land() == {ONE: ([1, 2], 2)}
    once = land.store.snapshot()
    P.save_pages(land.store, spark.createDataFrame([], "day string, pull long, offset long, total long, rows array<struct<local_day string>>, landed timestamp"), once.whole["usage_batch"])
    assert land.store.snapshot().version == once.version
