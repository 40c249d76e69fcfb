"""The revision feed as a stream tells what the batch job tells, over restarts, disorder and repeats."""

import json

from ledgerloom.operators import feeds
from ledgerloom.streaming import revisions

ROWS = [(f, i * 3 + f, i // 4 - (2 if i % 11 == 5 else 0), i // 9) for f in range(3) for i in range(40)]


def events(df):
    return sorted(tuple(r) for r in df.select(*feeds.ROW, "kind").collect())


def test_batches_in_disorder_tell_the_same(spark, tmp_path):
    path, df = str(tmp_path / "t"), lambda rows: spark.createDataFrame(rows, revisions.LANDED)
    want = events(feeds.changes(df(ROWS)))
    assert {k[-1] for k in want} == {"revision", "epoch_reset"} and events(revisions.told(spark, path)) == []
    parts = [[r for r in ROWS if min(2, r[1] // 42 + (r[1] % 5 == 2)) == n] for n in range(3)]
    revisions.tell(df(parts[0] + parts[0][:7]), path, 0, 45)  # ids twice in a batch
    revisions.tell(df(parts[1] + parts[0][:9]), path, 1, 45)  # and again in the next
    seen = events(revisions.told(spark, path))
    assert seen and set(seen) < set(want)
    revisions.tell(df(parts[1] + parts[0][:9]), path, 1, 45)  # a batch that was cut short runs again
    assert events(revisions.told(spark, path)) == seen
    revisions.tell(df(parts[2]), path, 2, 0)
    assert events(revisions.told(spark, path)) == want
    revisions.tell(df([(0, 1, 99, 99), (0, 10**6, 0, 0), (None, 5, 1, 1), (7, None, 1, 1)]), path, 3, 0)
    assert [tuple(r) for r in spark.read.parquet(f"{path}/late").where("batch = 3").drop("batch").collect()] == [(0, 1, 99, 99)]
    assert set(events(revisions.told(spark, path))) - set(want) == {(0, 10**6, 0, 0, "epoch_reset")}
    revisions.tell(df([]), path, 4, 0)
    assert len(events(revisions.told(spark, path))) == len(want) + 1


def test_the_stream_goes_on_after_a_restart(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    for n in range(2):
        rows = [dict(zip(feeds.ROW, r)) for r in ROWS if r[1] // 60 == n] + [dict(zip(feeds.ROW, (9, 10**6 + n, 5, 5)))]
        (tmp_path / f"land-{n}.json").write_text("\n".join(map(json.dumps, rows)))
        revisions.revision_stream(spark, at("land-*.json"), at("t"), at("mark"), 0).awaitTermination()
    got = events(revisions.told(spark, at("t")))
    assert got == events(feeds.changes(spark.createDataFrame(ROWS + [(9, 10**6, 5, 5), (9, 10**6 + 1, 5, 5)], revisions.LANDED)))
