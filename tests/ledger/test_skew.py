"""Hot keys, deep chains and deep pages: the same rows, and no task that gets them all."""

import random
import re

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators import dataset as D, ranking, scans, tables as S, threads as T


@pytest.fixture(autouse=True)
def small_ranges(spark):
    """As many ranges as shuffle partitions, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_latest_before_splits_a_hot_key(spark, monkeypatch):
    pick, rows = random.Random(3), []
    for i in range(20_000):
        of = "hot" if i % 10 else f"k{pick.randrange(300)}"
        anchor = f"v{i}" if pick.random() < (0.0002 if of == "hot" else 0.3) else None  # most ranges of the hot key have none
        rows.append((i, of, (pick.randrange(1 << 40), i), anchor))
    df = spark.createDataFrame(rows, "id long, of string, ord struct<t:long,i:long>, anchor string").repartition(7)
    seen = []
    real = scans.staged
    monkeypatch.setattr(scans, "staged", lambda d: seen.append(real(d)) or seen[-1])
    got = {r["id"]: r["latest"] for r in scans.latest_before(df, "of", "ord", "anchor").collect()}
    before = W.partitionBy("of").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    want = {r["id"]: r["x"] for r in df.withColumn("x", F.last("anchor", ignorenulls=True).over(before)).collect()}
    assert got == want and len(set(got.values())) > 100
    sizes = [r["n"] for r in seen[0].groupBy("part_").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
    assert scans.latest_before(df.limit(0), "of", "ord", "anchor").columns == [*df.columns, "latest"]


def test_ranks_where_most_values_are_equal(spark, monkeypatch):
    pick = random.Random(4)
    values = [5] * 9_000 + [pick.randrange(1000) for _ in range(1_000)] + [None] * 50
    seen, real = [], ranking.staged
    monkeypatch.setattr(ranking, "staged", lambda d: seen.append(real(d)) or seen[-1])
    got = ranking.nearest_rank(spark.createDataFrame([(v,) for v in values], "v long"), "v", median=50, p90=90, p97=97, top=100).first()
    order = sorted(v for v in values if v is not None)
    assert tuple(got) == tuple(order[-(-len(order) * p // 100) - 1] for p in (50, 90, 97, 100))
    sizes = [r["n"] for r in seen[0].groupBy("part_").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == len(set(order)) and max(sizes) < 2.5 * sum(sizes) / 8  # a row for each value
    assert tuple(ranking.nearest_rank(spark.createDataFrame([(None,)], "v long"), "v", median=50).first()) == (None,)


def forest(spark, edges):
    rows = [("codex", s, t, "subagent", p) for s, t, p in edges]
    return spark.createDataFrame(rows, "agent string, session_id string, thread_id string, type string, parent string")


def closure(edges):
    up = {(s, t): p for s, t, p in edges}
    out = set()
    for s, t in up:
        at, seen = up[s, t], set()
        while (s, at) in up and at not in seen:
            seen.add(at)
            if at != t:
                out.add((s, at, t))
            at = up[s, at]
    return out


def test_descendants_of_chains_trees_and_cycles(spark, monkeypatch):
    pick = random.Random(5)
    edges = [("chain", f"c{i}", f"c{i - 1}" if i else "root") for i in range(200)]
    edges += [("tree", f"t{i}", f"t{pick.randrange(i)}" if i else "") for i in range(60)]
    edges += [("ring", f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("ring", "tail", "r0"), ("self", "x", "x"), ("self", "y", "x"), ("other", "c5", "c4")]
    rounds, real = [], T.staged
    monkeypatch.setattr(T, "staged", lambda d: rounds.append(1) or real(d))
    got = [(r["session_id"], r["top"], r["thread_id"]) for r in T.descendants(forest(spark, edges)).collect()]
    assert len(got) == len(set(got)) and set(got) == closure(edges)
    assert len(rounds) <= 1 + 2 * 9  # 200 levels in some eight rounds


def items(spark, rows):
    kind = "agent string, session_id string, thread_id string, last_activity long, has_usage_rows boolean, total long, cost double, cache_hit_rate double, project struct<kind:string,path:string,name:string>"
    return spark.createDataFrame([("codex", i, i, a, True, 1, 1.0, 0.5, ("project", "/" + n, n) if n is not None else ("unknown", "", "")) for i, a, n in rows], kind)


def test_a_deep_page_sorts_only_its_range(spark):
    n = 5_000
    order = list(range(n))
    random.Random(6).shuffle(order)
    pages = S.Pages(items(spark, [(f"s{i:05}", i // 3, "p") for i in order]), "last_activity", True)
    want = [f"s{i:05}" for i in sorted(range(n), key=lambda i: (-(i // 3), f"s{i:05}"))]
    for number in (1, 400, pages.pages, 10**9):
        at = min(number, pages.pages)
        got = pages.page(number).orderBy("position").collect()
        assert [r["session_id"] for r in got] == want[(at - 1) * 6 : at * 6] and got[0]["position"] == (at - 1) * 6 + 1
    plan = pages.page(400)._jdf.queryExecution().executedPlan().toString()
    read = re.search(r"PartitionFilters: \[([^\]]*)\]", plan)[1]  # the ranges that hold the page, one or two of eight
    assert len(pages.rows.before) == 8 and 1 <= len(set(re.findall(r"\b\d\b", read))) <= 2 and "part_" in read


def test_long_lists_of_models_are_looked_up(spark, monkeypatch):
    rows = spark.createDataFrame([("2024-01-01", f"p{i % 7}", f"m{i}", i) for i in range(200)], "local_day string, provider string, model_name string, id int")
    pairs = tuple((f"p{i % 7}", f"m{i}") for i in range(0, 200, 3)) + (("p0", "m1"), ("", "m5"))
    ids = lambda: sorted(r["id"] for r in D.in_scope(rows, D.Scope(models=pairs)).collect())
    looked_up = ids()
    monkeypatch.setattr(D, "MANY", 1000)
    assert looked_up == ids() == list(range(0, 200, 3))


@pytest.mark.parametrize("descending", [False, True])
def test_names_are_collated_and_digits_go_by_value(spark, descending):
    long = "9" * 25
    names = ["a2", "a10", "a010", "A10", "a" + long, "a1" + "0" * 25, "é", "e", "f", "E", "z", "Z", "x1y2", "x1y10", "x02y1", None, ""]
    rows = [(f"s{i:02}", 1, n) for i, n in enumerate(names)]
    pages = S.Pages(items(spark, rows), "project", descending, size=50)
    got = [names[int(r["session_id"][1:])] for r in pages.page().orderBy("position").collect()]
    want = ["a2", "a10", "a010", "A10", "a" + long, "a1" + "0" * 25, "e", "E", "é", "f", "x1y2", "x1y10", "x02y1", "z", "Z"]
    if descending:
        want = want[::-1]
        i = want.index("a010")
        want[i : i + 2] = want[i : i + 2][::-1]  # equal names stay in the order of their keys
    assert got == [*want, None, ""]
