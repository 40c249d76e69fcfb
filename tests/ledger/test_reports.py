"""Every report against its SQL in DuckDB on the smallest tables, and the invariant of the roll-ups."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from ledgerloom.operators import dataset as D
from ledgerloom.plans import loading, oracle, quotas, reports

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
QUERIES = reports.QUERIES | quotas.QUERIES | loading.QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    return con


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "is_integer") or type(x).__name__ == "Decimal":
        return round(float(x), 6)
    return x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    found = duck.execute(oracle.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    want = sorted(([value(r[names.index(c)]) for c in order] for r in found.fetchall()), key=repr)
    have = sorted(([value(r[c]) for c in order] for r in got.collect()), key=repr)
    assert have == want


def test_all_queries_have_a_name_in_the_entry():
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_totals_agree_between_list_and_distributions(spark):
    items = reports.session_list(spark, SF).groupBy().sum("calls", "total").first()
    models = reports.model_distribution(spark, SF).groupBy().sum("calls", "total").first()
    projects = reports.project_distribution(spark, SF).groupBy().sum("calls", "total").first()
    assert tuple(items) == tuple(models) == tuple(projects)


def test_scope_is_normalised():
    scope = D.Scope(agents=("claude-desktop", " ", "claude"), models=(("p", "m"), ("p", "m")))
    assert scope.agents == ("claude",) and scope.models == (("p", "m"),)
    with pytest.raises(ValueError):
        D.Scope("2024-02-01", "2024-01-01")
    with pytest.raises(ValueError):
        D.Scope(projects=(("project", ""),))
