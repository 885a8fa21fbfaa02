"""Driver contract: entry smoke, key coverage, Spark vs DuckDB on sf0.001."""
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import duck, rows_key  # noqa: E402

SF = "/root/testdata/sf0.001"
ORACLE = E.oracle_sql()


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["department", "headcount", "mean_risk_12m_pct", "high_risk_count", "is_total"]
    total = [r for r in rows if r.is_total == 1]
    assert len(total) == 1 and total[0].headcount == sum(r.headcount for r in rows if r.is_total == 0)


def test_every_oracle_key_is_a_query():
    assert set(ORACLE) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle_sf0001(spark, con, name):
    df = E.queries()[name](spark, SF)
    srows, scols = df.collect(), df.columns
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(c.lower() for c in scols) == sorted(c.lower() for c in dcols)
    assert rows_key(scols, srows) == rows_key(dcols, res.fetchall())
