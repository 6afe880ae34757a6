"""Every registered query against its SQL text on DuckDB (sf0.001 tables):
same column names, same row count, same values (doubles to 6 decimals)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools"))

import __spark_entry__ as E  # noqa: E402
import oracle_check  # noqa: E402

from calibrix.plans import catalog  # noqa: E402

SF = os.environ.get("CALIBRIX_ORACLE_SF", "/root/testdata/sf0.001")
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    if not os.path.exists(f"{SF}/lineitem.parquet"):
        pytest.skip("test tables not present")
    oracle_check.SF = SF
    return oracle_check.duck_connect(SF)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    assert oracle_check.check(spark, duck, name, E.queries()[name], SQL[name], verbose=True)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "Measured_TC_Conc" in df.columns
