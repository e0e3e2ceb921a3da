"""Every registered key against its DuckDB oracle on the smallest test tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry
from cadenza.plans.catalog import oracle_sql, queries
from tools.compare import TABLES, compare

SF = os.environ.get("CADENZA_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_key_has_an_oracle():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("key", sorted(oracle_sql()))
def test_key_matches_oracle(spark, con, key):
    r = compare(spark, SF, key, queries()[key], oracle_sql()[key], con)
    assert r["cols_match"] and r["match"], r


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() >= 0 and df.columns == ["Month", "Month_Num", "Total", "Individual", "Group", "Ensemble"]
