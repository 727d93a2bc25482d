"""Every registered query against its DuckDB oracle on the smallest tables."""

import os
import re
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import TABLES, rows_key  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["cust_key", "customer_name", "acct_bal", "mkt_segment"]


def test_every_query_has_an_oracle_or_is_sampling():
    # the training-data queries (op1_ ... op13_, pipeline) have their own tests
    own = {q for q in entry.queries() if not re.match(r"op\d+_|pipeline$", q)}
    missing = own - set(entry.oracle_sql())
    assert missing == set()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = df.columns
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(ocols)
    idx = [ocols.index(c) for c in cols]
    orows = [tuple(r[i] for i in idx) for r in cur.fetchall()]
    assert len(srows) == len(orows)
    assert rows_key(srows) == rows_key(orows)
