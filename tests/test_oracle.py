"""Every registered query against its DuckDB oracle on the smallest data."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "scripts"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import digest  # noqa: E402
from reelhouse.plans.oracle import SQL  # noqa: E402
from reelhouse.plans.registry import QUERIES as OWN  # noqa: E402
from reelhouse.sources.tables import TABLES, table_path  # noqa: E402
from tests.conftest import SF_SMALL  # noqa: E402

QUERIES = E.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    return con


def test_every_query_has_an_oracle():
    assert set(OWN) == set(SQL)
    assert set(SQL) <= set(E.oracle_sql()) and set(OWN) <= set(QUERIES)


def test_entry(spark):
    assert E.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(SQL[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)
