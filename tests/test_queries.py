"""Every query with SQL against DuckDB on the smallest tables, when they are present."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as driver  # noqa: E402

FOLDER = Path("/root/testdata/sf0.001")
SQL = driver.oracle_sql()
QUERIES = driver.queries()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def test_registry():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 150


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, tables, name):
    made = QUERIES[name](spark, str(FOLDER))
    found = tables.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(made.columns) == sorted(columns)
    expected = sorted(repr(tuple(plain(v) for v in row)) for row in found.fetchall())
    got = sorted(repr(tuple(plain(row[c]) for c in columns)) for row in made.collect())
    assert got == expected
