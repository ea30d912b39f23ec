"""Every query against its SQL, on the smallest test tables (skipped where they are absent)."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path("/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def normal(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return tuple(map(normal, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in ROOT.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.skipif(not ROOT.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, str(ROOT))
    columns = sorted(df.columns)
    ours = Counter(tuple(normal(r[c]) for c in columns) for r in df.collect())
    found = db.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = Counter(tuple(normal(row[names.index(c)]) for c in columns) for row in found.fetchall())
    assert ours == theirs


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
