"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from rulespan.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(tuple("null" if v is None else f"{round(v, 6) + 0.0:.4f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLE_SQL:
        assert got.count() > 0
        return
    columns = sorted(got.columns)
    want = db.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert plain(got.select(columns).collect()) == plain(db.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall())
