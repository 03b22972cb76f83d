import os

import duckdb
import pytest

from phasewright.plans import file_queries, map_queries, more_queries, queries  # noqa: F401

DATA = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(rows, columns, order):
    at = [columns.index(c) for c in order]
    fix = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return sorted(str([fix(r[i]) for i in at]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(spark, tables, name):
    got = queries.queries()[name](spark, DATA)
    want = tables.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain([tuple(r) for r in got.collect()], got.columns, sorted(names)) == plain(want.fetchall(), names, sorted(names))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_runs(spark, tables, name):
    assert queries.queries()[name](spark, DATA).count() >= 0
