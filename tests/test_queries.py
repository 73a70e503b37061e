"""Every registered core query on the smallest tables, against its SQL where there is one."""

import glob
import os

import pytest

from marlstone.plans import registry

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def other(data):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fixed = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted(names), sorted((tuple(fixed(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, other, name):
    df = registry.queries()[name](spark, data)
    names, rows = rows_of(df.columns, df.collect())
    assert len(set(names)) == len(names)
    if name in registry.oracle_sql():
        cur = other.execute(registry.oracle_sql()[name])
        assert (names, rows) == rows_of([d[0] for d in cur.description], cur.fetchall())
    else:
        assert rows
