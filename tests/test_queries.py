"""Every query of the library against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tidemark import queries as own

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SAMPLED = {"reservoir", "split_random"}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(SF + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", list(own.QUERIES))
def test_query(spark, sql, name):
    out = own.QUERIES[name](spark, SF)
    got = [tuple(r) for r in out.collect()]
    if name not in own.ORACLE_SQL:
        assert got
        return
    expected = sql.execute(own.ORACLE_SQL[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(out.columns)
    assert table(out.columns, got) == table(columns, expected.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["series_id", "g", "value"]
    assert set(own.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
