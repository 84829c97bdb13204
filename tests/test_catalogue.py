"""Every catalogue query with SQL against DuckDB on the small tables."""

import os

import duckdb
import pytest

from millrace.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    ours = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)
    found = con.execute(ORACLE_SQL[name])
    order = [[c[0] for c in found.description].index(n) for n in names]
    assert ours == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
