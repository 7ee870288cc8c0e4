"""Every registered event query against its SQL."""

from pathlib import Path

import duckdb
import pytest

from pulseweave import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cur = duck.execute(queries.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple(str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r)
    expected = sorted(key(r) for r in cur.fetchall())
    found = sorted(key([r[c] for c in names]) for r in df.collect())
    assert found == expected
    assert found
