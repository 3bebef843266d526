"""Every registered query against its SQL, at the small scale."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for p in Path(tables).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 6)
        return x

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", [n for n in SQL if not n.startswith(("op", "pipeline"))])
def test_query_equals_sql(spark, duck, tables, name):
    got = entry.queries()[name](spark, tables)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = norm(map(tuple, got.collect()), got.columns), norm(want.fetchall(), names)
    assert len(a) == len(b)
    assert a == b
