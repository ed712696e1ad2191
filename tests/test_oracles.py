"""Every catalogue query against its DuckDB form on the smallest tables."""

import datetime
import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from shutterlake.plans import catalogue

TABLES = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float | Decimal):
        return "nan" if math.isnan(v) else f"{float(v) + 0.0:.6g}"
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in TABLES.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", catalogue.ORACLES)
def test_equals_duckdb(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(TABLES))
    result = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want
