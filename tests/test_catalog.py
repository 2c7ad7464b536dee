"""Every query against its SQL in DuckDB, on small tables of the same shape as the driver's."""

import os
from pathlib import Path

import duckdb
import pytest

from tidemark.plans.catalog import QUERIES, SQL

DATA = os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for p in Path(DATA).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def normal(rows):
    return sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    got = frame.collect()
    assert name in SQL
    result = duck.sql(SQL[name])
    assert sorted(frame.columns) == sorted(result.columns)
    order = [result.columns.index(c) for c in frame.columns]
    assert normal(got) == normal([tuple(r[i] for i in order) for r in result.fetchall()])
