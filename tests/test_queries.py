"""Every registered query against its SQL answer on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from faultline.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES, catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def cell(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else "~" if v is None else str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([cell(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        assert got[1]
        return
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert got == table(names, cur.fetchall())


def test_every_answer_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
