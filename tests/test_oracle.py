"""Every query that SQL can express gives the rows of its SQL."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from kelpline import queries as core

NAMES = sorted(core.oracle_sql())


def test_every_sql_has_a_query():
    assert set(NAMES) <= set(core.queries())


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        return round(x, 6) + 0.0 if isinstance(x, float) and not math.isnan(x) else str(x)

    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_and_sql_agree(spark, data, db, name):
    df = core.queries()[name](spark, data)
    rel = db.sql(core.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = bag(df.columns, df.collect()), bag(rel.columns, rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(NAMES)))
def test_query_without_sql_runs(spark, data, name):
    df = core.queries()[name](spark, data)
    assert df.count() >= 1
