"""Every registered core query against its SQL in DuckDB."""

from __future__ import annotations

from collections import Counter

import pytest

from joinloom import queries as core

duckdb = pytest.importorskip("duckdb")
NAMES = sorted(core.queries())


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for t in (*core.TABLES,):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_agrees(spark, data, oracle, name):
    df = core.queries()[name](spark, data)
    columns = sorted(df.columns)
    result = oracle.execute(core.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = Counter(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == theirs


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
