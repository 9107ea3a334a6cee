"""The benchmark-shaped workload against DuckDB; with $JOB_SQL, a folder of the benchmark's own texts, these as well."""

from __future__ import annotations

import os
import re
from pathlib import Path

import pytest

from joinloom import workload
from joinloom.catalog import imdb
from joinloom.operators.verify import same
from joinloom.plans.order import run_sql
from joinloom.plans.sql import without_aggregates
from joinloom.sources.csv import write_csv

duckdb = pytest.importorskip("duckdb")


def _compare(spark, folder, tables, texts, rows_too=False):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    some = 0
    for text in texts:
        ours = [tuple(r) for r in run_sql(text, tables, imdb()).collect()]
        theirs = re.sub(r"\bat\b", "at_", text.rstrip().rstrip(";"))  # a keyword there
        assert ours == con.execute(theirs).fetchall(), text
        some += any(x is not None for x in ours[0])
        if rows_too:
            n = con.execute(f"SELECT count(*) FROM ({without_aggregates(text).rstrip().rstrip(';')})").fetchone()[0]
            assert run_sql(text, tables, imdb(), mode="rows").count() == n
    return some


def test_shaped_queries(spark, tmp_path):
    texts = workload.shaped(12, seed=5)
    assert texts == workload.shaped(12, seed=5) and len(set(workload.shaped())) == 113
    tables = workload.fill(spark, str(tmp_path), 0.0002)
    assert len(tables) == 21 and tables["cast_info"].count() == 7248
    assert _compare(spark, tmp_path, tables, texts, rows_too=True) >= 6


def test_literals_reach_the_tables(spark, tmp_path):
    text = "SELECT MIN(t.title) AS x FROM title t, info_type it, movie_info mi WHERE t.id = mi.movie_id AND it.id = mi.info_type_id AND it.info = 'top' AND t.title LIKE '%Big%Cat%' AND (mi.note IN ('a', 'b') OR mi.note IS NULL)"
    known = workload.literals([text])
    assert known == {("info_type", "info"): ["top"], ("title", "title"): ["Big Cat"], ("movie_info", "note"): ["a", "b"]}
    tables = workload.fill(spark, str(tmp_path), 0.0002, known)
    assert tables["info_type"].where("info = 'top'").count() == 1


def test_import_of_all_tables(spark, tmp_path):
    small = workload.fill(spark, str(tmp_path / "made"), 0.00001)
    for t, df in small.items():
        write_csv(df.coalesce(1), str(tmp_path / "csv" / f"{t}.csv"))
    loaded = workload.import_tables(spark, str(tmp_path / "csv"), str(tmp_path / "loaded"))
    assert set(loaded) == set(imdb().tables) and all(same(small[t], loaded[t]) for t in ("title", "cast_info", "kind_type"))


@pytest.mark.skipif("JOB_SQL" not in os.environ, reason="needs a folder of query texts")
def test_benchmark_texts(spark, tmp_path):
    texts = [p.read_text() for p in sorted(Path(os.environ["JOB_SQL"]).glob("[0-9]*.sql"))]
    tables = workload.fill(spark, str(tmp_path), 0.0005, workload.literals(texts))
    assert _compare(spark, tmp_path, tables, texts) > 0
