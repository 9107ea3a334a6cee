from __future__ import annotations

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from joinloom.catalog import from_ddl, imdb
from joinloom.functions.predicates import Compare
from joinloom.operators.verify import difference, printed, same
from joinloom.sources.cache import TableCache, answer, cached, save_answer
from joinloom.sources.csv import import_csv, read_csv
from joinloom.sources.memory import from_duckdb, from_rows
from joinloom.streaming import scan_stream
from joinloom.types import Attribute, CsvError, DataType

AS = [Attribute("a", DataType.INT32), Attribute("s", DataType.VARCHAR), Attribute("d", DataType.FP64)]


def rows(spark, tmp_path, text, **options):
    (tmp_path / "t.csv").write_bytes(text.encode())
    return [tuple(r) for r in read_csv(spark, str(tmp_path / "t.csv"), AS, **options).collect()]


def test_dialect(spark, tmp_path):
    assert rows(spark, tmp_path, '1,"a,b",0.5\n2,"x\ny",1\n3,"q\\"q\\\\",2\n4,c\\d,3\n') == [(1, "a,b", 0.5), (2, "x\ny", 1.0), (3, 'q"q\\', 2.0), (4, "c\\d", 3.0)]
    assert rows(spark, tmp_path, "1,,\n,x,\n5,\"\",1") == [(1, None, None), (None, "x", None), (5, None, 1.0)]
    assert rows(spark, tmp_path, "1,a,1\r\n2,b,2\r\n") == rows(spark, tmp_path, "1,a,1\n2,b,2\n") == rows(spark, tmp_path, "1,a,1\r2,b,2\r")
    assert rows(spark, tmp_path, 'a,s,d\n1,"say ""x""",1\n', header=True, escape='"') == [(1, 'say "x"', 1.0)]
    assert rows(spark, tmp_path, "1,a,1,\n", trailing_comma=True) == [(1, "a", 1.0)]
    assert rows(spark, tmp_path, "1,a,1\n2,b,2\n", predicate=Compare(1, "=", "b")) == [(2, "b", 2.0)]


@pytest.mark.parametrize("text", ["1,a,1,9\n", "1,a\n", "x,a,1\n", "99999999999,a,1\n", "12abc,a,1\n"])
def test_strict(spark, tmp_path, text):
    with pytest.raises((PySparkException, Py4JJavaError)):
        rows(spark, tmp_path, text)


def test_open_quote(spark, tmp_path):
    with pytest.raises(CsvError):
        rows(spark, tmp_path, '1,"a,1\n')
    with pytest.raises(CsvError):
        rows(spark, tmp_path, '1,"a,1\n2,"b,1\n', multi_line=False)
    assert rows(spark, tmp_path, '1,"a\\"b",1\n') == rows(spark, tmp_path, '1,"a\\"b",1\n', multi_line=False) == [(1, 'a"b', 1.0)]


def test_import_and_cache(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,a,1\n2,b,2\n")
    assert import_csv(spark, str(tmp_path / "t.csv"), str(tmp_path / "p"), AS).count() == 2
    keep, calls = Compare(0, ">", 1), []

    def make():
        calls.append(1)
        return read_csv(spark, str(tmp_path / "t.csv"), AS, keep)

    for _ in range(2):
        assert [tuple(r) for r in cached(spark, str(tmp_path), "t", keep, make).collect()] == [(2, "b", 2.0)]
    assert len(calls) == 1 and cached(spark, str(tmp_path), "t", None, lambda: read_csv(spark, str(tmp_path / "t.csv"), AS)).count() == 2
    held = TableCache()
    assert held.get("t", make) is held.get("t", make)
    held.release()


def test_verify_and_print(spark, tmp_path):
    kinds = [DataType.INT32, DataType.VARCHAR]
    a = from_rows(spark, [(1, "x"), (1, "x"), (None, None)], kinds)
    save_answer(a, str(tmp_path), "q")
    assert same(a, answer(spark, str(tmp_path), "q"))
    b = from_rows(spark, [(1, "x"), (None, None)], kinds)
    assert not same(a, b) and [tuple(r) for r in difference(a, b).collect()] == [(1, "x", 2, 1)]
    with pytest.raises(ValueError):
        same(a, a.select("c0"))
    with pytest.raises(ValueError):
        same(a, a.select("c1", "c0"))
    assert [r[0] for r in printed(from_rows(spark, [(1, 'a"\\\n\r\t')], kinds)).collect()] == ['1|"a\\"\\\\\\n\\r\\t"']
    assert [r[0] for r in printed(from_rows(spark, [(None, None)], kinds)).collect()] == ["NULL|NULL"]


def test_duckdb_rows(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    df = from_rows(spark, [(1, "a")], [DataType.INT32, DataType.VARCHAR])
    assert same(df, from_duckdb(spark, con, "SELECT 1::INTEGER AS c0, 'a' AS c1", df.schema))


def test_catalogs():
    tables = imdb().tables
    assert len(tables) == 21 and len(tables["title"]) == 12 and not tables["title"][0].nullable and tables["cast_info"][3].nullable
    got = from_ddl("CREATE TABLE t (id integer NOT NULL PRIMARY KEY, name character varying(10), x bigint, y double precision, PRIMARY KEY (id));").tables["t"]
    assert [(a.type, a.nullable) for a in got] == [(DataType.INT32, False), (DataType.VARCHAR, True), (DataType.INT64, True), (DataType.FP64, True)]


def test_stream(spark, tmp_path):
    kinds = [Attribute("c0", DataType.INT32), Attribute("c1", DataType.VARCHAR)]
    from_rows(spark, [(1, "a"), (2, "b")], [a.type for a in kinds]).write.parquet(str(tmp_path / "in"))
    out = scan_stream(spark, str(tmp_path / "in"), kinds, [1], Compare(0, "=", 2)).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    out.awaitTermination(60)
    assert [r[0] for r in spark.table("seen").collect()] == ["b"]
