from __future__ import annotations

import json

import pytest

from joinloom.catalog import load
from joinloom.engine import build_context, destroy_context, execute, prefiltered, run_suite
from joinloom.plans.plan import Plan
from joinloom.plans.sql import without_aggregates
from joinloom.queries import GUIDED, GUIDED_SQL
from joinloom.sources.memory import from_rows
from joinloom.types import DataType, EngineError


@pytest.fixture
def tables(spark, data):
    found = load(spark, data, ("region", "nation", "supplier"))
    for name, df in found.items():
        df.createOrReplaceTempView(name)
    return found


def test_context(spark):
    context = build_context(spark)
    plan = Plan()
    plan.new_scan_node(plan.new_input(from_rows(spark, [(1,)], [DataType.INT32])), [(0, DataType.INT32)])
    assert [tuple(r) for r in execute(plan, context).collect()] == [(1,)]
    assert context.tables.get("t", lambda: spark.range(3)).count() == 3
    destroy_context(context)


def test_suite(spark, tables, tmp_path):
    plans = json.dumps({"sql_directory": "sql", "names": ["q1", "q2"], "plans": [GUIDED, {"Plan": {"Node Type": "Seq Scan", "Relation Name": "region"}}]})
    texts = {"sql/q1.sql": GUIDED_SQL, "sql/q2.sql": "SELECT MIN(r.r_name) AS x FROM region r WHERE r.r_regionkey > 2"}
    context, report = build_context(spark), tmp_path / "report.txt"
    expected = lambda name, text: spark.sql(without_aggregates(text)).toDF(*[f"c{i}" for i in range(2 if name == "q1" else 1)])
    runs = run_suite(context, plans, texts.__getitem__, tables, expected=expected, report=str(report))
    assert [(r.name, r.correct) for r in runs] == [("q1", True), ("q2", True)] and float(report.read_text()) > 0
    asked = []
    for _ in range(2):
        again = run_suite(context, plans, texts.__getitem__, tables, expected=lambda n, t: asked.append(n) or expected(n, t), answers=str(tmp_path / "answers"))
        assert all(r.correct for r in again)
    assert asked == ["q1", "q2"]
    wrong = run_suite(context, plans, texts.__getitem__, tables, expected=lambda n, t: expected(n, t).limit(0), only={"q2"}, report=str(tmp_path / "none.txt"))
    assert [r.correct for r in wrong] == [False] and not (tmp_path / "none.txt").exists()
    with pytest.raises(EngineError):
        run_suite(context, plans, lambda path: "SELECT s.s_name FROM supplier s", tables)
    destroy_context(context)


def test_prefiltered(spark, tables, tmp_path):
    found = prefiltered(build_context(spark), str(tmp_path), GUIDED_SQL, tables)
    assert set(found) == {"r", "n", "s"} and [r.r_name for r in found["r"].collect()] == ["EUROPE"]
    assert found["n"].count() == 25


@pytest.mark.parametrize("order", [(0, 1), (1, 0)])
def test_prefiltered_covers_inner_equalities(spark, tmp_path, order):
    kinds = [DataType.INT32, DataType.INT32]
    from_rows(spark, [(1, 1), (1, 2), (3, 3)], kinds).toDF("id", "x").write.parquet(str(tmp_path / "t"))
    from_rows(spark, [(1, 0)], kinds).toDF("uid", "y").write.parquet(str(tmp_path / "u"))
    tables = {n: spark.read.parquet(str(tmp_path / n)) for n in "tu"}
    texts = ("SELECT t.x FROM t, u WHERE t.id = u.uid AND t.x = u.uid", "SELECT t.x FROM t, u WHERE t.id = u.uid")
    for k in order:
        found = prefiltered(build_context(spark), str(tmp_path / "cache"), texts[k], tables)
        assert found["t"].count() == (2, 3)[k]


def test_prefiltered_modes_versions_and_memory(spark, tmp_path):
    kinds = [DataType.INT32, DataType.VARCHAR]
    where = str(tmp_path / "t")
    from_rows(spark, [(1, None), (2, "a\nb"), (3, "ab")], kinds).toDF("id", "s").write.parquet(where)
    count = lambda text, **m: prefiltered(build_context(spark), str(tmp_path / "cache"), text, {"t": spark.read.parquet(where)}, **m)["t"].count()
    text = "SELECT t.id FROM t WHERE NOT (t.s LIKE 'a%b')"
    assert [count(text), count(text, null_mode="two_valued"), count(text, like_mode="regex"), count(text)] == [0, 1, 1, 0]
    from_rows(spark, [(i, "x") for i in range(5)], kinds).toDF("id", "s").write.mode("overwrite").parquet(where)
    assert count(text) == 5
    for n in (1, 2):  # rows in memory have no version: never cached
        held = {"t": from_rows(spark, [(1, "x")] * n, kinds).toDF("id", "s")}
        assert prefiltered(build_context(spark), str(tmp_path / "cache"), text, held)["t"].count() == n
