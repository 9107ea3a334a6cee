from __future__ import annotations

import pytest

from joinloom.catalog import Catalog, imdb
from joinloom.plans.explain import load, tree_of
from joinloom.plans.graph import classes, conditions, connected
from joinloom.plans.order import build, entities_of, greedy, run_sql
from joinloom.plans.sql import Entity, bind, parse, without_aggregates
from joinloom.sources.memory import from_rows
from joinloom.types import Attribute, DataType, EngineError, TypeMismatch, UnsupportedSql, schema_of

I, S = DataType.INT32, DataType.VARCHAR
CATALOG = Catalog({"t": [Attribute("id", I), Attribute("x", I), Attribute("s", S)], "u": [Attribute("id", I), Attribute("y", S)]})


@pytest.fixture(scope="module")
def tables(spark):
    t = from_rows(spark, [(1, 1, "a"), (2, 1, "b"), (3, None, None), (4, 2, "it's")], [I, I, S]).toDF("id", "x", "s")
    u = from_rows(spark, [(1, "p"), (2, "q"), (2, "r"), (None, "n")], [I, S]).toDF("id", "y")
    return {"t": t, "u": u}


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM t", "SELECT 1 FROM t", "SELECT t.x + 1 FROM t", "SELECT max(t.x) FROM t", "SELECT DISTINCT x FROM t", "SELECT x FROM t GROUP BY x", "SELECT x FROM t ORDER BY x",
        "SELECT x FROM t LIMIT 1", "SELECT x FROM t JOIN u ON t.id = u.id", "SELECT x FROM (SELECT x FROM t) q", "SELECT x FROM t WHERE x IN (SELECT id FROM u)", "SELECT x FROM t WHERE 1 = x",
        "SELECT x FROM t WHERE x + 1 = 2", "SELECT t.x FROM t, u WHERE t.id < u.id", "SELECT t.x FROM t, u WHERE t.id = u.id OR t.x = 1", "SELECT t.x FROM t, u WHERE t.x = 1 OR u.y = 'a'",
        "SELECT t.x FROM t, u WHERE NOT (t.id = u.id)", "SELECT x FROM t WHERE s ILIKE 'a'", "SELECT x FROM t WHERE x = NULL", "SELECT x FROM t WHERE x IS 1", "SELECT x FROM t; SELECT x FROM t",
        "SELECT x FROM t WHERE id = x", "SELECT x, min(id) FROM t", "SELECT x FROM t UNION SELECT x FROM t", "INSERT INTO t VALUES (1)", "SELECT x FROM t WHERE s LIKE 5", "SELECT x FROM t WHERE x ? 1",
    ],
)
def test_rejected(text):
    with pytest.raises(UnsupportedSql):
        bind(text, CATALOG)


@pytest.mark.parametrize(
    "text, error",
    [
        ("SELECT x FROM nowhere", EngineError), ("SELECT nothing FROM t", EngineError), ("SELECT q.x FROM t", EngineError), ("SELECT id FROM t, u WHERE t.id = u.id", EngineError), ("SELECT t.x FROM t, u AS t", EngineError),
        ("SELECT x FROM t WHERE x = 'a'", TypeMismatch), ("SELECT x FROM t WHERE s = 1", TypeMismatch), ("SELECT x FROM t WHERE x LIKE 'a'", TypeMismatch), ("SELECT x FROM t, u WHERE t.x = u.y", EngineError),
        ("SELECT x FROM t WHERE x BETWEEN 'a' AND 'b'", TypeMismatch),
    ],
)
def test_binding_errors(text, error):
    with pytest.raises(error):
        bind(text, CATALOG)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("select T.x from t as T where s = 'it''s'", [(2,)]),
        ("SELECT x FROM t WHERE x IS NULL -- nothing known", [(None,)]),
        ("SELECT id FROM t WHERE NOT s IS NOT NULL", [(3,)]),
        ("SELECT id FROM t WHERE id > -5 AND id NOT BETWEEN 2 AND 3;", [(1,), (4,)]),
        ("SELECT t.s, u.y FROM t, u WHERE t.id = u.id", [("a", "p"), ("b", "q"), ("b", "r")]),
        ("SELECT min(t.s) AS low, min(u.id) FROM t, u WHERE t.id = u.id AND u.y = 'none'", [(None, None)]),
        ("SELECT a.id, b.id AS other, a.id AS again FROM t a, t b WHERE a.x = b.id AND b.s IN ('a', 'b')", [(1, 1, 1), (2, 1, 2), (4, 2, 4)]),
    ],
)
def test_results(spark, tables, text, expected):
    assert sorted(map(tuple, run_sql(text, tables).collect()), key=str) == sorted(expected, key=str)


def test_unconnected_tables(spark, tables):
    with pytest.raises(UnsupportedSql):
        run_sql("SELECT t.x FROM t, u", tables)
    assert not connected(bind("SELECT t.x FROM t, u", CATALOG))


def test_rows_mode_and_rewrite(spark, tables):
    text = "SELECT MIN(t.s) AS low FROM t, u WHERE t.id = u.id"
    assert without_aggregates(text) == "SELECT t.s AS low FROM t, u WHERE t.id = u.id"
    assert sorted(r.low for r in run_sql(text, tables, mode="rows").collect()) == ["a", "b", "b"]
    assert parse(text).items[0].function == "min"


def test_classes_drop_redundant_conditions():
    q = bind("SELECT a.id FROM t a, t b, t c WHERE a.id = b.id AND b.id = c.id AND a.id = c.id AND a.x = c.x", CATALOG)
    a, b, c = (Entity("t", i) for i in range(3))
    found = classes(q)
    assert sorted(map(len, found)) == [2, 3] and connected(q)
    assert len(conditions(found, {a}, {b})) == 1 and len(conditions(found, {a, b}, {c})) == 2


def test_implied_equality_inside_one_table(spark):
    t = from_rows(spark, [(1, 1, "a"), (2, 1, "b")], [I, I, S]).toDF("id", "x", "s")
    u = from_rows(spark, [(1, "p"), (2, "q")], [I, S]).toDF("id", "y")
    assert [tuple(r) for r in run_sql("SELECT t.s FROM t, u WHERE t.id = u.id AND t.x = u.id", {"t": t, "u": u}).collect()] == [("a",)]


def test_explain_trees(spark, tables):
    q = bind("SELECT a.s, u.y FROM t a, u WHERE a.id = u.id", Catalog.of_frames(tables))
    scan = lambda **k: {"Node Type": "Seq Scan", **k}
    node = {"Node Type": "Gather", "Plans": [{"Node Type": "Hash Join", "Plans": [{"Node Type": "Hash", "Plans": [scan(Alias="a")]}, {"Node Type": "Index Only Scan", "Relation Name": "u"}]}]}
    tree = tree_of({"Plan": node}, q)
    assert tree == (True, Entity("t", 0), Entity("u", 0))
    assert sorted(map(tuple, build(q, tables, tree).to_dataframe(guided=True).collect())) == [("a", "p"), ("b", "q"), ("b", "r")]
    join = lambda *plans: {"Node Type": "Hash Join", "Plans": list(plans)}
    hashed = lambda x: {"Node Type": "Hash", "Plans": [x]}
    for bad in (
        {"Node Type": "Nested Loop"}, {"Node Type": "Merge Join"}, {"Node Type": "Sort"}, join(scan(Alias="a"), scan(Alias="u")), join(hashed(scan(Alias="a")), hashed(scan(Alias="u"))),
        scan(Alias="z"), scan(), scan(**{"Relation Name": "z"}),
    ):
        with pytest.raises(EngineError):
            tree_of(bad, q)
    with pytest.raises(EngineError):
        build(q, tables, Entity("t", 0))
    assert load('{"sql_directory": "d", "names": ["q"], "plans": [{"Plan": {}}]}') == ("d", {"q": {"Plan": {}}})


JOB_SHAPED = [
    "SELECT MIN(mc.note) AS note, MIN(t.title) AS title, MIN(t.production_year) AS year FROM company_type AS ct, info_type AS it, movie_companies AS mc, movie_info_idx AS mi, title AS t WHERE ct.kind = 'k0' AND it.info = 'i1' AND mc.note NOT LIKE '%(x)%' AND (mc.note LIKE '%a%' OR mc.note LIKE '%b%') AND ct.id = mc.company_type_id AND t.id = mc.movie_id AND t.id = mi.movie_id AND mc.movie_id = mi.movie_id AND it.id = mi.info_type_id",
    "SELECT MIN(n.name) AS person, MIN(t.title) AS title FROM aka_name AS an, cast_info AS ci, name AS n, title AS t, role_type AS rt WHERE (n.gender = 'f' OR n.name LIKE 'a%' OR (n.name_pcode_cf BETWEEN 'a' AND 'c' AND n.imdb_index IS NOT NULL)) AND t.production_year >= 0 AND rt.role IN ('r0', 'r1', 'r2') AND n.id = an.person_id AND n.id = ci.person_id AND an.person_id = ci.person_id AND t.id = ci.movie_id AND ci.role_id = rt.id",
    "SELECT MIN(t1.title) AS first, MIN(t2.title) AS second FROM link_type AS lt, movie_link AS ml, title AS t1, title AS t2, kind_type AS k1, kind_type AS k2 WHERE lt.link IN ('l0', 'l1', 'l2') AND t2.production_year BETWEEN 0 AND 3 AND lt.id = ml.link_type_id AND t1.id = ml.movie_id AND t2.id = ml.linked_movie_id AND k1.id = t1.kind_id AND k2.id = t2.kind_id",
]


@pytest.fixture(scope="module")
def movies(spark):
    """Small tables of the schema: ids 0..n, foreign keys and strings by arithmetic, some nulls."""
    out = {}
    for table, attributes in imdb().tables.items():
        rows = []
        for i in range(12):
            row = []
            for k, a in enumerate(attributes):
                if a.name == "id":
                    row.append(i)
                elif a.nullable and (i + k) % 7 == 0:
                    row.append(None)
                elif a.type is I:
                    row.append((i * (k + 1)) % 5)
                else:
                    row.append({"gender": "mf"[i % 2]}.get(a.name, "abc"[(i + k) % 3] + a.name[0] if a.name not in ("kind", "info", "role", "link") else f"{a.name[0]}{i % 3}"))
            rows.append(tuple(row))
        out[table] = spark.createDataFrame(rows, schema_of(attributes))
    return out


@pytest.mark.parametrize("text", JOB_SHAPED)
def test_job_shaped_queries_agree_with_spark_sql(spark, movies, text):
    for name, df in movies.items():
        df.createOrReplaceTempView(name)
    ours = run_sql(text, movies, imdb())
    assert [tuple(r) for r in ours.collect()] == [tuple(r) for r in spark.sql(text).collect()]
    rows = run_sql(text, movies, imdb(), mode="rows")
    assert sorted(map(str, rows.collect())) == sorted(map(str, spark.sql(without_aggregates(text)).collect())) and rows.count() > 0
    query = bind(text, imdb())
    tree = greedy(query, {e: float(i) for i, e in enumerate(query.entities.values())})
    assert entities_of(tree) == set(query.entities.values()) and connected(query)
