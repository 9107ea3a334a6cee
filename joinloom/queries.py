"""Driver queries over the test tables: each is one operator or a small combination, with the SQL an oracle can run."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, load
from .engine import Context, destroy_context, prefiltered, run_suite
from .functions.predicates import Compare, fnv1a
from .operators.verify import difference, in_order, printed, same
from .plans.explain import tree_of
from .plans.order import build, run_sql
from .plans.plan import Plan
from .plans.sql import bind, parse
from .sources.cache import answer, cached, save_answer
from .sources.csv import read_csv, write_csv
from .sources.memory import from_duckdb, from_rows
from .sources.shared import fresh_path
from .types import Attribute, CsvError, DataType, EngineError
from .workload import import_tables

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")
I32, I64, F64, STR = DataType.INT32, DataType.INT64, DataType.FP64, DataType.VARCHAR

# Queries in the front end's own SQL; the oracle runs the same text.
SQL = {
    "scan_project": "SELECT o_orderstatus, o_orderkey FROM orders",
    "filter_eq": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
    "filter_neq": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'",
    "filter_lt": "SELECT o_orderkey FROM orders WHERE o_totalprice < 50000",
    "filter_gt": "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000.5",
    "filter_leq": "SELECT p_partkey FROM part WHERE p_size <= 10",
    "filter_geq": "SELECT p_partkey FROM part WHERE p_size >= 40",
    "filter_str_range": "SELECT p_partkey, p_brand FROM part WHERE p_brand >= 'Brand#10' AND p_brand < 'Brand#20'",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%'",
    "filter_not_like": "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%ring%'",
    "filter_like_underscore": "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1_'",
    "filter_like_newline": "SELECT doc_id FROM documents WHERE text LIKE 'T%.\n%'",
    "filter_like_backslash": r"SELECT p_partkey FROM part WHERE p_name NOT LIKE '%\%'",
    "filter_between_int": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20",
    "filter_between_str": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment BETWEEN 'B' AND 'G'",
    "filter_in_int": "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 7, 49)",
    "filter_in_str": "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "filter_not_in": "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')",
    "filter_negative": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -500",
    "filter_and_or_nested": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR (c_mktsegment = 'FURNITURE' AND c_name LIKE '%7%')",
    "filter_not_parenthesised": "SELECT c_custkey FROM customer WHERE NOT (c_mktsegment = 'BUILDING' OR c_acctbal < 0)",
    "join_comma_sql": "SELECT s.s_name, n.n_name FROM supplier AS s, nation AS n, region AS r WHERE s.s_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey AND r.r_name = 'ASIA'",
    "join_duplicate_keys": "SELECT c.c_custkey, s.s_suppkey FROM customer c, supplier s WHERE c.c_nationkey = s.s_nationkey",
    "join_self_alias": "SELECT n1.n_name AS customer_nation, n2.n_name AS supplier_nation, l.l_orderkey FROM nation n1, nation n2, customer c, supplier s, orders o, lineitem l WHERE n1.n_nationkey = c.c_nationkey AND n2.n_nationkey = s.s_nationkey AND s.s_suppkey = l.l_suppkey AND c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND n1.n_name = 'NATION_1' AND n2.n_name IN ('NATION_2', 'NATION_3')",
    "join_transitive_closure": "SELECT n.n_name, s.s_suppkey, c.c_custkey FROM nation n, supplier s, customer c WHERE n.n_nationkey = s.s_nationkey AND s.s_nationkey = c.c_nationkey AND n.n_nationkey = c.c_nationkey AND c.c_acctbal > 9000",
    "join_multi_class": "SELECT a.l_orderkey AS left_order, b.l_orderkey AS right_order FROM lineitem a, lineitem b WHERE a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey",
    "join_chain_5": "SELECT r.r_name, n.n_name, c.c_name, o.o_orderkey, l.l_linenumber FROM region r, nation n, customer c, orders o, lineitem l WHERE r.r_regionkey = n.n_regionkey AND n.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND r.r_name = 'ASIA' AND o.o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "join_on_bigint": "SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus FROM lineitem l, orders o WHERE l.l_orderkey = o.o_orderkey AND o.o_orderstatus = 'P'",
    "join_on_double": "SELECT a.p_partkey AS a_key, b.p_partkey AS b_key FROM part a, part b WHERE a.p_retailprice = b.p_retailprice",
    "agg_min_global": "SELECT MIN(c.c_name) AS customer, MIN(o.o_orderpriority) AS priority, MIN(l.l_quantity) AS quantity FROM customer c, orders o, lineitem l WHERE c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND c.c_mktsegment = 'BUILDING'",
    "agg_min_empty": "SELECT MIN(o_orderkey) AS low_key, MIN(o_orderstatus) AS low_status FROM orders WHERE o_orderstatus = 'nothing'",
}


def _sql(text: str) -> Query:
    listed = tuple(dict.fromkeys(t for t, _ in parse(text).tables))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(text, load(spark, sf_dir, listed))

    return run


def _orders_with_nulls(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"))
    return {"orders": orders}


def _nulls(text: str, **modes) -> Query:
    return lambda spark, sf_dir: run_sql(text, _orders_with_nulls(spark, sf_dir), **modes)


_NULLED = "(SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders)"


def _two(spark: SparkSession, sf_dir: str, left: str, right: str) -> tuple[Plan, int, int]:
    plan = Plan()
    return plan, plan.new_input(spark.read.parquet(f"{sf_dir}/{left}.parquet")), plan.new_input(spark.read.parquet(f"{sf_dir}/{right}.parquet"))


def _nation_supplier(build_left: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        plan, nation, supplier = _two(spark, sf_dir, "nation", "supplier")
        a = plan.new_scan_node(nation, [(0, I32), (1, STR)])
        b = plan.new_scan_node(supplier, [(2, I32), (1, STR)])
        plan.new_join_node(build_left, a, b, 0, 0, [(0, I32), (1, STR), (3, STR)])
        return plan.to_dataframe(guided=True, names=["n_nationkey", "n_name", "s_name"])

    return run


def join_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    nulled = lambda t, k: spark.read.parquet(f"{sf_dir}/{t}.parquet").withColumn(k, F.nullif(F.col(k), F.lit(0)))
    plan = Plan()
    a = plan.new_scan_node(plan.new_input(nulled("customer", "c_nationkey")), [(0, I64), (2, I32)])
    b = plan.new_scan_node(plan.new_input(nulled("supplier", "s_nationkey")), [(2, I32), (0, I64)])
    plan.new_join_node(True, a, b, 1, 0, [(0, I64), (3, I64)])
    return plan.to_dataframe(names=["c_custkey", "s_suppkey"])


def join_empty_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan()
    a = plan.new_scan_node(plan.new_input(spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey < 0")), [(0, I32), (1, STR)])
    b = plan.new_scan_node(plan.new_input(spark.read.parquet(f"{sf_dir}/supplier.parquet")), [(2, I32)])
    plan.new_join_node(True, a, b, 0, 0, [(1, STR), (2, I32)])
    return plan.to_dataframe(names=["n_name", "s_nationkey"])


def join_on_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = Plan()
    a = plan.new_scan_node(plan.new_input(docs), [(0, I64), (2, STR)])
    b = plan.new_scan_node(plan.new_input(docs.select("lang").distinct()), [(0, STR)])
    plan.new_join_node(False, a, b, 1, 0, [(0, I64), (2, STR)])
    return plan.to_dataframe(names=["doc_id", "lang"])


def join_output_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, nation, region = _two(spark, sf_dir, "nation", "region")
    a, b = plan.new_scan_node(nation, [(0, I32), (1, STR), (2, I32)]), plan.new_scan_node(region, [(1, STR), (0, I32)])
    plan.new_join_node(True, a, b, 2, 1, [(3, STR), (1, STR), (3, STR), (0, I32)])
    return plan.to_dataframe(names=["r_name", "n_name", "r_name_again", "n_nationkey"])


def join_leftdeep_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, ("region", "nation", "supplier"))
    plan = Plan()
    r, n, s = (plan.new_input(t[x]) for x in ("region", "nation", "supplier"))
    a, b, c = plan.new_scan_node(r, [(0, I32), (1, STR)]), plan.new_scan_node(n, [(0, I32), (2, I32)]), plan.new_scan_node(s, [(0, I64), (2, I32)])
    ab = plan.new_join_node(True, a, b, 0, 1, [(1, STR), (2, I32)])
    plan.new_join_node(True, ab, c, 1, 1, [(0, STR), (2, I64)])
    return plan.to_dataframe(names=["r_name", "s_suppkey"])


def join_bushy_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation with customer) with (orders with lineitem)."""
    t = load(spark, sf_dir, ("nation", "customer", "orders", "lineitem"))
    plan = Plan()
    n, c, o, li = (plan.new_input(t[x]) for x in ("nation", "customer", "orders", "lineitem"))
    nc = plan.new_join_node(True, plan.new_scan_node(n, [(0, I32), (1, STR)]), plan.new_scan_node(c, [(0, I64), (2, I32)]), 0, 1, [(1, STR), (2, I64)])
    ol = plan.new_join_node(True, plan.new_scan_node(o, [(0, I64), (1, I64)]), plan.new_scan_node(li, [(0, I64), (3, I32)]), 0, 0, [(1, I64), (0, I64), (3, I32)])
    plan.new_join_node(True, nc, ol, 1, 0, [(0, STR), (3, I64), (4, I32)])
    return plan.to_dataframe(names=["n_name", "o_orderkey", "l_linenumber"])


GUIDED_SQL = "SELECT MIN(n.n_name) AS nation, MIN(s.s_name) AS supplier FROM region AS r, nation AS n, supplier AS s WHERE r.r_regionkey = n.n_regionkey AND n.n_nationkey = s.s_nationkey AND r.r_name = 'EUROPE'"
GUIDED = {"Plan": {"Node Type": "Aggregate", "Plans": [{"Node Type": "Hash Join", "Plans": [
    {"Node Type": "Seq Scan", "Relation Name": "supplier", "Alias": "s"},
    {"Node Type": "Hash", "Plans": [{"Node Type": "Hash Join", "Plans": [
        {"Node Type": "Index Only Scan", "Relation Name": "nation", "Alias": "n"}, {"Node Type": "Hash", "Plans": [{"Node Type": "Seq Scan", "Relation Name": "region"}]},
    ]}]},
]}]}}


def plan_json_guided(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = load(spark, sf_dir, TABLES)
    query = bind(GUIDED_SQL, Catalog.of_frames(tables))
    rows = build(query, tables, tree_of(GUIDED, query)).to_dataframe(guided=True)
    return rows.agg(F.min("c0").alias("nation"), F.min("c1").alias("supplier"))


def rows_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All joined rows of a query's columns, its MINs left out."""
    return run_sql(GUIDED_SQL, load(spark, sf_dir, TABLES), mode="rows")


_PART = [Attribute("p_partkey", I64), Attribute("p_name", STR), Attribute("p_size", I32), Attribute("p_retailprice", F64)]


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "part-csv")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.when(F.col("p_size") > 10, F.concat(F.lit('"a\\", b\n'), "p_name")).alias("p_name"), "p_size", "p_retailprice")
    write_csv(part, path)
    return read_csv(spark, path, _PART, Compare(2, "<", 30))


def cache_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, keep = fresh_path(spark, "cache"), Compare(3, "=", "BUILDING")
    make = lambda: spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").where(keep.to_column(lambda i: F.col("c_mktsegment")))
    cached(spark, folder, "customer", keep, make)
    return cached(spark, folder, "customer", keep, lambda: 1 / 0)  # the second time it is there


PREFILTERED = (
    "SELECT l.l_orderkey FROM lineitem l, part p WHERE l.l_partkey = p.p_partkey AND l.l_suppkey = p.p_partkey AND p.p_size < 20",
    "SELECT l.l_orderkey FROM lineitem l, part p WHERE l.l_partkey = p.p_partkey AND p.p_size < 20",
)


def cache_prefiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered inputs by fingerprint: the second query must not get the rows of the first, whose joins imply one equality more."""
    folder, tables = fresh_path(spark, "prefiltered"), load(spark, sf_dir, ("lineitem", "part"))
    found = [prefiltered(Context(spark), folder, text, tables)["l"] for text in (*PREFILTERED, PREFILTERED[0])]
    return functools.reduce(DataFrame.unionByName, [df.groupBy("l_linenumber").agg(F.count("*").alias("n")).withColumn("query", F.lit(i)) for i, df in enumerate(found)])


def csv_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one nation each, as written, and cut inside the last quoted field: whether reading raises."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.concat(F.lit('"'), "n_name", F.lit('"')).alias("n_name"))
    columns, out = [Attribute("n_nationkey", I32), Attribute("n_name", STR)], []
    for case, text in (("whole", F.concat("n_nationkey", F.lit(","), "n_name")), ("open", F.concat("n_nationkey", F.lit(","), F.expr("rtrim('\"', n_name)"))), ("ragged", F.concat("n_nationkey", F.lit(",1,2")))):
        path = fresh_path(spark, "strict-csv")
        nation.select(text.alias("value")).coalesce(1).write.text(path)
        try:
            out.append((case, read_csv(spark, path, columns).agg(F.count_distinct("n_nationkey", "n_name")).first()[0]))
        except (CsvError, PySparkException, Py4JJavaError):
            out.append((case, None))
    return spark.createDataFrame(out, "case string, n_rows long")


def _lookup(table: str, column: int, kind: DataType, keys: list[int], names: list[str], kept: tuple[int, DataType]) -> Query:
    """Keys in memory against a table: the build side is the small one."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        plan = Plan()
        a = plan.new_scan_node(plan.new_input(from_rows(spark, [(k,) for k in keys], [kind])), [(0, kind)])
        b = plan.new_scan_node(plan.new_input(spark.read.parquet(f"{sf_dir}/{table}.parquet")), [(column, kind), kept])
        plan.new_join_node(True, a, b, 0, 0, [(0, kind), (2, kept[1])])
        return plan.to_dataframe(guided=True, names=names)

    return run


def duckdb_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another engine's result as a source, joined in a plan."""
    import duckdb
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("regionkey", T.IntegerType()), T.StructField("label", T.StringType())])
    labels = from_duckdb(spark, duckdb.connect(), "SELECT i::INTEGER, 'region ' || i FROM range(1, 4) t(i)", schema)
    plan = Plan()
    a = plan.new_scan_node(plan.new_input(labels), [(0, I32), (1, STR)])
    b = plan.new_scan_node(plan.new_input(spark.read.parquet(f"{sf_dir}/nation.parquet")), [(2, I32), (1, STR)])
    plan.new_join_node(True, a, b, 0, 0, [(1, STR), (3, STR)])
    return plan.to_dataframe(names=["label", "n_name"])


def table_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is made once a session, however often plans ask for it."""
    context, made = Context(spark), []
    get = lambda: context.tables.get("supplier", lambda: made.append(1) or spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    rows = [run_sql("SELECT s_suppkey FROM supplier WHERE s_acctbal > 0", {"supplier": get()}).count() for _ in range(2)]
    destroy_context(context)
    return spark.createDataFrame([(rows[0], rows[1], len(made))], "first long, second long, made int")


def import_all_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files of several tables, loaded by their catalog."""
    folder, names = fresh_path(spark, "import"), ("region", "nation", "supplier")
    tables = load(spark, sf_dir, names)
    for t, df in tables.items():
        write_csv(df, f"{folder}/csv/{t}.csv")
    loaded = import_tables(spark, f"{folder}/csv", f"{folder}/parquet", Catalog.of_frames(tables))
    return run_sql("SELECT r.r_name, n.n_name, s.s_suppkey, s.s_acctbal FROM region r, nation n, supplier s WHERE r.r_regionkey = n.n_regionkey AND n.n_nationkey = s.s_nationkey", loaded)


SUITE = {"sql_directory": "sql", "names": ["guided", "scan"], "plans": [GUIDED, {"Plan": {"Node Type": "Seq Scan", "Relation Name": "region"}}]}
SUITE_SQL = {"sql/guided.sql": GUIDED_SQL, "sql/scan.sql": "SELECT MIN(r.r_name) AS x FROM region r WHERE r.r_regionkey > 2"}


def suite_runner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suite in its plans' join orders against answers that are kept: the second run must not ask for them again."""
    context, tables, answers, asked = Context(spark), load(spark, sf_dir, ("region", "nation", "supplier")), fresh_path(spark, "suite"), []

    def expected(name: str, text: str) -> DataFrame:
        asked.append(name)
        rows = run_sql(text, tables, mode="rows")
        return rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])

    runs = [run_suite(context, json.dumps(SUITE), SUITE_SQL.__getitem__, tables, expected=expected, answers=answers) for _ in range(2)]
    destroy_context(context)
    return spark.createDataFrame([(r.name, r.correct, asked.count(r.name)) for r in runs[1]], "name string, correct boolean, asked int")


REFUSED = (
    "SELECT COUNT(n_name) FROM nation", "SELECT n_name FROM nation GROUP BY n_name", "SELECT * FROM nation", "SELECT 1 FROM nation", "SELECT n_nationkey + 1 FROM nation",
    "SELECT DISTINCT n_name FROM nation", "SELECT n_name FROM nation ORDER BY n_name", "SELECT n_name FROM nation WHERE n_nationkey = 'x'", "SELECT n_name FROM nation",
)


def refused_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies outside the grammar is refused before anything runs; the last text is inside."""
    catalog, out = Catalog.of_frames(load(spark, sf_dir, ("nation",))), []
    for text in REFUSED:
        try:
            bind(text, catalog)
            out.append((text, False))
        except EngineError:
            out.append((text, True))
    return spark.createDataFrame(out, "text string, refused boolean")


def predicate_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates as text, and the hash that names them."""
    query = bind("SELECT p_name FROM part WHERE p_size > 10 AND (p_name LIKE 'a%' OR NOT (p_brand = 'it''s'))", Catalog.of_frames(load(spark, sf_dir, ("part",))))
    text = next(iter(query.filters.values())).pretty()
    hashes = [str(fnv1a(x)) for x in ("", "a", "foobar")]
    return spark.createDataFrame([("predicate", text), *((f"hash {i}", h) for i, h in enumerate(hashes))], "name string, shown string")


def memory_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_rows(spark, [(1, 10, 0.5, "a"), (None, None, None, None), (2, 20, 1.5, "")], [I32, I64, F64, STR])


def verify_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by which a table and its shuffled copy differ: none; and by which a changed copy differs."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    changed = nation.where("n_nationkey <> 3").unionByName(nation.where("n_nationkey = 4"))
    equal = same(nation, nation.repartition(4))
    return difference(nation, changed).select(F.col("c0").alias("n_nationkey"), F.col("n_left"), F.col("n_right"), F.lit(equal).alias("copy_equal"))


def golden_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "answers")
    result = run_sql(SQL["join_comma_sql"], load(spark, sf_dir, TABLES))
    save_answer(result, folder, "q")
    return difference(result, answer(spark, folder, "q")).agg(F.count("*").alias("different"))


def print_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.when(F.col("p_size") > 25, F.concat("p_name", F.lit('\t"\\'))).alias("p_name"), "p_size")
    return printed(in_order(part))


OTHERS: dict[str, tuple[Query, str | None]] = {
    "filter_is_null": (_nulls("SELECT o_orderkey FROM orders WHERE status IS NULL"), f"SELECT o_orderkey FROM {_NULLED} WHERE status IS NULL"),
    "filter_is_not_null": (_nulls("SELECT o_orderkey, status FROM orders WHERE status IS NOT NULL"), f"SELECT o_orderkey, status FROM {_NULLED} WHERE status IS NOT NULL"),
    "filter_not_3vl": (_nulls("SELECT o_orderkey FROM orders WHERE NOT (status = 'O')"), f"SELECT o_orderkey FROM {_NULLED} WHERE NOT (status = 'O')"),
    "filter_not_2vl": (_nulls("SELECT o_orderkey FROM orders WHERE NOT (status = 'O')", null_mode="two_valued"), f"SELECT o_orderkey FROM {_NULLED} WHERE NOT coalesce(status = 'O', false)"),
    "filter_like_regex_mode": (
        lambda spark, sf_dir: run_sql("SELECT doc_id FROM documents WHERE text LIKE 'T%.'", load(spark, sf_dir, TABLES), like_mode="regex"),
        "SELECT doc_id FROM documents WHERE text LIKE 'T%.' AND text NOT LIKE '%\n%'",
    ),
    "join_inner_build_left": (_nation_supplier(True), "SELECT n_nationkey, n_name, s_name FROM nation, supplier WHERE n_nationkey = s_nationkey"),
    "join_inner_build_right": (_nation_supplier(False), "SELECT n_nationkey, n_name, s_name FROM nation, supplier WHERE n_nationkey = s_nationkey"),
    "join_null_keys": (join_null_keys, "SELECT c_custkey, s_suppkey FROM customer, supplier WHERE nullif(c_nationkey, 0) = nullif(s_nationkey, 0)"),
    "join_empty_result": (_sql("SELECT n.n_name, s.s_name FROM nation n, supplier s WHERE n.n_nationkey = s.s_nationkey AND n.n_name = 'nowhere'"), "SELECT n_name, s_name FROM nation, supplier WHERE n_nationkey = s_nationkey AND n_name = 'nowhere'"),
    "join_empty_build": (join_empty_build, "SELECT n_name, s_nationkey FROM nation, supplier WHERE n_nationkey = s_nationkey AND n_nationkey < 0"),
    "join_on_string": (join_on_string, "SELECT doc_id, d.lang AS lang FROM documents d, (SELECT DISTINCT lang FROM documents) x WHERE d.lang = x.lang"),
    "join_output_reorder": (join_output_reorder, "SELECT r_name, n_name, r_name AS r_name_again, n_nationkey FROM nation, region WHERE n_regionkey = r_regionkey"),
    "join_leftdeep_3": (join_leftdeep_3, "SELECT r_name, s_suppkey FROM region, nation, supplier WHERE r_regionkey = n_regionkey AND n_nationkey = s_nationkey"),
    "join_bushy_4": (join_bushy_4, "SELECT n_name, o_orderkey, l_linenumber FROM nation, customer, orders, lineitem WHERE n_nationkey = c_nationkey AND c_custkey = o_custkey AND o_orderkey = l_orderkey"),
    "plan_json_guided": (plan_json_guided, GUIDED_SQL),
    "rows_mode": (rows_mode, "SELECT n.n_name AS nation, s.s_name AS supplier FROM region AS r, nation AS n, supplier AS s WHERE r.r_regionkey = n.n_regionkey AND n.n_nationkey = s.s_nationkey AND r.r_name = 'EUROPE'"),
    "csv_roundtrip": (csv_roundtrip, "SELECT p_partkey, CASE WHEN p_size > 10 THEN '\"a\\\", b\n' || p_name END AS p_name, p_size, p_retailprice FROM part WHERE p_size < 30"),
    "cache_roundtrip": (cache_roundtrip, "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "cache_prefiltered": (cache_prefiltered, " UNION ALL ".join(f"SELECT l_linenumber, count(*) AS n, {i}::INTEGER AS query FROM lineitem {w} GROUP BY l_linenumber" for i, w in enumerate(("WHERE l_partkey = l_suppkey", "", "WHERE l_partkey = l_suppkey")))),
    "csv_strict": (csv_strict, "SELECT 'whole' AS \"case\", count(*) AS n_rows FROM nation UNION ALL SELECT 'open', NULL UNION ALL SELECT 'ragged', NULL"),
    "lookup_point": (_lookup("orders", 0, I64, list(range(100)) + list(range(10**9, 10**9 + 100)), ["o_orderkey", "o_orderstatus"], (2, STR)), "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 0 AND 99"),
    "lookup_multimap": (_lookup("lineitem", 1, I64, [1, 2, 3, 3], ["l_partkey", "l_orderkey"], (0, I64)), "SELECT l_partkey, l_orderkey FROM lineitem, (VALUES (1), (2), (3), (3)) k(x) WHERE l_partkey = x"),
    "lookup_sparse": (_lookup("orders", 0, I64, [10**12 + i for i in range(100)], ["o_orderkey", "o_orderstatus"], (2, STR)), "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 1000000000000"),
    "duckdb_source": (duckdb_source, "SELECT 'region ' || n_regionkey AS label, n_name FROM nation WHERE n_regionkey BETWEEN 1 AND 3"),
    "table_cache": (table_cache, "SELECT count(*) AS first, count(*) AS second, 1::INTEGER AS made FROM supplier WHERE s_acctbal > 0"),
    "import_all_tables": (import_all_tables, "SELECT r_name, n_name, s_suppkey, s_acctbal FROM region, nation, supplier WHERE r_regionkey = n_regionkey AND n_nationkey = s_nationkey"),
    "suite_runner": (suite_runner, "SELECT unnest(['guided', 'scan']) AS name, true AS correct, 1::INTEGER AS asked"),
    "refused_sql": (refused_sql, " UNION ALL ".join("SELECT '" + t.replace("'", "''") + f"' AS text, {'false' if t == REFUSED[-1] else 'true'} AS refused" for t in REFUSED)),
    "predicate_print": (predicate_print, "SELECT * FROM (VALUES ('predicate', '[AND]\n  4 > 10\n  [OR]\n    1 LIKE ''a%''\n    [NOT]\n      2 = ''it\\''s'''), ('hash 0', '14695981039346656037'), ('hash 1', '12638187200555641996'), ('hash 2', '9625390261332436968')) t(name, shown)"),
    "memory_source": (memory_source, "SELECT * FROM (VALUES (1::INTEGER, 10::BIGINT, 0.5::DOUBLE, 'a'), (NULL, NULL, NULL, NULL), (2, 20, 1.5, '')) t(c0, c1, c2, c3)"),
    "verify_compare": (verify_compare, "SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 1::BIGINT ELSE 1::BIGINT END AS n_left, CASE n_nationkey WHEN 3 THEN 0::BIGINT ELSE 2::BIGINT END AS n_right, true AS copy_equal FROM nation WHERE n_nationkey IN (3, 4)"),
    "golden_answer": (golden_answer, "SELECT 0::BIGINT AS different"),
    "print_rows": (print_rows, r"""SELECT p_partkey || '|' || coalesce('"' || CASE WHEN p_size > 25 THEN replace(p_name, '"', '\"') || '\t\"\\' END || '"', 'NULL') || '|' || p_size AS line FROM part"""),
}


def queries() -> dict[str, Query]:
    return {name: _sql(text) for name, text in SQL.items()} | {name: q for name, (q, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL) | {name: text for name, (_, text) in OTHERS.items() if text}
