"""Join scenarios through the plan API."""

from __future__ import annotations

from collections import Counter

import pytest

from joinloom.plans.plan import Plan
from joinloom.sources.memory import from_rows
from joinloom.types import DataType, InvalidPlan, TypeMismatch

I, L, D, S = DataType.INT32, DataType.INT64, DataType.FP64, DataType.VARCHAR


def two(spark, left, right, kinds=(I,), build_left=True, guided=False):
    plan = Plan()
    a = plan.new_scan_node(plan.new_input(from_rows(spark, left, list(kinds))), [(i, k) for i, k in enumerate(kinds)])
    b = plan.new_scan_node(plan.new_input(from_rows(spark, right, list(kinds))), [(i, k) for i, k in enumerate(kinds)])
    both = list(kinds) * 2
    plan.new_join_node(build_left, a, b, 0, 0, [(i, k) for i, k in enumerate(both)])
    return Counter(tuple(r) for r in plan.to_dataframe(guided).collect())


@pytest.mark.parametrize("build_left", [True, False])
@pytest.mark.parametrize(
    "left, right, expected",
    [
        ([], [], {}),
        ([1], [1], {(1, 1): 1}),
        ([1, 2, 3], [1, 2, 3], {(1, 1): 1, (2, 2): 1, (3, 3): 1}),
        ([1, 2, 3], [4, 5, 6], {}),
        ([1, 1, 2, 3], [1, 1, 2, 3], {(1, 1): 4, (2, 2): 1, (3, 3): 1}),
        ([1, 1, None, 2, 3], [1, 1, None, 2, 3], {(1, 1): 4, (2, 2): 1, (3, 3): 1}),
    ],
)
def test_single_column(spark, left, right, expected, build_left):
    for guided in (False, True):
        assert two(spark, [(x,) for x in left], [(x,) for x in right], build_left=build_left, guided=guided) == Counter(expected)


@pytest.mark.parametrize("kind, value", [(L, 1 << 40), (D, 0.1), (S, "é" * 20_000)])
def test_key_types(spark, kind, value):
    assert two(spark, [(value,), (None,)], [(value,), (value,), (None,)], (kind,)) == Counter({(value, value): 2})


def test_reordered_outputs_and_duplicates(spark):
    rows = [(1, "xxx"), (1, "yyy"), (None, "zzz"), (2, "uuu"), (3, "vvv")]
    plan = Plan()
    table = plan.new_input(from_rows(spark, rows, [I, S]))
    a, b = plan.new_scan_node(table, [(0, I), (1, S)]), plan.new_scan_node(table, [(1, S), (0, I)])
    plan.new_join_node(False, a, b, 0, 1, [(0, I), (2, S), (1, S), (2, S)])
    got = Counter(tuple(r) for r in plan.to_dataframe(names=["a", "b", "c", "d"]).collect())
    assert got == Counter({(1, x, y, x): 1 for x in ("xxx", "yyy") for y in ("xxx", "yyy")} | {(2, "uuu", "uuu", "uuu"): 1, (3, "vvv", "vvv", "vvv"): 1})


def test_three_tables_with_strings_and_bushy_tree(spark):
    plan = Plan()
    scans = [plan.new_scan_node(plan.new_input(from_rows(spark, rows, [I, S])), [(0, I), (1, S)]) for rows in ([(1, "a"), (2, "b"), (3, "c")], [(1, "x"), (2, "y")], [(1, "u"), (2, "v"), (3, "w")], [(2, "q")])]
    ab = plan.new_join_node(False, scans[0], scans[1], 0, 0, [(0, I), (1, S), (3, S)])
    plan.new_join_node(False, ab, scans[2], 0, 0, [(0, I), (1, S), (4, S)])
    assert sorted(map(tuple, plan.to_dataframe().collect())) == [(1, "a", "u"), (2, "b", "v")]
    cd = plan.new_join_node(True, scans[2], scans[3], 0, 0, [(0, I), (3, S)])
    plan.new_join_node(True, ab, cd, 0, 0, [(1, S), (2, S), (4, S)])
    assert [tuple(r) for r in plan.to_dataframe().collect()] == [("b", "y", "q")]


def test_root_scan_and_self_join_of_one_node(spark):
    plan = Plan()
    a = plan.new_scan_node(plan.new_input(from_rows(spark, [(1, 2.5), (2, None)], [I, D])), [(1, D), (0, I), (1, D)])
    assert sorted(map(tuple, plan.to_dataframe().collect()), key=str) == [(2.5, 1, 2.5), (None, 2, None)]
    plan.new_join_node(True, a, a, 1, 1, [(1, I), (3, D)])
    assert sorted(map(tuple, plan.to_dataframe().collect()), key=str) == [(1, 2.5), (2, None)]


def test_two_keys(spark):
    plan = Plan()
    table = plan.new_input(from_rows(spark, [(1, 1), (1, 2), (2, None)], [I, I]))
    a, b = (plan.new_scan_node(table, [(0, I), (1, I)]) for _ in range(2))
    plan.new_join_node(True, a, b, [0, 1], [0, 1], [(0, I), (3, I)])
    assert sorted(map(tuple, plan.to_dataframe().collect())) == [(1, 1), (1, 2)]


def test_invalid_plans(spark):
    def base():
        plan = Plan()
        a = plan.new_scan_node(plan.new_input(from_rows(spark, [(1, "a")], [I, S])), [(0, I), (1, S)])
        return plan, a

    with pytest.raises(InvalidPlan):
        Plan().validate()
    for node, error in (
        (lambda p, a: p.new_scan_node(3, [(0, I)]), InvalidPlan),
        (lambda p, a: p.new_scan_node(0, [(9, I)]), InvalidPlan),
        (lambda p, a: p.new_scan_node(0, [(0, S)]), TypeMismatch),
        (lambda p, a: p.new_join_node(True, a, 7, 0, 0, []), InvalidPlan),
        (lambda p, a: p.new_join_node(True, a, 1, 0, 0, []), InvalidPlan),  # its own child
        (lambda p, a: p.new_join_node(True, a, a, 0, 5, []), InvalidPlan),
        (lambda p, a: p.new_join_node(True, a, a, 0, 1, [(0, I)]), TypeMismatch),
        (lambda p, a: p.new_join_node(True, a, a, 0, 0, [(4, I)]), InvalidPlan),
        (lambda p, a: p.new_join_node(True, a, a, 0, 0, [(1, I)]), TypeMismatch),
    ):
        plan, a = base()
        node(plan, a)
        with pytest.raises(error):
            plan.validate()
    with pytest.raises(InvalidPlan):
        base()[0].new_join_node(True, 0, 0, [0], [0, 1], [])


def test_guided_build_sides(spark, data):
    def text(build_left):
        plan = Plan()
        n, s = (plan.new_input(spark.read.parquet(f"{data}/{t}.parquet")) for t in ("nation", "supplier"))
        a, b = plan.new_scan_node(n, [(0, I)]), plan.new_scan_node(s, [(2, I)])
        plan.new_join_node(build_left, a, b, 0, 0, [(0, I)])
        return plan.to_dataframe(guided=True)._jdf.queryExecution().executedPlan().toString()

    assert "BuildLeft" in text(True) and "BuildRight" in text(False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "300")
    try:
        assert "BroadcastHashJoin" not in text(False)  # too large an estimate to broadcast
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_integer_column_and_sparse_probe(spark):
    plan = Plan()
    a = plan.new_scan_node(plan.new_input(spark.range(6000).selectExpr("int(id) AS c0")), [(0, I)])
    b = plan.new_scan_node(plan.new_input(from_rows(spark, [(10,), (5500,), (19_000,)], [I])), [(0, I)])
    plan.new_join_node(False, a, b, 0, 0, [(0, I)])
    assert sorted(r[0] for r in plan.to_dataframe().collect()) == [10, 5500]
