from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from joinloom.functions.predicates import Compare, Logic, any_of, between, fingerprint, fnv1a, is_in, negated
from joinloom.sources.memory import from_rows
from joinloom.types import DataType, TypeMismatch

KINDS = [DataType.INT32, DataType.VARCHAR]
ROWS = [(1, "a"), (2, "ab"), (3, "a\nb"), (4, "a\\b"), (5, ""), (None, None), (7, "a_b"), (8, "A%"), (9, "a\rb"), (10, "a.b")]


def keys(spark, predicate, **modes):
    predicate.check(KINDS.__getitem__)
    df = from_rows(spark, ROWS, KINDS)
    return {r[0] for r in df.where(predicate.to_column(lambda i: F.col(f"c{i}"), **modes)).collect()}


@pytest.mark.parametrize(
    "op, value, expected",
    [("=", 3, {3}), ("!=", 3, {1, 2, 4, 5, 7, 8, 9, 10}), ("<", 3, {1, 2}), (">", 7, {8, 9, 10}), ("<=", 2, {1, 2}), (">=", 9, {9, 10}), ("IS NULL", None, {None}), (">", 2.5, {3, 4, 5, 7, 8, 9, 10})],
)
def test_numbers(spark, op, value, expected):
    assert keys(spark, Compare(0, op, value)) == expected


@pytest.mark.parametrize(
    "op, value, expected",
    [
        ("=", "ab", {2}), ("<", "a", {5, 8}), (">=", "ab", {2}), ("LIKE", "a%b", {2, 3, 4, 7, 9, 10}), ("LIKE", "a_b", {3, 4, 7, 9, 10}), ("LIKE", "a\\b", {4}),
        ("LIKE", "", {5}), ("LIKE", "%", {1, 2, 3, 4, 5, 7, 8, 9, 10}), ("LIKE", "a.b", {10}), ("NOT LIKE", "a%", {5, 8}),
    ],
)
def test_strings(spark, op, value, expected):
    assert keys(spark, Compare(1, op, value)) == expected


def test_regex_mode_stops_at_newlines_only(spark):
    assert keys(spark, Compare(1, "LIKE", "a%b"), like_mode="regex") == {2, 4, 7, 9, 10}
    assert keys(spark, Compare(1, "LIKE", "a.b"), like_mode="regex") == {10}


def test_null_modes(spark):
    part = negated(Compare(0, "=", 1))
    assert None not in keys(spark, part) and None in keys(spark, part, null_mode="two_valued")
    part = negated(is_in(0, [1, 2]))
    assert keys(spark, part) == {3, 4, 5, 7, 8, 9, 10} and None in keys(spark, part, null_mode="two_valued")
    assert keys(spark, Compare(0, "IS NOT NULL")) == {1, 2, 3, 4, 5, 7, 8, 9, 10}


def test_logic(spark):
    assert keys(spark, between(0, 2, 4)) == {2, 3, 4}
    assert keys(spark, any_of([Compare(0, "=", 1), Logic("AND", (Compare(0, ">", 6), Compare(1, "LIKE", "A%")))])) == {1, 8}


def test_types():
    for bad in (Compare(0, "=", "1"), Compare(1, "=", 1), Compare(0, "LIKE", "1"), Compare(0, "=", None), Compare(0, "=", True)):
        with pytest.raises(TypeMismatch):
            bad.check(KINDS.__getitem__)
    with pytest.raises(TypeMismatch):
        Compare(0, "~", 1)


def test_pretty_and_fingerprint():
    p = Logic("AND", (Compare(1, "LIKE", "a%"), Logic("NOT", (Compare(0, "IS NULL"),))))
    assert p.pretty() == "[AND]\n  1 LIKE 'a%'\n  [NOT]\n    0 IS NULL "
    assert fnv1a("") == 0xCBF29CE484222325 and fnv1a("a") == 0xAF63DC4C8601EC8C
    assert fingerprint("t", None) == f"t_{fnv1a('No filter')}" != fingerprint("t", p)


def test_filters_reach_the_scan(spark, data):
    part = spark.read.parquet(f"{data}/part.parquet")
    plan = part.where(is_in(0, [1, 7]).to_column(lambda i: F.col("p_size"))).select("p_partkey")._jdf.queryExecution().executedPlan().toString()
    assert "In(p_size, [1,7])" in plan and "p_name" not in plan.split("ReadSchema")[1]


def test_strings_print_apart():
    two = Logic("AND", (Compare(1, "=", "x"), Compare(1, "=", "y")))
    one = Logic("AND", (Compare(1, "=", "x'\n  1 = 'y"),))
    assert two.pretty() != one.pretty() and fingerprint("t", two) != fingerprint("t", one)
    assert len({Compare(1, "=", v).pretty() for v in ("\n", "\\n", "\\\n", "\r", "'", "\\'")}) == 6
