"""Comparison of results as bags, and a text form of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side holds more often, with ``n_left`` and ``n_right``.  One shuffle; columns are matched by position.

    Raises ValueError where the numbers or types of columns differ.
    """
    kinds = [[f.dataType.simpleString() for f in df.schema] for df in (left, right)]
    if len(kinds[0]) != len(kinds[1]):
        raise ValueError(f"{len(kinds[0])} columns against {len(kinds[1])}")
    if kinds[0] != kinds[1]:
        raise ValueError(f"types {kinds[0]} against {kinds[1]}")
    names = [f"c{i}" for i in range(len(kinds[0]))]
    both = left.toDF(*names).withColumn("side", F.lit(1)).unionByName(right.toDF(*names).withColumn("side", F.lit(0)))
    counts = both.groupBy(*names).agg(F.sum("side").alias("n_left"), F.sum(1 - F.col("side")).alias("n_right"))
    return counts.where("n_left <> n_right")


def same(left: DataFrame, right: DataFrame) -> bool:
    return not difference(left, right).take(1)


def printed(df: DataFrame) -> DataFrame:
    """One column ``line``: fields joined by pipes, strings quoted and escaped, NULL for nulls."""
    return df.select(F.concat_ws("|", *[_field(F.col(f"`{f.name}`"), f.dataType) for f in df.schema]).alias("line"))


def _field(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            c = F.replace(c, F.lit(raw), F.lit(shown))
        c = F.concat(F.lit('"'), c, F.lit('"'))
    return F.coalesce(c.cast("string"), F.lit("NULL"))


def in_order(df: DataFrame) -> DataFrame:
    """Sorted by all columns, nulls last."""
    return df.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in df.columns])
