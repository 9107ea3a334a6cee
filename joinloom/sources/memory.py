"""Rows in memory, and result sets of DuckDB, as DataFrames with positional column names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..types import Attribute, DataType, schema_of


def from_rows(spark: SparkSession, rows: Iterable[tuple], types: list[DataType]) -> DataFrame:
    """Columns are called c0, c1, ..."""
    return spark.createDataFrame(list(rows), schema_of([Attribute(f"c{i}", t) for i, t in enumerate(types)]))


def from_duckdb(spark: SparkSession, connection, sql: str, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame(connection.execute(sql).fetchall(), schema)
