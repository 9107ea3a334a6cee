"""Streaming input for filters and projections; the engine's own operators are batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import Predicate
from ..types import Attribute, schema_of


def scan_stream(spark: SparkSession, folder: str, attributes: list[Attribute], columns: list[int], predicate: Predicate | None = None, format: str = "parquet") -> DataFrame:
    """A stream of the files that appear in ``folder``, filtered and projected as a scan is."""
    rows = spark.readStream.schema(schema_of(attributes)).format(format).load(folder)
    if predicate is not None:
        predicate.check(lambda i: attributes[i].type)
        rows = rows.where(predicate.to_column(lambda i: F.col(attributes[i].name)))
    return rows.select(*[attributes[i].name for i in columns])
