"""The four column types and errors of the engine."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T


class DataType(Enum):
    INT32 = "int32"
    INT64 = "int64"
    FP64 = "fp64"
    VARCHAR = "varchar"

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self]

    @property
    def numeric(self) -> bool:
        return self is not DataType.VARCHAR

    @staticmethod
    def of(kind: T.DataType) -> DataType:
        for mine, spark in _SPARK.items():
            if type(kind) is type(spark):
                return mine
        raise TypeMismatch(f"no column type for {kind.simpleString()}")


_SPARK = {DataType.INT32: T.IntegerType(), DataType.INT64: T.LongType(), DataType.FP64: T.DoubleType(), DataType.VARCHAR: T.StringType()}


class EngineError(Exception):
    """Any error of planning or binding."""


class TypeMismatch(EngineError):
    """A column, literal or key of a wrong type."""


class InvalidPlan(EngineError):
    """A plan whose indexes, types or shape are wrong."""


class UnsupportedSql(EngineError):
    """SQL outside the strict grammar."""


class CsvError(EngineError):
    """A CSV file that breaks the dialect."""


@dataclass(frozen=True)
class Attribute:
    name: str
    type: DataType
    nullable: bool = True


def schema_of(attributes: list[Attribute]) -> T.StructType:
    return T.StructType([T.StructField(a.name, a.type.spark, a.nullable) for a in attributes])
