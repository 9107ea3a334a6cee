r"""CSV by an explicit schema.

Dialect: fields by ``sep``, quoted fields may hold separators and newlines, ``escape`` makes a quote inside quotes, an empty
field (quoted or not) is null, records end in ``\n``, ``\r`` or ``\r\n``.  Reading is strict: rows of another width,
numbers that don't parse or don't fit, and quotes that are never closed raise an error.  Spark's parser lets the last pass,
so quotes are counted in one more scan of the text.  Filters are applied in the scan.  A file whose quoted fields hold
newlines can't be split; ``multi_line=False`` reads files without such fields in splits, and a record must close its quotes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import Predicate
from ..types import Attribute, CsvError, schema_of


def read_csv(
    spark: SparkSession, path: str, attributes: list[Attribute], predicate: Predicate | None = None, header: bool = False,
    sep: str = ",", escape: str = "\\", trailing_comma: bool = False, check_quotes: bool = True, multi_line: bool = True,
) -> DataFrame:
    """Rows of the files at ``path``; ``check_quotes=False`` leaves out the scan for quotes that are never closed."""
    schema = schema_of([Attribute(a.name, a.type) for a in attributes])
    if trailing_comma:
        schema = schema.add("jl_nothing", "string")
    if check_quotes:
        _closed(spark, path, escape, multi_line)
    df = (
        spark.read.schema(schema).option("sep", sep).option("quote", '"').option("escape", escape).option("header", header)
        .option("multiLine", multi_line).option("mode", "FAILFAST").option("enforceSchema", True).csv(path)
    )
    df = df.drop("jl_nothing") if trailing_comma else df
    if predicate is None:
        return df
    predicate.check(lambda i: attributes[i].type)
    return df.where(predicate.to_column(lambda i: F.col(attributes[i].name)))


def _closed(spark: SparkSession, path: str, escape: str, multi_line: bool) -> None:
    """Each file, or each line if records are lines, must hold an even number of quotes that aren't escaped."""
    body = F.col("value")
    if escape != '"':
        body = F.replace(F.replace(body, F.lit(escape * 2), F.lit("")), F.lit(f'{escape}"'), F.lit(""))
    quotes = F.length(body) - F.length(F.replace(body, F.lit('"'), F.lit("")))
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), quotes.alias("n"))
    bad = (rows.groupBy("file").agg(F.sum("n").alias("n")) if multi_line else rows).where("n % 2 = 1").take(1)
    if bad:
        raise CsvError(f"a quote isn't closed in {bad[0]['file']}")


def write_csv(df: DataFrame, path: str, sep: str = ",", escape: str = "\\") -> None:
    df.write.option("sep", sep).option("quote", '"').option("escape", escape).option("emptyValue", "").option("nullValue", "").csv(path)


def import_csv(spark: SparkSession, source: str, target: str, attributes: list[Attribute], **options) -> DataFrame:
    """A CSV file as Parquet."""
    read_csv(spark, source, attributes, **options).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
