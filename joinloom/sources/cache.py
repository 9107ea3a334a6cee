"""Filtered tables and expected answers as Parquet, named by a fingerprint of table and predicate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.predicates import Predicate, fingerprint


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a complete Parquet folder stands at ``path``, on any file system Spark knows."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def version(df: DataFrame) -> str | None:
    """The files behind ``df`` with their sizes and times, and its columns; None where rows don't come from files."""
    spark, files = df.sparkSession, sorted(df.inputFiles())
    if not files:
        return None
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in files]
    states = [p.getFileSystem(conf).getFileStatus(p) for p in paths]
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    return "\n".join([plan, *(f"{f} {s.getLen()} {s.getModificationTime()}" for f, s in zip(files, states, strict=True))])


def cached(spark: SparkSession, folder: str, table: str, predicate: Predicate | None, make: Callable[[], DataFrame], more: str = "") -> DataFrame:
    """The filtered table from the cache; ``make`` builds it the first time.  ``more``: what else its rows depend on."""
    path = f"{folder}/{fingerprint(table, predicate, more)}.parquet"
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_answer(df: DataFrame, folder: str, query: str) -> None:
    """An expected answer, as a bag: order carries no meaning."""
    df.write.mode("overwrite").parquet(f"{folder}/{query}.parquet")


def answer(spark: SparkSession, folder: str, query: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{query}.parquet")


class TableCache:
    """Base tables kept by name for one session; persisted once, released together."""

    def __init__(self):
        self._held: dict[str, DataFrame] = {}

    def get(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._held:
            self._held[name] = make().persist()
        return self._held[name]

    def release(self) -> None:
        for df in self._held.values():
            df.unpersist()
        self._held.clear()
