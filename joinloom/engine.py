"""Executing plans, and running a suite of SQL files with EXPLAIN-shaped plans against expected results."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .operators.verify import same
from .plans.explain import load, tree_of
from .plans.graph import classes, inside
from .plans.order import build, filtered
from .plans.plan import Plan
from .plans.sql import bind
from .sources.cache import TableCache, answer, cached, exists, save_answer, version


@dataclass
class Context:
    """A session and the base tables it keeps."""

    spark: SparkSession
    tables: TableCache = field(default_factory=TableCache)


def build_context(spark: SparkSession) -> Context:
    return Context(spark)


def execute(plan: Plan, context: Context, guided: bool = True) -> DataFrame:
    """The plan's result as a DataFrame of positional columns; nothing runs until it is read."""
    return plan.to_dataframe(guided)


def destroy_context(context: Context) -> None:
    context.tables.release()


@dataclass(frozen=True)
class Run:
    name: str
    milliseconds: float
    correct: bool


def run_suite(
    context: Context, plans: str, read: Callable[[str], str], tables: dict[str, DataFrame], catalog: Catalog | None = None,
    expected: Callable[[str, str], DataFrame] | None = None, only: set[str] | None = None, report: str | None = None, answers: str | None = None,
) -> list[Run]:
    """Each query of a plans file in its plan's join order: all joined rows, timed, compared as bags.

    ``read`` gives the text of a path; ``expected`` gives a query's rows from its name and its SQL without aggregates, and is
    asked outside the timed part.  With a folder ``answers`` it is asked once a query: answers are kept there and read again.
    Base tables are persisted in the context.  The seconds of all queries go to file ``report`` if every result is right.
    """
    folder, named = load(plans)
    catalog = catalog or Catalog.of_frames(tables)
    tables = {t: context.tables.get(t, lambda df=df: df) for t, df in tables.items()}

    def right(name: str, text: str) -> DataFrame:
        if answers is None:
            return expected(name, text)
        if not exists(context.spark, f"{answers}/{name}.parquet"):
            save_answer(expected(name, text), answers, name)
        return answer(context.spark, answers, name)

    runs = []
    for name, node in named.items():
        if only is not None and name not in only:
            continue
        text = read(f"{folder}/{name}.sql")
        query = bind(text, catalog)
        result = build(query, tables, tree_of(node, query)).to_dataframe(guided=True)
        began = time.perf_counter()
        result.write.format("noop").mode("overwrite").save()
        took = (time.perf_counter() - began) * 1000
        named_result = result.toDF(*[f"c{i}" for i in range(len(result.columns))])
        runs.append(Run(name, took, expected is None or same(named_result, right(name, text))))
    if report and all(r.correct for r in runs):
        with open(report, "w") as f:
            f.write(f"{sum(r.milliseconds for r in runs) / 1000:.3f}\n")
    return runs


def prefiltered(
    context: Context, folder: str, query_text: str, tables: dict[str, DataFrame], catalog: Catalog | None = None, null_mode: str = "sql", like_mode: str = "sql",
) -> dict[str, DataFrame]:
    """Each FROM item's filtered rows from the fingerprint cache in ``folder``, by alias: joins can be timed alone.

    The fingerprint covers all that the rows depend on: predicate, equalities inside the table, modes, and the table's
    files with their times.  Tables that don't come from files aren't cached.
    """
    catalog = catalog or Catalog.of_frames(tables)
    query = bind(query_text, catalog)
    found, out = classes(query), {}
    for alias, e in query.entities.items():
        rows = filtered(query, e, tables[e.table], null_mode, like_mode).select(*[F.col(f"`{a.name}`") for a in catalog.attributes(e.table)])
        source = version(tables[e.table])
        if source is not None:
            equal = sorted((i, j) for (_, i), (_, j) in inside(found, e))
            rows = cached(context.spark, folder, e.table, query.filters.get(e), lambda rows=rows: rows, f"{equal} {null_mode} {like_mode}\n{source}")
        out[alias] = rows
    return out
