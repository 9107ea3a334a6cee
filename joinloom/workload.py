"""A workload of the join order benchmark's shape: loading its tables from CSV, filling them by rule, and queries by rule.

The data set itself needs a download.  ``fill`` makes tables of its relative sizes from hashes of row numbers, with foreign
keys that favour low ids, nulls where columns allow them, and strings that include those a given set of queries asks for,
so its predicates select something.  ``shaped`` makes query texts: trees of foreign keys over 4 to 12 tables with filters.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, imdb
from .functions.predicates import Compare, Predicate
from .plans.sql import bind
from .sources.csv import import_csv
from .types import Attribute, DataType

# Rows of the full data set in thousands (the smallest tables in rows below), rounded.
THOUSANDS = {
    "aka_name": 901, "aka_title": 361, "cast_info": 36244, "char_name": 3140, "company_name": 235, "complete_cast": 135, "keyword": 134,
    "movie_companies": 2609, "movie_info": 14836, "movie_info_idx": 1380, "movie_keyword": 4524, "movie_link": 30, "name": 4167, "person_info": 2964, "title": 2528,
}
SMALL = {"comp_cast_type": 4, "company_type": 4, "info_type": 113, "kind_type": 7, "link_type": 18, "role_type": 12}
#: Tables that columns ending in _id refer to.
REFERS = {
    "movie_id": "title", "linked_movie_id": "title", "episode_of_id": "title", "person_id": "name", "person_role_id": "char_name", "role_id": "role_type",
    "kind_id": "kind_type", "company_id": "company_name", "company_type_id": "company_type", "info_type_id": "info_type", "keyword_id": "keyword",
    "link_type_id": "link_type", "subject_id": "comp_cast_type", "status_id": "comp_cast_type",
}

Literals = dict[tuple[str, str], list[str]]


def import_tables(spark: SparkSession, source: str, target: str, catalog: Catalog | None = None, **options) -> dict[str, DataFrame]:
    """Every table of the catalog from ``source``/<table>.csv as Parquet in ``target``."""
    catalog = catalog or imdb()
    return {t: import_csv(spark, f"{source}/{t}.csv", f"{target}/{t}.parquet", attributes, **options) for t, attributes in catalog.tables.items()}


def literals(texts: Iterable[str], catalog: Catalog | None = None) -> Literals:
    """The strings that queries compare each column with; wildcards of patterns become blanks."""
    catalog, out = catalog or imdb(), {}

    def walk(table: str, p: Predicate) -> None:
        if not isinstance(p, Compare):
            for child in p.children:
                walk(table, child)
        elif isinstance(p.value, str):
            value = p.value.replace("%", " ").replace("_", "x").strip() if p.op.endswith("LIKE") else p.value
            known = out.setdefault((table, catalog.attributes(table)[p.column].name), [])
            if value and value not in known:
                known.append(value)

    for text in texts:
        for entity, p in bind(text, catalog).filters.items():
            walk(entity.table, p)
    return out


def rows_of(table: str, scale: float) -> int:
    return SMALL.get(table) or max(10, int(THOUSANDS[table] * 1000 * scale))


def _draw(name: str) -> Column:
    """A number in 0..1 by row and column."""
    return F.pmod(F.xxhash64("id", F.lit(name)), F.lit(1_000_003)) / 1_000_003


def _value(table: str, a: Attribute, scale: float, known: Literals) -> Column:
    u, own = _draw(f"{table}.{a.name}"), known.get((table, a.name), [])
    if a.name == "id":
        return F.col("id").cast("int")
    if a.name in REFERS:
        value = (1 + F.floor(u * u * rows_of(REFERS[a.name], scale))).cast("int")
    elif a.type is not DataType.VARCHAR:
        value = F.floor(1900 + u * 120 if a.name == "production_year" else u * 60).cast("int")
    elif table in SMALL:  # each value once
        value = F.get(F.array(*map(F.lit, own)), (F.col("id") - 1).cast("int")) if own else F.lit(None)
        value = F.coalesce(value, F.concat(F.lit(f"{a.name}_"), F.col("id")))
    else:
        other = F.concat(F.lit(f"{a.name}_"), F.floor(u * 1000).cast("string"), F.lit(" ("), F.floor(_draw(a.name) * 30).cast("string"), F.lit(")"))
        value = F.when(_draw(f"{table}.{a.name}?") < 0.5, F.get(F.array(*map(F.lit, own)), F.floor(u * len(own)).cast("int"))).otherwise(other) if own else other
    return F.when(_draw(f"{table}.{a.name}!") >= 0.1, value) if a.nullable else value


def fill(spark: SparkSession, folder: str, scale: float = 0.001, known: Literals | None = None, catalog: Catalog | None = None) -> dict[str, DataFrame]:
    """The tables as Parquet in ``folder``, at ``scale`` times the full sizes."""
    out = {}
    for table, attributes in (catalog or imdb()).tables.items():
        rows = spark.range(1, rows_of(table, scale) + 1).select(*[_value(table, a, scale, known or {}).alias(a.name) for a in attributes])
        rows.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        out[table] = spark.read.parquet(f"{folder}/{table}.parquet")
    return out


def shaped(count: int = 113, seed: int = 1) -> list[str]:
    """Texts of MIN queries over trees of foreign keys, at most three tables of facts about a movie each."""
    rng, catalog = random.Random(seed), imdb()
    edges = [(t, a.name, REFERS[a.name]) for t, attributes in catalog.tables.items() for a in attributes if a.name in REFERS and a.name != "episode_of_id"]
    facts = {t for t, c, _ in edges if c in ("movie_id", "linked_movie_id") and t != "title"}
    out = []
    while len(out) < count:
        tables, on = ["title"], []
        for _ in range(rng.randint(3, 11)):
            at = rng.randrange(len(tables))
            choice = [(t, c, r) for t, c, r in edges if t == tables[at] or r == tables[at] and t in facts and sum(x in facts for x in tables) < 3]
            if not choice:
                continue
            t, c, r = rng.choice(choice)
            new, k = (r, len(tables)) if t == tables[at] else (t, len(tables))
            if new in tables and new != "title" or tables.count(new) > 1:
                continue
            tables.append(new)
            on.append(f"x{at}.{c} = x{k}.id" if t == tables[at] and new == r else f"x{k}.{c} = x{at}.id")
        if len(tables) < 4:
            continue
        where = [f"x0.production_year > {rng.randint(1900, 2015)}"]
        for k, t in enumerate(tables[1:], 1):
            text = next((a for a in catalog.tables[t][1:] if a.type is DataType.VARCHAR), None)
            if text is None or rng.random() < 0.4:
                continue
            where.append(rng.choice([f"x{k}.{text.name} LIKE '%{rng.randint(0, 9)}%'", f"x{k}.{text.name} <> '{text.name}_1'", f"x{k}.{text.name} IN ('{text.name}_2', '{text.name}_3', '{text.name}_5')" if t in SMALL else f"x{k}.{text.name} NOT LIKE '%(1%'"]))
        items = [(k, next(a.name for a in catalog.tables[t] if a.type is DataType.VARCHAR)) for k, t in enumerate(tables) if any(a.type is DataType.VARCHAR for a in catalog.tables[t])][:3]
        select = ", ".join(f"MIN(x{k}.{c}) AS m{k}" for k, c in items)
        out.append(f"SELECT {select} FROM {', '.join(f'{t} AS x{k}' for k, t in enumerate(tables))} WHERE {' AND '.join(on + where)}")
    return out
