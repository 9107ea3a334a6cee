"""Table schemas: from DDL text, from Parquet files, and the 21 tables of the join order benchmark."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .types import Attribute, DataType, EngineError

# Tables of the IMDB schema.
IMDB = """
CREATE TABLE aka_name (id integer NOT NULL, person_id integer NOT NULL, name text NOT NULL, imdb_index text, name_pcode_cf text, name_pcode_nf text, surname_pcode text, md5sum text);
CREATE TABLE aka_title (id integer NOT NULL, movie_id integer NOT NULL, title text NOT NULL, imdb_index text, kind_id integer NOT NULL, production_year integer, phonetic_code text, episode_of_id integer, season_nr integer, episode_nr integer, note text, md5sum text);
CREATE TABLE cast_info (id integer NOT NULL, person_id integer NOT NULL, movie_id integer NOT NULL, person_role_id integer, note text, nr_order integer, role_id integer NOT NULL);
CREATE TABLE char_name (id integer NOT NULL, name text NOT NULL, imdb_index text, imdb_id integer, name_pcode_nf text, surname_pcode text, md5sum text);
CREATE TABLE comp_cast_type (id integer NOT NULL, kind text NOT NULL);
CREATE TABLE company_name (id integer NOT NULL, name text NOT NULL, country_code text, imdb_id integer, name_pcode_nf text, name_pcode_sf text, md5sum text);
CREATE TABLE company_type (id integer NOT NULL, kind text NOT NULL);
CREATE TABLE complete_cast (id integer NOT NULL, movie_id integer, subject_id integer NOT NULL, status_id integer NOT NULL);
CREATE TABLE info_type (id integer NOT NULL, info text NOT NULL);
CREATE TABLE keyword (id integer NOT NULL, keyword text NOT NULL, phonetic_code text);
CREATE TABLE kind_type (id integer NOT NULL, kind text NOT NULL);
CREATE TABLE link_type (id integer NOT NULL, link text NOT NULL);
CREATE TABLE movie_companies (id integer NOT NULL, movie_id integer NOT NULL, company_id integer NOT NULL, company_type_id integer NOT NULL, note text);
CREATE TABLE movie_info (id integer NOT NULL, movie_id integer NOT NULL, info_type_id integer NOT NULL, info text NOT NULL, note text);
CREATE TABLE movie_info_idx (id integer NOT NULL, movie_id integer NOT NULL, info_type_id integer NOT NULL, info text NOT NULL, note text);
CREATE TABLE movie_keyword (id integer NOT NULL, movie_id integer NOT NULL, keyword_id integer NOT NULL);
CREATE TABLE movie_link (id integer NOT NULL, movie_id integer NOT NULL, linked_movie_id integer NOT NULL, link_type_id integer NOT NULL);
CREATE TABLE name (id integer NOT NULL, name text NOT NULL, imdb_index text, imdb_id integer, gender text, name_pcode_cf text, name_pcode_nf text, surname_pcode text, md5sum text);
CREATE TABLE person_info (id integer NOT NULL, person_id integer NOT NULL, info_type_id integer NOT NULL, info text NOT NULL, note text);
CREATE TABLE role_type (id integer NOT NULL, role text NOT NULL);
CREATE TABLE title (id integer NOT NULL, title text NOT NULL, imdb_index text, kind_id integer NOT NULL, production_year integer, imdb_id integer, phonetic_code text, episode_of_id integer, season_nr integer, episode_nr integer, series_years text, md5sum text);
"""


@dataclass
class Catalog:
    """Table name to its ordered attributes."""

    tables: dict[str, list[Attribute]] = field(default_factory=dict)

    def attributes(self, table: str) -> list[Attribute]:
        if table not in self.tables:
            raise EngineError(f"no table {table!r} in the schema")
        return self.tables[table]

    def ordinal(self, table: str, column: str) -> int:
        for i, a in enumerate(self.attributes(table)):
            if a.name == column:
                return i
        raise EngineError(f"no column {column!r} in table {table!r}")

    @staticmethod
    def of_frames(frames: dict[str, DataFrame]) -> Catalog:
        """Columns of a type outside the engine's four are left out."""
        out = Catalog()
        for name, df in frames.items():
            out.tables[name] = [Attribute(f.name, kind, f.nullable) for f in df.schema if (kind := _kind(f.dataType))]
        return out


def _kind(spark_type) -> DataType | None:
    try:
        return DataType.of(spark_type)
    except EngineError:
        return None


_DDL_TYPES = (
    (r"bigint|int8", DataType.INT64), (r"int(eger|4)?|smallint", DataType.INT32), (r"double( precision)?|float8?|real", DataType.FP64),
    (r"(character varying|varchar|char|character)(\s*\(\s*\d+\s*\))?|text|string", DataType.VARCHAR),
)


def from_ddl(text: str) -> Catalog:
    """CREATE TABLE statements; lengths and keys are read over, NOT NULL and PRIMARY KEY make a column required."""
    out = Catalog()
    for table, body in re.findall(r"create\s+table\s+(?:if\s+not\s+exists\s+)?(\w+)\s*\((.*?)\)\s*;", text, re.I | re.S):
        columns = []
        for part in re.split(r",(?![^(]*\))", body):
            m = re.match(r"\s*(\w+)\s+(.*?)\s*$", part, re.S)
            if not m or m[1].lower() in ("primary", "foreign", "unique", "constraint", "check"):
                continue
            rest = re.sub(r"\s+", " ", m[2].lower())
            kind = next((k for pattern, k in _DDL_TYPES if re.match(rf"(?:{pattern})(?![\w])", rest)), None)
            if kind is None:
                raise EngineError(f"unknown type of column {m[1]!r} of {table!r}: {rest}")
            columns.append(Attribute(m[1], kind, not re.search(r"not null|primary key", rest)))
        out.tables[table] = columns
    return out


def imdb() -> Catalog:
    return from_ddl(IMDB)


def load(spark: SparkSession, folder: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
