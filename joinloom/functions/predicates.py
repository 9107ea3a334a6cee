"""The predicate language: comparisons of a column with a literal, joined by AND, OR and NOT.

Predicates address columns by ordinal, so they outlive renaming; ``to_column`` turns one into a Spark column that
Catalyst pushes to the scan.  ``null_mode`` "sql" keeps three-valued logic; "two_valued" makes NOT of unknown true.
``like_mode`` "sql" lets ``%`` and ``_`` match newlines as SQL does; "regex" doesn't.  A backslash in a LIKE pattern is an
ordinary character in either mode.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import DataType, TypeMismatch

Literal = int | float | str | None
OPS = ("=", "!=", "<", ">", "<=", ">=", "LIKE", "NOT LIKE", "IS NULL", "IS NOT NULL")


def _quoted(text: str) -> str:
    """In single quotes; what could end the string or the line is escaped, so no two strings print alike."""
    for raw, shown in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r")):
        text = text.replace(raw, shown)
    return f"'{text}'"


@dataclass(frozen=True)
class Compare:
    column: int
    op: str
    value: Literal = None

    def __post_init__(self):
        if self.op not in OPS:
            raise TypeMismatch(f"unknown operator {self.op!r}")

    def pretty(self, indent: int = 0) -> str:
        return f"{'':{indent}}{self.column} {self.op} {self._value()}" if indent else f"{self.column} {self.op} {self._value()}"

    def _value(self) -> str:
        if self.op.startswith("IS ") or self.value is None:
            return ""
        return _quoted(self.value) if isinstance(self.value, str) else str(self.value)

    def columns(self) -> set[int]:
        return {self.column}

    def check(self, kind: Callable[[int], DataType]) -> None:
        """Raises TypeMismatch unless the literal suits the column."""
        if self.op.startswith("IS "):
            return
        have = kind(self.column)
        if self.value is None or isinstance(self.value, bool):
            raise TypeMismatch(f"column {self.column} {self.op} needs a number or string")
        if isinstance(self.value, str) == have.numeric:
            raise TypeMismatch(f"column {self.column} is {have.value}, the literal {self.value!r} isn't")
        if self.op.endswith("LIKE") and have.numeric:
            raise TypeMismatch(f"LIKE needs a string column, column {self.column} is {have.value}")

    def to_column(self, of: Callable[[int], Column], null_mode: str = "sql", like_mode: str = "sql") -> Column:
        c = of(self.column)
        match self.op:
            case "IS NULL":
                return c.isNull()
            case "IS NOT NULL":
                return c.isNotNull()
            case "LIKE":
                return like(c, str(self.value), like_mode)
            case "NOT LIKE":
                return ~like(c, str(self.value), like_mode)
            case "=":
                return c == F.lit(self.value)
            case "!=":
                return c != F.lit(self.value)
            case "<":
                return c < F.lit(self.value)
            case ">":
                return c > F.lit(self.value)
            case "<=":
                return c <= F.lit(self.value)
            case _:
                return c >= F.lit(self.value)


@dataclass(frozen=True)
class Logic:
    op: str  # AND, OR, NOT
    children: tuple[Predicate, ...]

    def pretty(self, indent: int = 0) -> str:
        return "\n".join([f"{'':{indent}}[{self.op}]" if indent else f"[{self.op}]", *(c.pretty(indent + 2) for c in self.children)])

    def columns(self) -> set[int]:
        return set().union(*(c.columns() for c in self.children))

    def check(self, kind: Callable[[int], DataType]) -> None:
        for c in self.children:
            c.check(kind)

    def to_column(self, of: Callable[[int], Column], null_mode: str = "sql", like_mode: str = "sql") -> Column:
        parts = [c.to_column(of, null_mode, like_mode) for c in self.children]
        if null_mode == "two_valued":
            parts = [F.coalesce(p, F.lit(False)) for p in parts]
        if self.op == "NOT":
            return ~parts[0]
        if self.op == "OR" and null_mode == "sql" and (values := self._equalities()):
            return of(values[0]).isin(*values[1])  # one In filter reaches the scan
        out = parts[0]
        for p in parts[1:]:
            out = out & p if self.op == "AND" else out | p
        return out

    def _equalities(self) -> tuple[int, list] | None:
        if all(isinstance(c, Compare) and c.op == "=" and c.column == self.children[0].column for c in self.children):
            return self.children[0].column, [c.value for c in self.children]
        return None


Predicate = Compare | Logic


def all_of(parts: list[Predicate]) -> Predicate | None:
    return None if not parts else parts[0] if len(parts) == 1 else Logic("AND", tuple(parts))


def any_of(parts: list[Predicate]) -> Predicate:
    return parts[0] if len(parts) == 1 else Logic("OR", tuple(parts))


def negated(part: Predicate) -> Predicate:
    return Logic("NOT", (part,))


def between(column: int, low: Literal, high: Literal) -> Predicate:
    return Logic("AND", (Compare(column, ">=", low), Compare(column, "<=", high)))


def is_in(column: int, values: list[Literal]) -> Predicate:
    return any_of([Compare(column, "=", v) for v in values])


def like(c: Column, pattern: str, mode: str = "sql") -> Column:
    if mode == "sql":
        return c.like(pattern.replace("\\", "\\\\"))
    wild = {"%": ".*", "_": "."}
    body = "".join(wild.get(x) or re.sub(r"([^\w\s]|_)", r"\\\1", x) for x in pattern)
    return c.rlike(f"(?d)^(?:{body})\\z")


def fnv1a(text: str) -> int:
    """64-bit FNV-1a of the UTF-8 bytes."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def fingerprint(table: str, predicate: Predicate | None, more: str = "") -> str:
    """The name of a filtered table in the cache; ``more`` is whatever else its rows depend on."""
    shown = predicate.pretty() if predicate else "No filter"
    return f"{table}_{fnv1a(f'{shown}\n{more}' if more else shown)}"
