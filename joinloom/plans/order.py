"""From a bound query to a plan: filtered inputs, a join tree (given or greedy), needed columns only, outputs.

The greedy order starts from the smallest filtered table and always adds the connected table of the smallest estimate.
Estimates are Catalyst's sizes of the inputs times a selectivity guessed from the predicate, so no job runs to plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Compare, Logic, Predicate
from ..types import EngineError, UnsupportedSql
from .graph import classes, conditions, inside
from .plan import Plan, estimated_bytes
from .sql import BoundQuery, ColumnRef, Entity, bind

#: A join tree: an entity, or (build_left, left tree, right tree).
Tree = Entity | tuple

_SELECTIVITY = {"=": 0.05, "!=": 0.9, "LIKE": 0.2, "NOT LIKE": 0.8, "IS NULL": 0.1, "IS NOT NULL": 0.9}


def selectivity(p: Predicate | None) -> float:
    if p is None:
        return 1.0
    if isinstance(p, Compare):
        return _SELECTIVITY.get(p.op, 0.4)
    parts = [selectivity(c) for c in p.children]
    if p.op == "NOT":
        return 1 - parts[0]
    out = 1.0
    for s in parts:
        out *= s if p.op == "AND" else 1 - s
    return out if p.op == "AND" else 1 - out


def greedy(query: BoundQuery, weight: dict[Entity, float], cross: bool = False) -> Tree:
    """A left-deep tree; ``cross`` allows tables that no equality connects."""
    found = classes(query)
    rest = sorted(query.entities.values(), key=lambda e: (weight[e], e.table, e.occurrence))
    tree: Tree = rest.pop(0)
    have, size = {tree}, weight[tree]
    while rest:
        linked = [e for e in rest if conditions(found, have, {e})]
        if not linked and not cross:
            raise UnsupportedSql("tables without a join condition are not supported")
        nxt = (linked or rest)[0]
        rest.remove(nxt)
        tree = (size <= weight[nxt], tree, nxt)
        have.add(nxt)
        size = max(size, weight[nxt])
    return tree


def entities_of(tree: Tree) -> set[Entity]:
    return {tree} if isinstance(tree, Entity) else entities_of(tree[1]) | entities_of(tree[2])


def filtered(query: BoundQuery, entity: Entity, table: DataFrame, null_mode: str = "sql", like_mode: str = "sql") -> DataFrame:
    """The entity's rows under its filters, with the catalog's columns."""
    names = [a.name for a in query.catalog.attributes(entity.table)]
    out = table.select(*[F.col(f"`{n}`") for n in names])
    part = query.filters.get(entity)
    if part is not None:
        out = out.where(part.to_column(lambda i: F.col(f"`{names[i]}`"), null_mode, like_mode))
    for (_, i), (_, j) in inside(classes(query), entity):
        out = out.where(F.col(f"`{names[i]}`") == F.col(f"`{names[j]}`"))
    return out


def build(query: BoundQuery, tables: Callable[[str], DataFrame] | dict[str, DataFrame], tree: Tree | None = None, null_mode: str = "sql", like_mode: str = "sql", cross: bool = False) -> Plan:
    """A plan whose root's columns are the query's outputs in order."""
    get = tables.__getitem__ if isinstance(tables, dict) else tables
    frames = {e: filtered(query, e, get(e.table), null_mode, like_mode) for e in query.entities.values()}
    if tree is None:
        weight = {e: estimated_bytes(get(e.table)) * selectivity(query.filters.get(e)) for e in frames}
        tree = greedy(query, weight, cross)
    if entities_of(tree) != set(frames):
        raise EngineError("the join tree doesn't hold each table once")
    plan, found = Plan(), classes(query)
    inputs = {e: plan.new_input(df) for e, df in frames.items()}

    def grow(t: Tree, wanted: list[ColumnRef]) -> tuple[int, list[ColumnRef]]:
        if isinstance(t, Entity):
            node = plan.new_scan_node(inputs[t], [(c[1], query.attribute(c).type) for c in wanted])
            return node, wanted
        build_left, a, b = t
        ours, theirs = entities_of(a), entities_of(b)
        on = conditions(found, ours, theirs)
        if not on:
            raise EngineError("no join condition between " + ", ".join(sorted(e.table for e in ours)) + " and " + ", ".join(sorted(e.table for e in theirs)))
        left, have = grow(a, _needed(wanted, ours, [c for c, _ in on]))
        right, more = grow(b, _needed(wanted, theirs, [c for _, c in on]))
        both = have + more
        node = plan.new_join_node(build_left, left, right, [have.index(c) for c, _ in on], [more.index(c) for _, c in on], [(both.index(c), query.attribute(c).type) for c in wanted])
        return node, wanted

    wanted = list(dict.fromkeys(c for c, _, _ in query.outputs))
    root, have = grow(tree, wanted)
    outputs = [c for c, _, _ in query.outputs]
    if have != outputs:  # a column is selected twice
        node = plan.nodes[root]
        plan.nodes[root] = type(node)(**{**node.__dict__, "outputs": tuple(node.outputs[have.index(c)] for c in outputs)})
    plan.root = root
    return plan


def _needed(wanted: list[ColumnRef], entities: set[Entity], keys: list[ColumnRef]) -> list[ColumnRef]:
    return list(dict.fromkeys([c for c in wanted if c[0] in entities] + keys))


def run_sql(text: str, tables: dict[str, DataFrame], catalog=None, mode: str = "sql", tree: Tree | None = None, guided: bool = False, null_mode: str = "sql", like_mode: str = "sql") -> DataFrame:
    """The result of a query: mode "sql" applies MIN, mode "rows" returns all joined rows of its columns."""
    from ..catalog import Catalog

    query = bind(text, catalog or Catalog.of_frames(tables))
    rows = build(query, tables, tree, null_mode, like_mode).to_dataframe(guided)
    names = [n for _, _, n in query.outputs]
    if mode == "sql" and any(f for _, f, _ in query.outputs):
        return rows.agg(*[F.min(c).alias(n) for c, n in zip(rows.columns, names, strict=True)])
    return rows.toDF(*names)


__all__ = ["Logic", "Tree", "build", "entities_of", "filtered", "greedy", "run_sql", "selectivity"]
