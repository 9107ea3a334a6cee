"""Positional plans of scans and inner hash joins.

Nodes are addressed by index, columns by position; a join's outputs index the left child's columns followed by the
right child's, in any order and as often as wanted.  ``to_dataframe`` declares the plan; Catalyst chooses how to run it,
unless build sides are asked for.  Every node's columns get names of their own, so self-joins never clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import DataType, InvalidPlan, TypeMismatch

Outputs = tuple[tuple[int, DataType], ...]


@dataclass(frozen=True)
class Scan:
    base_table: int
    outputs: Outputs


@dataclass(frozen=True)
class HashJoin:
    build_left: bool
    left: int
    right: int
    keys: tuple[tuple[int, int], ...]
    outputs: Outputs


@dataclass
class Plan:
    nodes: list[Scan | HashJoin] = field(default_factory=list)
    inputs: list[DataFrame] = field(default_factory=list)
    root: int | None = None

    def new_input(self, table: DataFrame) -> int:
        self.inputs.append(table)
        return len(self.inputs) - 1

    def new_scan_node(self, base_table: int, output_attrs) -> int:
        return self._add(Scan(base_table, tuple(output_attrs)))

    def new_join_node(self, build_left: bool, left: int, right: int, left_attr, right_attr, output_attrs) -> int:
        """``left_attr`` and ``right_attr`` are positions, or equally long lists of them."""
        ours, theirs = ([x] if isinstance(x, int) else list(x) for x in (left_attr, right_attr))
        if len(ours) != len(theirs) or not ours:
            raise InvalidPlan("a join needs as many left keys as right keys, one at least")
        return self._add(HashJoin(build_left, left, right, tuple(zip(ours, theirs, strict=True)), tuple(output_attrs)))

    def _add(self, node: Scan | HashJoin) -> int:
        self.nodes.append(node)
        self.root = len(self.nodes) - 1
        return self.root

    # --- checks ---------------------------------------------------------------------------------------------

    def validate(self) -> None:
        """Raises InvalidPlan or TypeMismatch; nothing runs."""
        if self.root is None:
            raise InvalidPlan("the plan has no root")
        self._types(self.root, set())

    def _types(self, at: int, open_: set[int]) -> list[DataType]:
        if not 0 <= at < len(self.nodes):
            raise InvalidPlan(f"no node {at}")
        if at in open_:
            raise InvalidPlan(f"node {at} is its own ancestor")
        node = self.nodes[at]
        if isinstance(node, Scan):
            if not 0 <= node.base_table < len(self.inputs):
                raise InvalidPlan(f"node {at}: no input {node.base_table}")
            have = self.inputs[node.base_table].schema.fields
            have = [f.dataType for f in have]
            for i, kind in node.outputs:
                if not 0 <= i < len(have):
                    raise InvalidPlan(f"node {at}: no column {i} in input {node.base_table}")
                if DataType.of(have[i]) is not kind:
                    raise TypeMismatch(f"node {at}: column {i} is {have[i].simpleString()}, not {kind.value}")
        else:
            left, right = (self._types(child, open_ | {at}) for child in (node.left, node.right))
            for i, j in node.keys:
                if not (0 <= i < len(left) and 0 <= j < len(right)):
                    raise InvalidPlan(f"node {at}: key ({i}, {j}) out of range")
                if left[i] is not right[j]:
                    raise TypeMismatch(f"node {at}: keys are {left[i].value} and {right[j].value}")
            both = left + right
            for i, kind in node.outputs:
                if not 0 <= i < len(both):
                    raise InvalidPlan(f"node {at}: no column {i} in its children")
                if both[i] is not kind:
                    raise TypeMismatch(f"node {at}: column {i} is {both[i].value}, not {kind.value}")
        return [kind for _, kind in node.outputs]

    # --- execution ------------------------------------------------------------------------------------------

    def to_dataframe(self, guided: bool = False, names: list[str] | None = None) -> DataFrame:
        """The root's rows as columns ``names`` (c0, c1, ... by default).

        ``guided`` hints each join's build side: broadcast where Catalyst's size estimate of it is below
        ``spark.sql.autoBroadcastJoinThreshold``, shuffled hash up to ``HASH_FACTOR`` times that in each partition,
        and no hint beyond (a sort-merge join spills where a hash table would not fit).
        """
        self.validate()
        out = self._frame(self.root, guided)
        return out.toDF(*(names or [f"c{i}" for i in range(len(out.columns))]))

    def _frame(self, at: int, guided: bool) -> DataFrame:
        node = self.nodes[at]
        if isinstance(node, Scan):
            table = self.inputs[node.base_table]
            source = [F.col(f"`{c}`") for c in table.columns] if len(set(table.columns)) == len(table.columns) else None
            if source is None:
                table = table.toDF(*[f"i{k}" for k in range(len(table.columns))])
                source = [F.col(c) for c in table.columns]
            return table.select(*[source[i].alias(f"n{at}_c{k}") for k, (i, _) in enumerate(node.outputs)])
        left, right = self._frame(node.left, guided), self._frame(node.right, guided)
        if node.left == node.right:  # the same node twice
            right = right.toDF(*[f"{c}_r" for c in right.columns])
        both = left.columns + right.columns
        if guided:
            left, right = (_hinted(left), right) if node.build_left else (left, _hinted(right))
        on = [F.col(left.columns[i]) == F.col(right.columns[j]) for i, j in node.keys]
        joined = left.join(right, on, "inner")
        return joined.select(*[F.col(both[i]).alias(f"n{at}_c{k}") for k, (i, _) in enumerate(node.outputs)])


HASH_FACTOR = 10


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _hinted(df: DataFrame) -> DataFrame:
    conf = df.sparkSession.conf
    limit = int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    size = estimated_bytes(df)
    if 0 <= size <= limit:
        return df.hint("broadcast")
    if size <= HASH_FACTOR * limit * int(conf.get("spark.sql.shuffle.partitions")):
        return df.hint("shuffle_hash")
    return df
