"""Nodes of a plan over bars: signals and indicators, with their lags, in as few shuffles as possible."""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.blocks import NUMBER, OWN, Blocks, recurred_series
from tidemark.functions.linear import Formula, Linear, Op
from tidemark.functions.windows import before, so_far


@dataclass(frozen=True)
class Node:
    """A producer of columns; subclasses say how, in up to four steps.

    inputs: columns that look back on one row at most; sums: sums so far of
    columns; steps: recursions; raw: the outputs before the lag. Temporary columns
    carry the node's key, so equal nodes (lags aside) are computed once.
    """

    lag: int = 0

    def __post_init__(self):
        if not isinstance(self.lag, int) or self.lag < 0:
            raise ValueError(f"lag must be a whole number from 0 on, not {self.lag!r}")

    def names(self) -> list[str]:
        raise NotImplementedError

    def inputs(self, bars: DataFrame) -> DataFrame:
        return bars

    def sums(self) -> dict[str, str]:
        """Columns to make, each the sum so far of a column; missing values count 0."""
        return {}

    def steps(self) -> list[Op]:
        return []

    def raw(self, bars: DataFrame) -> DataFrame:
        return bars

    def strength(self, *outputs: Column) -> Column:
        raise NotImplementedError(f"{type(self).__name__} has no signal strength")

    def spec(self) -> tuple:
        return (type(self).__name__, *(getattr(self, f.name) for f in fields(self) if f.name != "lag"))

    def temp(self, k: int | str) -> str:
        return f"__{self.names()[0]}__{k}".replace(".", "_")

    def outputs(self) -> list[str]:
        return [f"{n}_lag{self.lag}" if self.lag else n for n in self.names()]

    def lookback(self) -> int:
        """Bars that an output reads, itself included; 0 if all before it."""
        return 0

    def reach(self) -> int:
        """Rows that ``raw`` looks back on, itself included."""
        return max(1, self.lookback())

    def strength_reach(self) -> int:
        """Rows that ``strength`` looks back on, itself included."""
        return 1


def strength_name(node: Node) -> str:
    return f"strength__{node.outputs()[0].removeprefix('indicator__').removeprefix('signal__')}"


def _layers(nodes: list[Node]) -> list[list[Node]]:
    """nodes in layers: a node whose column is an output of another comes in a layer after that one's."""
    made = {name: node for node in nodes for name in node.outputs()}
    depth: dict[str, int] = {}

    def of(node: Node, above: tuple[str, ...]) -> int:
        name = node.outputs()[0]
        if name in above:
            raise ValueError(f"{name} is made of itself")
        if name not in depth:
            source = made.get(str(getattr(node, "column", "")).lower())
            depth[name] = 0 if source is None else 1 + of(source, (*above, name))
        return depth[name]

    layers: dict[int, list[Node]] = {}
    for node in nodes:
        layers.setdefault(of(node, ()), []).append(node)
    return [layers[k] for k in sorted(layers)]


def compute(bars: DataFrame, nodes: list[Node], strengths: bool = False, block_rows: int | None = None) -> DataFrame:
    """bars with the outputs of all nodes and, if asked for, a column of strength for each.

    Nodes that differ in their lag alone share one computation. Two nodes of
    one output name but other parameters are an error. A node may read, as its
    column, an output of another node of the plan, whatever their order. The
    recursions of all nodes (of those that read other nodes' outputs, all of one
    depth) take one shuffle, all windows another; no node adds one of its own.

    A series is one ordered pass unless block_rows is given: then it is cut into
    blocks of so many rows (``functions.blocks``), each a task's, whatever the number of
    series; that stores the bars once and takes a pass for each level of recursion.
    The rows' values are the same; times of a series have to differ.
    """
    known: dict[str, tuple] = {}
    for node in nodes:
        for name in node.names():
            if known.setdefault(name, node.spec()) != node.spec():
                raise ValueError(f"two nodes with other parameters give {name}")
    if block_rows is not None:
        return _in_blocks(bars, nodes, strengths, block_rows)
    for layer in _layers(nodes):
        columns = bars.columns
        bars = _inputs(bars, layer)
        sums = {out: F.sum(F.coalesce(F.col(x), F.lit(0.0))).over(so_far()) for node in _unique(layer) for out, x in node.sums().items()}
        bars = recurred_series(bars.withColumns(sums) if sums else bars, [s for node in _unique(layer) for s in node.steps()])
        bars = _outputs(bars, layer, columns)
    return _strengths(bars, nodes) if strengths else bars


def _in_blocks(bars: DataFrame, nodes: list[Node], strengths: bool, block_rows: int) -> DataFrame:
    blocks = Blocks(bars, block_rows)
    frame = blocks.frame
    for layer in _layers(nodes):
        columns = frame.columns
        if any(type(n).inputs is not Node.inputs for n in layer):
            frame = blocks.windowed(frame, 2, lambda f, layer=layer: _inputs(f, layer))
        ops: list[Op] = []
        for node in _unique(layer):
            for out, x in node.sums().items():
                ops += [Formula(f"{out}_", (x,), lambda v: np.where(np.isnan(v), 0.0, v), hidden=True), Linear(out, f"{out}_")]
            ops += node.steps()
        frame = blocks.recurred(frame, ops)
        reach = max(n.reach() + n.lag for n in layer)
        frame = blocks.windowed(frame, reach, lambda f, layer=layer, columns=columns: _outputs(f, layer, columns))
    if strengths:
        frame = blocks.windowed(frame, max(n.strength_reach() for n in nodes), lambda f: _strengths(f, nodes))
    return frame.select(*[F.col(f"`{c}`") for c in [*bars.columns, *(c for c in frame.columns if c not in bars.columns and c != NUMBER)]])


def _unique(nodes: list[Node]) -> list[Node]:
    found: dict[tuple, Node] = {}
    for node in nodes:
        found.setdefault(node.spec(), node)
    return list(found.values())


def _inputs(bars: DataFrame, nodes: list[Node]) -> DataFrame:
    for node in _unique(nodes):
        bars = node.inputs(bars)
    return bars


def _outputs(bars: DataFrame, nodes: list[Node], columns: list[str]) -> DataFrame:
    """columns and the nodes' outputs; what blocks need besides stays."""
    columns = [*columns, *(c for c in (OWN,) if c in bars.columns and c not in columns)]
    for node in _unique(nodes):
        bars = node.raw(bars)
    outputs = {out: before(F.col(node.temp(k)), node.lag) for node in nodes for k, out in enumerate(node.outputs())}
    return bars.select(*[F.col(f"`{c}`") for c in columns], *[c.alias(name) for name, c in outputs.items()])


def _strengths(bars: DataFrame, nodes: list[Node]) -> DataFrame:
    return bars.withColumns({strength_name(n): n.strength(*(F.col(f"`{c}`") for c in n.outputs())) for n in nodes})


def feature_columns(frame: DataFrame) -> list[str]:
    """Columns that a node has made, told by their names."""
    return [c for c in frame.columns if c.startswith(("signal__", "indicator__"))]
