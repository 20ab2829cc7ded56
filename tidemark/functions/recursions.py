"""Values that depend on their predecessor by steps that are not linear, run once over each sorted series; for linear ones see ``linear``.

Series are dealt out by symbol and sorted; a task goes through its rows in
order, one Arrow batch after the other, and keeps nothing but the recursions'
states. So a series may be longer than memory.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Step = Callable[..., tuple]


class Ewm:
    """Exponential mean with weight a, not adjusted; a missing value leaves it standing but lets its weight fade."""

    __slots__ = ("a", "keep", "least", "n", "old", "y")

    def __init__(self, a: float, least: int = 0):
        self.a, self.keep, self.least = a, 1.0 - a, least
        self.y, self.old, self.n = None, 1.0, 0

    def __call__(self, x):
        if self.y is None:
            if x is None:
                return None
            self.y, self.n = x, 1
        else:
            self.old *= self.keep
            if x is not None:
                if x != self.y:
                    self.y = (self.old * self.y + self.a * x) / (self.old + self.a)
                self.old = 1.0
                self.n += 1
        return self.y if self.n >= self.least else None


def span(n: int, least: int = 0) -> Ewm:
    return Ewm(2.0 / (n + 1), least)


def wilder(n: int, least: int = 0) -> Ewm:
    return Ewm(1.0 / n, least)


def scan(rows: DataFrame, steps: list[tuple[list[str], list[str], Callable[[], Step]]], keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts",), types: dict[str, T.DataType] | None = None) -> DataFrame:
    """rows with further columns, DOUBLE unless ``types`` says otherwise, from recursions over each series.

    steps: input columns, output columns, and a function that makes a fresh
    step for a series; a step takes a row's inputs and returns its outputs.
    One shuffle serves all steps.
    """
    if not steps:
        return rows
    from pyspark.sql.pandas.types import to_arrow_type

    types = types or {}
    added = [c for _, outs, _ in steps for c in outs]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, types.get(c, T.DoubleType())) for c in added]])
    names = rows.columns
    kinds = [to_arrow_type(types.get(c, T.DoubleType())) for c in added]

    def run(batches):
        key, live = None, []
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in {*keys, *(c for ins, _, _ in steps for c in ins)}}
            marks = list(zip(*(columns[k] for k in keys), strict=True))
            out: list[list] = [[None] * batch.num_rows for _ in added]
            at = 0
            while at < len(marks):
                end = at
                while end < len(marks) and marks[end] == marks[at]:
                    end += 1
                if marks[at] != key:
                    key, live = marks[at], [make() for _, _, make in steps]
                first = 0
                for (ins, outs, _), step in zip(steps, live, strict=True):
                    lists = [columns[c][at:end] for c in ins]
                    for i, values in enumerate(zip(*lists, strict=True), at):
                        for k, y in enumerate(step(*values), first):
                            out[k][i] = y
                    first += len(outs)
                at = end
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], [*names, *added])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
