"""Long series in blocks of rows, so that one series is many tasks.

``Blocks`` numbers the rows of each series without putting a series into one
task: rows are dealt out by ranges of (symbol, ts) and stored, the ranges' few row
counts are summed up, and a row's number is its range's base plus its place. A
block is so many rows by number. Then

* a window runs over (symbol, block), where each block has a copy of the last
  rows of the one before it (``windowed``), as many as the window looks back on;
* a linear recursion is the fold of its blocks' affine maps (``recurred``): one
  pass gives the maps, a small table of them is folded by series, and another
  pass starts each block from its state. Recursions of recursions take one such
  pass for each level.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.functions.linear import Formula, Op, evaluate, inputs_of, levels
from tidemark.functions.storage import few, stored

#: Rows of a block: some 10 MB of bars.
BLOCK_ROWS = 100_000
NUMBER, OWN, _STATE, _ITEM, _PART = "__rn", "__own", "__state", "__item", "__part"


def numbered(rows: DataFrame) -> DataFrame:
    """rows, stored, with their number in their series by ts, from 0; no task has more than a range of rows."""
    placed = rows.repartitionByRange("symbol", "ts").sortWithinPartitions("symbol", "ts").withColumn(NUMBER, F.monotonically_increasing_id())
    placed = stored(placed, "ranges")
    part = F.shiftright(NUMBER, 33)
    sizes = placed.groupBy("symbol", part.alias(_PART)).agg(F.min(NUMBER).alias("__first"), F.count("*").alias("__n"))
    # one row for each range that a series has a part in
    before = F.sum("__n").over(Window.partitionBy("symbol").orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1))
    bases = few(stored(sizes.select(F.col("symbol").alias("__symbol"), _PART, (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__base")), "bases"))
    joined = placed.join(bases, placed["symbol"].eqNullSafe(bases["__symbol"]) & (part == bases[_PART]))
    return joined.select(*[placed[c] for c in rows.columns], (F.col(NUMBER) + F.col("__base")).alias(NUMBER))


def _floats(batch: pa.RecordBatch, names: list[str]) -> dict[str, np.ndarray]:
    return {c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names}


def _columns(values: dict[str, np.ndarray], names: list[str]) -> list[pa.Array]:
    return [pa.array(values[c], pa.float64(), from_pandas=True) for c in names]


def recurred_series(rows: DataFrame, ops: list[Op], keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """rows with the columns of all ops that are not hidden; each series is one ordered pass, a batch at a time."""
    if not ops:
        return rows
    reads, added = inputs_of(ops), [o.out for o in ops if not o.hidden]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.DoubleType()) for c in added]])
    names = rows.columns

    def run(batches):
        key, states = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            edges = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
            whole, parts = _floats(batch, reads), []
            for at, end in zip(edges[:-1], edges[1:], strict=True):
                if marks[at] != key:
                    key, states = marks[at], {}
                parts.append(evaluate(ops, {c: x[at:end] for c, x in whole.items()}, states))
            values = {c: np.concatenate([p[c] for p in parts]) for c in added}
            yield pa.RecordBatch.from_arrays([*batch.columns, *_columns(values, added)], [*names, *added])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


class Blocks:
    """The rows of a table by series and block; ``frame`` has their numbers."""

    def __init__(self, rows: DataFrame, block_rows: int = BLOCK_ROWS):
        if block_rows < 1:
            raise ValueError("a block has one row at least")
        self.frame, self.size, self.kind = numbered(rows), block_rows, rows.schema["symbol"].dataType

    @property
    def block(self) -> Column:
        return F.floor(F.col(NUMBER) / self.size).cast("long")

    def windowed(self, frame: DataFrame, reach: int, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """make(frame), where windows look back on at most ``reach`` rows, this one included.

        make gets blocks as series of their own (``keyed``).
        """
        made = make(self.keyed(frame, reach)).filter(OWN)
        return made.select(F.col("symbol.name").alias("symbol"), *[F.col(f"`{c}`") for c in made.columns if c not in ("symbol", OWN)])

    def keyed(self, frame: DataFrame, reach: int) -> DataFrame:
        """frame with symbol and block for its symbol, and at the start of each block copies of the last reach - 1 rows before it, which it does not own."""
        if reach > self.size + 1:
            raise ValueError(f"windows of {reach} rows need blocks of {reach - 1} rows at least, not {self.size}")
        own = F.struct(self.block.alias("to"), F.lit(True).alias("own"))
        late = F.col(NUMBER) % self.size > self.size - reach
        copies = F.when(late, F.array(own, F.struct((self.block + 1).alias("to"), F.lit(False).alias("own")))).otherwise(F.array(own))
        others = [c for c in frame.columns if c != "symbol"]
        spread = frame.withColumn(_ITEM, F.explode(copies))
        return spread.select(F.struct(F.col("symbol").alias("name"), F.col(f"{_ITEM}.to").alias("block")).alias("symbol"), *[F.col(f"`{c}`") for c in others], F.col(f"{_ITEM}.own").alias(OWN))

    def _pass(self, frame: DataFrame, states: DataFrame | None, keep: list[str], run: Callable, schema: T.StructType) -> DataFrame:
        """run over the whole blocks in order; the first row of a block has its states."""
        if states is not None:
            on = frame["symbol"].eqNullSafe(states["__symbol"]) & (frame[NUMBER] == states["__start"])
            frame = frame.join(states, on, "left").select(*[frame[c] for c in keep], F.col(_STATE))
        else:
            frame = frame.select(*keep, F.lit(None).cast("array<double>").alias(_STATE))
        return frame.repartition("symbol", self.block).sortWithinPartitions("symbol", NUMBER).mapInArrow(run, schema)

    def recurred(self, frame: DataFrame, ops: list[Op]) -> DataFrame:
        """frame with the columns of all ops that are not hidden."""
        if not ops:
            return frame
        frame = stored(frame, "inputs")  # read once for each level and once more
        level, size, reads = levels(ops), self.size, inputs_of(ops)
        linear = sorted((o for o in ops if not isinstance(o, Formula)), key=lambda o: level[o.out])  # as their states stand in the table
        states = None
        for depth in range(1, max(level.values()) + 1):
            states = self._folded(frame, states, [o for o in ops if level[o.out] < depth], [o for o in linear if level[o.out] == depth], linear)
        added = [o.out for o in ops if not o.hidden]
        names = frame.columns
        schema = T.StructType([*frame.schema.fields, *[T.StructField(c, T.DoubleType()) for c in added]])

        def run(batches):
            live: dict = {}
            for batch in batches:
                parts = [evaluate(ops, columns, live) for columns in _ranges(batch, reads, size, linear, live) if columns]
                if parts:
                    values = {c: np.concatenate([p[c] for p in parts]) for c in added}
                    yield pa.RecordBatch.from_arrays([*batch.select(names).columns, *_columns(values, added)], [*names, *added])

        return self._pass(frame, states, names, run, schema)

    def _folded(self, frame: DataFrame, states: DataFrame | None, below: list[Op], ops: list[Op], linear: list[Op]) -> DataFrame:
        """The states of all ops so far at each block's start: what ``states`` has, and those of ``ops`` from their blocks' maps."""
        size = self.size
        reads = inputs_of([*below, *ops])
        keep = ["symbol", NUMBER, *reads]
        symbol = T.StructField("symbol", self.kind)
        schema = T.StructType([symbol, T.StructField("block", T.LongType()), T.StructField("part", T.LongType()), T.StructField("maps", T.ArrayType(T.DoubleType()))])
        known = [o for o in linear if o in below]

        def maps(batches):
            """A map for each part of a block that comes in one batch."""
            live: dict = {}
            for batch in batches:
                at, rows = 0, []
                numbers = batch.column(NUMBER).to_numpy()
                for columns in _ranges(batch, reads, size, known, live):
                    if not columns:
                        continue
                    n = len(columns[NUMBER])
                    with np.errstate(all="ignore"):
                        found = evaluate(below, columns, live)
                        rows.append((batch.column("symbol")[at], int(numbers[at]) // size, int(numbers[at]), [v for o in ops for v in o.summary(found)]))
                    at += n
                if rows:
                    kinds = (batch.schema.field("symbol").type, pa.int64(), pa.int64(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema.names)

        widths = [len(o.summary({c: np.zeros(0) for c in o.reads()})) for o in ops]
        out = T.StructType([T.StructField("__symbol", self.kind), T.StructField("__start", T.LongType()), T.StructField("__new", T.ArrayType(T.DoubleType()))])

        def fold(batches):
            """The states at each block's start, of the few maps of a series in order."""
            none = object()
            key, block, live = none, None, []
            for batch in batches:
                rows = []
                symbols, blocks, lists = batch.column("symbol").to_pylist(), batch.column("block").to_pylist(), batch.column("maps").to_pylist()
                for k in range(batch.num_rows):
                    if key is none or symbols[k] != key:
                        key, block, live = symbols[k], None, [o.EMPTY for o in ops]
                    if blocks[k] != block:
                        block = blocks[k]
                        rows.append((batch.column("symbol")[k], block * size, [v for s in live for v in s]))
                    at = 0
                    for i, (o, w) in enumerate(zip(ops, widths, strict=True)):
                        live[i] = o.after(live[i], lists[k][at : at + w])
                        at += w
                kinds = (batch.schema.field("symbol").type, pa.int64(), pa.list_(pa.float64()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], out.names)

        found = stored(self._pass(frame, states, keep, maps, schema), "maps")
        new = found.repartition("symbol").sortWithinPartitions("symbol", "part").mapInArrow(fold, out)
        if states is None:
            both = new.select("__symbol", "__start", F.col("__new").alias(_STATE))
        else:
            new = new.withColumnsRenamed({"__symbol": "__s", "__start": "__b"})
            both = states.join(new, states["__symbol"].eqNullSafe(new["__s"]) & (states["__start"] == new["__b"])).select("__symbol", "__start", F.concat(_STATE, "__new").alias(_STATE))
        return few(stored(both, "states"))


def _ranges(batch: pa.RecordBatch, reads: list[str], size: int, linear: list[Op], live: dict):
    """The columns of each part of a batch that lies in one block; at a block's first row its states replace ``live``."""
    numbers = batch.column(NUMBER).to_numpy()
    starts = np.flatnonzero(numbers % size == 0).tolist()
    whole = _floats(batch, reads)
    edges = sorted({0, *starts, len(numbers)})
    begins = set(starts)
    for at, end in zip(edges[:-1], edges[1:], strict=True):
        if at in begins:
            live.clear()
            packed = batch.column(_STATE)[at].as_py()
            place = 0
            for o in linear if packed else ():
                n = len(o.EMPTY)
                live[o.out] = tuple(np.nan if v is None else v for v in packed[place : place + n])
                place += n
        yield {c: x[at:end] for c, x in whole.items()} | {NUMBER: numbers[at:end]}
