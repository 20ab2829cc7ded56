"""Parameters as data: any number of trials over one scan of the bars.

A trial is rows of a table (trial, family, period, weight): the strengths of some
indicators of a price, each with a period and a weight of its own. A task goes
through its bars in order with sums so far, from which the window of any
period is two look-ups, so a period is a number and not a plan. Strengths stand
in a matrix of bars by (family, period); all trials' signals are its product with a
matrix of weights. What a task passes on of a batch is a few sums for each trial.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.blocks import OWN, Blocks
from tidemark.operators.montecarlo import draw, uniform

#: Rows of a trials table, and weights by trial and by pair of family and period, that a call takes; the weights are sent to every task.
MAX_PARTS, MAX_WEIGHTS = 1_000_000, 4_000_000
#: Bars by trials that a task holds at once.
CELLS = 4_000_000

Strength = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _or_zero(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), 0.0, x)


def _over(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.divide(x, y, out=np.full(len(x), np.nan), where=(y != 0) & ~np.isnan(y))


#: Strengths by family, of price, its mean and deviation over the period (missing before it is full), and the price a period ago.
FAMILIES: dict[str, Strength] = {
    "sma": lambda x, mean, sd, was: np.tanh(_or_zero(_over(x - mean, sd))),
    "bollinger": lambda x, mean, sd, was: np.tanh((0.5 - np.where(np.isnan(r := _over(x - (mean - 2 * sd), 4 * sd)), 0.5, r)) * 4),
    "momentum": lambda x, mean, sd, was: np.sign(x - was),
}


# --- parameters


def sampled(spark, space: dict, n: int, seed: int = 0, first: int = 0) -> DataFrame:
    """trial (from first on) and a column for each parameter, drawn by trial and place in space: columns, not a driver's loop."""
    trial = F.col("trial")
    table = spark.range(first, first + n).select(F.col("id").alias("trial"))
    return table.select("trial", *[p.column(seed, trial, k).alias(name) for k, (name, p) in enumerate(space.items(), 1)])


def whole(seed: int, trial: Column, stream: int, n: int) -> Column:
    """A whole number from 0 to n - 1."""
    return F.pmod(draw(seed, trial, F.lit(0), stream), F.lit(n))


def share(seed: int, trial: Column, stream: int) -> Column:
    return uniform(seed, trial, F.lit(0), stream)


def parts(trials: DataFrame, *rows: tuple[Column, Column, Column]) -> DataFrame:
    """(trial, family, period, weight) of a table of parameters, from columns for each part."""
    made = [F.struct(f.cast("string").alias("family"), p.cast("int").alias("period"), w.cast("double").alias("weight")) for f, p, w in rows]
    return trials.select("trial", F.explode(F.array(*made)).alias("part")).select("trial", "part.*")


@dataclass(frozen=True)
class _Table:
    """The trials as arrays: their numbers, the pairs of family and period, weights by pair and trial."""

    trials: np.ndarray
    pairs: list[tuple[str, int]]
    weights: np.ndarray

    @property
    def longest(self) -> int:
        return max((n for _, n in self.pairs), default=1)


def _table(parts: DataFrame) -> _Table:
    rows = parts.groupBy("trial", "family", "period").agg(F.sum("weight").alias("weight")).limit(MAX_PARTS + 1).toPandas()  # parameters
    trials, pairs = np.unique(rows["trial"].to_numpy(np.int64)), sorted(set(zip(rows["family"], rows["period"].astype(int), strict=True)))
    if len(rows) > MAX_PARTS or len(trials) * len(pairs) > MAX_WEIGHTS:
        raise ValueError(f"at most {MAX_PARTS} rows and {MAX_WEIGHTS} weights at once; these are {len(trials)} trials of {len(pairs)} families and periods")
    for family, n in pairs:
        if family not in FAMILIES or n < 2:
            raise ValueError(f"unknown family {family!r} or period {n}; periods are 2 at least, families {sorted(FAMILIES)}")
    place = {p: k for k, p in enumerate(pairs)}
    weights = np.zeros((len(pairs), len(trials)))
    weights[[place[p] for p in zip(rows["family"], rows["period"].astype(int), strict=True)], np.searchsorted(trials, rows["trial"].to_numpy(np.int64))] = rows["weight"]
    return _Table(trials, pairs, weights)


def _strengths(x: np.ndarray, first: int, pairs: list[tuple[str, int]]) -> np.ndarray:
    """Strengths of the rows from ``first`` on by pair, of the prices up to there and before."""
    centre = np.nanmean(x) if len(x) and not np.isnan(x).all() else 0.0  # sums of small numbers lose less
    y = _or_zero(x - centre)
    sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (~np.isnan(x), y, y * y)]
    end = np.arange(first, len(x)) + 1
    out = np.empty((len(end), len(pairs)))
    made: dict[int, tuple] = {}
    for k, (family, n) in enumerate(pairs):
        if n not in made:
            begin = np.maximum(end - n, 0)
            count, s1, s2 = (s[end] - s[begin] for s in sums)
            full = count == n
            var = (s2 - s1 * s1 / n) / (n - 1)
            var = np.where(var <= 1e-12 * np.maximum(s2, 1e-300), 0.0, var)  # of equal prices, but for the sums' last digits
            was = np.where(end - 1 - n >= 0, x[np.maximum(end - 1 - n, 0)], np.nan)
            made[n] = np.where(full, centre + s1 / n, np.nan), np.where(full, np.sqrt(np.maximum(var, 0.0)), np.nan), was
        out[:, k] = FAMILIES[family](x[first:], *made[n])
    return out


def _signals(strengths: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """By row and trial; missing where a strength that the trial uses is."""
    gone = np.isnan(strengths)
    out = np.tanh(_or_zero(strengths) @ weights)
    if gone.any():
        out[(gone.astype(float) @ (weights != 0)) > 0] = np.nan
    return out


def _in_order(table: _Table, keys: list[str], each: Callable):
    """A function for mapInArrow: each(batch, at, end, prices, first) for every range of rows of a series.

    prices are those of the rows, after as many before them as windows look back on; first is the place of the range's first row.
    """
    back = table.longest + 1

    def run(batches):
        key, tail = object(), np.zeros(0)
        for whole in batches:
            step = max(1, CELLS // max(1, len(table.trials)))
            for batch in (whole.slice(k, step) for k in range(0, whole.num_rows, step)):
                marks = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
                prices = batch.column("x").cast(pa.float64()).to_numpy(zero_copy_only=False)
                edges = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
                for at, end in zip(edges[:-1], edges[1:], strict=True):
                    if marks[at] != key:
                        key, tail = marks[at], np.zeros(0)
                    x = np.concatenate([tail, prices[at:end]])
                    yield from each(batch, at, end, x, len(tail))
                    tail = x[-back:]

    return run


def _series(bars: DataFrame, column: str, table: _Table, block_rows: int | None, extra: list[Column]) -> tuple[DataFrame, list[str]]:
    """symbol, x, ts, own and further columns, in order by series or block; the names that tell a range's series."""
    rows = bars.select("symbol", "ts", F.col(column).cast("double").alias("x"), *extra)
    if block_rows is None:
        keyed = rows.withColumn(OWN, F.lit(True)).withColumn("block", F.lit(0).cast("long"))
    else:
        blocks = Blocks(rows, block_rows)
        keyed = blocks.keyed(blocks.frame, table.longest + 2).withColumns({"block": F.col("symbol.block"), "symbol": F.col("symbol.name")})
    return keyed.repartition("symbol", "block").sortWithinPartitions("symbol", "block", "ts"), ["symbol", "block"]


def signals(bars: DataFrame, parts: DataFrame, column: str = "close", block_rows: int | None = None) -> DataFrame:
    """(trial, symbol, ts, signal): tanh of each trial's weighted strengths at each bar, null where one is missing."""
    table = _table(parts)
    rows, keys = _series(bars, column, table, block_rows, [])
    kinds = bars.schema
    schema = T.StructType([T.StructField("trial", T.LongType()), kinds["symbol"], kinds["ts"], T.StructField("signal", T.DoubleType())])

    def each(batch, at, end, x, first):
        own = batch.column(OWN).to_numpy(zero_copy_only=False)[at:end].astype(bool)
        places = pa.array(np.repeat(np.flatnonzero(own) + at, len(table.trials)))
        if len(places):
            made = _signals(_strengths(x, first, table.pairs)[own], table.weights)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(table.trials, int(own.sum()))), batch.column("symbol").take(places), batch.column("ts").take(places), pa.array(made.reshape(-1), from_pandas=True)], schema.names)

    return rows.mapInArrow(_in_order(table, keys, each), schema)


_SUMS = ["n", "s", "r", "ss", "rr", "sr"]


def scores(bars: DataFrame, parts: DataFrame, split=None, column: str = "close", block_rows: int | None = None) -> DataFrame:
    """trial, n, score, valid_n, valid_score: how well each trial's signals foretell the next log return.

    A score is the correlation of a bar's signal with the next bar's return,
    the mean of it over series; returns of bars from ``split`` (a time) on count
    to valid_score, those before it to score. Bars without a signal, or without a
    next return, count nothing; a series in which either never varies has no score.
    A trial without any has nulls. Times of a series have to differ.
    """
    table = _table(parts)
    late = F.lit(False) if split is None else F.coalesce(F.col("ts") >= F.lit(split), F.lit(False))
    rows, keys = _series(bars, column, table, block_rows, [late.alias("late")])
    schema = T.StructType([T.StructField("trial", T.LongType()), bars.schema["symbol"], T.StructField("late", T.BooleanType()), *[T.StructField(c, T.DoubleType()) for c in _SUMS]])

    def each(batch, at, end, x, first):
        # the signal of a bar meets the return of the one after it, which is the row that owns the pair
        own = batch.column(OWN).to_numpy(zero_copy_only=False)[at:end].astype(bool)
        start = max(first, 1)
        if start >= len(x):
            return
        good = (x[start:] > 0) & (x[start - 1 : -1] > 0)
        r = np.where(good, np.log(np.where(good, x[start:], 1.0) / np.where(good, x[start - 1 : -1], 1.0)), np.nan)
        late = batch.column("late").to_numpy(zero_copy_only=False)[at:end].astype(bool)
        own, late = own[start - first :], late[start - first :]
        made = _signals(_strengths(x[:-1], start - 1, table.pairs), table.weights)
        for part in (False, True):
            rows = np.flatnonzero(own & (late == part) & good)
            if not len(rows):
                continue
            s, y = made[rows], r[rows, None]
            there = ~np.isnan(s)
            s, y = _or_zero(s), np.where(there, y, 0.0)
            found = [there.sum(axis=0).astype(float), s.sum(axis=0), y.sum(axis=0), (s * s).sum(axis=0), (y * y).sum(axis=0), (s * y).sum(axis=0)]
            n = len(table.trials)
            yield pa.RecordBatch.from_arrays([pa.array(table.trials), batch.column("symbol").take(pa.array(np.full(n, at))), pa.array(np.full(n, part)), *map(pa.array, found)], schema.names)

    sums = rows.mapInArrow(_in_order(table, keys, each), schema).groupBy("trial", "symbol", "late").agg(*[F.sum(c).alias(c) for c in _SUMS])
    n, s, r, ss, rr, sr = (F.col(c) for c in _SUMS)
    a, b = n * ss - s * s, n * rr - r * r
    tiny = lambda v, of: v > F.lit(1e-12) * of
    value = F.when(tiny(a, n * ss) & tiny(b, n * rr), (n * sr - s * r) / (F.sqrt(a) * F.sqrt(b)))
    by = sums.withColumn("value", value).groupBy("trial").agg(
        F.coalesce(F.sum(F.when(~F.col("late"), F.col("n"))), F.lit(0.0)).cast("long").alias("n"),
        F.avg(F.when(~F.col("late"), F.col("value"))).alias("score"),
        F.coalesce(F.sum(F.when(F.col("late"), F.col("n"))), F.lit(0.0)).cast("long").alias("valid_n"),
        F.avg(F.when(F.col("late"), F.col("value"))).alias("valid_score"),
    )
    every = parts.select("trial").distinct()
    return every.join(by, "trial", "left").fillna(0, ["n", "valid_n"])
