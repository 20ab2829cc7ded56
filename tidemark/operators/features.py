"""Targets, feature tables, scalers and splits in time."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.blocks import recurred_series
from tidemark.functions.linear import Formula, Linear, Op, quotient
from tidemark.functions.windows import after, before, full, log, ratio, so_far
from tidemark.operators.base import Node, compute, feature_columns

DRIFTS = ("rolling", "ewma", "expanding")


def future_return(bars: DataFrame, periods: int = 5, column: str = "close", scale: float = 10.0, name: str = "target") -> DataFrame:
    """tanh of the scaled log return over the next bars."""
    x = F.col(column)
    return bars.withColumn(name, F.tanh(log(ratio(after(x, periods), x)) * F.lit(float(scale))))


def directional_target(bars: DataFrame, periods: int = 5, column: str = "close", name: str = "target") -> DataFrame:
    """Sign of the change over the next bars."""
    return bars.withColumn(name, F.signum(after(F.col(column), periods) - F.col(column)))


def next_log_return(bars: DataFrame, column: str = "close", name: str = "target") -> DataFrame:
    return bars.withColumn(name, log(ratio(after(F.col(column)), F.col(column))))


def _adjusted(out: str, source: str, span: int, least: int) -> list[Op]:
    """Exponential mean with weights that add up over what has been seen."""
    keep = 1 - 2 / (span + 1)
    return [
        Formula("__x", (source,), lambda x: np.where(np.isnan(x), 0.0, x), hidden=True),
        Formula("__one", (source,), lambda x: (~np.isnan(x)).astype(float), hidden=True),
        Linear("__top", "__x", keep, hidden=True),
        Linear("__bottom", "__one", keep, hidden=True),
        Linear("__count", "__one", hidden=True),
        Formula(out, ("__top", "__bottom", "__count"), lambda top, bottom, n: np.where(n >= least, quotient(top, bottom), np.nan)),
    ]


def excess_return(bars: DataFrame, periods: int = 5, column: str = "close", vol_window: int = 21, drift_window: int = 252, drift: str = "rolling", drift_span: int | None = None, scale: float = 2.0, name: str = "target") -> DataFrame:
    """tanh of the future log return less trailing drift, in units of trailing volatility.

    drift: mean over drift_window bars, an exponential mean, or the mean so
    far; each from drift_window values on. Null where volatility is 0.
    """
    if drift not in DRIFTS:
        raise ValueError(f"unknown drift {drift!r}; one of {DRIFTS}")
    x = F.col(column)
    columns = bars.columns
    bars = bars.withColumn("__r", log(ratio(x, before(x))))
    r = F.col("__r")
    if drift == "ewma":
        bars = recurred_series(bars, _adjusted("__m", "__r", drift_span or drift_window, drift_window))
    elif drift == "rolling":
        bars = bars.withColumn("__m", full(F.avg, r, drift_window))
    else:
        bars = bars.withColumn("__m", F.when(F.count(r).over(so_far()) >= drift_window, F.avg(r).over(so_far())))
    bars = bars.withColumns({"__v": full(F.stddev_samp, r, vol_window) * math.sqrt(periods), "__f": log(ratio(after(x, periods), x))})
    return bars.select(*columns, F.tanh((F.col("__f") - F.col("__m") * periods) / F.nullif(F.col("__v") * F.lit(float(scale)), F.lit(0.0))).alias(name))


def complete_rows(frame: DataFrame, features: list[str], target: str = "target") -> DataFrame:
    """Rows that lack no feature and have a target."""
    return frame.dropna(subset=[*features, target])


def feature_matrix(bars: DataFrame, nodes: list[Node], target: str = "target") -> DataFrame:
    """symbol, ts, the nodes' columns and the next bar's log return, complete rows only."""
    frame = next_log_return(compute(bars, nodes), name=target)
    names = feature_columns(frame)
    return complete_rows(frame.select("symbol", "ts", *[F.col(f"`{c}`") for c in names], target), names, target)


@dataclass(frozen=True)
class Scaler:
    """(x - offset) / scale by column, fitted on one table and used on any."""

    columns: tuple[str, ...]
    offsets: tuple[float, ...]
    scales: tuple[float, ...]

    @staticmethod
    def fit(frame: DataFrame, columns: list[str], kind: str = "standard") -> Scaler:
        """standard: mean and deviation of the whole; minmax: least value and range. A constant column is scaled by 1."""
        if kind not in ("standard", "minmax"):
            raise ValueError("kind must be standard or minmax")
        low, wide = (F.avg, F.stddev_pop) if kind == "standard" else (F.min, lambda c: F.max(c) - F.min(c))
        row = frame.agg(*[low(F.col(f"`{c}`")).alias(f"a{k}") for k, c in enumerate(columns)], *[wide(F.col(f"`{c}`")).alias(f"b{k}") for k, c in enumerate(columns)]).first()
        return Scaler(tuple(columns), tuple(float(row[f"a{k}"] or 0.0) for k in range(len(columns))), tuple(float(row[f"b{k}"] or 0.0) or 1.0 for k in range(len(columns))))

    def transform(self, frame: DataFrame) -> DataFrame:
        return frame.withColumns({c: (F.col(f"`{c}`") - F.lit(a)) / F.lit(b) for c, a, b in zip(self.columns, self.offsets, self.scales, strict=True)})

    def affine(self) -> tuple[tuple[float, ...], tuple[float, ...]]:
        return self.offsets, self.scales


@dataclass(frozen=True)
class Fold:
    """Bounds of rows, from and up to: numbers, or columns where they differ by series."""

    fold: int
    train_from: int | Column
    train_to: int | Column
    test_from: int | Column
    test_to: int | Column


def walk_forward(n: int, n_splits: int = 5, initial_train_ratio: float = 0.6, expanding: bool = True, embargo: int = 0) -> list[Fold]:
    """Folds of row numbers: each tests the rows after those it trains on; the last takes what is left.

    embargo rows at the end of each training part are left out.
    """
    if n_splits < 1 or not 0 < initial_train_ratio < 1 or embargo < 0:
        raise ValueError("n_splits from 1, initial_train_ratio between 0 and 1, embargo from 0")
    first = int(n * initial_train_ratio)
    size = (n - first) // n_splits
    if size < 1:
        raise ValueError(f"{n} rows are too few for {n_splits} folds")
    out = []
    for k in range(n_splits):
        at = first + k * size
        start = 0 if expanding else max(0, at - first)
        out.append(Fold(k, start, max(start, at - embargo), at, at + size if k < n_splits - 1 else n))
    return out


def walk_forward_columns(n: Column, n_splits: int = 5, initial_train_ratio: float = 0.6, expanding: bool = True, embargo: int = 0) -> list[Fold]:
    """walk_forward with bounds that are columns: n is the number of rows of the row's own series.

    A series that is too short for the folds is an error when the rows are read.
    """
    if n_splits < 1 or not 0 < initial_train_ratio < 1 or embargo < 0:
        raise ValueError("n_splits from 1, initial_train_ratio between 0 and 1, embargo from 0")
    first = (n * F.lit(float(initial_train_ratio))).cast("long")
    size = F.floor((n - first) / F.lit(n_splits))
    size = F.when(size >= 1, size).otherwise(F.raise_error(F.concat(n.cast("string"), F.lit(f" rows are too few for {n_splits} folds"))))
    out = []
    for k in range(n_splits):
        at = first + F.lit(k) * size
        start = F.lit(0) if expanding else F.greatest(F.lit(0), at - first)
        out.append(Fold(k, start, F.greatest(start, at - F.lit(embargo)), at, at + size if k < n_splits - 1 else n))
    return out


def purged_split(n: int, val_fraction: float = 0.2, embargo: int = 0, min_val: int = 1) -> tuple[int, int]:
    """(rows to train on, first row to validate on) of n rows in order of time."""
    if not 0 < val_fraction < 1 or embargo < 0:
        raise ValueError("val_fraction must be between 0 and 1, embargo from 0")
    start = n - max(min_val, int(n * val_fraction))
    end = start - embargo
    if end < 1:
        raise ValueError("too few rows for this split")
    return end, start


def numbered(frame: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """frame with row, counted from 0 in order of time within a series."""
    return frame.withColumn("row", (F.row_number().over(Window.partitionBy(*keys).orderBy("ts")) - 1).cast("long"))


def with_folds(frame: DataFrame, folds: list[Fold], row: str = "row") -> DataFrame:
    """Rows once for each fold that they are in, with fold and part (train or test); rows in none go."""
    one = lambda f: F.when((F.col(row) >= f.train_from) & (F.col(row) < f.train_to), F.struct(F.lit(f.fold).alias("fold"), F.lit("train").alias("part"))).when((F.col(row) >= f.test_from) & (F.col(row) < f.test_to), F.struct(F.lit(f.fold).alias("fold"), F.lit("test").alias("part")))
    return frame.withColumn("_f", F.explode(F.array_compact(F.array(*[one(f) for f in folds])))).select("*", "_f.fold", "_f.part").drop("_f")


# --- losses as columns; averaged by the caller


def squared_error(y: Column, p: Column) -> Column:
    return (p - y) * (p - y)


def directional_loss(y: Column, p: Column, weight: float = 0.1) -> Column:
    return F.greatest(-F.signum(y) * p, F.lit(0.0)) + F.lit(weight) * squared_error(y, p)


def pinball_loss(y: Column, p: Column, q: float) -> Column:
    if not 0 < q < 1:
        raise ValueError("q must be between 0 and 1")
    e = y - p
    return F.greatest(F.lit(q) * e, F.lit(q - 1) * e)
