"""Column helpers over a series of bars, ordered by time within its symbol."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

SERIES = ("symbol",)


def series() -> WindowSpec:
    return Window.partitionBy(*SERIES).orderBy("ts")


def last(n: int) -> WindowSpec:
    """This bar and the n - 1 before it."""
    return series().rowsBetween(-(n - 1), 0)


def so_far() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, 0)


def full(agg, x: Column, n: int) -> Column:
    """agg over the last n bars, null unless all n have a value."""
    return F.when(F.count(x).over(last(n)) == n, agg(x).over(last(n)))


def before(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(series()) if n else x


def after(x: Column, n: int = 1) -> Column:
    return F.lead(x, n).over(series())


def nz(x: Column) -> Column:
    """x, or null where it is zero; for denominators."""
    return F.nullif(x, F.lit(0.0))


def ratio(x: Column, y: Column) -> Column:
    return x / nz(y)


def running(x: Column) -> Column:
    """Sum so far; null in place where x is null."""
    return F.when(x.isNotNull(), F.sum(x).over(so_far()))


def positive(x: Column) -> Column:
    """max(x, 0), null where x is null."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def log(x: Column) -> Column:
    """Natural logarithm, null at and below zero."""
    return F.when(x > 0, F.ln(x))
