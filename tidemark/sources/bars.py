"""Bars: the table (symbol, ts, open, high, low, close, volume) that all operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ["open", "high", "low", "close"]
COLUMNS = ["symbol", "ts", *PRICES, "volume"]
#: Orders rows of one instant; any further columns a table needs for a total order go after ts.
FREQUENCIES = ("minute", "hour", "day", "week", "month")


def validate(bars: DataFrame) -> DataFrame:
    """bars with prices and volume as DOUBLE and NaN as NULL; a missing or ill-typed column is an error."""
    by = {f.name.lower(): f for f in bars.schema.fields}
    if missing := [c for c in COLUMNS if c not in by]:
        raise ValueError(f"bars lack the columns {missing}")
    for c in [*PRICES, "volume"]:
        if not isinstance(by[c].dataType, T.NumericType):
            raise ValueError(f"column {c} is {by[c].dataType.simpleString()}, not a number")
    if not isinstance(by["ts"].dataType, T.TimestampType | T.TimestampNTZType | T.DateType):
        raise ValueError("column ts is no time")

    def clean(c: str) -> Column:
        x = F.col(by[c].name).cast("double")
        return F.when(~F.isnan(x), x)

    return bars.withColumns({c: clean(c) for c in [*PRICES, "volume"]})


def read_bars(spark: SparkSession, path: str, symbol: str | None = None, start=None, end=None, fmt: str = "parquet") -> DataFrame:
    """Bars from files, of [start, end) and one symbol if given; both conditions reach the scan."""
    bars = spark.read.format(fmt).load(path)
    return validate(between(bars if symbol is None else bars.filter(F.col("symbol") == symbol), start, end, closed=False))


def between(bars: DataFrame, start=None, end=None, closed: bool = True) -> DataFrame:
    """Bars from start to end; with closed, the end itself too (a label slice)."""
    if start is not None:
        bars = bars.filter(F.col("ts") >= F.lit(start))
    if end is not None:
        bars = bars.filter(F.col("ts") <= F.lit(end) if closed else F.col("ts") < F.lit(end))
    return bars


def to_bars(rows: DataFrame, symbol: str, ts: str, price: Column | str, volume: Column | None = None, every: str = "hour", ties: tuple[str, ...] = ()) -> DataFrame:
    """Bars of raw trades or events: first, greatest, least and last price by symbol and truncated time.

    ``ties`` name the columns that order rows of one instant. volume is summed
    (rows are counted unless it is given). Rows without a price make no bar.
    Partial aggregation keeps a row a bar and task in the shuffle.
    """
    if every not in FREQUENCIES:
        raise ValueError(f"unknown frequency {every}; one of {FREQUENCIES}")
    price = F.col(price) if isinstance(price, str) else price
    rows = rows.select(F.col(symbol).alias("symbol"), F.col(ts).alias("_at"), F.date_trunc(every, F.col(ts)).cast(rows.schema[ts].dataType).alias("ts"), price.cast("double").alias("_price"), (F.lit(1.0) if volume is None else volume.cast("double")).alias("_volume"), *[F.col(c).alias(f"_tie{k}") for k, c in enumerate(ties)])
    rows = rows.filter(F.col("_price").isNotNull() & ~F.isnan("_price"))
    order = F.struct("_at", *[f"_tie{k}" for k in range(len(ties))])
    return rows.groupBy("symbol", "ts").agg(
        F.min_by("_price", order).alias("open"),
        F.max("_price").alias("high"),
        F.min("_price").alias("low"),
        F.max_by("_price", order).alias("close"),
        F.sum("_volume").alias("volume"),
    )
