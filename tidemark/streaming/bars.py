"""Bars and exponential means over streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.recursions import span

FREQUENCIES = {"minute": "1 minute", "hour": "1 hour", "day": "1 day"}


def stream_bars(rows: DataFrame, symbol: str, ts: str, price: str, every: str = "hour", late: str = "10 minutes", ties: tuple[str, ...] = ()) -> DataFrame:
    """Bars of a stream of trades, each given once its time is over and late rows can no longer come.

    Rows later than ``late`` behind the newest are left out, as the watermark says.
    """
    rows = rows.select(F.col(symbol).alias("symbol"), F.col(ts).cast("timestamp").alias("at"), F.col(price).cast("double").alias("price"), *ties).filter("price is not null")
    order = F.struct("at", *ties)
    found = rows.withWatermark("at", late).groupBy("symbol", F.window("at", FREQUENCIES[every])).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").cast("double").alias("volume"))
    return found.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_ema(bars: DataFrame, period: int = 20, column: str = "close") -> DataFrame:
    """symbol, ts, value and ema of a stream of bars that come in order; the mean of each symbol is kept as state."""

    def follow(key, frames, state: GroupState):
        mean = span(period)
        if state.exists:
            mean.y, mean.old, mean.n = state.get
        for frame in frames:
            frame = frame.sort_values("ts")
            out = [mean(None if pd.isna(x) else float(x)) for x in frame["value"]]
            yield pd.DataFrame({"symbol": frame["symbol"], "ts": frame["ts"], "value": frame["value"], "ema": out})
        state.update((mean.y, mean.old, mean.n))

    rows = bars.select("symbol", "ts", F.col(column).alias("value"))
    return rows.groupBy("symbol").applyInPandasWithState(follow, "symbol string, ts timestamp, value double, ema double", "y double, old double, n long", "append", GroupStateTimeout.NoTimeout)
