"""A page on one backtest: equity, drawdown, closes with trades, and tables of scores."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import equity_steps, metrics

#: Points of a curve on the page; longer series are thinned to the last bar of even stretches.
POINTS = 2000


def thinned(rows: DataFrame, points: int = POINTS) -> DataFrame:
    """At most so many rows of one series in order of time: the last of each of as many even stretches of time."""
    from pyspark.sql.window import Window

    ends = rows.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("a"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("b")).first()
    step = max(1, (ends["b"] - ends["a"]) // points + 1) if ends["a"] is not None else 1
    slot = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(ends["a"])) / F.lit(step))
    return rows.withColumn("_slot", slot).withColumn("_rank", F.row_number().over(Window.partitionBy("_slot").orderBy(F.desc("ts")))).filter("_rank = 1").drop("_slot", "_rank").orderBy("ts")


def _line(values: list[float], title: str, width: int = 900, height: int = 220) -> str:
    if not values:
        return ""
    low, high = min(values), max(values)
    wide = (high - low) or 1.0
    points = " ".join(f"{k * width / max(1, len(values) - 1):.1f},{height - (v - low) / wide * height:.1f}" for k, v in enumerate(values))
    return f'<h2>{html.escape(title)}</h2><svg viewBox="0 0 {width} {height}" width="{width}"><polyline fill="none" stroke="#246" points="{points}"/></svg><p>{low:,.4f} to {high:,.4f}</p>'


def report(result: DataFrame, bars: DataFrame, symbol: str, title: str = "Backtest") -> str:
    """The page as HTML text, of one series of the output of simulate(); only the points drawn leave Spark."""
    own = equity_steps(result.filter(F.col("symbol") == symbol))
    curve = thinned(own.select("ts", "equity", (F.col("drawdown") * 100).alias("drawdown"))).collect()
    closes = thinned(bars.filter(F.col("symbol") == symbol).select("ts", "close")).collect()
    scores = metrics(result.filter(F.col("symbol") == symbol)).first().asDict()
    table = "".join(f"<tr><td>{html.escape(k)}</td><td>{html.escape(f'{v:,.4f}' if isinstance(v, float) else str(v))}</td></tr>" for k, v in scores.items())
    curves = _line([r["equity"] for r in curve], "Equity") + _line([r["drawdown"] or 0.0 for r in curve], "Drawdown, per cent") + _line([r["close"] for r in closes if r["close"] is not None], "Close")
    return f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}: {html.escape(symbol)}</h1>{curves}<table>{table}</table>"


def write_report(result: DataFrame, bars: DataFrame, symbol: str, path: str, title: str = "Backtest") -> None:
    """report() as a text file under path, through Spark's writer."""
    result.sparkSession.createDataFrame([(report(result, bars, symbol, title),)], "page string").coalesce(1).write.mode("overwrite").text(path)
