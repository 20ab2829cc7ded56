"""One query for each signal and indicator over hourly bars of the events table, and its SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import indicators as I
from tidemark.operators.base import Node, compute, strength_name
from tidemark.operators.kernels import KERNELS, KernelRegression, weights
from tidemark.operators.signals import Cyclical, External, HeikinAshi, LogReturns, join_external
from tidemark.plans.oracle import NUDGE, Steps, full, lag, nz, so_far, spread
from tidemark.sources.bars import to_bars


def hourly(spark, sf_dir: str) -> DataFrame:
    return to_bars(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "value", every="hour", ties=("event_id",))


def rounded(frame: DataFrame, names: list[str], places: int = 6, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    return frame.select(*keys, *[(F.round(F.col(f"`{n}`") + NUDGE, places) + 0.0).alias(n) for n in names])


def node_query(node: Node, strength: bool = True) -> Callable:
    def run(spark, sf_dir: str) -> DataFrame:
        frame = compute(hourly(spark, sf_dir), [node], strengths=strength)
        names = node.outputs()
        if strength:
            frame = frame.withColumnRenamed(strength_name(node), "strength")
            names = [*names, "strength"]
        return rounded(frame, names)

    return run


def _build() -> dict[str, tuple[Node, str | None, bool]]:
    out: dict[str, tuple[Node, str | None, bool]] = {}

    def put(name: str, node: Node, s: Steps, columns: list[str], strength: str | None = None):
        exprs = dict(zip(node.outputs(), columns, strict=True))
        if strength is not None:
            exprs["strength"] = strength
        out[name] = (node, s.rounded(exprs), strength is not None)

    def averaged(name: str, node: Node, s: Steps, y: str):
        put(name, node, s.add(y=y), ["y"], spread("close - y", node.period, "close"))

    typical = "(high + low + close) / 3"
    n = 20
    averaged("sma", I.SMA(period=n), Steps(), full("avg", "close", n))
    averaged("wma", I.WMA(period=n), Steps(), "(" + " + ".join(f"{lag('close', n - 1 - k)} * {k + 1}.0" for k in range(n)) + f") / {n * (n + 1) / 2}")
    averaged("cma", I.CMA(period=n), Steps(), f"CASE WHEN {so_far('count', 'close')} >= {n} THEN {so_far('avg', 'close')} END")
    a = 2 / (n + 1)
    averaged("ema", I.EMA(period=n), Steps().ewm("e1", "close", a), "e1")
    averaged("dema", I.DEMA(period=n), Steps().ewm("e1", "close", a).ewm("e2", "e1", a), "2 * e1 - e2")
    averaged("tema", I.TEMA(period=n), Steps().ewm("e1", "close", a).ewm("e2", "e1", a).ewm("e3", "e2", a), "3 * e1 - 3 * e2 + e3")

    n = 14
    s = Steps().add(d=f"close - {lag('close')}").ewm("g", "CASE WHEN d IS NOT NULL THEN greatest(d, 0) END", 1 / n, n).ewm("l", "CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END", 1 / n, n)
    s.add(y=f"100 - 100 / (1 + g / {nz('l')})")
    put("rsi", I.RSI(period=n), s, ["y"], "tanh((50 - y) / 20)")
    s = Steps().ewm("f", "close", 2 / 13).ewm("w", "close", 2 / 27).add(m="f - w").ewm("g", "m", 0.2)
    put("macd", I.MACD(), s, ["m", "g"], "coalesce(g, 0)")
    put("momentum", I.Momentum(), Steps().add(y=f"close - {lag('close', n)}"), ["y"], "sign(y)")
    top, bottom = full("max", "high", n), full("min", "low", n)
    put("larry_williams", I.LarryWilliams(), Steps().add(t=top, b=bottom).add(y="(t - close) / nullif(t - b, 0) * -100"), ["y"], "tanh((-50 - y) / 20)")
    s = Steps().add(m=full("avg", "close", 20), w=full("stddev_samp", "close", 20)).add(u="m + 2 * w", b="m - 2 * w")
    put("bollinger", I.BollingerBands(), s, ["u", "m", "b"], "tanh((0.5 - coalesce((close - b) / nullif(u - b, 0), 0.5)) * 4)")
    s = Steps().add(t=typical).add(m=full("avg", "t", n), w=f"list(t) OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)").add(y=f"(t - m) / nullif(0.015 * list_sum(list_transform(w, lambda v: abs(v - m))) / {n}, 0)")
    put("cci", I.CCI(), s, ["y"], "tanh(-y / 100)")
    s = Steps().add(t=top, b=bottom).add(r="(close - b) / nullif(t - b, 0) * 100").add(k=full("avg", "r", 3)).add(d=full("avg", "k", 3))
    put("stochastic", I.Stochastic(), s, ["k", "d"], "tanh((50 - coalesce(k, 50)) / 20)")
    put("roc", I.ROC(), Steps().add(p=f"nullif({lag('close', 12)}, 0)").add(y="(close - p) / p * 100"), ["y"], spread("y", 12))
    a = 2 / (n + 1)
    s = Steps().ewm("e1", "close", a).ewm("e2", "e1", a).ewm("e3", "e2", a).add(y=f"(e3 / nullif({lag('e3')}, 0) - 1) * 100")
    put("trix", I.TRIX(), s, ["y"], spread("y", n))
    put("dpo", I.DPO(), Steps().add(y=f"close - {full('avg', 'close', 11)}"), ["y"], spread("y", 20, "close"))
    four = lambda x: f"({x} + 2 * {lag(x, 1)} + 2 * {lag(x, 2)} + {lag(x, 3)}) / 6"
    s = Steps().add(co="close - open", hl="high - low").add(m=four("co"), r=four("hl")).add(y=f"({full('sum', 'm', 10)}) / nullif({full('sum', 'r', 10)}, 0)").add(g=four("y"))
    put("rvi", I.RVI(), s, ["y", "g"], "tanh(coalesce(y, 0) * 5)")
    s = Steps().add(dh=f"high - {lag('high')}", dl=f"{lag('low')} - low").add(u="CASE WHEN dh IS NOT NULL THEN greatest(dh, 0) END", d="CASE WHEN dl IS NOT NULL THEN greatest(dl, 0) END")
    s.add(u2=full("avg", "u", n), d2=full("avg", "d", n)).add(y="u2 / nullif(u2 + d2, 0)")
    put("demarker", I.DeMarker(), s, ["y"], "tanh((0.5 - coalesce(y, 0.5)) * 6)")

    s = Steps().add(v=f"sign(close - {lag('close')}) * volume").add(o=f"CASE WHEN v IS NOT NULL THEN {so_far('sum', 'v')} END")
    s.add(y=f"(o - {lag('o', n)}) / nullif({full('stddev_samp', 'o', n)}, 0)")
    put("obv", I.OBV(), s, ["y"], "tanh(coalesce(y, 0))")
    s = Steps().add(v=f"volume * (close - {lag('close')})").ewm("y", "v", 2 / 14)
    put("force_index", I.ForceIndex(), s, ["y"], spread("y", 13))
    s = Steps().add(f="((close - low) - (high - close)) / nullif(high - low, 0) * volume").add(ad=f"CASE WHEN f IS NOT NULL THEN {so_far('sum', 'f')} END").ewm("q", "ad", 0.5).ewm("w", "ad", 2 / 11).add(y="q - w")
    put("cho", I.CHO(), s, ["y"], spread("y", 10))

    tr = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
    put("atr", I.ATR(), Steps().add(t=tr).ewm("y", "t", 1 / n), ["y"])
    s = Steps().add(t=tr, up=f"high - {lag('high')}", dn=f"{lag('low')} - low").add(p="coalesce(CASE WHEN up > dn AND up > 0 THEN up END, 0)", m="coalesce(CASE WHEN dn > up AND dn > 0 THEN dn END, 0)")
    s.ewm("r", "t", 1 / n).ewm("p1", "p", 1 / n).ewm("m1", "m", 1 / n).add(pd="100 * p1 / nullif(r, 0)", md="100 * m1 / nullif(r, 0)").add(dx="100 * abs(pd - md) / nullif(pd + md, 0)").ewm("y", "dx", 1 / n)
    put("adx", I.ADX(), s, ["y", "pd", "md"], "coalesce((pd - md) / nullif(pd + md, 0) * tanh(y / 25), 0)")
    s = Steps().add(r="high - low").ewm("e1", "r", 0.2).ewm("e2", "e1", 0.2).add(q="e1 / nullif(e2, 0)").add(y=full("sum", "q", 25))
    put("mass_index", I.MassIndex(), s, ["y"], "tanh((26.75 - coalesce(y, 26.75)) / 1.5)")

    for kernel in KERNELS:
        node, bw = KernelRegression(kernel=kernel, bandwidth=8), 8
        terms = " + ".join(f"{lag('close', i)} * {w!r}::DOUBLE" for i, w in enumerate(weights(kernel, bw)))
        s = Steps().add(e=terms).add(q="(close - e) * (close - e)").add(w=f"sqrt(({full('sum', 'q', bw)}) / {bw - 1}) * 2").add(u="e + w", b="e - w")
        put(f"kernel_{kernel.replace(' ', '_')}", node, s, ["e", "u", "b", "w"], f"tanh(coalesce((close - e) / coalesce(nullif(w, 0), nullif({full('stddev_samp', 'close', bw)}, 0)), 0))")

    logs = lambda x: f"CASE WHEN {x} / nullif({lag('close')}, 0) > 0 THEN ln({x} / nullif({lag('close')}, 0)) END"
    put("log_returns", LogReturns(), Steps().add(**{f"y{k}": logs(p) for k, p in enumerate(("open", "high", "low", "close"))}), ["y0", "y1", "y2", "y3"])
    s = Steps().add(hc="(open + high + low + close) / 4").recur("ho", "hc, open, close", "(s.open + s.close) / 2", "(e.y + e.hc) / 2")
    s.ctes[-2] = s.ctes[-2].replace("AS y FROM", "AS y, s.hc AS hc FROM").replace("(e.y + e.hc) / 2 FROM", "(e.y + e.hc) / 2, s.hc FROM")
    s.add(hh="greatest(high, ho, hc)", hl="least(low, ho, hc)", was=lag("hc"))
    put("heikin_ashi", HeikinAshi(), s, [f"CASE WHEN {x} / nullif(was, 0) > 0 THEN ln({x} / nullif(was, 0)) END" for x in ("ho", "hh", "hl", "hc")])
    put("cyclical_hour", Cyclical(component="hour", period=24), Steps(), [f"{f}(hour(ts) * {2 * math.pi!r}::DOUBLE / 24)" for f in ("sin", "cos")])
    put("cyclical_weekday", Cyclical(component="day_of_week", period=7), Steps(), [f"{f}((isodow(ts) - 1) * {2 * math.pi!r}::DOUBLE / 7)" for f in ("sin", "cos")])
    put("cyclical_month", Cyclical(component="month", period=12), Steps(), [f"{f}(month(ts) * {2 * math.pi!r}::DOUBLE / 12)" for f in ("sin", "cos")])
    put("cyclical_month_day", Cyclical(component="day_of_month", period=30.5), Steps(), [f"{f}(day(ts) * {2 * math.pi!r}::DOUBLE / 30.5)" for f in ("sin", "cos")])
    put("cyclical_year_day", Cyclical(component="day_of_year", period=365), Steps(), [f"{f}(dayofyear(ts) * {2 * math.pi!r}::DOUBLE / 365)" for f in ("sin", "cos")])
    put("lagged_sma", I.SMA(period=5, lag=3), Steps().add(m=full("avg", "close", 5)).add(y=lag("m", 3)), ["y"], spread("close - y", 5, "close"))
    return out


def crossovers(spark, sf_dir):
    node = KernelRegression(kernel="gaussian", bandwidth=8)
    frame = node.crossovers(compute(hourly(spark, sf_dir), [node]))
    return frame.select("symbol", "ts", "bullish", "bearish")


def _crossovers_sql() -> str:
    terms = " + ".join(f"{lag('close', i)} * {w!r}::DOUBLE" for i, w in enumerate(weights("gaussian", 8)))
    s = Steps().add(e=terms).add(d=f"e - {lag('e')}").add(was=lag("d"))
    return s.select("symbol, ts, coalesce(d > 0 AND was < 0, false) AS bullish, coalesce(d < 0 AND was > 0, false) AS bearish")


def external(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    # the mean order of the same calendar day, whatever the year, as a column from elsewhere
    daily = orders.groupBy(F.date_format("o_orderdate", "MM-dd").alias("day")).agg(F.round(F.avg("o_totalprice"), 4).alias("Order Mean"))
    bars = bars.withColumn("day", F.date_format("ts", "MM-dd"))
    node = External(column="Order Mean", normalization=lambda c: c / 1000.0)
    return rounded(compute(join_external(bars, daily, ["Order Mean"], ("day",)), [node]), node.outputs())


EXTERNAL_SQL = Steps().select("1").split(" SELECT 1")[0] + """, d AS (
  SELECT strftime(o_orderdate, '%m-%d') AS day, round(avg(o_totalprice), 4) AS x FROM orders GROUP BY 1)
SELECT symbol, ts, round(x / 1000.0 + 1.3e-9, 6) + 0.0 AS indicator__order_mean__lag_0 FROM s0 LEFT JOIN d ON d.day = strftime(ts, '%m-%d')"""


def engine_atr(spark, sf_dir):
    return rounded(I.engine_atr(hourly(spark, sf_dir)), ["atr"])


def _engine_atr_sql() -> str:
    w = lag("close")
    s = Steps().add(t=f"CASE WHEN {w} IS NOT NULL THEN greatest(high - low, abs(high - {w}), abs(low - {w})) END")
    return s.rounded({"atr": full("avg", "t", 14)})


def _kernel(node: KernelRegression) -> Steps:
    bw = node.bandwidth
    terms = " + ".join(f"{lag('close', i)} * {w!r}::DOUBLE" for i, w in enumerate(weights(node.kernel, bw)))
    return Steps().add(e=terms).add(q="(close - e) * (close - e)").add(w=f"sqrt(({full('sum', 'q', bw)}) / {bw - 1}) * {node.deviations!r}").add(u="e + w", b="e - w")


_WINDOWS = [I.SMA(), I.WMA(), I.CMA(), I.Momentum(), I.LarryWilliams(), I.BollingerBands(), I.CCI(), I.Stochastic(), I.ROC(), I.DPO(), I.RVI(), I.DeMarker(), I.OBV(), LogReturns(), KernelRegression()]
_RECURSIONS = [I.EMA(), I.DEMA(), I.TEMA(), I.RSI(), I.MACD(), I.TRIX(), I.ForceIndex(), I.CHO(), I.ADX(), I.ATR(), I.MassIndex(), HeikinAshi()]


def window_plan(spark, sf_dir) -> DataFrame:
    """Every window-only indicator in one plan: one shuffle for the bars, one for all windows."""
    return rounded(compute(hourly(spark, sf_dir), _WINDOWS), [c for n in _WINDOWS for c in n.outputs()])


def recursion_plan(spark, sf_dir) -> DataFrame:
    """Every recursive indicator in one plan: their recursions share one pass."""
    return rounded(compute(hourly(spark, sf_dir), _RECURSIONS), [c for n in _RECURSIONS for c in n.outputs()])


#: Small enough that each of the tables' series is several blocks.
_BLOCK = 256


def window_blocks(spark, sf_dir) -> DataFrame:
    """``window_plan`` with each series cut into blocks that have the last rows of the one before."""
    return rounded(compute(hourly(spark, sf_dir), _WINDOWS, block_rows=_BLOCK), [c for n in _WINDOWS for c in n.outputs()])


def recursion_blocks(spark, sf_dir) -> DataFrame:
    """``recursion_plan`` with each series cut into blocks whose maps are folded."""
    return rounded(compute(hourly(spark, sf_dir), _RECURSIONS, block_rows=_BLOCK), [c for n in _RECURSIONS for c in n.outputs()])


_CHAIN = [I.SMA(column="signal__ha_close", period=5), HeikinAshi(), I.EMA(column="indicator__sma_5", period=4)]


def chained(spark, sf_dir) -> DataFrame:
    """An exponential mean of a mean of smoothed closes, three nodes of one plan."""
    return rounded(compute(hourly(spark, sf_dir), _CHAIN), [c for n in _CHAIN for c in n.outputs()])


def _chained_sql() -> str:
    s = Steps()
    s.ctes.append(f"ha AS ({_ALL['heikin_ashi'][1].replace(f' + {NUDGE!r}, 6)', ', 17)')})")
    s.ctes.append("hb AS (SELECT h.*, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, signal__ha_close AS x FROM ha h)")
    s.top = "hb"
    return s.add(m=full("avg", "x", 5)).ewm("e", "m", 2 / 5).rounded({f"signal__ha_{p}": f"signal__ha_{p}" for p in ("open", "high", "low", "close")} | {"indicator__sma_5": "m", "indicator__ema_4": "e"})


_ALL = _build()


def _joined(nodes: list[Node]) -> str:
    """The SQL of several nodes' own queries, joined."""
    parts = []
    for node in nodes:
        if isinstance(node, KernelRegression):
            sql = _kernel(node).rounded(dict(zip(node.outputs(), ["e", "u", "b", "w"], strict=True)))
        else:
            sql = next(sql for other, sql, _ in _ALL.values() if other == node)
        columns = ", ".join(f'"{c}"' for c in node.outputs())
        parts.append(f"(SELECT symbol, ts, {columns} FROM ({sql}))")
    return "SELECT * FROM " + parts[0] + "".join(f" JOIN {p} USING (symbol, ts)" for p in parts[1:])


def queries() -> dict[str, Callable]:
    out = {name: node_query(node, strength) for name, (node, _, strength) in _ALL.items()}
    return out | {"kernel_crossovers": crossovers, "external_column": external, "engine_atr": engine_atr, "windows_all": window_plan, "ewm_family": recursion_plan, "windows_blocks": window_blocks, "ewm_blocks": recursion_blocks, "chained_average": chained}


def oracle_sql() -> dict[str, str]:
    out = {name: sql for name, (_, sql, _) in _ALL.items() if sql}
    return out | {"kernel_crossovers": _crossovers_sql(), "external_column": EXTERNAL_SQL, "engine_atr": _engine_atr_sql(), "windows_all": _joined(_WINDOWS), "ewm_family": _joined(_RECURSIONS), "windows_blocks": _joined(_WINDOWS), "ewm_blocks": _joined(_RECURSIONS), "chained_average": _chained_sql()}
