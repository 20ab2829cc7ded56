"""Queries on strategies, simulated accounts, their scores, resampling, features and targets, with SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import features as X
from tidemark.operators import indicators as I
from tidemark.operators import metrics as M
from tidemark.operators import montecarlo as MC
from tidemark.operators import risk as R
from tidemark.operators import trials as D
from tidemark.operators.base import compute
from tidemark.operators.model_search import IndicatorSpec, ModelSearch
from tidemark.operators.network import Network
from tidemark.operators.search import FloatParam, IntParam, optimize, optimize_signals, trials_table
from tidemark.operators.signals import LogReturns
from tidemark.operators.simulate import Account, backtest, trades
from tidemark.operators.strategy import Precomputed, Rules, Weighted
from tidemark.plans.indicator_queries import hourly, rounded
from tidemark.plans.oracle import NUDGE, Steps, full, lag, lead, so_far
from tidemark.sources.bars import between, to_bars

ACCOUNT = Account()
RULES = Rules(sizer=R.FixedSizer(0.5))


def crossing(rules: Rules = RULES) -> Weighted:
    """The flagship: two averages, the short one for the move and the long one against it."""
    return Weighted(((I.SMA(period=5), 1.5), (I.SMA(period=20), -0.7)), rules)


_CROSSING = Steps().add(a=full("avg", "close", 5), b=full("avg", "close", 20))
_CROSSING.add(sa=f"tanh(coalesce((close - a) / nullif({full('stddev_samp', 'close', 5)}, 0), 0))", sb=f"tanh(coalesce((close - b) / nullif({full('stddev_samp', 'close', 20)}, 0), 0))")
_CROSSING.add(signal_strength="tanh(sa * 1.5 + sb * -0.7)")


def _account_sql(et: float = 0.5, xt: float = 0.1, comm: float = 0.001, slip: float = 0.0005, part: float = 0.5) -> Steps:
    """The account as a recursion over (cash, units, price and bar of entry); y is equity."""
    s = Steps()
    s.ctes, s.top, s.k = list(_CROSSING.ctes), _CROSSING.top, _CROSSING.k
    out = f"(pos > 0 AND sig < {xt} OR pos < 0 AND sig > -{xt})"
    # what the row before left (cash0, pos0, ...), then the exit, then the entry
    row = f"SELECT symbol, rn, ts, close AS c, signal_strength AS sig FROM {s.top}"
    exit_price = f"c * CASE WHEN pos > 0 THEN 1 - {slip} ELSE 1 + {slip} END"
    step = (
        f"SELECT symbol, rn, ts, c, sig, cash1, pos1, gone, xp, CASE WHEN can AND sig > {et} THEN cash1 * {part} / (c * (1 + {slip})) WHEN can AND sig < -{et} THEN -cash1 * {part} / (c * (1 - {slip})) END AS new, "
        f"entry, ecomm, ebar, pos, can FROM (SELECT *, pos1 = 0 AND sig IS NOT NULL AND cash1 + pos1 * c > 0 AS can FROM (SELECT *, CASE WHEN gone THEN cash + pos * xp - abs(pos) * xp * {comm} ELSE cash END AS cash1, CASE WHEN gone THEN 0 ELSE pos END AS pos1 "
        f"FROM (SELECT *, coalesce({out}, false) AS gone, {exit_price} AS xp FROM (%s))))"
    )
    last = (
        f"SELECT symbol, rn, ts, c, sig, CASE WHEN new > 0 THEN cash1 - new * c * (1 + {slip}) * (1 + {comm}) WHEN new < 0 THEN cash1 - new * c * (1 - {slip}) * (1 - {comm}) ELSE cash1 END AS cash, coalesce(new, pos1) AS pos, "
        f"CASE WHEN new > 0 THEN c * (1 + {slip}) WHEN new < 0 THEN c * (1 - {slip}) ELSE entry END AS entry, CASE WHEN new IS NOT NULL THEN abs(new) * c * (1 + sign(new) * {slip}) * {comm} ELSE ecomm END AS ecomm, CASE WHEN new IS NOT NULL THEN rn ELSE ebar END AS ebar, "
        f"CASE WHEN gone THEN pos * (xp - entry) - abs(pos) * xp * {comm} - ecomm END AS pnl, CASE WHEN gone THEN rn - ebar END AS held, CASE WHEN gone THEN sign(pos) END AS side, CASE WHEN gone THEN ecomm + abs(pos) * xp * {comm} END AS paid, CASE WHEN gone THEN xp END AS xp, CASE WHEN gone THEN abs(pos) END AS size, CASE WHEN gone THEN entry END AS was_entry "
        f"FROM ({step})"
    )
    start = f"SELECT *, 100000.0::DOUBLE AS cash, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS ecomm, 0::BIGINT AS ebar FROM ({row}) WHERE rn = 1"
    later = f"SELECT s.*, e.cash, e.pos, e.entry, e.ecomm, e.ebar FROM acc e JOIN ({row}) s ON s.symbol = e.symbol AND s.rn = e.rn + 1"
    s.ctes.append(f"acc AS ({last % start} UNION ALL {last % later})")
    s.ctes.append("eq AS (SELECT *, greatest(cash + pos * c, 0) AS equity FROM acc)")
    s.top = "eq"
    return s


def signal(spark, sf_dir):
    return rounded(crossing().signals(hourly(spark, sf_dir)), ["signal_strength"])


def equity(spark, sf_dir):
    return rounded(backtest(hourly(spark, sf_dir), crossing(), ACCOUNT), ["equity"], 4)


def trade_log(spark, sf_dir):
    log = trades(backtest(hourly(spark, sf_dir), crossing(), ACCOUNT))
    return rounded(log.withColumnRenamed("exit_date", "ts"), ["entry_price", "exit_price", "size", "pnl", "commission"], 4, ("symbol", "ts", "direction", "bars_held", "exit_reason"))


TRADE_SQL = _account_sql().select("symbol, ts, CASE WHEN side > 0 THEN 'long' ELSE 'short' END AS direction, held::INT AS bars_held, 'signal' AS exit_reason, " + ", ".join(f"round({e} + {NUDGE!r}, 4) + 0.0 AS {n}" for n, e in (("entry_price", "was_entry"), ("exit_price", "xp"), ("size", "size"), ("pnl", "pnl"), ("commission", "paid")))) + " WHERE pnl IS NOT NULL"


def scores(spark, sf_dir):
    found = M.metrics(backtest(hourly(spark, sf_dir), crossing(), ACCOUNT))
    return rounded(found, [m for m in M.METRICS if m not in ("total_trades", "rebalance_count")], 6, ("symbol", "total_trades"))


def _scores_sql() -> str:
    s = _account_sql()
    s.ctes.append("st AS (SELECT *, equity / nullif(lag(equity) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret, (equity - max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) / max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS dd FROM eq)")
    year = math.sqrt(252)
    side = lambda n, v: f"coalesce(count(*) FILTER (side = {v} AND pnl > 0) / nullif(count(*) FILTER (side = {v}), 0), 0) AS {n}_win_rate, coalesce(avg(pnl) FILTER (side = {v} AND pnl > 0), 0) AS {n}_avg_win, coalesce(avg(pnl) FILTER (side = {v} AND pnl <= 0), 0) AS {n}_avg_loss"
    s.ctes.append(
        f"g AS (SELECT symbol, (arg_max(equity, ts) - arg_min(equity, ts)) / arg_min(equity, ts) AS total_return, count(*) AS n, coalesce(stddev_samp(ret) * {year!r}, 0) AS annual_volatility, coalesce(stddev_samp(ret) FILTER (ret < 0) * {year!r}, 0) AS dv, min(dd) AS max_drawdown, "
        f"count(pnl) AS total_trades, coalesce(count(*) FILTER (pnl > 0) / nullif(count(pnl), 0), 0) AS win_rate, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gain, abs(coalesce(sum(pnl) FILTER (pnl <= 0), 0)) AS loss, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS avg_win, "
        f"coalesce(avg(pnl) FILTER (pnl <= 0), 0) AS avg_loss, coalesce(avg(held), 0) AS avg_trade_bars, coalesce(sum(paid), 0) AS total_commission, 0.0 AS total_financing, {side('long', 1)}, {side('short', -1)} FROM st GROUP BY symbol)"
    )
    s.ctes.append("h AS (SELECT *, CASE WHEN total_return <= -1 THEN -1 ELSE pow(1 + total_return, 252.0 / n) - 1 END AS annualized_return FROM g)")
    s.ctes.append("k AS (SELECT *, CASE WHEN annual_volatility > 0 THEN annualized_return / annual_volatility ELSE 0 END AS sharpe_ratio, CASE WHEN dv > 0 THEN annualized_return / dv ELSE 0 END AS sortino_ratio, CASE WHEN total_trades = 0 THEN 'nan'::DOUBLE WHEN loss > 0 THEN gain / loss ELSE 'inf'::DOUBLE END AS profit_factor FROM h)")
    s.top = "k"
    return s.select("symbol, total_trades, " + ", ".join(f"round({m} + {NUDGE!r}, 6) + 0.0 AS {m}" for m in M.METRICS if m not in ("total_trades", "rebalance_count")))


def drawdowns(spark, sf_dir):
    return rounded(M.equity_steps(backtest(hourly(spark, sf_dir), crossing(), ACCOUNT)), ["drawdown"])


DRAWDOWN_SQL = _account_sql().select(f"symbol, ts, round((equity - max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) / nullif(max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) + {NUDGE!r}, 6) + 0.0 AS drawdown")


def protected(spark, sf_dir):
    """The whole simulator: next-bar fills, leverage, financing, protective orders, rebalancing."""
    rules = Rules(sizer=R.RiskSizer(0.05, 1.0), take_profit=R.SignalTarget(150.0), stop_loss=R.FixedStop(120.0), trailing_stop=R.ParabolicTrail(step_points=5.0))
    account = Account(leverage=3.0, financing_rate=0.0001, execute_on="next_open", rebalance_band=0.25)
    return rounded(backtest(hourly(spark, sf_dir), crossing(rules), account), ["equity"], 4)


def precomputed(spark, sf_dir):
    """A signal table with gaps, aligned to the bars."""
    bars = hourly(spark, sf_dir)
    made = crossing().signals(bars).filter(F.hour("ts") % 3 != 0).select("symbol", "ts", F.col("signal_strength").alias("value"))
    return rounded(Precomputed(made, RULES).signals(bars), ["signal_strength"])


PRECOMPUTED_SQL = _CROSSING.select(f"symbol, ts, CASE WHEN hour(ts) % 3 <> 0 THEN round(signal_strength + {NUDGE!r}, 6) + 0.0 END AS signal_strength")


def regimes(spark, sf_dir):
    steps = M.equity_steps(backtest(hourly(spark, sf_dir), crossing(), ACCOUNT))
    labels = hourly(spark, sf_dir).select("symbol", "ts", F.when(F.hour("ts") < 12, "morning").otherwise("evening").alias("regime"))
    found = M.regime_breakdown(steps, labels, ("symbol", "ts"))
    return rounded(found, ["mean_return", "sharpe"], 6, ("regime", "n"))


def _regimes_sql() -> str:
    s = _account_sql()
    s.ctes.append("st AS (SELECT *, equity / nullif(lag(equity) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret FROM eq)")
    s.ctes.append(f"g AS (SELECT CASE WHEN hour(ts) < 12 THEN 'morning' ELSE 'evening' END AS regime, count(*) AS n, avg(ret) AS m, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * {math.sqrt(252)!r} ELSE 0 END AS sh FROM st WHERE ret IS NOT NULL GROUP BY 1)")
    s.top = "g"
    return s.select(f"regime, n, round(m + {NUDGE!r}, 6) + 0.0 AS mean_return, round(sh + {NUDGE!r}, 6) + 0.0 AS sharpe")


def gates(spark, sf_dir):
    found = M.metrics(backtest(hourly(spark, sf_dir), crossing(), ACCOUNT))
    least = M.min_trade_gate(found, 10).select("symbol", F.col("passed").alias("enough_trades"))
    baselines = spark.createDataFrame([("hold", 0.0), ("bank", 0.02)], "baseline string, threshold double")
    above = M.promotion_gates(found.select(F.col("symbol").alias("name"), F.col("total_return").alias("value")), baselines, 0.01)
    return above.select(F.col("name").alias("symbol"), "baseline", "passed").join(least, "symbol")


def _gates_sql() -> str:
    s = _account_sql()
    s.ctes.append("g AS (SELECT symbol, (arg_max(equity, ts) - arg_min(equity, ts)) / arg_min(equity, ts) AS v, count(pnl) >= 10 AS enough_trades FROM eq GROUP BY 1)")
    s.top = "g, (VALUES ('hold', 0.0), ('bank', 0.02)) b(baseline, threshold)"
    return s.select("symbol, baseline, v > threshold + 0.01 AS passed, enough_trades")


def daily_bars(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    bars = to_bars(lines, "l_returnflag", "l_shipdate", F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0)), F.col("l_quantity"), "day", ("l_orderkey", "l_linenumber"))
    return rounded(bars, ["open", "high", "low", "close", "volume"], 6)


DAILY_SQL = f"""
SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, round(arg_min(p, (l_shipdate, l_orderkey, l_linenumber)) + {NUDGE!r}, 6) + 0.0 AS open, round(max(p) + {NUDGE!r}, 6) + 0.0 AS high,
  round(min(p) + {NUDGE!r}, 6) + 0.0 AS low, round(arg_max(p, (l_shipdate, l_orderkey, l_linenumber)) + {NUDGE!r}, 6) + 0.0 AS close, round(sum(l_quantity) + {NUDGE!r}, 6) + 0.0 AS volume
FROM (SELECT *, l_extendedprice / nullif(l_quantity, 0) AS p FROM lineitem) WHERE p IS NOT NULL GROUP BY 1, 2"""


def bars_query(spark, sf_dir):
    return rounded(hourly(spark, sf_dir), ["open", "high", "low", "close", "volume"])


def date_slice(spark, sf_dir):
    from datetime import datetime

    return rounded(between(hourly(spark, sf_dir), datetime(2024, 1, 5), datetime(2024, 1, 10)), ["close"])


def target_query(make: Callable[[DataFrame], DataFrame]) -> Callable:
    return lambda spark, sf_dir: rounded(make(hourly(spark, sf_dir)), ["target"])


def _log(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ln({x}) END"


def _excess_sql(drift: str) -> str:
    s = Steps().add(was=lag("close"), nxt=lead("close", 5)).add(r=_log("close / nullif(was, 0)"), f=_log("nxt / nullif(close, 0)"))
    if drift == "ewma":
        keep = repr(1 - 2 / 51)
        s.ctes.append(
            f"aw AS (SELECT symbol, rn, coalesce(r, 0)::DOUBLE AS t, (r IS NOT NULL)::INT::DOUBLE AS b, (r IS NOT NULL)::INT AS k FROM {s.top} WHERE rn = 1 UNION ALL "
            f"SELECT s.symbol, s.rn, e.t * {keep}::DOUBLE + coalesce(s.r, 0), e.b * {keep}::DOUBLE + (s.r IS NOT NULL)::INT, e.k + (s.r IS NOT NULL)::INT FROM aw e JOIN {s.top} s ON s.symbol = e.symbol AND s.rn = e.rn + 1)"
        )
        s.ctes.append(f"am AS (SELECT p.*, CASE WHEN e.k >= 50 THEN e.t / nullif(e.b, 0) END AS mean_ FROM {s.top} p JOIN aw e USING (symbol, rn))")
        s.top = "am"
    s.add(m="mean_" if drift == "ewma" else full("avg", "r", 50) if drift == "rolling" else f"CASE WHEN {so_far('count', 'r')} >= 50 THEN {so_far('avg', 'r')} END", v=f"({full('stddev_samp', 'r', 21)}) * {math.sqrt(5)!r}")
    return s.rounded({"target": "tanh((f - m * 5) / nullif(v * 2.0, 0))"})


def feature_rows(spark, sf_dir):
    frame = X.feature_matrix(hourly(spark, sf_dir), [I.SMA(period=5), I.Momentum(period=3)])
    scaler = X.Scaler.fit(frame, ["indicator__sma_5", "indicator__momentum_3"])
    return rounded(scaler.transform(frame), ["indicator__sma_5", "indicator__momentum_3", "target"])


def _feature_sql() -> str:
    s = Steps().add(a=full("avg", "close", 5), b=f"close - {lag('close', 3)}", nxt=lead("close")).add(t=_log("nxt / nullif(close, 0)"))
    s.ctes.append(f"f AS (SELECT * FROM {s.top} WHERE a IS NOT NULL AND b IS NOT NULL AND t IS NOT NULL)")
    s.ctes.append("z AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM f)")
    s.top = "f, z"
    return s.rounded({"indicator__sma_5": "(a - ma) / sa", "indicator__momentum_3": "(b - mb) / sb", "target": "t"})


def minmax_rows(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return rounded(X.Scaler.fit(bars, ["close", "volume"], "minmax").transform(bars), ["close", "volume"])


MINMAX_SQL = Steps().select("symbol, ts, " + ", ".join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) + {NUDGE!r}, 6) + 0.0 AS {c}" for c in ("close", "volume")))


def folds(spark, sf_dir):
    frame = X.numbered(hourly(spark, sf_dir)).withColumn("bars", F.count("*").over(Window.partitionBy("symbol")))
    made = X.with_folds(frame, X.walk_forward_columns(F.col("bars"), 4, 0.6, embargo=5))
    return made.groupBy("symbol", "fold", "part").agg(F.count("*").alias("n"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))


FOLDS_SQL = Steps().select("1").rsplit(" SELECT 1", 1)[0] + """, c AS (SELECT symbol, count(*) AS n, CAST(trunc(count(*) * 0.6::DOUBLE) AS BIGINT) AS first FROM s0 GROUP BY 1),
f AS (SELECT symbol, k AS fold, n, first + k * ((n - first) // 4) AS begin_, CASE WHEN k < 3 THEN first + (k + 1) * ((n - first) // 4) ELSE n END AS stop FROM c, range(4) t(k)),
x AS (SELECT symbol, rn - 1 AS i, fold, CASE WHEN rn - 1 < begin_ - 5 THEN 'train' WHEN rn - 1 >= begin_ AND rn - 1 < stop THEN 'test' END AS part FROM s0 JOIN f USING (symbol))
SELECT symbol, fold::INT AS fold, part, count(*) AS n, min(i) AS first_row, max(i) AS last_row FROM x WHERE part IS NOT NULL GROUP BY 1, 2, 3"""


def losses(spark, sf_dir):
    frame = X.directional_target(compute(hourly(spark, sf_dir), [LogReturns()]))
    y, p = F.col("target"), F.tanh(F.col("signal__log_return_close"))
    found = frame.filter(y.isNotNull() & p.isNotNull()).groupBy("symbol").agg(F.avg(X.directional_loss(y, p, 0.1)).alias("directional"), F.avg(X.pinball_loss(y, p, 0.9)).alias("pinball"), F.avg(X.squared_error(y, p)).alias("mse"))
    return rounded(found, ["directional", "pinball", "mse"], 6, ("symbol",))


def _losses_sql() -> str:
    s = Steps().add(y=f"sign({lead('close', 5)} - close)", q=f"close / nullif({lag('close')}, 0)").add(p="tanh(CASE WHEN q > 0 THEN ln(q) END)")
    s.ctes.append(f"g AS (SELECT symbol, avg(greatest(-sign(y) * p, 0) + 0.1 * (p - y) * (p - y)) AS d, avg(greatest(0.9 * (y - p), -0.1 * (y - p))) AS pb, avg((p - y) * (p - y)) AS m FROM {s.top} WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY 1)")
    s.top = "g"
    return s.select(f"symbol, round(d + {NUDGE!r}, 6) + 0.0 AS directional, round(pb + {NUDGE!r}, 6) + 0.0 AS pinball, round(m + {NUDGE!r}, 6) + 0.0 AS mse")


_BLOCK = 10


def circular_paths(spark, sf_dir):
    """Three circular block bootstraps of every series: the bar that each simulated close repeats, and the close."""
    made = MC.paths(hourly(spark, sf_dir), 3, "circular", seed=7, block=_BLOCK)
    return rounded(made, ["open", "high", "low", "close", "volume"], 5, ("symbol", "sim", "ts"))


def _drawn(s: Steps, name: str, source: str, i: str, stream: int, seed: int = 7) -> None:
    """A column d<stream> of a drawn number, one step of the generator after the other."""
    s.ctes.append(f"{name}0 AS (SELECT *, (sim * 7919 + ({i}) * 104729 + {seed * 15485863 + stream * 32452843}) % {MC._M} AS x FROM {source})")
    for k, (a, c) in enumerate(((48271, 11), (69621, 1013), (16807, 7001)), 1):
        s.ctes.append(f"{name}{k}a AS (SELECT * EXCLUDE (x), ((x + {c}) * {a}) % {MC._M} AS x FROM {name}{k - 1})")
        s.ctes.append(f"{name}{k} AS (SELECT * EXCLUDE (x), (x * (x % 65521) + x) % {MC._M} AS x FROM {name}{k}a)")
    s.ctes.append(f"{name} AS (SELECT * EXCLUDE (x), x AS d{stream} FROM {name}3)")


def _paths_sql(kind: str, sims: int = 3, whole: bool = False) -> str:
    """Simulations of every series: the return r that each bar gets, then prices, rounded unless they are to be whole."""
    s = Steps().add(was=lag("close")).add(r="CASE WHEN close > 0 AND was > 0 THEN ln(close / was) END", o="open / close", h="high / close", l="low / close", i="rn - 1", n="count(*) OVER (PARTITION BY symbol)")
    past = s.top
    s.ctes.append(f"sims AS (SELECT symbol, ts, i, n, sim::BIGINT AS sim FROM {past}, range({sims}) t(sim) WHERE n > 2)")
    _drawn(s, "db", "sims", "i", 5)
    _drawn(s, "dc", "db", "i", 6)
    returned = f"LEFT JOIN {past} a ON a.symbol = j.symbol AND a.i = j.src"
    if kind == "circular":
        _drawn(s, "da", "dc", f"(i - 1) // {_BLOCK}", 1)
        s.ctes.append(f"src AS (SELECT *, (d1 % (n - 1) + (i - 1) % {_BLOCK}) % (n - 1) + 1 AS src FROM da)")
    elif kind == "shuffle":
        _drawn(s, "da", "dc", "i - 1", 1)
        s.ctes.append("src AS (SELECT *, CASE WHEN i > 0 THEN row_number() OVER (PARTITION BY symbol, sim, i > 0 ORDER BY d1, i) END AS src FROM da)")
    elif kind == "stationary":
        _drawn(s, "da", "dc", "i - 1", 1)
        _drawn(s, "dd", "da", "i - 1", 2)
        s.ctes.append(f"dn AS (SELECT *, d1 % (n - 1) AS start, (d2 + 0.5) / {float(MC._M)!r}::DOUBLE < 1.0 / greatest(2, round(pow(n, {1 / 3!r}::DOUBLE))) AS begins FROM dd)")
        s.ctes.append(
            "bl AS (SELECT symbol, sim, i, i AS at, start AS from_ FROM dn WHERE i = 1 UNION ALL SELECT d.symbol, d.sim, d.i, CASE WHEN d.begins OR b.from_ + d.i - b.at >= d.n - 1 THEN d.i ELSE b.at END, "
            "CASE WHEN d.begins OR b.from_ + d.i - b.at >= d.n - 1 THEN d.start ELSE b.from_ END FROM bl b JOIN dn d ON d.symbol = b.symbol AND d.sim = b.sim AND d.i = b.i + 1)"
        )
        s.ctes.append("src AS (SELECT dn.*, bl.from_ + bl.i - bl.at + 1 AS src FROM dn LEFT JOIN bl USING (symbol, sim, i))")
    else:
        _drawn(s, "da", "dc", "i", 3)
        _drawn(s, "dd", "da", "i", 4)
        s.ctes.append(f"st AS (SELECT symbol, avg(r) AS mu, stddev_pop(r) AS sd FROM {past} WHERE i > 0 GROUP BY 1)")
        u = lambda k: f"((d{k} + 0.5) / {float(MC._M)!r}::DOUBLE)"
        s.ctes.append(f"src AS (SELECT dd.*, mu - sd * sd / 2 + sd * sqrt(-2 * ln({u(3)})) * cos({2 * math.pi!r}::DOUBLE * {u(4)}) AS r FROM dd JOIN st USING (symbol))")
        returned = ""
    s.ctes.append("j AS (SELECT *, d5 % (n - 1) + 1 AS shape, d6 % (n - 1) + 1 AS vol FROM src)")
    r = "a.r" if returned else "j.r"
    s.ctes.append(
        f"m AS (SELECT j.symbol, j.sim, j.ts, j.i, c0.close * exp(sum(CASE WHEN j.i > 0 THEN coalesce({r}, 0) ELSE 0 END) OVER (PARTITION BY j.symbol, j.sim ORDER BY j.i ROWS UNBOUNDED PRECEDING)) AS close, b.o, b.h, b.l, v.volume FROM j "
        f"{returned} JOIN {past} b ON b.symbol = j.symbol AND b.i = j.shape JOIN {past} v ON v.symbol = j.symbol AND v.i = j.vol JOIN {past} c0 ON c0.symbol = j.symbol AND c0.i = 0)"
    )
    s.ctes.append("q AS (SELECT *, close * o AS open FROM m)")
    s.top = "q"
    if whole:
        return s.select("symbol, sim, ts, close")
    r = lambda e, n: f"round({e} + {NUDGE!r}, 5) + 0.0 AS {n}"
    return s.select(f"symbol, sim, ts, {r('open', 'open')}, {r('greatest(close * h, open, close)', 'high')}, {r('least(close * l, open, close)', 'low')}, {r('close', 'close')}, {r('volume', 'volume')}")


def resampled(kind: str) -> Callable:
    return lambda spark, sf_dir: rounded(MC.paths(hourly(spark, sf_dir), 3, kind, seed=7), ["open", "high", "low", "close", "volume"], 5, ("symbol", "sim", "ts"))


_PATHS = 50


def _path_results(spark, sf_dir):
    return MC.path_scores(MC.paths(hourly(spark, sf_dir), _PATHS, "stationary", seed=7))


def path_summary(spark, sf_dir):
    """The spread of simulated paths' own scores."""
    found = MC.summary(_path_results(spark, sf_dir))
    return rounded(found, [c for c in found.columns if c not in ("symbol", "metric", "n_valid", "n_nan")], 6, ("symbol", "metric", "n_valid", "n_nan"))


def path_intervals(spark, sf_dir):
    """An interval of the paths' returns, and the share of paths that end no higher than they began."""
    found = _path_results(spark, sf_dir).cache()
    return rounded(MC.confidence_interval(found, "log_return").join(MC.percentile_of(found, "log_return", 0.0), "symbol"), ["low", "high", "percentile"], 6, ("symbol",))


def _path_results_sql() -> str:
    return (
        f"WITH pa AS ({_paths_sql('stationary', _PATHS, True)}), pb AS (SELECT *, ln(close / lag(close) OVER w) AS r, close / max(close) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS down FROM pa WINDOW w AS (PARTITION BY symbol, sim ORDER BY ts)), "
        "pc AS (SELECT symbol, sim, ln(arg_max(close, ts) / arg_min(close, ts)) AS log_return, stddev_samp(r) AS volatility, min(down) AS max_drawdown FROM pb GROUP BY ALL), pd AS (UNPIVOT pc ON log_return, volatility, max_drawdown INTO NAME metric VALUE value) "
    )


def _path_summary_sql() -> str:
    r = lambda e, n: f"round({e} + {NUDGE!r}, 6) + 0.0 AS {n}"
    points = ", ".join(r(f"quantile_cont(value, {p / 100})", f"p{p}") for p in (5, 25, 50, 75, 95))
    return _path_results_sql() + f"SELECT symbol, metric, count(value) AS n_valid, count(*) - count(value) AS n_nan, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std')}, {r('min(value)', 'min')}, {points}, {r('max(value)', 'max')} FROM pd GROUP BY ALL"


def _path_intervals_sql() -> str:
    r = lambda e, n: f"round({e} + {NUDGE!r}, 6) + 0.0 AS {n}"
    return _path_results_sql() + f"SELECT symbol, {r('quantile_cont(value, 0.05)', 'low')}, {r('quantile_cont(value, 0.95)', 'high')}, {r('avg((value <= 0)::INT) * 100', 'percentile')} FROM pd WHERE metric = 'log_return' GROUP BY symbol"


def significance(spark, sf_dir):
    """Each series' ratio against luck: as one alone, and as the best of all of them."""
    frame = compute(hourly(spark, sf_dir), [LogReturns()]).select("symbol", "ts", F.col("signal__log_return_close").alias("ret"))
    return rounded(M.significance(M.return_moments(frame)).select("symbol", "n", "psr", "expected_max", "deflated"), ["psr", "expected_max", "deflated"], 6, ("symbol", "n"))


def _significance_sql() -> str:
    from statistics import NormalDist

    trials = 5  # the tables have five series; a ratio's quantiles are numbers and not columns
    low, high = (NormalDist().inv_cdf(1 - 1 / x) for x in (trials, trials * math.e))
    gamma = 0.5772156649015329
    cdf = lambda z: f"0.5 + exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * sign({z}) * list_sum([exp((2 * k + 1) * ln(abs({z})) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi())) FOR k IN range(160)])"
    r = lambda e, n: f"round({e} + {NUDGE!r}, 6) + 0.0 AS {n}"
    return (
        f"WITH mo AS ({_moments_sql(False)}), va AS (SELECT var_samp(sharpe) AS v FROM mo), z AS (SELECT symbol, n, sharpe, sqrt(v) * {((1 - gamma) * low + gamma * high)!r}::DOUBLE AS top, sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) AS f FROM mo, va) "
        f"SELECT symbol, n, {r(cdf('sharpe * f'), 'psr')}, {r('top', 'expected_max')}, {r(cdf('(sharpe - top) * f'), 'deflated')} FROM z"
    )


def monte_carlo(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return MC.summary(MC.run(bars, crossing(), 20, ACCOUNT, "stationary", seed=1, names=["total_return", "max_drawdown", "sharpe_ratio"]))


def sharpe_interval(spark, sf_dir):
    frame = compute(hourly(spark, sf_dir), [LogReturns()]).select("symbol", "ts", F.col("signal__log_return_close").alias("ret"))
    return rounded(MC.sharpe_interval(frame, block=10, seed=3), ["sharpe", "ci_low", "ci_high"], 6, ("symbol",))


def _returns() -> Steps:
    return Steps().add(was=lag("close")).add(ret="CASE WHEN close > 0 AND was > 0 THEN ln(close / was) END")


def _interval_sql(block: int = 10, sims: int = 1000) -> str:
    s, year = _returns(), math.sqrt(252)
    s.ctes.append(f"re AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS m FROM {s.top} WHERE ret IS NOT NULL)")
    s.ctes.append(f"sims AS (SELECT symbol, i, m, sim::BIGINT AS sim FROM re, range({sims}) t(sim))")
    _drawn(s, "da", "sims", f"(i - 1) // {block}", 1, seed=3)
    ratio = f"avg(ret) / nullif(stddev_samp(ret), 0) * {year!r}"
    s.ctes.append(f"b AS (SELECT da.symbol, da.sim, avg(re.ret) / nullif(stddev_samp(re.ret), 0) * {year!r} AS x FROM da JOIN re ON re.symbol = da.symbol AND re.i = (d1 % da.m + (da.i - 1) % {block}) % da.m + 1 GROUP BY 1, 2)")
    s.ctes.append("e AS (SELECT symbol, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi FROM b GROUP BY 1)")
    s.ctes.append(f"w AS (SELECT symbol, {ratio} AS sharpe FROM re GROUP BY 1)")
    s.top = "w JOIN e USING (symbol)"
    r = lambda e, n: f"round({e} + {NUDGE!r}, 6) + 0.0 AS {n}"
    return s.select(f"symbol, {r('sharpe', 'sharpe')}, {r('lo', 'ci_low')}, {r('hi', 'ci_high')}")


def moments(spark, sf_dir):
    frame = compute(hourly(spark, sf_dir), [LogReturns()]).select("symbol", "ts", F.col("signal__log_return_close").alias("ret"))
    return rounded(M.return_moments(frame), ["mean", "sharpe", "skew", "kurtosis"], 6, ("symbol", "n"))


def _moments_sql(round_: bool = True) -> str:
    s = _returns()
    s.ctes.append(f"c AS (SELECT symbol, ret, avg(ret) OVER (PARTITION BY symbol) AS m FROM {s.top} WHERE ret IS NOT NULL)")
    s.ctes.append("g AS (SELECT symbol, count(*) AS n, avg(ret) AS m, avg(ret) / nullif(stddev_samp(ret), 0) AS sh, avg(pow(ret - m, 3)) / pow(avg(pow(ret - m, 2)), 1.5) AS sk, avg(pow(ret - m, 4)) / pow(avg(pow(ret - m, 2)), 2) AS ku FROM c GROUP BY 1)")
    s.top = "g"
    r = lambda e, n: f"round({e} + {NUDGE!r}, 6) + 0.0 AS {n}" if round_ else f"{e} AS {n}"
    return s.select(f"symbol, n, {r('m', 'mean')}, {r('sh', 'sharpe')}, {r('sk', 'skew')}, {r('ku', 'kurtosis')}")


#: A short average's strength with a weight of its own, against a long one's.
_SPACE = {"fast": IntParam(3, 8), "slow": IntParam(12, 24, 4), "weight": FloatParam(0.5, 2.0)}
_TRIALS, _SPLIT = 1000, datetime(2024, 1, 22)


def parameter_search(spark, sf_dir):
    """A thousand trials as data: drawn in columns, scored on bars before and after a time in one scan."""
    trials = D.sampled(spark, _SPACE, _TRIALS, seed=5)
    sma = F.lit("sma")
    found = D.scores(hourly(spark, sf_dir), D.parts(trials, (sma, F.col("fast"), F.col("weight")), (sma, F.col("slow"), F.lit(-0.7))), _SPLIT)
    return rounded(trials.join(found, "trial"), ["weight", "score", "valid_score"], 6, ("trial", "fast", "slow", "n", "valid_n"))


def _search_sql() -> str:
    s = _returns()
    s.add(r="ret", late=f"ts >= TIMESTAMP '{_SPLIT}'")
    periods = [*range(3, 9), *range(12, 25, 4)]
    s.add(**{f"p{n}": f"tanh(coalesce((close - {full('avg', 'close', n)}) / nullif({full('stddev_samp', 'close', n)}, 0), 0))" for n in periods})
    s.add(**{f"q{n}": lag(f"p{n}") for n in periods})
    s.ctes.append("st AS (" + " UNION ALL ".join(f"SELECT symbol, ts, r, late, {n} AS period, q{n} AS q FROM {s.top}" for n in periods) + ")")
    s.ctes.append(f"t AS (SELECT range AS sim FROM range({_TRIALS}))")
    for name, source, k in (("ta", "t", 1), ("tb", "ta", 2), ("tc", "tb", 3)):
        _drawn(s, name, source, "0", k, seed=5)
    s.ctes.append(f"tr AS (SELECT sim AS trial, (3 + d1 % 6)::INT AS fast, (12 + 4 * (d2 % 4))::INT AS slow, (d3 + 0.5) / {float(MC._M)!r}::DOUBLE * 1.5 + 0.5 AS weight FROM tc)")
    s.ctes.append("sg AS (SELECT trial, a.symbol, a.late, a.r, tanh(a.q * weight + b.q * -0.7) AS x FROM tr JOIN st a ON a.period = fast JOIN st b ON b.period = slow AND b.symbol = a.symbol AND b.ts = a.ts WHERE a.q IS NOT NULL AND a.r IS NOT NULL)")
    s.ctes.append("co AS (SELECT trial, symbol, late, count(*) AS n, corr(x, r) AS c FROM sg GROUP BY ALL)")
    s.ctes.append("sc AS (SELECT trial, coalesce(sum(n) FILTER (NOT late), 0)::BIGINT AS n, avg(c) FILTER (NOT late) AS score, coalesce(sum(n) FILTER (late), 0)::BIGINT AS valid_n, avg(c) FILTER (late) AS valid_score FROM co GROUP BY 1)")
    s.top = "tr JOIN sc USING (trial)"
    r = lambda e: f"round({e} + {NUDGE!r}, 6) + 0.0 AS {e}"
    return s.select(f"trial, fast, slow, n, valid_n, {r('weight')}, {r('score')}, {r('valid_score')}")


def signal_search(spark, sf_dir):
    """The same space searched by densities of good and bad trials, a batch at a time."""
    return trials_table(spark, optimize_signals(hourly(spark, sf_dir).cache(), _SPACE, lambda p: [("sma", p["fast"], p["weight"]), ("sma", p["slow"], -0.7)], _SPLIT))


def model_search(spark, sf_dir):
    """Indicators, periods and lags with a network for each trial, 50 trials of 20 epochs: what became of each."""
    specs = [IndicatorSpec("momentum", I.Momentum, 2, 20, (0, 1, 2)), IndicatorSpec("sma", I.SMA, 3, 30), IndicatorSpec("roc", I.ROC, 2, 20, (0, 3)), IndicatorSpec("rsi", I.RSI, 5, 20)]
    search = ModelSearch(hourly(spark, sf_dir).cache(), specs, datetime(2024, 1, 18), datetime(2024, 1, 25), seed=7)
    return trials_table(spark, search.run().trials)


def backtest_search(spark, sf_dir):
    """The same space searched by backtests' returns."""

    def factory(p):
        return Weighted(((I.SMA(period=p["fast"]), p["weight"]), (I.SMA(period=p["slow"]), -0.7)), RULES)

    return trials_table(spark, optimize(hourly(spark, sf_dir).cache(), _SPACE, factory, "total_return"))


def learned(spark, sf_dir):
    names = ["indicator__sma_5", "indicator__momentum_3"]
    frame = X.feature_matrix(hourly(spark, sf_dir), [I.SMA(period=5), I.Momentum(period=3)])
    scaler = X.Scaler.fit(frame, names)
    scaled = scaler.transform(frame).cache()
    net = Network.dense(names, (8,)).fit(scaled)
    return net.predict(scaled).select("symbol", "ts", "prediction")


def queries() -> dict[str, Callable]:
    return {
        "bars_hour": bars_query, "bars_day": daily_bars, "date_slice": date_slice, "strategy_signal": signal, "backtest_equity": equity, "backtest_trades": trade_log, "backtest_metrics": scores,
        "backtest_drawdown": drawdowns, "backtest_protected": protected, "strategy_precomputed": precomputed, "regime_breakdown": regimes, "promotion_gates": gates,
        "target_future": target_query(X.future_return), "target_direction": target_query(X.directional_target), "target_excess_rolling": target_query(lambda b: X.excess_return(b, drift_window=50)),
        "target_excess_expanding": target_query(lambda b: X.excess_return(b, drift_window=50, drift="expanding")), "target_excess_ewma": target_query(lambda b: X.excess_return(b, drift_window=50, drift="ewma")),
        "feature_matrix": feature_rows, "scaler_minmax": minmax_rows, "walk_forward": folds, "losses": losses, "paths_circular": circular_paths, "paths_stationary": resampled("stationary"), "paths_shuffle": resampled("shuffle"), "paths_gbm": resampled("gbm"),
        "monte_carlo": monte_carlo, "sharpe_interval": sharpe_interval, "return_moments": moments, "significance": significance, "path_summary": path_summary, "path_intervals": path_intervals, "parameter_search": parameter_search, "signal_search": signal_search, "backtest_search": backtest_search, "model_search": model_search, "network": learned,
    }


def oracle_sql() -> dict[str, str]:
    prices = {c: c for c in ("open", "high", "low", "close", "volume")}
    future = _log(f"{lead('close', 5)} / nullif(close, 0)")
    return {
        "bars_hour": Steps().rounded(prices),
        "bars_day": DAILY_SQL,
        "date_slice": Steps().rounded({"close": "close"}) + " WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-10'",
        "strategy_signal": _CROSSING.rounded({"signal_strength": "signal_strength"}),
        "backtest_equity": _account_sql().rounded({"equity": "equity"}, 4),
        "backtest_trades": TRADE_SQL,
        "backtest_metrics": _scores_sql(),
        "backtest_drawdown": DRAWDOWN_SQL,
        "strategy_precomputed": PRECOMPUTED_SQL,
        "regime_breakdown": _regimes_sql(),
        "promotion_gates": _gates_sql(),
        "target_future": Steps().rounded({"target": f"tanh(({future}) * 10)"}),
        "target_direction": Steps().rounded({"target": f"sign({lead('close', 5)} - close)"}),
        "target_excess_rolling": _excess_sql("rolling"),
        "target_excess_expanding": _excess_sql("expanding"),
        "feature_matrix": _feature_sql(),
        "scaler_minmax": MINMAX_SQL,
        "walk_forward": FOLDS_SQL,
        "losses": _losses_sql(),
        "paths_circular": _paths_sql("circular"),
        "paths_stationary": _paths_sql("stationary"),
        "paths_shuffle": _paths_sql("shuffle"),
        "paths_gbm": _paths_sql("gbm"),
        "sharpe_interval": _interval_sql(),
        "target_excess_ewma": _excess_sql("ewma"),
        "return_moments": _moments_sql(),
        "significance": _significance_sql(),
        "path_summary": _path_summary_sql(),
        "path_intervals": _path_intervals_sql(),
        "parameter_search": _search_sql(),
    }
