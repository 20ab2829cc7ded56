"""Scores of simulated accounts, and whether they could be luck."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

YEAR = 252
METRICS = ["total_return", "annualized_return", "sharpe_ratio", "sortino_ratio", "max_drawdown", "annual_volatility", "total_trades", "win_rate", "profit_factor", "avg_win", "avg_loss", "avg_trade_bars", "total_commission", "total_financing", "long_win_rate", "short_win_rate", "long_avg_win", "long_avg_loss", "short_avg_win", "short_avg_loss", "rebalance_count"]
#: Rows of thresholds that are broadcast to be held against every value.
MAX_BASELINES = 100_000
_NORMAL = NormalDist()


def _finite(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def equity_steps(result: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """result with ret (change over the bar before, null if not finite) and drawdown from the peak so far."""
    w = Window.partitionBy(*keys).orderBy("ts")
    was, peak = F.lag("equity").over(w), F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ret = F.when(was != 0, F.col("equity") / F.nullif(was, F.lit(0.0)) - 1)
    return result.withColumns({"ret": _finite(ret), "drawdown": (F.col("equity") - peak) / F.nullif(peak, F.lit(0.0))})


def metrics(result: DataFrame, keys: tuple[str, ...] = ("symbol",), risk_free_rate: float = 0.0) -> DataFrame:
    """One row of METRICS a series, of the output of simulate().

    profit_factor is infinite where nothing was lost and NaN without trades;
    a trade without gain counts as lost; what has no cases is 0.
    """
    steps = equity_steps(result, keys)
    t = lambda c: F.col(f"trade.{c}")
    pnl, won, lost = t("pnl"), t("pnl") > 0, t("pnl") <= 0
    mean = lambda x, cond: F.coalesce(F.avg(F.when(cond, x)), F.lit(0.0))
    count = lambda cond: F.count(F.when(cond, 1))
    rate = lambda cond, of: F.coalesce(count(cond) / F.nullif(count(of), F.lit(0)), F.lit(0.0))
    some = F.col("trade").isNotNull()
    sides = []
    for side in ("long", "short"):
        own = t("direction") == side
        sides += [rate(own & won, own).alias(f"{side}_win_rate"), mean(pnl, own & won).alias(f"{side}_avg_win"), mean(pnl, own & lost).alias(f"{side}_avg_loss")]
    g = steps.groupBy(*keys).agg(
        F.min_by("equity", "ts").alias("_first"),
        F.max_by("equity", "ts").alias("_last"),
        F.count("*").alias("_n"),
        (F.stddev_samp("ret") * math.sqrt(YEAR)).alias("_vol"),
        (F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))) * math.sqrt(YEAR)).alias("_down"),
        F.min("drawdown").alias("max_drawdown"),
        count(some).alias("total_trades"),
        rate(won, some).alias("win_rate"),
        F.coalesce(F.sum(F.when(won, pnl)), F.lit(0.0)).alias("_gain"),
        F.abs(F.coalesce(F.sum(F.when(lost, pnl)), F.lit(0.0))).alias("_loss"),
        mean(pnl, won).alias("avg_win"),
        mean(pnl, lost).alias("avg_loss"),
        mean(t("bars_held"), some).alias("avg_trade_bars"),
        F.coalesce(F.sum(t("commission")), F.lit(0.0)).alias("total_commission"),
        F.coalesce(F.sum(t("financing")), F.lit(0.0)).alias("total_financing"),
        *sides,
        F.sum("rebalances").alias("rebalance_count"),
    )
    total = F.when(F.col("_first") > 0, F.coalesce(_finite((F.col("_last") - F.col("_first")) / F.nullif("_first", F.lit(0.0))), F.lit(0.0))).otherwise(F.lit(0.0))
    g = g.withColumn("total_return", total)
    year = F.when(F.col("total_return") <= -1, F.lit(-1.0)).otherwise(F.pow(1 + F.col("total_return"), F.lit(float(YEAR)) / F.col("_n")) - 1)
    g = g.withColumns({"annualized_return": F.coalesce(_finite(year), F.lit(0.0)), "annual_volatility": F.coalesce(_finite(F.col("_vol")), F.lit(0.0)), "_down": F.coalesce(_finite(F.col("_down")), F.lit(0.0))})
    over = lambda vol: F.when(F.col(vol) > 0, (F.col("annualized_return") - risk_free_rate) / F.nullif(vol, F.lit(0.0))).otherwise(F.lit(0.0))
    factor = F.when(F.col("total_trades") == 0, F.lit(float("nan"))).when(F.col("_loss") > 0, F.col("_gain") / F.nullif("_loss", F.lit(0.0))).otherwise(F.lit(float("inf")))
    g = g.withColumns({"sharpe_ratio": over("annual_volatility"), "sortino_ratio": over("_down"), "profit_factor": factor})
    return g.select(*keys, *METRICS)


def long_form(scores: DataFrame, keys: tuple[str, ...] = ("symbol",), names: list[str] | None = None) -> DataFrame:
    """keys, metric, value: a row for each metric."""
    return scores.unpivot(list(keys), [F.col(m).cast("double").alias(m) for m in names or METRICS], "metric", "value")


def probabilistic_sharpe_ratio(sharpe: float, n: int, benchmark: float = 0.0, skew: float = 0.0, kurtosis: float = 3.0) -> float:
    """Probability that the true ratio (per bar, like the given one) is above the benchmark; kurtosis is not excess."""
    if n < 2:
        raise ValueError("n must be at least 2")
    spread = math.sqrt(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2)
    if spread == 0:
        raise ValueError("these moments leave no spread")
    return _NORMAL.cdf((sharpe - benchmark) * math.sqrt(n - 1) / spread)


def expected_max_sharpe(variance: float, n_trials: int) -> float:
    """The best ratio to be expected of so many trials of no skill."""
    if variance < 0:
        raise ValueError("variance must not be negative")
    if n_trials <= 1:
        return 0.0
    gamma = 0.5772156649015329
    z = lambda p: _NORMAL.inv_cdf(1 - 1 / p)
    return math.sqrt(variance) * ((1 - gamma) * z(n_trials) + gamma * z(n_trials * math.e))


def deflated_sharpe_ratio(sharpe: float, n: int, variance: float, n_trials: int, skew: float = 0.0, kurtosis: float = 3.0) -> float:
    return probabilistic_sharpe_ratio(sharpe, n, expected_max_sharpe(variance, n_trials), skew, kurtosis)


def return_moments(returns: DataFrame, keys: tuple[str, ...] = ("symbol",), value: str = "ret") -> DataFrame:
    """n, mean, per-bar Sharpe ratio, skew and kurtosis (not excess) of each series, for the ratios above."""
    x = F.col(value)
    return returns.filter(x.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), (F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0))).alias("sharpe"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurtosis"))


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution's share below z, to some 15 places, by its series."""
    start = F.struct(z.alias("term"), z.alias("total"))
    add = lambda s, k: F.struct((s["term"] * z * z / (2 * k + 1)).alias("term"), (s["total"] + s["term"] * z * z / (2 * k + 1)).alias("total"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(160)), start, add)["total"]
    near = F.lit(0.5) + F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * total
    return F.when(z > 8, F.lit(1.0)).when(z < -8, F.lit(0.0)).otherwise(near)


def significance(moments: DataFrame, n_trials: int | None = None, variance: float | None = None, benchmark: float = 0.0) -> DataFrame:
    """The output of ``return_moments`` with psr, expected_max and deflated: the three ratios above as columns, for any number of series.

    The trials are the table's rows, and variance that of their ratios, unless
    given. Null where a series has fewer than two returns or moments that leave no spread.
    """
    if n_trials is None or variance is None:
        row = moments.agg(F.count("sharpe").alias("n"), F.coalesce(F.var_samp("sharpe"), F.lit(0.0)).alias("v")).first()
        n_trials, variance = row["n"] if n_trials is None else n_trials, row["v"] if variance is None else variance
    top = F.lit(expected_max_sharpe(variance, n_trials))
    sharpe, n = F.col("sharpe"), F.col("n")
    spread = 1 - F.col("skew") * sharpe + (F.col("kurtosis") - 1) / 4 * sharpe * sharpe
    above = lambda level: normal_cdf(F.when((n >= 2) & (spread > 0), (sharpe - level) * F.sqrt(n - 1) / F.sqrt(F.when(spread > 0, spread))))
    return moments.withColumns({"psr": above(F.lit(benchmark)), "expected_max": top, "deflated": above(top)})


def regime_breakdown(returns: DataFrame, regimes: DataFrame, on: tuple[str, ...] = ("ts",), value: str = "ret", label: str = "regime") -> DataFrame:
    """regime, n, mean_return, sharpe (yearly; 0 without spread) of the rows that both tables have."""
    x = F.col(value)
    both = returns.filter(x.isNotNull()).join(regimes.filter(F.col(label).isNotNull()), list(on))
    spread = F.stddev_samp(x)
    return both.groupBy(F.col(label).alias("regime")).agg(F.count("*").alias("n"), F.avg(x).alias("mean_return"), F.when(spread > 0, F.avg(x) / F.nullif(spread, F.lit(0.0)) * math.sqrt(YEAR)).otherwise(F.lit(0.0)).alias("sharpe"))


def promotion_gates(values: DataFrame, baselines: DataFrame, min_margin: float = 0.0) -> DataFrame:
    """Each of values (name, value) against each of baselines (baseline, threshold): strictly above it and the margin.

    The result has a row for each pair. baselines is counted and broadcast
    whole; a table of more than MAX_BASELINES rows is an error, and none of it is left out.
    """
    if baselines.count() > MAX_BASELINES:
        raise ValueError(f"more than {MAX_BASELINES} baselines")
    pairs = values.crossJoin(F.broadcast(baselines))
    return pairs.withColumn("passed", F.col("value") > F.col("threshold") + F.lit(min_margin))


def min_trade_gate(scores: DataFrame, least: int) -> DataFrame:
    return scores.withColumns({"min_trades": F.lit(least), "passed": F.col("total_trades") >= least})
