"""Indicators and the strength of the signal that each gives, from -1 to 1 unless said otherwise."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.linear import Formula, Mean, quotient, span, wilder
from tidemark.functions.windows import before, full, last, nz, positive, ratio
from tidemark.operators.base import Node


def _or(x: Column, value: float) -> Column:
    return F.coalesce(x, F.lit(value))


def _chain(source: str, outs: list[str], n: int) -> list[Mean]:
    """Means of means, the first of source."""
    return [span(out, x, n) for out, x in zip(outs, [source, *outs], strict=False)]


@dataclass(frozen=True)
class _Priced(Node):
    column: str = "close"

    @property
    def x(self) -> Column:
        return F.col(self.column.lower())


# --- moving averages


@dataclass(frozen=True)
class _Average(_Priced):
    period: int = 20

    def names(self):
        return [f"indicator__{type(self).__name__.lower()}_{self.period}"]

    def strength(self, mean):
        return F.tanh(_or(ratio(self.x - mean, full(F.stddev_samp, self.x, self.period)), 0.0))

    def strength_reach(self):
        return self.period


@dataclass(frozen=True)
class SMA(_Average):
    """Mean of the last bars."""

    def raw(self, bars):
        return bars.withColumn(self.temp(0), full(F.avg, self.x, self.period))

    def lookback(self):
        return self.period


@dataclass(frozen=True)
class WMA(_Average):
    """Mean with weights that rise by one up to this bar."""

    def raw(self, bars):
        n = self.period
        total = sum((before(self.x, n - 1 - k) * F.lit(k + 1.0) for k in range(n)), F.lit(0.0))
        return bars.withColumn(self.temp(0), total / F.lit(n * (n + 1) / 2))

    def lookback(self):
        return self.period


@dataclass(frozen=True)
class CMA(_Average):
    """Mean of all bars so far, from the period-th value on."""

    def inputs(self, bars):
        return bars.withColumn(self.temp("one"), F.when(self.x.isNotNull(), F.lit(1.0)))

    def sums(self):
        return {self.temp("n"): self.temp("one"), self.temp("s"): self.column.lower()}

    def raw(self, bars):
        n = F.col(self.temp("n"))
        return bars.withColumn(self.temp(0), F.when(n >= self.period, F.col(self.temp("s")) / nz(n)))


@dataclass(frozen=True)
class EMA(_Average):
    """Exponential mean."""

    def steps(self):
        return _chain(self.column.lower(), [self.temp(0)], self.period)


@dataclass(frozen=True)
class DEMA(_Average):
    """Twice the exponential mean less the mean of the mean."""

    def steps(self):
        return _chain(self.column.lower(), [self.temp("e1"), self.temp("e2")], self.period)

    def raw(self, bars):
        return bars.withColumn(self.temp(0), 2 * F.col(self.temp("e1")) - F.col(self.temp("e2")))


@dataclass(frozen=True)
class TEMA(_Average):
    """Three exponential means combined to take out their delay."""

    def steps(self):
        return _chain(self.column.lower(), [self.temp(f"e{k}") for k in (1, 2, 3)], self.period)

    def raw(self, bars):
        e1, e2, e3 = (F.col(self.temp(f"e{k}")) for k in (1, 2, 3))
        return bars.withColumn(self.temp(0), 3 * e1 - 3 * e2 + e3)


# --- oscillators


@dataclass(frozen=True)
class RSI(_Priced):
    """Relative strength of gains and losses; null where nothing was lost."""

    period: int = 14

    def names(self):
        return [f"indicator__rsi_{self.period}"]

    def inputs(self, bars):
        return bars.withColumn(self.temp("d"), self.x - before(self.x))

    def steps(self):
        d, up, down, gain, loss = (self.temp(c) for c in ("d", "up", "down", "gain", "loss"))
        return [
            Formula(up, (d,), lambda x: np.maximum(x, 0.0), hidden=True),
            Formula(down, (d,), lambda x: np.maximum(-x, 0.0), hidden=True),
            wilder(gain, up, self.period, least=self.period, hidden=True),
            wilder(loss, down, self.period, least=self.period, hidden=True),
            Formula(self.temp(0), (gain, loss), lambda g, lost: 100.0 - 100.0 / (1.0 + quotient(g, lost))),
        ]

    def strength(self, rsi):
        return F.tanh((50 - rsi) / 20)


@dataclass(frozen=True)
class MACD(_Priced):
    """Difference of two exponential means, and its own mean over nine bars; the strength is that mean, unbounded."""

    fast: int = 12
    slow: int = 26

    def names(self):
        return [f"indicator__macd_{self.fast}_{self.slow}", f"indicator__macd_signal_{self.fast}_{self.slow}"]

    def steps(self):
        x, f, s = self.column.lower(), self.temp("f"), self.temp("s")
        return [span(f, x, self.fast, hidden=True), span(s, x, self.slow, hidden=True), Formula(self.temp(0), (f, s), np.subtract), span(self.temp(1), self.temp(0), 9)]

    def strength(self, macd, signal):
        return _or(signal, 0.0)


@dataclass(frozen=True)
class Momentum(_Priced):
    """Change over the period."""

    period: int = 14

    def names(self):
        return [f"indicator__momentum_{self.period}"]

    def raw(self, bars):
        return bars.withColumn(self.temp(0), self.x - before(self.x, self.period))

    def strength(self, m):
        return F.signum(m)

    def lookback(self):
        return self.period + 1


@dataclass(frozen=True)
class LarryWilliams(_Priced):
    """Place of the price in the range of the period, from 0 at its top to -100."""

    period: int = 14

    def names(self):
        return [f"indicator__lw_{self.period}"]

    def raw(self, bars):
        top, bottom = full(F.max, F.col("high"), self.period), full(F.min, F.col("low"), self.period)
        return bars.withColumn(self.temp(0), ratio(top - self.x, top - bottom) * -100)

    def strength(self, v):
        return F.tanh((-50 - v) / 20)

    def lookback(self):
        return self.period


@dataclass(frozen=True)
class BollingerBands(_Priced):
    """Mean and bands of standard deviations around it."""

    period: int = 20
    num_deviations: float = 2

    def names(self):
        return [f"indicator__bb_{b}_{self.period}" for b in ("upper", "middle", "lower")]

    def raw(self, bars):
        mean, wide = full(F.avg, self.x, self.period), full(F.stddev_samp, self.x, self.period) * F.lit(float(self.num_deviations))
        return bars.withColumns({self.temp(0): mean + wide, self.temp(1): mean, self.temp(2): mean - wide})

    def strength(self, upper, middle, lower):
        return F.tanh((0.5 - _or(ratio(self.x - lower, upper - lower), 0.5)) * 4)

    def lookback(self):
        return self.period


@dataclass(frozen=True)
class CCI(Node):
    """Distance of the typical price from its mean, by its mean absolute deviation."""

    period: int = 14

    def names(self):
        return [f"indicator__cci_{self.period}"]

    def raw(self, bars):
        tp = (F.col("high") + F.col("low") + F.col("close")) / 3
        bars = bars.withColumn(self.temp("t"), tp)
        t = F.col(self.temp("t"))
        bars = bars.withColumns({self.temp("m"): full(F.avg, t, self.period), self.temp("w"): F.collect_list(t).over(last(self.period))})
        m = F.col(self.temp("m"))
        off = F.aggregate(self.temp("w"), F.lit(0.0), lambda s, v: s + F.abs(v - m)) / F.lit(float(self.period))
        return bars.withColumn(self.temp(0), ratio(t - m, F.lit(0.015) * off))

    def strength(self, cci):
        return F.tanh(-cci / 100)

    def lookback(self):
        return self.period


@dataclass(frozen=True)
class Stochastic(Node):
    """Place of the close in the range of the period, slowed; and the mean of that."""

    k_period: int = 14
    d_period: int = 3
    slowing: int = 3

    def names(self):
        return [f"indicator__stoch_{x}_{self.k_period}_{self.d_period}_{self.slowing}" for x in "kd"]

    def raw(self, bars):
        bottom, top = full(F.min, F.col("low"), self.k_period), full(F.max, F.col("high"), self.k_period)
        bars = bars.withColumn(self.temp("r"), ratio(F.col("close") - bottom, top - bottom) * 100)
        bars = bars.withColumn(self.temp(0), full(F.avg, F.col(self.temp("r")), self.slowing))
        return bars.withColumn(self.temp(1), full(F.avg, F.col(self.temp(0)), self.d_period))

    def strength(self, k, d):
        return F.tanh((50 - _or(k, 50.0)) / 20)

    def lookback(self):
        return self.k_period + self.d_period + self.slowing - 2


@dataclass(frozen=True)
class _Spread(_Priced):
    """Strength by the indicator's own deviation over the period."""

    period: int = 14

    def strength(self, v):
        return F.tanh(_or(ratio(v, full(F.stddev_samp, v, self.period)), 0.0))

    def strength_reach(self):
        return self.period


@dataclass(frozen=True)
class ROC(_Spread):
    """Change over the period in per cent."""

    period: int = 12

    def names(self):
        return [f"indicator__roc_{self.period}"]

    def raw(self, bars):
        was = nz(before(self.x, self.period))
        return bars.withColumn(self.temp(0), (self.x - was) / was * 100)

    def lookback(self):
        return self.period + 1


@dataclass(frozen=True)
class TRIX(_Spread):
    """Change in per cent of a threefold exponential mean."""

    def names(self):
        return [f"indicator__trix_{self.period}"]

    def steps(self):
        return _chain(self.column.lower(), [self.temp(f"e{k}") for k in (1, 2, 3)], self.period)

    def raw(self, bars):
        e = F.col(self.temp("e3"))
        return bars.withColumn(self.temp(0), (ratio(e, before(e)) - 1) * 100)

    def reach(self):
        return 2


@dataclass(frozen=True)
class DPO(_Priced):
    """Price less a mean over half the period and one."""

    period: int = 20

    def names(self):
        return [f"indicator__dpo_{self.period}"]

    def raw(self, bars):
        return bars.withColumn(self.temp(0), self.x - full(F.avg, self.x, self.period // 2 + 1))

    def strength(self, dpo):
        return F.tanh(_or(ratio(dpo, full(F.stddev_samp, self.x, self.period)), 0.0))

    def lookback(self):
        return self.period


def _four(x: Column) -> Column:
    """Weights 1, 2, 2, 1 over this and the three bars before."""
    return (x + 2 * before(x, 1) + 2 * before(x, 2) + before(x, 3)) / 6


@dataclass(frozen=True)
class RVI(Node):
    """Smoothed moves within bars over smoothed ranges, and its smoothing."""

    period: int = 10

    def names(self):
        return [f"indicator__rvi_{self.period}", f"indicator__rvi_signal_{self.period}"]

    def raw(self, bars):
        bars = bars.withColumns({self.temp("m"): _four(F.col("close") - F.col("open")), self.temp("r"): _four(F.col("high") - F.col("low"))})
        total = lambda c: full(F.sum, F.col(self.temp(c)), self.period)
        bars = bars.withColumn(self.temp(0), ratio(total("m"), total("r")))
        return bars.withColumn(self.temp(1), _four(F.col(self.temp(0))))

    def strength(self, rvi, signal):
        return F.tanh(_or(rvi, 0.0) * 5)

    def lookback(self):
        return self.period + 6


@dataclass(frozen=True)
class DeMarker(Node):
    """Rises of highs against falls of lows."""

    period: int = 14

    def names(self):
        return [f"indicator__demarker_{self.period}"]

    def raw(self, bars):
        h, low = F.col("high"), F.col("low")
        bars = bars.withColumns({self.temp("u"): positive(h - before(h)), self.temp("d"): positive(before(low) - low)})
        up, down = (full(F.avg, F.col(self.temp(c)), self.period) for c in "ud")
        return bars.withColumn(self.temp(0), ratio(up, up + down))

    def strength(self, d):
        return F.tanh((0.5 - _or(d, 0.5)) * 6)

    def lookback(self):
        return self.period + 1


# --- volume


@dataclass(frozen=True)
class OBV(Node):
    """Change over the period of volume signed by the close's direction, by that sum's deviation."""

    period: int = 14

    def names(self):
        return [f"indicator__obv_roc_{self.period}"]

    def inputs(self, bars):
        c = F.col("close")
        return bars.withColumn(self.temp("v"), F.signum(c - before(c)) * F.col("volume"))

    def sums(self):
        return {self.temp("all"): self.temp("v")}

    def raw(self, bars):
        bars = bars.withColumn(self.temp("s"), F.when(F.col(self.temp("v")).isNotNull(), F.col(self.temp("all"))))
        s = F.col(self.temp("s"))
        return bars.withColumn(self.temp(0), ratio(s - before(s, self.period), full(F.stddev_samp, s, self.period)))

    def reach(self):
        return self.period + 1

    def strength(self, v):
        return F.tanh(_or(v, 0.0))


@dataclass(frozen=True)
class ForceIndex(Node):
    """Exponential mean of volume times the close's change."""

    period: int = 13

    def names(self):
        return [f"indicator__force_{self.period}"]

    def inputs(self, bars):
        c = F.col("close")
        return bars.withColumn(self.temp("v"), F.col("volume") * (c - before(c)))

    def steps(self):
        return _chain(self.temp("v"), [self.temp(0)], self.period)

    def strength(self, f):
        return F.tanh(_or(ratio(f, full(F.stddev_samp, f, self.period)), 0.0))

    def strength_reach(self):
        return self.period


@dataclass(frozen=True)
class CHO(Node):
    """Two exponential means of accumulated volume, by the close's place in the bar."""

    fast: int = 3
    slow: int = 10

    def names(self):
        return [f"indicator__cho_{self.fast}_{self.slow}"]

    def inputs(self, bars):
        h, low, c = F.col("high"), F.col("low"), F.col("close")
        flow = ratio((c - low) - (h - c), h - low) * F.col("volume")
        return bars.withColumn(self.temp("flow"), flow)

    def sums(self):
        return {self.temp("all"): self.temp("flow")}

    def steps(self):
        ad, f, s = (self.temp(c) for c in ("ad", "f", "s"))
        return [
            Formula(ad, (self.temp("all"), self.temp("flow")), lambda total, flow: np.where(np.isnan(flow), np.nan, total), hidden=True),
            span(f, ad, self.fast, hidden=True),
            span(s, ad, self.slow, hidden=True),
            Formula(self.temp(0), (f, s), np.subtract),
        ]

    def strength(self, v):
        return F.tanh(_or(ratio(v, full(F.stddev_samp, v, self.slow)), 0.0))

    def strength_reach(self):
        return self.slow


# --- trend


def true_range() -> Column:
    """Greatest of the range and the distances from the close before; on the first bar the range."""
    h, low, was = F.col("high"), F.col("low"), before(F.col("close"))
    return F.greatest(h - low, F.abs(h - was), F.abs(low - was))


@dataclass(frozen=True)
class ADX(Node):
    """Directional movement: its strength, and the parts up and down."""

    period: int = 14

    def names(self):
        return [f"indicator__adx_{self.period}", f"indicator__adx_plus_di_{self.period}", f"indicator__adx_minus_di_{self.period}"]

    def inputs(self, bars):
        h, low = F.col("high"), F.col("low")
        up, down = h - before(h), before(low) - low
        return bars.withColumns({self.temp("tr"): true_range(), self.temp("p"): _or(F.when((up > down) & (up > 0), up), 0.0), self.temp("m"): _or(F.when((down > up) & (down > 0), down), 0.0)})

    def steps(self):
        means = [wilder(self.temp(f"{c}_mean"), self.temp(c), self.period, hidden=True) for c in ("tr", "p", "m")]
        r, p, m = (o.out for o in means)
        plus, minus, dx = self.temp(1), self.temp(2), self.temp("dx")
        return [
            *means,
            *[Formula(out, (x, r), lambda x, r: quotient(100 * x, r)) for out, x in ((plus, p), (minus, m))],
            Formula(dx, (plus, minus), lambda p, m: quotient(100 * np.abs(p - m), p + m), hidden=True),
            wilder(self.temp(0), dx, self.period),
        ]

    def strength(self, adx, plus, minus):
        return _or(ratio(plus - minus, plus + minus) * F.tanh(adx / 25), 0.0)


@dataclass(frozen=True)
class ATR(Node):
    """Exponential mean of the true range; has no strength."""

    period: int = 14

    def names(self):
        return [f"indicator__atr_{self.period}"]

    def inputs(self, bars):
        return bars.withColumn(self.temp("tr"), true_range())

    def steps(self):
        return [wilder(self.temp(0), self.temp("tr"), self.period)]


@dataclass(frozen=True)
class MassIndex(Node):
    """Sum of the ratio of the range's mean to the mean of that."""

    ema_period: int = 9
    sum_period: int = 25

    def names(self):
        return [f"indicator__mi_{self.ema_period}_{self.sum_period}"]

    def inputs(self, bars):
        return bars.withColumn(self.temp("r"), F.col("high") - F.col("low"))

    def steps(self):
        return _chain(self.temp("r"), [self.temp("e1"), self.temp("e2")], self.ema_period)

    def raw(self, bars):
        bars = bars.withColumn(self.temp("q"), ratio(F.col(self.temp("e1")), F.col(self.temp("e2"))))
        return bars.withColumn(self.temp(0), full(F.sum, F.col(self.temp("q")), self.sum_period))

    def reach(self):
        return self.sum_period

    def strength(self, mi):
        return F.tanh((26.75 - _or(mi, 26.75)) / 1.5)


def engine_atr(bars: DataFrame, period: int = 14, name: str = "atr") -> DataFrame:
    """bars with a plain mean of true ranges, that of the first bar of a series left out; the simulator's volatility."""
    was = before(F.col("close"))
    bars = bars.withColumn("__tr", F.when(was.isNotNull(), true_range()))
    return bars.withColumn(name, full(F.avg, F.col("__tr"), period)).drop("__tr")
