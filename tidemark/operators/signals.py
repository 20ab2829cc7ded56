"""Signals: log returns, Heikin-Ashi candles, cycles of the calendar, columns from elsewhere."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.linear import Linear
from tidemark.functions.windows import before, log, ratio
from tidemark.operators.base import Node
from tidemark.sources.bars import PRICES

#: Calendar components: column of ts to a number; Monday is 0.
COMPONENTS: dict[str, Callable[[Column], Column]] = {
    "hour": F.hour,
    "day_of_week": F.weekday,
    "day_of_month": F.dayofmonth,
    "month": F.month,
    "day_of_year": F.dayofyear,
}


@dataclass(frozen=True)
class LogReturns(Node):
    """Log of each price over the close before."""

    def names(self):
        return [f"signal__log_return_{p}" for p in PRICES]

    def raw(self, bars: DataFrame) -> DataFrame:
        return bars.withColumns({self.temp(k): log(ratio(F.col(p), before(F.col("close")))) for k, p in enumerate(PRICES)})

    def lookback(self):
        return 2


@dataclass(frozen=True)
class HeikinAshi(Node):
    """Smoothed candles as log returns over the smoothed close before."""

    def names(self):
        return [f"signal__ha_{p}" for p in PRICES]

    def inputs(self, bars):
        close = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
        bars = bars.withColumns({self.temp("c"): close, self.temp("f"): before(F.lit(1)).isNull()})
        first = F.col(self.temp("f"))
        # the first open is the bar's own middle, a later one the mean of the smoothed open and close before it
        return bars.withColumns({self.temp("a"): F.when(first, F.lit(0.0)).otherwise(F.lit(0.5)), self.temp("b"): F.when(first, (F.col("open") + F.col("close")) / 2).otherwise(before(close) / 2)})

    def steps(self):
        return [Linear(self.temp("o"), self.temp("b"), self.temp("a"))]

    def reach(self):
        return 2

    def raw(self, bars):
        o, c = F.col(self.temp("o")), F.col(self.temp("c"))
        candle = [o, F.greatest("high", o, c), F.least("low", o, c), c]
        return bars.withColumns({self.temp(k): log(ratio(x, before(c))) for k, x in enumerate(candle)})


@dataclass(frozen=True)
class Cyclical(Node):
    """Sine and cosine of a calendar component over a period."""

    component: str = "hour"
    period: float = 24

    def __post_init__(self):
        super().__post_init__()
        if self.component not in COMPONENTS:
            raise ValueError(f"unknown component {self.component}; one of {sorted(COMPONENTS)}")
        if not self.period > 0:
            raise ValueError("period must be positive")

    def names(self):
        period = int(self.period) if float(self.period).is_integer() else self.period
        return [f"signal__{self.component}_p{period}_{f}" for f in ("sin", "cos")]

    def raw(self, bars):
        import math

        angle = COMPONENTS[self.component](F.col("ts")) * F.lit(2 * math.pi) / F.lit(float(self.period))
        return bars.withColumns({self.temp(0): F.sin(angle), self.temp(1): F.cos(angle)})

    def lookback(self):
        return 1


@dataclass(frozen=True)
class External(Node):
    """A column of the bars table itself, as joined on by the user, perhaps normalised."""

    column: str = ""
    name: str | None = None
    normalization: Callable[[Column], Column] | None = None

    def names(self):
        name = self.name or re.sub(r"[ .\-]", "_", self.column.lower())
        return [f"indicator__{name}__lag_0"]

    def raw(self, bars):
        if self.column not in bars.columns:
            raise KeyError(self.column)
        x = F.col(f"`{self.column}`")
        return bars.withColumn(self.temp(0), self.normalization(x) if self.normalization else x)

    def lookback(self):
        return 1


def join_external(bars: DataFrame, other: DataFrame, columns: list[str], keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """bars left-joined with columns of another table by series and time; bars without a match have nulls."""
    return bars.join(other.select(*keys, *columns), list(keys), "left")
