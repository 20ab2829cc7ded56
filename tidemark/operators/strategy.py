"""Strategies: how indicators become the column signal_strength, and when to trade on it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.base import Node, compute, strength_name
from tidemark.operators.risk import Sizer, Stop, Target, Trail

SIGNAL = "signal_strength"


@dataclass(frozen=True)
class Rules:
    """What every strategy decides besides the signal."""

    allow_long: bool = True
    allow_short: bool = True
    entry_threshold: float = 0.5
    exit_threshold: float = 0.1
    sizer: Sizer | None = None
    take_profit: Target | None = None
    stop_loss: Stop | None = None
    trailing_stop: Trail | None = None

    def columns(self) -> list[str]:
        """Columns of a bar that the protective orders read."""
        return sorted({c for o in (self.take_profit, self.stop_loss, self.trailing_stop) if o for c in o.columns()})


@dataclass(frozen=True)
class Weighted:
    """tanh of the weighted sum of strengths; null where one is null."""

    parts: tuple[tuple[Node, float], ...]
    rules: Rules = field(default_factory=Rules)

    def signals(self, bars: DataFrame) -> DataFrame:
        frame = compute(bars, [n for n, _ in self.parts], strengths=True)
        total = sum((F.col(strength_name(n)) * F.lit(float(w)) for n, w in self.parts), F.lit(0.0))
        return frame.withColumn(SIGNAL, F.tanh(total))


@dataclass(frozen=True)
class Precomputed:
    """A signal from another table (symbol, ts, value), by series and time; null where it has none."""

    table: DataFrame
    rules: Rules = field(default_factory=Rules)

    def signals(self, bars: DataFrame) -> DataFrame:
        return bars.join(self.table.select("symbol", "ts", F.col("value").cast("double").alias(SIGNAL)), ["symbol", "ts"], "left")


@dataclass(frozen=True)
class Learned:
    """The output of a fitted network over the indicators' columns; null where a feature is null."""

    network: object
    nodes: tuple[Node, ...]
    rules: Rules = field(default_factory=Rules)

    def signals(self, bars: DataFrame) -> DataFrame:
        frame = compute(bars, list(self.nodes))
        return self.network.predict(frame, SIGNAL)
