"""Position sizes and protective levels: small objects that the simulator calls with plain numbers.

A bar is a dict of its columns. direction is 1 for a long position, -1 for a
short one.
"""

from __future__ import annotations

from dataclasses import dataclass

Bar = dict


def need(bar: Bar, column: str):
    if column not in bar:
        raise KeyError(f"a bar has no column {column!r}")
    return bar[column]


class Sizer:
    """Units to hold before leverage and contract size."""

    needs_volatility = False

    def size(self, signal: float, equity: float, price: float, volatility: float | None) -> float | None:
        raise NotImplementedError


@dataclass(frozen=True)
class FixedSizer(Sizer):
    """A fixed fraction of equity."""

    fraction: float = 0.02

    def __post_init__(self):
        if not 0 < self.fraction <= 1:
            raise ValueError("fraction must be above 0 and at most 1")

    def size(self, signal, equity, price, volatility):
        return equity * self.fraction / price


@dataclass(frozen=True)
class RiskSizer(Sizer):
    """A fraction of equity at risk, by signal and volatility; nothing without a volatility above zero."""

    max_fraction: float = 0.02
    risk_multiplier: float = 2.0
    needs_volatility = True

    def __post_init__(self):
        if not 0 < self.max_fraction <= 1 or not self.risk_multiplier > 0:
            raise ValueError("max_fraction must be above 0 and at most 1, risk_multiplier positive")

    def size(self, signal, equity, price, volatility):
        if volatility is None or volatility <= 0:
            return 0.0
        return equity * self.max_fraction * abs(signal) / (volatility * self.risk_multiplier)


class Target:
    """A level at entry, or None."""

    def columns(self) -> list[str]:
        return []

    def level(self, entry: float, direction: int, signal: float, bar: Bar) -> float | None:
        raise NotImplementedError


class Stop(Target):
    pass


@dataclass(frozen=True)
class FixedTarget(Target):
    points: float

    def level(self, entry, direction, signal, bar):
        return entry + direction * self.points


@dataclass(frozen=True)
class SignalTarget(Target):
    base_points: float

    def level(self, entry, direction, signal, bar):
        return entry + direction * self.base_points * abs(signal)


@dataclass(frozen=True)
class FixedStop(Stop):
    points: float

    def level(self, entry, direction, signal, bar):
        return entry - direction * self.points


@dataclass(frozen=True)
class SignalStop(Stop):
    base_points: float

    def level(self, entry, direction, signal, bar):
        return entry - direction * self.base_points * abs(signal)


@dataclass(frozen=True)
class ColumnStop(Stop):
    """The value of a column, such as a moving average."""

    column: str

    def columns(self):
        return [self.column]

    def level(self, entry, direction, signal, bar):
        return need(bar, self.column)


def sar_seed(entry: float, direction: int, bar: Bar) -> tuple[float, float]:
    """Where a parabolic stop starts, and its extreme point."""
    if direction == 1:
        return min(entry, bar["low"]), bar["high"]
    return max(entry, bar["high"]), bar["low"]


@dataclass(frozen=True)
class ParabolicStop(Stop):
    """The bar's own column sar if it has one, else one step of a parabolic stop from the entry bar."""

    af_start: float = 0.02
    use_column: bool = False

    def columns(self):
        return ["sar"] if self.use_column else []

    def level(self, entry, direction, signal, bar):
        if bar.get("sar") is not None:
            return bar["sar"]
        seed, extreme = sar_seed(entry, direction, bar)
        return seed + self.af_start * (extreme - seed)


class Trail:
    """A stop that follows the price. start() gives a state and a level, move() the next ones."""

    step_points: float = 10.0

    def columns(self) -> list[str]:
        return []

    def start(self, entry: float, direction: int, signal: float, bar: Bar) -> tuple[tuple, float | None]:
        raise NotImplementedError

    def follow(self, state: tuple, direction: int, signal: float, bar: Bar) -> tuple[tuple, float | None]:
        """The state and the level it would have now, None to stay."""
        raise NotImplementedError

    def move(self, state: tuple, level: float, direction: int, signal: float, bar: Bar) -> tuple[tuple, float]:
        """Moves only by step_points or more, and only the way of the trade."""
        state, new = self.follow(state, direction, signal, bar)
        return state, level if new is None or direction * (new - level) < self.step_points else new


@dataclass(frozen=True)
class FixedTrail(Trail):
    base_points: float
    step_points: float = 10.0

    def start(self, entry, direction, signal, bar):
        return (), entry - direction * self.base_points

    def follow(self, state, direction, signal, bar):
        return state, bar["close"] - direction * self.base_points


@dataclass(frozen=True)
class SignalTrail(Trail):
    base_points: float
    step_points: float = 10.0

    def start(self, entry, direction, signal, bar):
        return (), entry - direction * self.base_points * abs(signal)

    def follow(self, state, direction, signal, bar):
        return state, bar["close"] - direction * self.base_points * abs(signal)


@dataclass(frozen=True)
class ColumnTrail(Trail):
    column: str
    step_points: float = 10.0

    def columns(self):
        return [self.column]

    def start(self, entry, direction, signal, bar):
        return (), need(bar, self.column)

    def follow(self, state, direction, signal, bar):
        return state, need(bar, self.column)


@dataclass(frozen=True)
class ParabolicTrail(Trail):
    """State: acceleration, extreme point, and the stop itself, which goes on moving below the step."""

    af_start: float = 0.02
    af_step: float = 0.02
    af_max: float = 0.2
    step_points: float = 10.0

    def start(self, entry, direction, signal, bar):
        seed, extreme = sar_seed(entry, direction, bar)
        sar = seed + self.af_start * (extreme - seed)
        return (self.af_start, extreme, sar), sar

    def follow(self, state, direction, signal, bar):
        if not state:
            raise RuntimeError("a parabolic trail must be started first")
        af, extreme, sar = state
        reach = bar["high"] if direction == 1 else bar["low"]
        if direction * (reach - extreme) > 0:
            extreme, af = reach, min(af + self.af_step, self.af_max)
        sar += af * (extreme - sar)
        return (af, extreme, sar), sar
