"""Kernel regression: a causal weighted mean of the last bars, and bands around it."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import before, full, nz, ratio
from tidemark.operators.base import Node

Kernel = Callable[[float, float], float]


def _within(limit: float, f: Kernel) -> Kernel:
    """f where abs(u) is at most limit, else 0."""
    return lambda u, b: f(u, b) if abs(u) <= limit else 0.0


#: Weight of a distance u in units of the bandwidth b.
KERNELS: dict[str, Kernel] = {
    "triangular": _within(1, lambda u, b: 1 - abs(u)),
    "gaussian": lambda u, b: math.exp(-u * u / 2) / math.sqrt(2 * math.pi),
    "epanechnikov": _within(1, lambda u, b: 0.75 * (1 - u * u)),
    "logistic": lambda u, b: 1 / (math.exp(u) + 2 + math.exp(-u)),
    "log logistic": lambda u, b: 1 / (1 + abs(u)) ** 2,
    "cosine": _within(1, lambda u, b: math.pi / 4 * math.cos(math.pi * u / 2)),
    "sinc": lambda u, b: 1.0 if u == 0 else math.sin(math.pi * u) / (math.pi * u),
    "laplace": lambda u, b: math.exp(-abs(u)) / (2 * b),
    "quartic": _within(1, lambda u, b: 15 / 16 * (1 - u * u) ** 2),
    "parabolic": _within(1, lambda u, b: 1 - u * u),
    "exponential": lambda u, b: math.exp(-abs(u)) / b,
    "silverman": _within(0.5, lambda u, b: 0.5 * math.exp(-u / 2) * math.sin(u / 2 + math.pi / 4)),
    "cauchy": lambda u, b: 1 / (math.pi * b * (1 + u * u)),
    "tent": _within(1, lambda u, b: 1 - abs(u)),
    "wave": _within(1, lambda u, b: (1 - abs(u)) * math.cos(math.pi * u)),
    "power": _within(1, lambda u, b: (1 - abs(u) ** 3) ** 3),
    "morters": _within(math.pi, lambda u, b: (1 + math.cos(u)) / (2 * math.pi * b)),
}
ALIASES = {"square": "quartic", "loglogistic": "log logistic"}


def kernel_name(name: str) -> str:
    """The name of a known kernel for any spelling of it."""
    plain = name.lower().replace("-", " ").replace("_", " ").strip()
    plain = ALIASES.get(plain, plain)
    if plain not in KERNELS:
        raise ValueError(f"unknown kernel {name!r}; one of {', '.join(sorted(KERNELS))}")
    return plain


def weights(kernel: str, bandwidth: int) -> list[float]:
    """Normalised weights of this bar, the one before, and so on; the kernel is taken at squared distances."""
    f = KERNELS[kernel_name(kernel)]
    w = [f(i * i / (bandwidth * bandwidth), 1.0) for i in range(bandwidth)]
    if sum(w) == 0:
        raise ValueError("the kernel's weights sum to zero")
    return [x / sum(w) for x in w]


@dataclass(frozen=True)
class KernelRegression(Node):
    """Estimate, upper and lower band, and the bands' width, over the last ``bandwidth`` bars."""

    kernel: str = "laplace"
    bandwidth: int = 14
    deviations: float = 2.0
    source: str = "close"

    def __post_init__(self):
        super().__post_init__()
        object.__setattr__(self, "kernel", kernel_name(self.kernel))
        if self.bandwidth < 1 or not self.deviations > 0:
            raise ValueError("bandwidth and deviations must be positive")
        weights(self.kernel, self.bandwidth)

    def names(self):
        dev = f"{self.deviations:g}".replace(".", "_")
        end = f"{self.kernel.replace(' ', '_')}_{self.source.lower()}_{self.bandwidth}_{dev}"
        return [f"indicator__kernel_{part}{end}" for part in ("", "upper_", "lower_", "stdev_")]

    @property
    def x(self) -> Column:
        return F.col(self.source.lower())

    def raw(self, bars: DataFrame) -> DataFrame:
        terms = [before(self.x, i) * F.lit(w) for i, w in enumerate(weights(self.kernel, self.bandwidth))]
        bars = bars.withColumn(self.temp(0), sum(terms[1:], terms[0]))
        estimate = F.col(self.temp(0))
        bars = bars.withColumn(self.temp("q"), (self.x - estimate) * (self.x - estimate))
        n = self.bandwidth
        wide = F.lit(0.0) if n == 1 else F.sqrt(full(F.sum, F.col(self.temp("q")), n) / F.lit(n - 1.0)) * F.lit(float(self.deviations))
        bars = bars.withColumn(self.temp(3), wide)
        wide = F.col(self.temp(3))
        return bars.withColumns({self.temp(1): estimate + wide, self.temp(2): estimate - wide})

    def strength(self, estimate, upper, lower, wide):
        scale = F.coalesce(nz(wide), nz(full(F.stddev_samp, self.x, self.bandwidth)))
        return F.tanh(F.coalesce(ratio(self.x - estimate, scale), F.lit(0.0)))

    def strength_reach(self):
        return self.bandwidth

    def crossovers(self, frame: DataFrame) -> DataFrame:
        """frame with bullish and bearish: whether the estimate turned at this bar; never null."""
        e = F.col(self.outputs()[0])
        frame = frame.withColumn("__d", e - before(e))
        d, was = F.col("__d"), before(F.col("__d"))
        flag = lambda c: F.coalesce(c, F.lit(False))
        return frame.withColumns({"bullish": flag((d > 0) & (was < 0)), "bearish": flag((d < 0) & (was > 0))}).drop("__d")

    def lookback(self):
        return 2 * self.bandwidth - 1
