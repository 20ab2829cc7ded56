"""Linear recursions over ordered series, as arrays: exponential means and what else has the form y' = a y + b.

A recursion over a range of rows is an affine map of the state before it, and maps
of neighbouring ranges compose. So a series need not be one ordered pass: each
block of rows gives its map, the maps of a series are folded, and a second pass
starts each block from its own state (``functions.blocks``). Inside a block the
same composition works on columns of an array, not on one row after the other.

Missing values are NaN in arrays and null in tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

_CHUNK = 64


def affine(alpha: np.ndarray, beta: np.ndarray, start: float) -> np.ndarray:
    """y[i] = alpha[i] y[i - 1] + beta[i], with y[-1] = start: maps of chunks side by side, then their ends the same way."""
    n = len(alpha)
    if n <= _CHUNK:
        out = np.empty(n)
        y = start
        for i, (a, b) in enumerate(zip(alpha.tolist(), beta.tolist(), strict=True)):
            y = a * y + b
            out[i] = y
        return out
    rows = -(-n // _CHUNK)
    a, b = np.ones(rows * _CHUNK), np.zeros(rows * _CHUNK)
    a[:n], b[:n] = alpha, beta
    a, b = a.reshape(rows, _CHUNK).T.copy(), b.reshape(rows, _CHUNK).T.copy()
    for c in range(1, _CHUNK):
        b[c] += a[c] * b[c - 1]
        a[c] *= a[c - 1]
    ends = affine(a[-1], b[-1], start)
    before = np.concatenate([[start], ends[:-1]])
    return (a * before + b).T.reshape(-1)[:n]


def composed(alpha: np.ndarray, beta: np.ndarray) -> tuple[float, float]:
    """The map of a whole range: y after it is the first times y before it plus the second."""
    b = affine(alpha, beta, 0.0)
    return float(np.prod(alpha)), float(b[-1]) if len(b) else 0.0


@dataclass(frozen=True)
class Mean:
    """Exponential mean of ``source`` with weight ``a``, not adjusted.

    A missing value leaves the mean standing but lets its weight fade: after so
    many rows without one it weighs (1 - a) to their number and one. Null before ``least`` values.
    """

    out: str
    source: str
    a: float
    least: int = 0
    hidden: bool = False

    #: state: the mean, rows since the last value, values so far
    EMPTY = (np.nan, 0.0, 0.0)

    def reads(self) -> tuple[str, ...]:
        return (self.source,)

    def _maps(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maps of all values but the first."""
        w = (1.0 - self.a) ** np.diff(at)
        return w / (w + self.a), self.a * x[at[1:]] / (w + self.a)

    def _first(self, state, place: float, x: float) -> float:
        y, gap, n = state
        if not n:
            return x
        w = (1.0 - self.a) ** (gap + place + 1)
        return (w * y + self.a * x) / (w + self.a)

    def run(self, columns: dict, state: tuple) -> tuple[np.ndarray, tuple]:
        x = columns[self.source]
        at = np.flatnonzero(~np.isnan(x))
        y, gap, n = state
        if not len(at):
            return np.full(len(x), y if n >= self.least else np.nan), (y, gap + len(x), n)
        first = self._first(state, float(at[0]), float(x[at[0]]))
        alpha, beta = self._maps(x, at)
        means = np.concatenate([[first], affine(alpha, beta, first)])
        seen = np.cumsum(~np.isnan(x))
        out = np.where(seen > 0, means[np.maximum(seen - 1, 0)], y)
        out[seen + n < self.least] = np.nan
        return out, (float(means[-1]), float(len(x) - 1 - at[-1]), n + len(at))

    #: of a block: rows, place of the first value (or -1), that value, the map of the others, rows after the last, values
    def summary(self, columns: dict) -> list[float]:
        x = columns[self.source]
        at = np.flatnonzero(~np.isnan(x))
        if not len(at):
            return [float(len(x)), -1.0, 0.0, 1.0, 0.0, 0.0, 0.0]
        a, b = composed(*self._maps(x, at))
        return [float(len(x)), float(at[0]), float(x[at[0]]), a, b, float(len(x) - 1 - at[-1]), float(len(at))]

    def after(self, state: tuple, summary: list[float]) -> tuple:
        rows, place, x, a, b, gap, count = summary
        if place < 0:
            return (state[0], state[1] + rows, state[2])
        return (a * self._first(state, place, x) + b, gap, state[2] + count)


@dataclass(frozen=True)
class Linear:
    """y' = alpha y + beta from 0 on; alpha and beta are columns, alpha may be a number. A missing one makes all later values null."""

    out: str
    beta: str
    alpha: str | float = 1.0
    hidden: bool = False

    EMPTY = (0.0,)

    def reads(self) -> tuple[str, ...]:
        return (self.beta, self.alpha) if isinstance(self.alpha, str) else (self.beta,)

    def _maps(self, columns: dict) -> tuple[np.ndarray, np.ndarray]:
        beta = columns[self.beta]
        return columns[self.alpha] if isinstance(self.alpha, str) else np.full(len(beta), float(self.alpha)), beta

    def run(self, columns: dict, state: tuple) -> tuple[np.ndarray, tuple]:
        alpha, beta = self._maps(columns)
        y = np.cumsum(np.concatenate([state, beta]))[1:] if self.alpha == 1.0 else affine(alpha, beta, state[0])
        return y, (float(y[-1]),) if len(y) else state

    def summary(self, columns: dict) -> list[float]:
        return list(composed(*self._maps(columns)))

    def after(self, state: tuple, summary: list[float]) -> tuple:
        return (summary[0] * state[0] + summary[1],)


@dataclass(frozen=True)
class Formula:
    """A column of arrays of the same row; no recursion."""

    out: str
    sources: tuple[str, ...]
    f: Callable[..., np.ndarray]
    hidden: bool = False

    def reads(self) -> tuple[str, ...]:
        return self.sources


Op = Mean | Linear | Formula


def span(out: str, source: str, n: int, **more) -> Mean:
    return Mean(out, source, 2.0 / (n + 1), **more)


def wilder(out: str, source: str, n: int, **more) -> Mean:
    return Mean(out, source, 1.0 / n, **more)


def inputs_of(ops: list[Op]) -> list[str]:
    """Columns that the ops read and none of them makes."""
    made = {o.out for o in ops}
    return list(dict.fromkeys(c for o in ops for c in o.reads() if c not in made))


def levels(ops: list[Op]) -> dict[str, int]:
    """How many recursions each op's value goes through, itself included."""
    level: dict[str, int] = {}
    for o in ops:  # an op comes after those that it reads
        below = max((level.get(c, 0) for c in o.reads()), default=0)
        level[o.out] = below if isinstance(o, Formula) else below + 1
    return level


def evaluate(ops: list[Op], columns: dict[str, np.ndarray], states: dict[str, tuple]) -> dict[str, np.ndarray]:
    """columns with the ops' values over a range of rows; states, by op, move on to its end."""
    columns = dict(columns)
    with np.errstate(all="ignore"):
        for o in ops:
            if isinstance(o, Formula):
                columns[o.out] = o.f(*(columns[c] for c in o.sources))
            else:
                columns[o.out], states[o.out] = o.run(columns, states.get(o.out, o.EMPTY))
    return columns


def quotient(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x / y, missing where y is 0."""
    return np.where(y == 0, np.nan, x / np.where(y == 0, 1.0, y))
