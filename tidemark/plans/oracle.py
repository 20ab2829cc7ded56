"""DuckDB SQL for bar queries, built step by step as common table expressions."""

from __future__ import annotations

BARS = """bars AS (
  SELECT e.event_type AS symbol, date_trunc('hour', e.ts) AS ts, arg_min(e.value, (e.ts, e.event_id)) AS open, max(e.value) AS high,
    min(e.value) AS low, arg_max(e.value, (e.ts, e.event_id)) AS close, count(*)::DOUBLE AS volume
  FROM events e WHERE e.value IS NOT NULL GROUP BY 1, 2)"""
#: Added before rounding on both sides, so that exact halves, which engines round either way, are none.
NUDGE = 1.3e-9
SERIES = "PARTITION BY symbol ORDER BY ts"


def frame(n: int) -> str:
    return f"OVER ({SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {frame(n)} = {n} THEN {agg}({x}) {frame(n)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({SERIES})" if n else x


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) OVER ({SERIES})"


def nz(x: str) -> str:
    return f"nullif({x}, 0)"


def so_far(agg: str, x: str) -> str:
    return f"{agg}({x}) OVER ({SERIES} ROWS UNBOUNDED PRECEDING)"


def spread(v: str, n: int, of: str | None = None) -> str:
    """Strength by a deviation over n bars."""
    return f"tanh(coalesce(({v}) / nullif({full('stddev_samp', of or v, n)}, 0), 0))"


class Steps:
    """Common table expressions, each with further columns over the last."""

    def __init__(self):
        self.ctes, self.top, self.k = [BARS, f"s0 AS (SELECT *, row_number() OVER ({SERIES}) AS rn FROM bars)"], "s0", 0

    def add(self, **columns: str) -> Steps:
        self.k += 1
        extra = ", ".join(f"{e} AS {n}" for n, e in columns.items())
        self.ctes.append(f"s{self.k} AS (SELECT *, {extra} FROM {self.top})")
        self.top = f"s{self.k}"
        return self

    def recur(self, name: str, x: str, first: str, following: str, state: str = "") -> Steps:
        """A column by a recursion: ``first`` over s (the row), ``following`` over e (the row before's y) and s."""
        self.k += 1
        k, src = self.k, self.top
        self.ctes.append(f"r{k} AS (SELECT symbol, rn, {first} AS y FROM (SELECT symbol, rn, {x} FROM {src}) s WHERE rn = 1 UNION ALL SELECT s.symbol, s.rn, {following} FROM r{k} e JOIN (SELECT symbol, rn, {x} FROM {src}) s ON s.symbol = e.symbol AND s.rn = e.rn + 1)")
        self.ctes.append(f"s{k} AS (SELECT p.*, e.y AS {name} FROM {src} p JOIN r{k} e ON e.symbol = p.symbol AND e.rn = p.rn)")
        self.top = f"s{k}"
        return self

    def ewm(self, name: str, x: str, a: float, least: int = 0) -> Steps:
        self.k += 1
        k, src = self.k, self.top
        self.ctes.append(
            f"r{k} AS (SELECT symbol, rn, x::DOUBLE AS y, 1.0::DOUBLE AS old, (x IS NOT NULL)::INT AS n FROM (SELECT symbol, rn, {x} AS x FROM {src}) s WHERE rn = 1 "
            f"UNION ALL SELECT s.symbol, s.rn, CASE WHEN s.x IS NULL THEN e.y WHEN e.y IS NULL THEN s.x WHEN e.y = s.x THEN e.y "
            f"ELSE (e.old * (1 - {a!r}::DOUBLE) * e.y + {a!r}::DOUBLE * s.x) / (e.old * (1 - {a!r}::DOUBLE) + {a!r}::DOUBLE) END, "
            f"CASE WHEN e.y IS NULL OR s.x IS NOT NULL THEN 1.0::DOUBLE ELSE e.old * (1 - {a!r}::DOUBLE) END, e.n + (s.x IS NOT NULL)::INT "
            f"FROM r{k} e JOIN (SELECT symbol, rn, {x} AS x FROM {src}) s ON s.symbol = e.symbol AND s.rn = e.rn + 1)"
        )
        self.ctes.append(f"s{k} AS (SELECT p.*, CASE WHEN e.n >= {least} THEN e.y END AS {name} FROM {src} p JOIN r{k} e ON e.symbol = p.symbol AND e.rn = p.rn)")
        self.top = f"s{k}"
        return self

    def select(self, what: str) -> str:
        return f"WITH RECURSIVE {', '.join(self.ctes)} SELECT {what} FROM {self.top}"

    def rounded(self, columns: dict[str, str], places: int = 6) -> str:
        """symbol, ts and the columns, rounded, minus zero made zero."""
        return self.select("symbol, ts, " + ", ".join(f'round({e} + {NUDGE!r}, {places}) + 0.0 AS "{n}"' for n, e in columns.items()))
