"""The trading simulator: one ordered pass over each series of a signal table.

A series is a symbol, and a run where many runs share one job. A task holds
the state of one open position and nothing else.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.recursions import scan
from tidemark.operators.indicators import engine_atr
from tidemark.operators.strategy import SIGNAL, Rules

#: Decimal places of sizes where no sizer is given.
SIZE_PLACES = 2
#: Bars of the volatility that sizers may use.
ATR_PERIOD = 14


@dataclass(frozen=True)
class Account:
    initial_capital: float = 100_000.0
    commission: float = 0.001
    slippage: float = 0.0005
    risk_free_rate: float = 0.0
    leverage: float = 1.0
    contract_size: float = 1.0
    maintenance_margin: float = 0.5
    financing_rate: float = 0.0
    execute_on: str = "close"
    rebalance_band: float | None = None

    def __post_init__(self):
        for ok, what in (
            (self.leverage >= 1, "leverage must be at least 1"),
            (self.contract_size > 0, "contract_size must be positive"),
            (0 <= self.maintenance_margin < 1, "maintenance_margin must be from 0 to below 1"),
            (math.isfinite(self.financing_rate), "financing_rate must be finite"),
            (self.execute_on in ("close", "next_open"), "execute_on must be close or next_open"),
            (self.rebalance_band is None or self.rebalance_band > 0, "rebalance_band must be positive"),
        ):
            if not ok:
                raise ValueError(what)


def trade_type(ts: T.DataType) -> T.StructType:
    f, d = T.StructField, T.DoubleType()
    return T.StructType([f("direction", T.StringType()), f("entry_date", ts), f("exit_date", ts), f("entry_price", d), f("exit_price", d), f("size", d), f("pnl", d), f("commission", d), f("financing", d), f("bars_held", T.IntegerType()), f("exit_reason", T.StringType()), f("rebalance_count", T.IntegerType())])


class Fold:
    """One account going through the bars of one series."""

    def __init__(self, rules: Rules, account: Account, columns: tuple[str, ...] = ()):
        self.r, self.a, self.columns = rules, account, columns
        self.cash = account.initial_capital
        self.units, self.direction, self.bar_no = 0.0, 0, -1
        self.last_signal, self.last_equity = None, account.initial_capital
        self._flat()

    def _flat(self) -> None:
        self.direction, self.units = 0, 0.0
        self.target = self.stop = self.trail = None
        self.trail_state: tuple = ()
        self.gained = self.reduced_comm = 0.0
        self.rebalances = 0

    def _worth(self, price: float) -> float:
        return self.cash + self.direction * self.units * price * self.a.contract_size

    def _size(self, signal: float, equity: float, price: float, atr: float | None) -> float:
        a = self.a
        if self.r.sizer is None:
            return round(equity * a.leverage / (price * a.contract_size), SIZE_PLACES)
        return (self.r.sizer.size(signal, equity, price, atr) or 0.0) * a.leverage / a.contract_size

    def _binding(self) -> tuple[float, str] | None:
        """The protective level that an adverse move meets first; of equal ones trail, stop, liquidation."""
        d, levels = self.direction, []
        if self.trail is not None:
            levels.append((self.trail, "ts"))
        if self.stop is not None:
            levels.append((self.stop, "sl"))
        if self.a.leverage > 1:
            levels.append(((self.a.maintenance_margin * self.margin - self.cash) / (d * self.units * self.a.contract_size), "liquidation"))
        return max(levels, key=lambda x: d * x[0]) if levels else None

    def _close(self, ts, price: float, reason: str) -> dict:
        a, d = self.a, self.direction
        notional = self.units * price * a.contract_size
        comm = notional * a.commission
        self.cash += d * notional - comm
        opened = self.units * self.entry_price * a.contract_size
        pnl = d * (notional - opened) - comm - self.entry_comm - self.financing + self.gained
        trade = {
            "direction": "long" if d == 1 else "short",
            "entry_date": self.entry_date,
            "exit_date": ts,
            "entry_price": self.entry_price,
            "exit_price": price,
            "size": self.units,
            "pnl": pnl,
            "commission": self.entry_comm + comm + self.reduced_comm,
            "financing": self.financing,
            "bars_held": self.bar_no - self.entry_bar,
            "exit_reason": reason,
            "rebalance_count": self.rebalances,
        }
        self._flat()
        return trade

    def _open(self, ts, direction: int, signal: float, fill: float, atr: float | None, bar: dict) -> None:
        a, r = self.a, self.r
        price = fill * (1 + direction * a.slippage)
        units = self._size(signal, self.cash, price, atr)
        if not units > 0:
            return
        notional = units * price * a.contract_size
        self.entry_comm = notional * a.commission
        self.cash -= direction * notional + self.entry_comm
        self._flat()
        self.units, self.direction, self.entry_price, self.entry_date, self.entry_bar = units, direction, price, ts, self.bar_no
        self.financing, self.margin = 0.0, notional / a.leverage
        if r.take_profit:
            self.target = r.take_profit.level(price, direction, signal, bar)
        if r.stop_loss:
            self.stop = r.stop_loss.level(price, direction, signal, bar)
        if r.trailing_stop:
            self.trail_state, self.trail = r.trailing_stop.start(price, direction, signal, bar)

    def _rebalance(self, signal: float, fill: float, price: float, atr: float | None) -> int:
        """Trade the difference to the size that the signal asks for now, if it is beyond the band; never closes."""
        a, d = self.a, self.direction
        equity = self._worth(price)
        if equity <= 0:
            return 0
        reference = fill * (1 + d * a.slippage)
        wanted = self._size(signal, equity, reference, atr)
        units = abs(wanted - self.units)
        if not wanted > 0 or not units / self.units > a.rebalance_band:
            return 0
        more = wanted > self.units
        at = reference if more else fill * (1 - d * a.slippage)
        notional = units * at * a.contract_size
        comm = notional * a.commission
        if more:
            self.entry_price = (self.units * self.entry_price + units * at) / (self.units + units)
            self.entry_comm += comm
            self.margin += notional / a.leverage
            self.cash -= d * notional + comm
            self.units += units
        else:
            self.margin *= (self.units - units) / self.units
            self.cash += d * notional - comm
            self.gained += d * (notional - units * self.entry_price * a.contract_size) - comm
            self.reduced_comm += comm
            self.units -= units
        self.rebalances += 1
        return 1

    def __call__(self, ts, opened, high, low, close, signal, atr, *others):
        """(equity, trade closed on this bar or None, rebalance fills) of the next bar."""
        self.bar_no += 1
        a, r = self.a, self.r
        if a.execute_on == "next_open":
            sig, fill, self.last_signal = self.last_signal, opened, signal
        else:
            sig, fill = signal, close
        if close is None or fill is None:  # nothing can be valued or traded
            return self.last_equity, None, 0
        trade, fills = None, 0
        bar = {"open": opened, "high": high, "low": low, "close": close, **dict(zip(self.columns, others, strict=True))}
        d = self.direction
        if d and self.bar_no > self.entry_bar and a.financing_rate:
            cost = self.units * close * a.contract_size * a.financing_rate
            self.cash -= cost
            self.financing += cost
        if d:
            if r.trailing_stop and self.trail is not None and sig is not None:
                self.trail_state, self.trail = r.trailing_stop.move(self.trail_state, self.trail, d, sig, bar)
            best, worst = (high, low) if d == 1 else (low, high)
            stop = self._binding()
            if self.target is not None and best is not None and d * (best - self.target) >= 0:
                trade = self._close(ts, self.target, "tp")
            elif stop is not None and worst is not None and d * (worst - stop[0]) <= 0:
                trade = self._close(ts, stop[0], stop[1])
            elif sig is not None and (d * sig < r.exit_threshold or (r.allow_short if d == 1 else r.allow_long) and d * sig < -r.entry_threshold):
                trade = self._close(ts, fill * (1 - d * a.slippage), "signal")
            elif a.rebalance_band is not None and sig is not None:
                fills = self._rebalance(sig, fill, close, atr)
        equity = self._worth(close)
        if sig is None or equity <= 0:
            equity = max(equity, 0.0)
        else:
            if not self.direction:
                if r.allow_long and sig > r.entry_threshold:
                    self._open(ts, 1, sig, fill, atr, bar)
                elif r.allow_short and sig < -r.entry_threshold:
                    self._open(ts, -1, sig, fill, atr, bar)
            equity = self._worth(close)
        self.last_equity = equity
        return equity, trade, fills


def simulate(frame: DataFrame, rules: Rules, account: Account = Account(), keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """keys, ts, equity, trade (a struct, null unless one was closed), rebalances: one row a bar.

    frame is a bars table with signal_strength. A position left at the end is
    neither closed nor logged. A bar without a close, or without the price that
    would be traded at, changes nothing.
    """
    if account.rebalance_band is not None and rules.sizer is None:
        raise ValueError("rebalance_band needs a sizer: the default size is all of equity")
    extra = tuple(rules.columns())
    if rules.sizer is not None and rules.sizer.needs_volatility:
        frame = engine_atr(frame, ATR_PERIOD, "__atr")
    else:
        frame = frame.withColumn("__atr", F.lit(None).cast("double"))
    inputs = ["ts", "open", "high", "low", "close", SIGNAL, "__atr", *extra]
    frame = frame.select(*dict.fromkeys([*keys, *inputs]))
    ts = frame.schema["ts"].dataType
    step = ([*inputs], ["equity", "trade", "rebalances"], lambda: Fold(rules, account, extra))
    out = scan(frame, [step], keys, ("ts",), {"trade": trade_type(ts), "rebalances": T.IntegerType()})
    return out.select(*keys, "ts", "equity", "trade", "rebalances")


def trades(result: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The log of closed trades; its columns are there even if it is empty."""
    return result.filter(F.col("trade").isNotNull()).select(*keys, "trade.*")


def backtest(bars: DataFrame, strategy, account: Account = Account(), keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """simulate() on the strategy's signals."""
    return simulate(strategy.signals(bars), strategy.rules, account, keys)
