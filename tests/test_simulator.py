"""The simulator's rules, one bar at a time."""

import math
from datetime import datetime, timedelta

import pytest

from tidemark.operators import risk as R
from tidemark.operators.simulate import Account, Fold, simulate, trades
from tidemark.operators.strategy import Rules

FREE = {"commission": 0.0, "slippage": 0.0}
START = datetime(2026, 4, 1)


def run(closes, signals, rules=None, account=None, highs=None, lows=None, opens=None, atr=None):
    fold = Fold(rules or Rules(), account or Account(**FREE))
    out = []
    for k, (c, s) in enumerate(zip(closes, signals, strict=True)):
        out.append(fold(START + timedelta(days=k), (opens or closes)[k], (highs or closes)[k], (lows or closes)[k], c, s, atr))
    return [e for e, _, _ in out], [t for _, t, _ in out if t], sum(f for _, _, f in out)


def test_accounting_of_a_long_trade():
    rules = Rules(allow_short=False, exit_threshold=0.0)
    equity, log, _ = run([10, 10, 11, 11], [1, 0, 0, -1], rules, Account(initial_capital=10_000, **FREE))
    assert log[0]["size"] == 1000 and equity[-1] == 11_000 and log[0]["pnl"] == 1000 and log[0]["exit_reason"] == "signal"


def test_next_open_acts_one_bar_later():
    account = Account(execute_on="next_open", **FREE)
    _, log, _ = run([11, 21, 31, 41], [1, 1, -1, -1], Rules(allow_short=False), account, opens=[10, 20, 30, 40])
    assert (log[0]["entry_price"], log[0]["exit_price"], log[0]["bars_held"]) == (20, 40, 2)


def test_flip_within_one_bar():
    _, log, _ = run([10, 12, 9], [1, -1, -1], Rules(sizer=R.FixedSizer(0.5)))
    assert [t["direction"] for t in log] == ["long"]
    equity, log, _ = run([10, 12, 9, 9], [1, -1, -1, 1], Rules(sizer=R.FixedSizer(0.5)))
    assert [t["direction"] for t in log] == ["long", "short"] and log[1]["pnl"] > 0 and equity[-1] > 100_000


def test_target_before_stop_and_none_on_the_entry_bar():
    rules = Rules(sizer=R.FixedSizer(0.5), take_profit=R.FixedTarget(2), stop_loss=R.FixedStop(2))
    _, log, _ = run([100, 100, 100], [1, 0.6, 0.6], rules, highs=[110, 103, 100], lows=[90, 97, 100])
    assert log[0]["exit_reason"] == "tp" and log[0]["exit_price"] == 102 and log[0]["bars_held"] == 1


def test_missing_signal_still_allows_stops_but_no_signal_exit():
    rules = Rules(sizer=R.FixedSizer(0.5), stop_loss=R.FixedStop(5))
    _, log, _ = run([100, 100, 100], [1, None, None], rules, lows=[100, 99, 94], highs=[100, 101, 100])
    assert log[0]["exit_reason"] == "sl" and log[0]["exit_price"] == 95


def test_liquidation_of_a_leveraged_account():
    rules = Rules(allow_short=False, exit_threshold=-1)
    equity, log, _ = run([100, 100, 60], [1, 1, 1], rules, Account(initial_capital=1000, leverage=2, maintenance_margin=0.5, **FREE), lows=[100, 100, 60])
    assert log[0]["exit_reason"] == "liquidation" and math.isclose(log[0]["exit_price"], (0.5 * 1000 + 1000) / 20)


def test_financing_leaves_the_entry_bar_out():
    _, log, _ = run([100, 100, 100], [1, 1, -1], Rules(allow_short=False), Account(initial_capital=1000, financing_rate=0.01, **FREE))
    assert math.isclose(log[0]["financing"], 20) and math.isclose(log[0]["pnl"], -20)


def test_rebalancing_trades_the_difference_only_beyond_the_band():
    account = Account(initial_capital=1000, rebalance_band=0.1, **FREE)
    rules = Rules(sizer=R.RiskSizer(0.5, 1.0), allow_short=False)
    _, _, none = run([100, 100], [0.8, 0.85], rules, account, atr=10.0)
    _, _, once = run([100, 100], [0.8, 1.0], rules, account, atr=10.0)
    assert (none, once) == (0, 1)


def test_trailing_stop_moves_by_steps_and_one_way():
    trail = R.FixedTrail(5.0, step_points=2.0)
    state, level = trail.start(100, 1, 1, {})
    assert level == 95
    assert trail.move(state, level, 1, 1, {"close": 101})[1] == 95
    assert trail.move(state, level, 1, 1, {"close": 103})[1] == 98
    assert trail.move(state, 98, 1, 1, {"close": 90})[1] == 98


def test_parabolic_levels():
    bar = {"high": 104.0, "low": 99.0, "close": 102.0}
    assert math.isclose(R.ParabolicStop().level(100, 1, 0.7, bar), 99.1)
    trail = R.ParabolicTrail(step_points=0.0)
    with pytest.raises(RuntimeError):
        trail.follow((), 1, 1, bar)
    state, level = trail.start(100, 1, 1, bar)
    assert math.isclose(level, 99.1) and trail.move(state, level, 1, 1, bar)[1] > level


@pytest.mark.parametrize("bad", [{"leverage": 0.5}, {"contract_size": 0}, {"maintenance_margin": 1}, {"execute_on": "never"}, {"rebalance_band": 0}, {"financing_rate": math.inf}])
def test_account_refuses(bad):
    with pytest.raises(ValueError):
        Account(**bad)


def test_series_are_apart_and_an_empty_log_has_columns(spark):
    rows = [(s, START + timedelta(days=k), 10.0, 10.0, 10.0, 10.0 + k, 1.0, 1.0 if k == 0 else -1.0) for s in ("a", "b") for k in range(3)]
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, signal_strength double")
    out = simulate(frame, Rules(allow_short=False))
    assert out.count() == 6 and trades(out).count() == 2
    none = trades(simulate(frame.withColumn("signal_strength", frame["signal_strength"] * 0), Rules()))
    assert none.count() == 0 and "exit_reason" in none.columns
    assert simulate(frame.limit(0), Rules()).count() == 0
