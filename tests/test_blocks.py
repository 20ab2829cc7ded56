"""One series as many tasks: row numbers, windows with copied rows, folded recursions."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import storage
from tidemark.functions.blocks import NUMBER, Blocks, numbered, recurred_series
from tidemark.functions.linear import Formula, Linear, Mean, affine, composed, evaluate, levels
from tidemark.functions.recursions import Ewm
from tidemark.operators import indicators as I
from tidemark.operators.base import compute
from tidemark.operators.kernels import KernelRegression
from tidemark.operators.signals import HeikinAshi, LogReturns

NODES = [I.SMA(period=5), I.WMA(period=4), I.CMA(period=3), I.EMA(period=6), I.EMA(period=6, lag=4), I.DEMA(period=5), I.TEMA(period=4), I.RSI(period=6), I.MACD(fast=3, slow=7), I.Momentum(), I.LarryWilliams(), I.BollingerBands(), I.CCI(), I.Stochastic(), I.ROC(), I.TRIX(period=4), I.DPO(), I.RVI(), I.DeMarker(), I.OBV(period=5), I.ForceIndex(), I.CHO(), I.ADX(period=5), I.ATR(), I.MassIndex(ema_period=3, sum_period=6), LogReturns(), HeikinAshi(), KernelRegression(bandwidth=6), I.SMA(column="signal__ha_close", period=3)]


def bars(spark, sizes, gaps=0.0, seed=1):
    g, rows = random.Random(seed), []
    for symbol, n in sizes.items():
        close = 100.0
        for k in range(n):
            close *= math.exp(g.gauss(0, 0.01))
            o, c = close * math.exp(g.gauss(0, 0.003)), close
            row = [o, max(o, c) * 1.002, min(o, c) * 0.998, c, float(g.randint(1, 99))]
            rows.append((symbol, datetime(2026, 1, 1) + timedelta(hours=k), *(None if g.random() < gaps else x for x in row)))
    g.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double").repartition(7)


def table(frame):
    names = sorted(frame.columns)
    return {(r["symbol"], r["ts"]): [r[c] for c in names] for r in frame.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k, row in a.items():
        for x, y in zip(row, b[k], strict=True):
            assert x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-8, abs_tol=1e-9), (k, x, y)


@pytest.mark.parametrize("gaps", [0.0, 0.15])
def test_a_series_of_sixteen_blocks_is_as_one_pass(spark, gaps):
    """The values of one symbol in 16 blocks, and of short symbols beside it, are those of one ordered pass."""
    frame = bars(spark, {"long": 640, "short": 3, None: 90}, gaps)
    got = compute(frame, NODES, strengths=False, block_rows=40)
    assert got.columns == compute(frame, NODES).columns
    same(table(got), table(compute(frame, NODES)))


def test_strengths_in_blocks(spark):
    frame = bars(spark, {"a": 200}, 0.05)
    nodes = [I.SMA(period=5), I.EMA(period=4), I.ForceIndex(), I.CHO(), I.TRIX(period=4), KernelRegression(bandwidth=6), I.OBV(period=5)]
    same(table(compute(frame, nodes, True, block_rows=50)), table(compute(frame, nodes, True)))


def test_numbers_and_even_blocks(spark):
    frame = bars(spark, {"a": 500, "b": 1, None: 60})
    rows = numbered(frame).select("symbol", "ts", NUMBER).collect()
    for symbol in ("a", "b", None):
        own = sorted(r["ts"] for r in rows if r["symbol"] == symbol)
        assert {r["ts"]: r[NUMBER] for r in rows if r["symbol"] == symbol} == {t: k for k, t in enumerate(own)}
    blocks = Blocks(frame, 100)
    seen = []

    def sized(keyed):
        seen.append({(r["symbol"]["name"], r["symbol"]["block"]): r["count"] for r in keyed.groupBy("symbol").count().collect()})
        return keyed

    blocks.windowed(blocks.frame, 21, sized)
    # no block of the long series has more than its own rows and the copied ones
    assert seen[0] == {("a", 0): 100, ("a", 1): 120, ("a", 2): 120, ("a", 3): 120, ("a", 4): 120, ("a", 5): 20, ("b", 0): 1, (None, 0): 60}
    with pytest.raises(ValueError):
        blocks.windowed(blocks.frame, 102, sized)
    assert Blocks(frame.limit(0)).frame.count() == 0 and compute(frame.limit(0), NODES[:9], block_rows=10).count() == 0


def test_maps_compose():
    g = np.random.default_rng(1)
    a, b = g.uniform(0, 1, 1000), g.normal(size=1000)
    y, out = 0.7, []
    for p, q in zip(a, b, strict=True):
        y = p * y + q
        out.append(y)
    assert np.allclose(affine(a, b, 0.7), out, rtol=1e-12)
    for cut in (0, 1, 63, 64, 65, 999, 1000):
        (p, q), (r, s) = composed(a[:cut], b[:cut]), composed(a[cut:], b[cut:])
        assert math.isclose(r * (p * 0.7 + q) + s, out[-1], rel_tol=1e-10)


@pytest.mark.parametrize("op", [Mean("y", "x", 0.3), Mean("y", "x", 0.1, least=4), Linear("y", "x", 0.5), Linear("y", "x")])
def test_an_op_over_any_cut_is_as_over_the_whole(op):
    g = np.random.default_rng(2)
    x = g.normal(size=300)
    if isinstance(op, Mean):
        x[g.random(300) < 0.4] = np.nan
        x[:5] = np.nan
        step = Ewm(op.a, op.least)
        rows = [step(None if np.isnan(v) else v) for v in x]
        whole, _ = op.run({"x": x}, op.EMPTY)
        assert np.allclose(whole, [np.nan if v is None else v for v in rows], equal_nan=True, rtol=1e-12)
    whole, end = op.run({"x": x}, op.EMPTY)
    for cuts in ([0, 1, 2, 3, 7, 300], [0, 150, 300], list(range(0, 301, 5))):
        state, folded, parts = op.EMPTY, op.EMPTY, []
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            y, state = op.run({"x": x[at:to]}, state)
            parts.append(y)
            folded = op.after(folded, op.summary({"x": x[at:to]}))
            assert np.allclose(state, folded, equal_nan=True, rtol=1e-9)
        assert np.allclose(np.concatenate(parts), whole, equal_nan=True, rtol=1e-9) and np.allclose(state, end, equal_nan=True)


def test_levels_and_recursions_of_recursions(spark):
    ops = [Mean("a", "close", 0.5), Formula("f", ("a", "close"), np.subtract), Linear("b", "f", 0.25), Mean("c", "b", 0.2, hidden=True), Formula("d", ("c", "a"), np.add)]
    assert levels(ops) == {"a": 1, "f": 1, "b": 2, "c": 3, "d": 3}
    frame = bars(spark, {"a": 300, "b": 40})
    blocks = Blocks(frame, 25)
    got = blocks.recurred(blocks.frame, ops).drop(NUMBER)
    assert got.columns == [*frame.columns, "a", "f", "b", "d"]
    same(table(got), table(recurred_series(frame, ops)))
    states: dict = {}
    assert set(evaluate(ops, {"close": np.ones(3)}, states)) == {"close", "a", "f", "b", "c", "d"} and set(states) == {"a", "b", "c"}


def test_stored_tables_are_cleared(spark):
    storage.clear_stored(spark)
    kept = storage.stored(spark.range(5), "test")
    assert kept.agg(F.sum("id")).first()[0] == 10
    assert storage.clear_stored(spark) == 1 and storage.clear_stored(spark) == 0
    with pytest.raises(Exception, match="."):
        kept.collect()
