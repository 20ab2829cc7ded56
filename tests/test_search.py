"""Parameters as data, proposals from two densities, trial logs that several drivers share."""

import json
import math
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_blocks import bars
from tidemark.operators import indicators as I
from tidemark.operators import risk as R
from tidemark.operators import search as S
from tidemark.operators import trials as D
from tidemark.operators.metrics import metrics
from tidemark.operators.search import CategoricalParam, FloatParam, IntParam, TrialLog, best, load_trials, optimize, optimize_signals, propose, search, trials_table
from tidemark.operators.simulate import Account, backtest
from tidemark.operators.strategy import Rules, Weighted

SPACE = {"n": IntParam(3, 9, 2), "w": FloatParam(0.5, 2.0, log=True), "x": FloatParam(-1.0, 1.0), "k": CategoricalParam(("a", "b", "c"))}
PARTS = "trial long, family string, period int, weight double"


def test_sampling_is_a_table(spark):
    table = D.sampled(spark, SPACE, 3000, seed=4)
    assert table.columns == ["trial", *SPACE]
    rows = table.collect()
    assert {r["n"] for r in rows} == {3, 5, 7, 9} and {r["k"] for r in rows} == {"a", "b", "c"} and len({r["trial"] for r in rows}) == 3000
    assert all(0.5 <= r["w"] <= 2 and -1 <= r["x"] <= 1 for r in rows)
    assert abs(np.mean([math.log(r["w"]) for r in rows])) < 0.05 and abs(np.corrcoef([r["n"] for r in rows], [r["x"] for r in rows])[0, 1]) < 0.06
    again = D.sampled(spark, SPACE, 10, seed=4, first=2990).orderBy("trial").collect()
    assert again == sorted(rows, key=lambda r: r["trial"])[2990:]


def test_a_thousand_trials_are_one_small_plan(spark):
    trials = D.sampled(spark, {"a": IntParam(2, 12), "b": IntParam(20, 60)}, 1000)
    parts = D.parts(trials, (F.lit("sma"), F.col("a"), F.lit(1.0)), (F.lit("momentum"), F.col("b"), F.lit(-0.5)))
    frame = bars(spark, {"a": 80})
    D.scores(frame, parts.filter("trial < 3"))._jdf.queryExecution().executedPlan()
    start = time.time()
    plan = D.scores(frame, parts)._jdf.queryExecution().executedPlan().toString()
    assert time.time() - start < 5 and len(plan) < 20_000


def expected_scores(frame, trials, split):
    """Each trial by the indicators' own plans."""
    out = {}
    for trial, own in trials.items():
        nodes = [({"sma": I.SMA, "bollinger": I.BollingerBands, "momentum": I.Momentum}[f](period=n), w) for f, n, w in own]
        rows = Weighted(tuple(nodes)).signals(frame).select("symbol", "ts", "close", "signal_strength").collect()
        series = {}
        for r in sorted(rows, key=lambda r: (str(r["symbol"]), r["ts"])):
            series.setdefault(r["symbol"], []).append(r)
        values, counts = {False: [], True: []}, {False: 0, True: 0}
        for own_rows in series.values():
            pairs = {False: [], True: []}
            for a, b in zip(own_rows[:-1], own_rows[1:], strict=True):
                if a["signal_strength"] is not None and a["close"] is not None and b["close"] is not None and not math.isnan(a["signal_strength"]):
                    pairs[b["ts"] >= split].append((a["signal_strength"], math.log(b["close"] / a["close"])))
            for late, found in pairs.items():
                counts[late] += len(found)
                if len({s for s, _ in found}) > 1 and len({r for _, r in found}) > 1:
                    values[late].append(np.corrcoef(np.array(found).T)[0, 1])
        out[trial] = [(counts[late], np.mean(values[late]) if values[late] else None) for late in (False, True)]
    return out


@pytest.mark.parametrize("block_rows", [None, 25])
def test_scores_are_those_of_the_indicators(spark, block_rows):
    frame = bars(spark, {"a": 190, "b": 60, "tiny": 2, None: 40}).withColumn("close", F.when(F.col("ts") != datetime(2026, 1, 2, 3), F.col("close")))
    trials = {7: [("sma", 5, 1.5), ("sma", 20, -0.7)], 3: [("momentum", 3, 1.0)], 9: [("bollinger", 12, 0.4), ("momentum", 1 + 1, 0.2)], 11: [("sma", 2, -1.0)]}
    parts = spark.createDataFrame([(t, *p) for t, own in trials.items() for p in own], PARTS)
    split = datetime(2026, 1, 1) + timedelta(hours=120)
    got = {r["trial"]: r for r in D.scores(frame, parts, split, block_rows=block_rows).collect()}
    for trial, ((n, value), (late_n, late)) in expected_scores(frame, trials, split).items():
        r = got[trial]
        assert (r["n"], r["valid_n"]) == (n, late_n)
        assert math.isclose(r["score"], value, abs_tol=1e-9) and math.isclose(r["valid_score"], late, abs_tol=1e-9)
    signals = D.signals(frame, parts, block_rows=block_rows)
    direct = Weighted(((I.SMA(period=5), 1.5), (I.SMA(period=20), -0.7))).signals(frame)
    a = {(r["symbol"], r["ts"]): r["signal"] for r in signals.filter("trial = 7").collect()}
    b = {(r["symbol"], r["ts"]): r["signal_strength"] for r in direct.collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a) and signals.count() == 4 * frame.count()


def test_scores_of_nothing(spark):
    parts = spark.createDataFrame([(1, "sma", 5, 1.0)], PARTS)
    none = D.scores(bars(spark, {"a": 30}).limit(0), parts).collect()
    assert [tuple(r) for r in none] == [(1, 0, None, 0, None)]
    flat = bars(spark, {"a": 30}).withColumn("close", F.lit(5.0))
    assert D.scores(flat, parts).first()["score"] is None
    for bad in [(1, "other", 5, 1.0), (1, "sma", 1, 1.0)]:
        with pytest.raises(ValueError):
            D.scores(flat, spark.createDataFrame([bad], PARTS))


def quality(p):
    return -((p["x"] - 0.3) ** 2) - (math.log(p["w"]) - 0.4) ** 2 - (p["n"] - 7) ** 2 / 40 - 0.2 * (p["k"] != "b")


def test_densities_beat_random_draws():
    """At equal numbers of trials, over 20 seeds."""
    def run(seed, random):
        done = []
        for number in range(60):
            params = propose(SPACE, [] if random else done, seed, number, True)
            done.append((params, quality(params)))
        return max(v for _, v in done)

    pairs = [(run(seed, False), run(seed, True)) for seed in range(20)]
    assert sum(a > b for a, b in pairs) >= 16 and np.mean([a for a, _ in pairs]) > np.mean([b for _, b in pairs])


@pytest.mark.parametrize("param", [IntParam(1, 9, 2), FloatParam(-1, 2), FloatParam(0.1, 10, log=True), IntParam(4, 4), FloatParam(2.0, 2.0)])
def test_densities_are_densities(param):
    g = np.random.default_rng(1)
    values = [param.sample(g) for _ in range(7)]
    line = S._Line(param, values)
    a, b = param.axis()
    if b > a:
        x = np.linspace(a, b, 4001)
        assert math.isclose(np.trapezoid([math.exp(line.log_density(v)) for v in x], x), 1.0, abs_tol=2e-3)
    drawn = [param.value(line.draw(g)) for _ in range(50)]
    assert all(param.low <= v <= param.high for v in drawn) and all(math.isclose(param.value(param.place(v)), v) for v in values)
    choice = S._Choices(CategoricalParam(("a", "b")), ["a", "a"])
    assert math.isclose(sum(math.exp(choice.log_density(c)) for c in "ab"), 1) and choice.log_density("a") > choice.log_density("b")


def test_search_by_signals_finds_what_is_there(spark):
    rows, price = [], 100.0
    g = np.random.default_rng(3)
    last = [price]
    for k in range(600):
        n = 6
        drift = np.sign(last[-1] - last[-n - 1]) * 0.004 if len(last) > n else 0.0
        price *= math.exp(drift + g.normal(0, 0.004))
        last.append(price)
        rows.append(("a", datetime(2026, 1, 1) + timedelta(hours=k), price))
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp, close double").cache()
    space = {"n": IntParam(2, 20), "w": FloatParam(-1.0, 1.0)}
    found = optimize_signals(frame, space, lambda p: [("momentum", p["n"], p["w"])], datetime(2026, 1, 20), 48, 16, seed=1)
    top = best(found)
    every = D.scores(frame, spark.createDataFrame([(n, "momentum", n, 1.0) for n in range(2, 21)], PARTS), datetime(2026, 1, 20))
    assert top["params"]["w"] > 0 and top["value"] >= 0.95 * every.agg(F.max("score")).first()[0] > 0.2
    assert any(t["valid_value"] is not None for t in found)
    assert [t["number"] for t in found] == list(range(48))
    table = load_trials(trials_table(spark, found))
    assert [(t["params"], t["valid_value"]) for t in table] == [(t["params"], t["valid_value"]) for t in found]


def test_a_batch_of_backtests_is_as_each_alone(spark):
    frame = bars(spark, {"a": 120, "b": 90}).cache()
    rules = Rules(entry_threshold=0.2, sizer=R.RiskSizer(0.01))
    factory = lambda p: Weighted(((I.SMA(period=p["n"]), p["w"]), (I.BollingerBands(period=8, num_deviations=p["d"]), 0.5)), rules)
    space = {"n": IntParam(3, 9), "w": FloatParam(0.5, 2.0), "d": CategoricalParam((1.5, 2.0))}
    found = optimize(frame, space, factory, "total_return", 6, 6, seed=2)
    for t in found:
        alone = metrics(backtest(frame, factory(t["params"]), Account())).agg(F.avg("total_return")).first()[0]
        assert t["state"] == "complete" and math.isclose(t["value"], alone, rel_tol=1e-9, abs_tol=1e-12)
    assert len({t["value"] for t in found}) > 2
    with pytest.raises(KeyError):
        optimize(frame, space, factory, "other")


def test_a_study_outlives_its_driver(spark, tmp_path):
    folder = f"file://{tmp_path}/study"
    seen = []

    def evaluate(trials):
        if len(seen) == 12:
            raise RuntimeError("the driver dies")
        seen.extend(t["number"] for t in trials)
        return [S._valued(t, quality(t["params"])) for t in trials]

    with pytest.raises(RuntimeError):
        search(SPACE, evaluate, 30, 4, log=TrialLog(spark, folder))
    kept = TrialLog(spark, folder).trials()
    assert [t["number"] for t in kept] == seen == list(range(12))
    seen.append(-1)  # the next one lives
    found = search(SPACE, evaluate, 30, 4, log=TrialLog(spark, folder))
    numbers = [t["number"] for t in found]
    # what the dead driver had claimed is not given out again
    assert len(found) == 30 and len(set(numbers)) == 30 and not set(numbers) & {12, 13, 14, 15} and found[:12] == kept


def test_drivers_share_a_study(spark, tmp_path):
    a, b = TrialLog(spark, f"file://{tmp_path}/s"), TrialLog(spark, f"file://{tmp_path}/s")
    assert a.trials() == [] and a.claim(3) == [0, 1, 2] and b.claim(2) == [3, 4] and a.claim(1) == [5]
    b.add({"number": 4, "params": {"x": 0.5}, "state": "complete", "value": 1.5})
    a.add({"number": 0, "params": {"x": 0.1}, "state": "pruned", "value": None})
    assert [t["number"] for t in a.trials()] == [0, 4] and json.dumps(b.trials()) == json.dumps(a.trials())
    found = search({"x": FloatParam(0, 1)}, lambda ts: [S._valued(t, t["params"]["x"]) for t in ts], 6, 2, log=b)
    assert sorted(t["number"] for t in found) == [0, 4, 6, 7, 8, 9]
