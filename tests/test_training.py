"""Networks trained side by side, dropout from counters, search over indicators with rungs."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_blocks import bars
from tidemark.operators import features as X
from tidemark.operators import indicators as I
from tidemark.operators import model_search as MS
from tidemark.operators.network import Network, ensemble, train, walk_forward_train
from tidemark.operators.search import TrialLog
from tidemark.operators.training import Job, Table, dropout_masks, fit_scalers, train_side_by_side

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.default_rng(1)
    made = []
    for k in range(400):
        x = g.normal(size=4) * [1, 10, 0.1, 1] + [0, 5, 0, 0]
        y = float(np.tanh(x[0] - 0.1 * x[1] + 5 * x[2]) + g.normal(0, 0.05))
        made.append((f"s{k % 2}", datetime(2026, 1, 1) + timedelta(hours=k // 2), k // 2, *(None if g.random() < 0.03 else float(v) for v in x), None if k % 50 == 7 else y))
    return spark.createDataFrame(made, "symbol string, ts timestamp, row long, a double, b double, c double, d double, target double").cache()


FOLDS = X.walk_forward(200, 3, 0.4, embargo=2)


def same_network(a, b, tol=1e-9):
    for x, y in zip((*a.weights, *a.biases), (*b.weights, *b.biases), strict=True):
        np.testing.assert_allclose(x, y, atol=tol, rtol=tol)


def test_trials_and_folds_side_by_side_are_as_each_alone(spark, rows):
    """Weights, losses and scalers by (trial, fold) are those of a training of its own over its own columns."""
    table = Table(rows, NAMES, folds=FOLDS)
    subsets = [["a", "b", "c"], ["a"], ["d", "b"], ["b", "c", "a"]]
    make = lambda k, own, fold: Job(k, Network.dense(own, (5,), seed=k), [NAMES.index(c) for c in own], fold)
    jobs = [make(10 * k + f, own, f) for k, own in enumerate(subsets) for f in range(3)]
    fit_scalers(table, jobs)
    train_side_by_side(table, jobs, epochs=6, rate=0.02, dropout=0.3, seed=5)
    for job in jobs[::4]:
        own = job.network.features
        alone = Job(1, Network.dense(own, (5,), seed=job.key), list(range(len(own))), 0)
        small = Table(rows, own, folds=[FOLDS[job.fold]])
        fit_scalers(small, [alone])
        train_side_by_side(small, [alone], epochs=6, rate=0.02, dropout=0.3, seed=5)
        same_network(job.network, alone.network)
        np.testing.assert_allclose(job.test_losses, alone.test_losses, rtol=1e-9)
        np.testing.assert_allclose(job.losses, alone.losses, rtol=1e-9)
        mine = rows.filter(F.col("row").between(FOLDS[job.fold].train_from, FOLDS[job.fold].train_to - 1)).dropna(subset=[*own, "target"])
        scaler = X.Scaler.fit(mine, own)
        np.testing.assert_allclose(job.offsets, scaler.offsets, rtol=1e-9)
        np.testing.assert_allclose(job.scales, scaler.scales, rtol=1e-9)
        assert len(job.test_losses) == len(job.losses) == 6


def test_dropout_does_not_depend_on_partitions(spark, rows):
    nets = []
    for parts in (2, 16):
        net = Network.dense(["a", "c"], (8, 4), seed=3)
        nets.append(net.fit(rows.repartition(parts).dropna(), epochs=5, dropout=0.4, seed=9))
    same_network(*nets)
    other = Network.dense(["a", "c"], (8, 4), seed=3).fit(rows.dropna(), epochs=5, dropout=0.4, seed=10)
    assert np.abs(other.weights[0] - nets[0].weights[0]).max() > 1e-4


def test_dropout_masks():
    keys = np.arange(20_000)
    masks = dropout_masks(keys, [6, 3], 0.25, 1, 2)
    assert [m.shape for m in masks] == [(20_000, 6), (20_000, 3)] and dropout_masks(keys, [6], 0.0, 1, 2) is None
    for m in masks:
        assert set(np.unique(m)) == {0.0, 1 / 0.75} and np.allclose((m == 0).mean(axis=0), 0.25, atol=0.015)
    assert abs(np.corrcoef(masks[0][:, 0], masks[0][:, 1])[0, 1]) < 0.03
    again = dropout_masks(keys[::-1], [6, 3], 0.25, 1, 2)
    assert (again[0][::-1] == masks[0]).all() and (dropout_masks(keys, [6], 0.25, 1, 3)[0] != masks[0]).any()


@pytest.mark.parametrize("hidden", ["relu", "tanh"])
def test_gradients_with_masks_match_differences(hidden):
    net = Network.dense(["a", "b"], (4, 3), hidden=hidden, seed=3)
    g = np.random.default_rng(0)
    x, y = g.standard_normal((30, 2)), g.standard_normal(30)
    masks = dropout_masks(np.arange(30), [4, 3], 0.4, 1, 1)
    for loss, option in (("mse", 0.1), ("directional", 0.1), ("pinball", 0.7)):
        total, grads = net.gradients(x, y, loss, option, masks)
        assert math.isclose(total, net.loss(net.forward(x, masks)[-1], y, loss, option))
        for layer in range(3):
            w, eps = net.weights[layer], 1e-6
            w[0, 0] += eps
            up, _ = net.gradients(x, y, loss, option, masks)
            w[0, 0] -= 2 * eps
            down, _ = net.gradients(x, y, loss, option, masks)
            w[0, 0] += eps
            assert math.isclose((up - down) / (2 * eps), grads[2 * layer][0, 0], rel_tol=1e-4, abs_tol=1e-5)


def test_walk_forward_networks_see_their_own_rows_alone(spark, rows):
    made = walk_forward_train(rows, ["a", "b", "c"], FOLDS, layers=(6,), epochs=4, rate=0.02)
    got = {(r["symbol"], r["row"], r["fold"]): r["prediction"] for r in made.collect()}
    assert {(r, f) for _, r, f in got} == {(r, f.fold) for f in FOLDS for r in range(f.test_from, f.test_to)}
    # other targets after a fold's training rows change nothing of its predictions
    late = rows.withColumn("target", F.when(F.col("row") >= FOLDS[1].train_to, -5.0).otherwise(F.col("target")))
    other = {(r["symbol"], r["row"], r["fold"]): r["prediction"] for r in walk_forward_train(late, ["a", "b", "c"], FOLDS, layers=(6,), epochs=4, rate=0.02).collect()}
    for k, v in got.items():
        if k[2] < 2:
            assert v is None and other[k] is None or math.isclose(v, other[k], abs_tol=1e-9)
    assert any(v is None for v in got.values())


@pytest.mark.parametrize("scale", ["standard", "minmax"])
def test_train_save_load_and_ensemble(spark, rows, tmp_path, scale):
    net, scaler = train(rows, ["a", "b", "c"], layers=(6,), scale=scale, epochs=8, rate=0.05)
    assert net.history[-1] < net.history[0] and len(net.history) == 8
    whole = X.Scaler.fit(rows.dropna(subset=["target"]) if scale == "minmax" else rows.dropna(subset=["a", "b", "c", "target"]), ["a", "b", "c"], scale)
    np.testing.assert_allclose(scaler.offsets, whole.offsets, rtol=1e-9)
    raw = net.scaled(scaler)
    raw.save(spark, str(tmp_path / "net"))
    back = Network.load(spark, str(tmp_path / "net"))
    same_network(raw, back, 1e-12)
    zero = Network([*back.features], [np.zeros_like(w) for w in back.weights], [np.zeros_like(b) for b in back.biases])
    a = back.predict(rows, "p").select("p").collect()
    both = ensemble(rows, [back, zero], "m")
    assert both.columns == [*rows.columns, "m"]
    for x, y in zip(a, both.collect(), strict=True):
        assert x["p"] is None and y["m"] is None or math.isclose(x["p"] / 2, y["m"], abs_tol=1e-12)


def test_rungs_stop_what_is_above_the_median():
    earlier = [{"losses": [1.0, 0.9]}, {"losses": [2.0, 1.9, 1.8]}, {"losses": None}]
    after = MS._rungs(earlier, 2, 4)
    jobs = [Job(k, None, [], test_losses=[v, v]) for k, v in enumerate([0.5, 3.0, 1.2])]
    for j in jobs:
        j.test_losses = j.test_losses[:1]
    assert after(1, jobs) == set()
    for j in jobs:
        j.test_losses = j.test_losses * 2
    assert after(2, jobs) == {1}  # losses there: 0.9, 1.9, 0.5, 3, 1.2; those above 1.2 stop


SPECS = [MS.IndicatorSpec("mom", I.Momentum, 2, 8, (0, 1, 2)), MS.IndicatorSpec("sma", I.SMA, 3, 9), MS.IndicatorSpec("roc", I.ROC, 2, 6, (0, 3), optional=False)]


def test_specs(spark):
    assert MS.specs_of(MS.specs_json(SPECS)) == SPECS
    assert set(SPECS[0].space()) == {"mom__include", "mom__period", "mom__lag"} and set(SPECS[2].space()) == {"roc__period", "roc__lag"}
    assert SPECS[0].chosen({"mom__include": False, "mom__period": 3, "mom__lag": 1}) is None
    assert SPECS[0].chosen({"mom__include": True, "mom__period": 3, "mom__lag": 1}) == I.Momentum(period=3, lag=1)
    for bad in [lambda: MS.IndicatorSpec("x", I.SMA, 5, 4), lambda: MS.IndicatorSpec("x", I.SMA, 1, 4, ()), lambda: MS.IndicatorSpec("x", I.SMA, 1, 4, (-1,)), lambda: MS.IndicatorSpec("x", I.MACD, 2, 4)]:
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        MS.ModelSearch(bars(spark, {"a": 30}), SPECS, datetime(2026, 1, 1), metric="other")


def test_search_over_indicators(spark, tmp_path):
    frame = bars(spark, {"a": 260, "b": 200}).cache()
    at = datetime(2026, 1, 1)
    made = MS.ModelSearch(frame, SPECS, at + timedelta(hours=120), at + timedelta(hours=170), "test_loss", (4,), epochs=6, rung=2, least_trials=4, seed=3)
    log = TrialLog(spark, f"file://{tmp_path}/models")
    found = made.run(14, 7, log)
    states = [t["state"] for t in found.trials]
    assert len(states) == 14 and states.count("pruned") >= 1 and states.count("complete") >= 3
    assert all(t["epochs"] in (2, 4) for t in found.trials if t["state"] == "pruned") and all(t["epochs"] == 6 for t in found.trials if t["state"] == "complete")
    # trained anew and alone it comes to the same
    assert math.isclose(found.best["value"], found.test_loss, rel_tol=1e-9) and found.best["value"] == min(t["value"] for t in found.trials if t["state"] == "complete")
    text = found.summary()
    assert "14 trials" in text and "test_loss" in text and "later: loss" in text
    signals = found.strategy().signals(frame)
    assert signals.filter("signal_strength IS NOT NULL").count() > 400
    # taken up again, the log's trials count
    assert [t["number"] for t in made.run(14, 7, TrialLog(spark, f"file://{tmp_path}/models")).trials] == [t["number"] for t in found.trials]
    judged = MS.ModelSearch(frame, SPECS[2:], at + timedelta(hours=120), metric="total_return", layers=(3,), epochs=2).run(2, 2)
    assert judged.best["state"] == "complete" and math.isfinite(judged.best["value"])
