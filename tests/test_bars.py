"""Indicators against pandas, plans, features, resampling, streams."""

import inspect
import json
import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import features as X
from tidemark.operators import indicators as I
from tidemark.operators import metrics as M
from tidemark.operators import montecarlo as MC
from tidemark.operators.base import compute, strength_name
from tidemark.operators.kernels import KERNELS, KernelRegression, kernel_name, weights
from tidemark.operators.network import Network
from tidemark.operators.search import RANDOM_TRIALS, CategoricalParam, FloatParam, IntParam, best, load_trials, optimize, trials_table
from tidemark.operators.signals import Cyclical, External, HeikinAshi, LogReturns
from tidemark.operators.simulate import Account, backtest
from tidemark.operators.strategy import Learned, Rules, Weighted
from tidemark.plans import registry, trading_queries
from tidemark.plans.oracle import Steps
from tidemark.sources.bars import read_bars, to_bars, validate
from tidemark.sources.report import report

N = 80


@pytest.fixture(scope="module")
def frame():
    i = np.arange(N)
    close = np.linspace(100, 120, N) + 2 * np.sin(i / 4)
    opened = close + 0.5 * np.sin(i / 6)
    ts = [datetime(2026, 1, 1) + timedelta(days=int(k)) for k in i]
    return pd.DataFrame({"symbol": "x", "ts": ts, "open": opened, "high": np.maximum(opened, close) + 1, "low": np.minimum(opened, close) - 1, "close": close, "volume": 1000.0 + (i % 11) * 40})


@pytest.fixture(scope="module")
def bars(spark, frame):
    return spark.createDataFrame(frame).cache()


def values(df, column):
    return df.orderBy("ts").select(F.col(f"`{column}`")).toPandas().iloc[:, 0].to_numpy(dtype=float)


def test_averages_match_pandas(bars, frame):
    nodes = [I.SMA(period=10), I.EMA(period=10), I.WMA(period=10), I.CMA(period=10), I.RSI(period=14)]
    out = compute(bars, nodes, strengths=True).cache()
    c = frame["close"]
    d = c.diff()
    gain, loss = (x.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean() for x in (d.clip(lower=0), -d.clip(upper=0)))
    w = np.arange(1, 11)
    expected = [c.rolling(10).mean(), c.ewm(span=10, adjust=False).mean(), c.rolling(10).apply(lambda x: (x * w).sum() / w.sum(), raw=True), c.expanding(10).mean(), 100 - 100 / (1 + gain / loss)]
    for node, y in zip(nodes, expected, strict=True):
        np.testing.assert_allclose(values(out, node.outputs()[0]), y.to_numpy(), rtol=1e-9)
    s = values(out, strength_name(nodes[0]))
    np.testing.assert_allclose(s, np.tanh(((c - expected[0]) / c.rolling(10).std()).fillna(0)), rtol=1e-9)


def test_one_plan_of_windows_takes_one_shuffle(bars):
    out = compute(bars, [I.SMA(), I.Stochastic(), I.ROC(), I.RVI(), I.DeMarker()], strengths=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1


def test_lag_drops_no_column_of_another_node(bars):
    out = compute(bars, [I.SMA(period=5), I.SMA(period=5, lag=2)])
    a, b = values(out, "indicator__sma_5"), values(out, "indicator__sma_5_lag2")
    np.testing.assert_allclose(a[:-2], b[2:])
    with pytest.raises(ValueError):
        compute(bars, [I.SMA(period=5), I.SMA(column="open", period=5)])
    with pytest.raises(ValueError):
        I.SMA(lag=-1)


def test_recursions_keep_gaps_and_cross_batches(spark):
    rows = [("s", datetime(2026, 1, 1) + timedelta(minutes=k), None if k % 7 == 3 else float(k % 5)) for k in range(300)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        got = values(compute(df, [I.EMA(period=6)]), "indicator__ema_6")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    np.testing.assert_allclose(got, pd.Series([r[2] for r in rows], dtype=float).ewm(span=6, adjust=False).mean())


@pytest.mark.parametrize("kernel", sorted(KERNELS))
def test_kernel_weights(kernel):
    w = weights(kernel, 5)
    assert len(w) == 5 and math.isclose(sum(w), 1)


def test_kernel_names():
    assert kernel_name("Log-Logistic") == "log logistic" and kernel_name("SQUARE") == "quartic"
    with pytest.raises(ValueError):
        kernel_name("round")


def test_signals_refuse(bars):
    for bad in ({"component": "era"}, {"period": 0}):
        with pytest.raises(ValueError):
            Cyclical(**bad)
    with pytest.raises(KeyError):
        compute(bars, [External(column="VIX")])
    assert External(column="My VIX.x").outputs() == ["indicator__my_vix_x__lag_0"]
    assert compute(bars, [HeikinAshi()]).count() == N


def test_bars_of_ties_and_nulls(spark):
    at = datetime(2026, 1, 1, 5, 30)
    rows = [("a", at, 3, 5.0), ("a", at, 1, 7.0), ("a", at, 2, None), ("b", at, 9, float("nan"))]
    out = to_bars(spark.createDataFrame(rows, "s string, ts timestamp_ntz, id int, p double"), "s", "ts", "p", ties=("id",)).collect()
    assert [(r["symbol"], r["open"], r["close"], r["high"], r["volume"]) for r in out] == [("a", 7.0, 5.0, 7.0, 2.0)]
    with pytest.raises(ValueError):
        validate(spark.range(3))


def test_read_bars_pushes_its_conditions_down(spark, bars, tmp_path):
    bars.write.parquet(str(tmp_path / "b"))
    out = read_bars(spark, str(tmp_path / "b"), "x", datetime(2026, 1, 5), datetime(2026, 1, 8))
    assert out.count() == 3 and "PushedFilters: [IsNotNull(symbol)" in out._jdf.queryExecution().toString()


def test_significance():
    assert math.isclose(M.probabilistic_sharpe_ratio(0.1, 101), 0.8407, abs_tol=2e-3) and M.probabilistic_sharpe_ratio(0.1, 101, 0.1) == 0.5
    assert M.expected_max_sharpe(1.0, 1) == 0 and M.expected_max_sharpe(1.0, 100) > M.expected_max_sharpe(1.0, 10) > 0
    assert M.deflated_sharpe_ratio(0.1, 101, 0.01, 50) < M.probabilistic_sharpe_ratio(0.1, 101)


def test_registered_search_and_interval_use_the_defaults(spark, tmp_path, monkeypatch):
    rows = [(k, "a", datetime(2026, 1, 1) + timedelta(hours=k), float(k % 7 + 1)) for k in range(30)]
    spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp, value double").write.parquet(str(tmp_path / "events.parquet"))
    calls = {}
    empty = {"optimize": [], "optimize_signals": [], "sharpe_interval": spark.createDataFrame([], "symbol string, sharpe double, ci_low double, ci_high double")}
    for module, name in ((trading_queries, "optimize"), (trading_queries, "optimize_signals"), (MC, "sharpe_interval")):
        bound = inspect.signature(getattr(module, name))

        def called(*args, _name=name, _bound=bound, **options):
            full = _bound.bind(*args, **options)
            full.apply_defaults()
            calls[_name] = full.arguments
            return empty[_name]

        monkeypatch.setattr(module, name, called)
    trading_queries.backtest_search(spark, str(tmp_path))
    trading_queries.signal_search(spark, str(tmp_path))
    trading_queries.sharpe_interval(spark, str(tmp_path))
    # the first batches are random, the later ones from the densities
    for name in ("optimize", "optimize_signals"):
        assert calls[name]["n_trials"] == 100 and RANDOM_TRIALS < 100 - calls[name]["batch"]
    assert calls["sharpe_interval"]["n_boot"] == 1000


def test_gates_on_all_baselines(spark):
    values = spark.createDataFrame([("a", 1499.5), ("b", None)], "name string, value double")
    baselines = spark.range(2500).select(F.col("id").cast("string").alias("baseline"), F.col("id").cast("double").alias("threshold"))
    got = M.promotion_gates(values, baselines, 0.5)
    assert got.columns == ["name", "value", "baseline", "threshold", "passed"]
    rows = {(r["name"], r["baseline"]): r["passed"] for r in got.collect()}
    assert rows == {("a", str(k)): k < 1499 for k in range(2500)} | {("b", str(k)): None for k in range(2500)}


def test_folds():
    made = X.walk_forward(10, 2, 0.6)
    assert [(f.train_from, f.train_to, f.test_from, f.test_to) for f in made] == [(0, 6, 6, 8), (0, 8, 8, 10)]
    assert X.walk_forward(10, 2, 0.6, expanding=False)[1].train_from == 2
    assert X.purged_split(100, 0.2, 5) == (75, 80)
    with pytest.raises(ValueError):
        X.walk_forward(3, 5)


def test_folds_reach_the_end_of_each_series(spark, tmp_path):
    start = datetime(2026, 1, 1)
    sizes = {"long": 611, "short": 41}
    rows = [(k, s, start + timedelta(hours=k), float(k % 7 + 1)) for s, n in sizes.items() for k in range(n)]
    spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r["symbol"], r["fold"], r["part"]): (r["n"], r["first_row"], r["last_row"]) for r in trading_queries.folds(spark, str(tmp_path)).collect()}
    want = {}
    for s, n in sizes.items():
        for f in X.walk_forward(n, 4, 0.6, embargo=5):
            want[s, f.fold, "train"] = (f.train_to - f.train_from, f.train_from, f.train_to - 1)
            want[s, f.fold, "test"] = (f.test_to - f.test_from, f.test_from, f.test_to - 1)
    assert got == want and {s: got[s, 3, "test"][2] + 1 for s in sizes} == sizes
    rolling = spark.range(43).withColumn("n", F.lit(43))
    for expanding, embargo in ((False, 0), (False, 9), (True, 40)):
        made = X.with_folds(rolling, X.walk_forward_columns(F.col("n"), 5, 0.3, expanding, embargo), "id").groupBy("fold", "part").agg(F.min("id"), F.max("id") + 1).collect()
        known = X.with_folds(rolling, X.walk_forward(43, 5, 0.3, expanding, embargo), "id").groupBy("fold", "part").agg(F.min("id"), F.max("id") + 1).collect()
        assert sorted(made) == sorted(known)
    with pytest.raises(Exception, match="3 rows are too few for 5 folds"):
        X.with_folds(spark.range(3).withColumn("n", F.lit(3)), X.walk_forward_columns(F.col("n")), "id").collect()


def test_scaler_of_a_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (5.0, 5.0)], "a double, b double")
    assert [r["b"] for r in X.Scaler.fit(df, ["a", "b"]).transform(df).collect()] == [0, 0, 0]
    assert [r["a"] for r in X.Scaler.fit(df, ["a"], "minmax").transform(df).orderBy("a").collect()] == [0, 0.5, 1]


def test_paths_keep_their_invariants(bars):
    for kind in MC.KINDS:
        made = MC.paths(bars, 3, kind, seed=4, block=5).cache()
        assert made.count() == 3 * N and made.filter("high < greatest(open, close) or low > least(open, close) or close <= 0").count() == 0
        again = MC.paths(bars.repartition(3), 3, kind, seed=4, block=5)
        assert made.orderBy("sim", "ts").toPandas().round(6).equals(again.orderBy("sim", "ts").toPandas().round(6))
    last = MC.paths(bars, 2, "shuffle", seed=1).groupBy("sim").agg(F.max_by("close", "ts").alias("c")).collect()
    assert all(math.isclose(r["c"], bars.agg(F.max_by("close", "ts")).first()[0], rel_tol=1e-9) for r in last)
    with pytest.raises(ValueError):
        MC.paths(bars, 1, "circular", block=N)


def test_blocks_are_cut_off_at_the_end_of_the_series(bars):
    past = [r["r"] for r in MC.history(bars).orderBy("i").collect()][1:]
    made = MC.paths(bars, 4, "stationary", seed=2, block=12).orderBy("sim", "ts").collect()
    for sim in range(4):
        closes = [r["close"] for r in made if r["sim"] == sim]
        drawn = [math.log(b / a) for a, b in zip(closes, closes[1:], strict=False)]
        at = [min(range(len(past)), key=lambda k: abs(past[k] - x)) for x in drawn]
        assert all(abs(past[k] - x) < 1e-9 for k, x in zip(at, drawn, strict=True))
        runs = sum(b == a + 1 for a, b in zip(at, at[1:], strict=False))
        assert runs > 0.75 * len(at) and not any(a == len(past) - 1 and b == 0 for a, b in zip(at, at[1:], strict=False) if a + 1 < len(past))


def test_normal_returns_have_the_drift_of_prices(bars):
    r = MC.history(bars).filter("i > 0").agg(F.avg("r").alias("mu"), F.stddev_pop("r").alias("sd")).first()
    made = MC.paths(bars, 400, "gbm", seed=5)
    w = Window.partitionBy("sim").orderBy("ts")
    found = made.withColumn("r", F.ln(F.col("close") / F.lag("close").over(w))).agg(F.avg("r").alias("mu"), F.stddev_pop("r").alias("sd"), F.count("r").alias("n")).first()
    assert abs(found["mu"] - (r["mu"] - r["sd"] ** 2 / 2)) < 4 * r["sd"] / found["n"] ** 0.5 and abs(found["sd"] / r["sd"] - 1) < 0.05


def test_nodes_read_nodes_of_the_same_plan(bars):
    chain = [I.SMA(column="signal__ha_close", period=3, lag=1), HeikinAshi(), I.EMA(column="indicator__sma_3_lag1", period=4)]
    got = compute(bars, chain)
    step = compute(compute(compute(bars, [chain[1]]), [chain[0]]), [chain[2]])
    assert sorted(got.columns) == sorted(step.columns)
    names = ["ts", *[c for n in chain for c in n.outputs()]]
    assert got.select(*[F.col(f"`{c}`") for c in names]).orderBy("ts").toPandas().equals(step.select(*[F.col(f"`{c}`") for c in names]).orderBy("ts").toPandas())
    with pytest.raises(ValueError):
        compute(bars, [I.SMA(column="indicator__ema_4", period=3), I.EMA(column="indicator__sma_3", period=4)])


def test_every_baseline_is_a_gate(spark):
    values = spark.createDataFrame([("a", 5.0), ("b", 600.0)], "name string, value double")
    baselines = spark.createDataFrame([(str(k), float(k)) for k in range(1001)], "baseline string, threshold double")
    found = M.promotion_gates(values, baselines)
    assert found.count() == 2002 and found.filter("passed").count() == 5 + 600


def test_intervals_and_percentiles_of_simulations(spark):
    rows = [("s", k, "m", float(k)) for k in range(101)] + [("s", 200, "m", float("nan")), ("s", 201, "m", None), ("s", 1, "other", 7.0)]
    results = spark.createDataFrame(rows, "symbol string, sim long, metric string, value double")
    assert tuple(MC.confidence_interval(results, "m").first()) == ("s", 5.0, 95.0)
    assert math.isclose(MC.percentile_of(results, "m", 49.5).first()["percentile"], 100 * 50 / 101)


def test_monte_carlo_search_and_network(spark, bars):
    strategy = Weighted(((I.SMA(period=5), 1.5), (I.SMA(period=20), -0.7)))
    out = MC.run(bars, strategy, 4, names=["total_return"])
    assert out.count() == 4 and MC.summary(out).first()["n_valid"] == 4
    space = {"n": IntParam(3, 9), "w": FloatParam(0.5, 2.0, log=True), "k": CategoricalParam(("a", "b"))}
    found = optimize(bars, space, lambda p: Weighted(((I.SMA(period=p["n"]), p["w"]),)) if p["k"] == "a" else 1 / 0, "total_return", 6, 3, seed=2)
    assert {t["state"] for t in found} <= {"complete", "failed", "pruned"} and best(found, "total_return")["params"]["k"] == "a"
    assert [t["params"] for t in load_trials(trials_table(spark, found))] == [t["params"] for t in found]
    rows = X.feature_matrix(bars, [I.Momentum(period=3), I.SMA(period=5)]).cache()
    names = ["indicator__momentum_3", "indicator__sma_5"]
    scaler = X.Scaler.fit(rows, names)
    net = Network.dense(names, (6,), seed=1).fit(scaler.transform(rows), epochs=15, rate=0.02)
    assert net.history[-1] < net.history[0]
    a = values(net.predict(scaler.transform(rows)), "prediction")
    np.testing.assert_allclose(a, values(Network.from_json(net.scaled(scaler).to_json()).predict(rows), "prediction"), atol=1e-9)
    signals = Learned(net.scaled(scaler), (I.Momentum(period=3), I.SMA(period=5)), Rules()).signals(bars)
    assert signals.filter("signal_strength is null").count() == 4
    page = report(backtest(bars, strategy, Account()), bars, "x")
    assert "total_return" in page and page.count("<svg") == 3


def test_gradients_match_differences():
    net = Network.dense(["a", "b"], (3,), seed=3)
    g = np.random.default_rng(0)
    x, y = g.standard_normal((20, 2)), g.standard_normal(20)
    for loss, option in (("mse", 0.1), ("directional", 0.1), ("pinball", 0.7)):
        _, grads = net.gradients(x, y, loss, option)
        w, eps = net.weights[0], 1e-6
        w[0, 1] += eps
        up, _ = net.gradients(x, y, loss, option)
        w[0, 1] -= 2 * eps
        down, _ = net.gradients(x, y, loss, option)
        w[0, 1] += eps
        assert math.isclose((up - down) / (2 * eps), grads[0][0, 1], rel_tol=1e-4, abs_tol=1e-6)


def test_plans_as_json():
    strategy = Weighted(((I.MACD(), 0.5), (KernelRegression(kernel="gaussian"), 1.0)))
    text = registry.plan_json(strategy)
    assert registry.plan_parts(text) == strategy.parts and json.loads(text)["rules"]["entry_threshold"] == 0.5
    assert "no protective stop" in registry.warnings(strategy) and len(registry.NODES) == 29


def test_sql_builder_is_recursive_where_it_must():
    assert "r1 AS" in Steps().ewm("y", "close", 0.5).select("y")


def test_streamed_bars_and_means(spark, tmp_path):
    from tidemark.streaming.bars import stream_bars, stream_ema

    at = datetime(2026, 1, 1)
    rows = [("a", at + timedelta(minutes=20 * k), float(k)) for k in range(30)]
    spark.createDataFrame(rows, "s string, ts timestamp, p double").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("s string, ts timestamp, p double").parquet(str(tmp_path / "in"))
    query = stream_bars(source, "s", "ts", "p").writeStream.format("memory").queryName("streamed").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    out = spark.sql("select * from streamed order by ts").collect()
    assert [(r["open"], r["close"], r["volume"]) for r in out[:2]] == [(0.0, 2.0, 3.0), (3.0, 5.0, 3.0)]
    bars = spark.readStream.schema("s string, ts timestamp, p double").parquet(str(tmp_path / "in")).selectExpr("s as symbol", "ts", "p as close")
    query = stream_ema(bars, 5).writeStream.format("memory").queryName("means").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.sql("select ema from means order by ts").toPandas()["ema"]
    np.testing.assert_allclose(got, pd.Series(range(30), dtype=float).ewm(span=5, adjust=False).mean())
