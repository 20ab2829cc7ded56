"""Significance as columns, gates, scores of paths, the report page."""

import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tests.test_blocks import bars
from tidemark.operators import indicators as I
from tidemark.operators import metrics as M
from tidemark.operators import montecarlo as MC
from tidemark.operators.simulate import Account, backtest
from tidemark.operators.strategy import Weighted
from tidemark.sources import report as R


def test_normal_distribution_as_a_column(spark):
    points = [k / 8 for k in range(-76, 77)] + [None]
    got = spark.createDataFrame([(z,) for z in points], "z double").select("z", M.normal_cdf(F.col("z")).alias("p")).collect()
    for r in got:
        assert r["p"] is None if r["z"] is None else math.isclose(r["p"], NormalDist().cdf(r["z"]), abs_tol=2e-15)


def test_significance_of_each_series_is_that_of_its_numbers(spark):
    g = random.Random(2)
    rows = [(f"s{k}", g.gauss(0.0005 * k, 0.01)) for k in range(6) for _ in range(30 + 40 * k)] + [("one", 0.01), ("flat", 0.01), ("flat", 0.01), ("flat", None)]
    moments = M.return_moments(spark.createDataFrame(rows, "symbol string, ret double"))
    for options in ({}, {"n_trials": 40, "variance": 0.02, "benchmark": 0.05}):
        found = M.significance(moments, **options).collect()
        known = [r["sharpe"] for r in found if r["sharpe"] is not None]
        mean = sum(known) / len(known)
        variance = options.get("variance", sum((x - mean) ** 2 for x in known) / (len(known) - 1))
        for r in found:
            if r["sharpe"] is None or r["n"] < 2:
                assert r["psr"] is None and r["deflated"] is None
                continue
            assert math.isclose(r["psr"], M.probabilistic_sharpe_ratio(r["sharpe"], r["n"], options.get("benchmark", 0.0), r["skew"], r["kurtosis"]), abs_tol=1e-12)
            assert math.isclose(r["deflated"], M.deflated_sharpe_ratio(r["sharpe"], r["n"], variance, options.get("n_trials", len(known)), r["skew"], r["kurtosis"]), abs_tol=1e-9)
    assert M.significance(moments.limit(0)).count() == 0


def test_too_many_baselines_are_an_error(spark, monkeypatch):
    values = spark.createDataFrame([("a", 1.0)], "name string, value double")
    baselines = spark.range(11).select(F.col("id").cast("string").alias("baseline"), F.col("id").cast("double").alias("threshold"))
    assert M.promotion_gates(values, baselines).count() == 11
    monkeypatch.setattr(M, "MAX_BASELINES", 10)
    with pytest.raises(ValueError):
        M.promotion_gates(values, baselines)


@pytest.mark.parametrize("kind", ["stationary", "circular", "wrapped", "shuffle", "gbm"])
def test_scores_of_paths(spark, kind):
    frame = bars(spark, {"a": 70, "b": 40, "tiny": 2})
    made = MC.paths(frame, 4, kind, seed=3).cache()
    rows = {}
    for r in sorted(made.collect(), key=lambda r: r["ts"]):
        rows.setdefault((r["symbol"], r["sim"]), []).append(r["close"])
    assert {k: len(v) for k, v in rows.items()} == {(s, k): n for s, n in (("a", 70), ("b", 40)) for k in range(4)}
    got = {(r["symbol"], r["sim"], r["metric"]): r["value"] for r in MC.path_scores(made).collect()}
    for (symbol, sim), c in rows.items():
        steps = [math.log(y / x) for x, y in zip(c[:-1], c[1:], strict=True)]
        mean = sum(steps) / len(steps)
        assert math.isclose(got[symbol, sim, "log_return"], math.log(c[-1] / c[0]), abs_tol=1e-9)
        assert math.isclose(got[symbol, sim, "volatility"], math.sqrt(sum((s - mean) ** 2 for s in steps) / (len(steps) - 1)), rel_tol=1e-9)
        assert math.isclose(got[symbol, sim, "max_drawdown"], min(x / max(c[: k + 1]) - 1 for k, x in enumerate(c)), abs_tol=1e-12)
    if kind == "shuffle":
        assert all(math.isclose(got["a", k, "log_return"], got["a", 0, "log_return"], abs_tol=1e-9) for k in range(4))


def test_intervals_by_running_sums_are_those_of_the_rows(spark):
    """Each resampling's ratio, of its blocks' sums, is that of its returns one by one."""
    g = random.Random(5)
    values = [g.gauss(0.001, 0.01) for _ in range(47)]
    rows = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)] + [("a", 99, None)], "symbol string, ts int, ret double")
    draws = {(r["sim"], r["k"]): r["d"] for r in spark.range(60).select(F.col("id").alias("sim"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("k")).select("sim", "k", MC.draw(4, F.col("sim"), F.col("k"), 1).alias("d")).collect()}
    ratios = []
    for sim in range(60):
        own = [values[(draws[sim, k] + j) % 47] for k in range(10) for j in range(min(5, 47 - 5 * k))]
        mean = sum(own) / 47
        ratios.append(mean / math.sqrt(sum((v - mean) ** 2 for v in own) / 46) * math.sqrt(252))
    ratios.sort()
    at = lambda q: ratios[int(q * 59)] + (q * 59 - int(q * 59)) * (ratios[min(59, int(q * 59) + 1)] - ratios[int(q * 59)])
    r = MC.sharpe_interval(rows, 5, 60, seed=4).first()
    assert math.isclose(r["ci_low"], at(0.025), rel_tol=1e-9) and math.isclose(r["ci_high"], at(0.975), rel_tol=1e-9)


def test_report_is_written_and_curves_keep_their_ends(spark, tmp_path):
    frame = bars(spark, {"a&b": 90})
    result = backtest(frame, Weighted(((I.SMA(period=5), 1.0),)), Account())
    R.write_report(result, frame, "a&b", str(tmp_path / "page"), "T<1>")
    page = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "page")).collect())
    assert "T&lt;1&gt;: a&amp;b" in page and "total_return" in page and page.count("<svg") == 3
    few = R.thinned(frame.select("ts", "close"), 10).collect()
    last = frame.agg(F.max("ts")).first()[0]
    assert 9 <= len(few) <= 10 and few[-1]["ts"] == last and [r["ts"] for r in few] == sorted(r["ts"] for r in few)
    assert R.thinned(frame.limit(0).select("ts", "close")).count() == 0
