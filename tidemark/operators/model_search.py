"""Search over indicators, periods and lags, with a network for each trial.

A batch of trials is one table of all their columns and one training
(``training``): each trial's network reads its own columns and trains on rows that
lack none of them. At the rungs of a batch, trials that are worse than the median
of all that have come there stop.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from statistics import median

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import indicators
from tidemark.operators.base import Node, compute
from tidemark.operators.features import Fold, Scaler, next_log_return
from tidemark.operators.metrics import METRICS, metrics
from tidemark.operators.network import Network
from tidemark.operators.search import MINIMISED, CategoricalParam, IntParam, TrialLog, best, search
from tidemark.operators.simulate import Account, backtest
from tidemark.operators.strategy import Learned, Rules
from tidemark.operators.training import Job, Table, fit_scalers, train_side_by_side

#: Epochs between two rungs, and trials that have to have come to one before it stops any.
RUNG, LEAST_TRIALS = 5, 5


@dataclass(frozen=True)
class IndicatorSpec:
    """An indicator that a trial may have: with a period between two bounds and one of some lags."""

    name: str
    node: type[Node]
    period_low: int
    period_high: int
    lag_values: tuple[int, ...] = (0,)
    optional: bool = True

    def __post_init__(self):
        if not self.name or not 1 <= self.period_low <= self.period_high:
            raise ValueError("a name is needed, and periods from 1 with low not above high")
        if not self.lag_values or min(self.lag_values) < 0:
            raise ValueError("lags from 0, one at least")
        if "period" not in {f for f in self.node.__dataclass_fields__}:
            raise ValueError(f"{self.node.__name__} has no period")

    def space(self) -> dict:
        out: dict = {f"{self.name}__include": CategoricalParam((True, False))} if self.optional else {}
        out[f"{self.name}__period"] = IntParam(self.period_low, self.period_high)
        if len(self.lag_values) > 1:
            out[f"{self.name}__lag"] = CategoricalParam(tuple(self.lag_values))
        return out

    def chosen(self, params: dict) -> Node | None:
        if self.optional and not params[f"{self.name}__include"]:
            return None
        return self.node(period=params[f"{self.name}__period"], lag=params.get(f"{self.name}__lag", self.lag_values[0]))


def specs_json(specs: list[IndicatorSpec]) -> str:
    return json.dumps([{"name": s.name, "node": s.node.__name__, "period": [s.period_low, s.period_high], "lags": list(s.lag_values), "optional": s.optional} for s in specs])


def specs_of(text: str) -> list[IndicatorSpec]:
    return [IndicatorSpec(d["name"], getattr(indicators, d["node"]), *d["period"], tuple(d["lags"]), d["optional"]) for d in json.loads(text)]


def _nodes(specs: list[IndicatorSpec], params: dict) -> list[Node]:
    return list({n.outputs()[0]: n for s in specs if (n := s.chosen(params)) is not None}.values())


@dataclass
class Found:
    """What a search has found: its trials, and the best one's network, trained anew for all epochs, with its scores."""

    specs: list[IndicatorSpec]
    metric: str
    trials: list[dict]
    nodes: list[Node]
    network: Network
    scaler: Scaler
    test_loss: float | None
    correlation: float | None
    scores: dict[str, dict] = field(default_factory=dict)

    @property
    def best(self) -> dict:
        return _best(self.trials, self.metric)

    def strategy(self, rules: Rules = Rules()) -> Learned:
        """On raw features: the scaler is in the network's first layer."""
        return Learned(self.network.scaled(self.scaler), tuple(self.nodes), rules)

    def summary(self) -> str:
        states = [t["state"] for t in self.trials]
        counts = ", ".join(f"{states.count(s)} {s}" for s in ("complete", "pruned", "failed"))
        lines = [f"{len(states)} trials: {counts}", f"best: trial {self.best['number']}, {self.metric} {self.best['value']:.6g}", "features: " + ", ".join(self.network.features)]
        for part, values in self.scores.items():
            lines.append(f"{part}: " + ", ".join(f"{k} {v:.6g}" for k, v in values.items() if v is not None))
        return "\n".join(lines)


def _best(trials: list[dict], metric: str) -> dict:
    return best(trials, metric, _rising(metric))


def _rising(metric: str) -> bool:
    if metric not in ("test_loss", "correlation", *METRICS):
        raise KeyError(metric)
    return metric != "test_loss" and metric not in MINIMISED


def _rungs(earlier: list[dict], every: int, least: int) -> Callable[[int, list[Job]], set[int]]:
    """Which jobs stop after an epoch: at a rung, those whose least loss so far is above the median of the losses there."""
    seen: dict[int, list[float]] = {}
    for t in earlier:
        for epoch, value in enumerate(t.get("losses") or (), 1):
            seen.setdefault(epoch, []).append(value)

    def after(epoch: int, live: list[Job]) -> set[int]:
        there = [j for j in live if len(j.test_losses) == epoch]
        values = seen.setdefault(epoch, [])
        values += [j.test_losses[-1] for j in there]
        if epoch % every or len(values) < least:
            return set()
        middle = median(values)
        return {j.key for j in there if min(j.test_losses) > middle}

    return after


class ModelSearch:
    """Trials of networks on one table of bars.

    train_to and test_to are times: bars before the first train, those from it
    up to the second judge the trials, what follows is for the caller's own test.
    metric is test_loss, correlation (of outputs and targets) or one of a
    backtest of the judging bars. target is the next bar's log return.
    """

    def __init__(self, bars: DataFrame, specs: list[IndicatorSpec], train_to, test_to=None, metric: str = "correlation", layers: tuple[int, ...] = (16,), epochs: int = 20, rate: float = 0.01, loss: str = "mse", dropout: float = 0.2, seed: int = 0, rung: int = RUNG, least_trials: int = LEAST_TRIALS, rules: Rules = Rules(), account: Account = Account()):
        if len({s.name for s in specs}) < len(specs) or not specs:
            raise ValueError("specs with names of their own are needed")
        self.bars, self.specs, self.metric, self.rising = bars, list(specs), metric, _rising(metric)
        self.train_to, self.test_to, self.layers, self.rules, self.account = train_to, test_to, layers, rules, account
        self.options = {"epochs": epochs, "rate": rate, "loss": loss, "dropout": dropout, "seed": seed}
        self.seed, self.rung, self.least = seed, rung, least_trials
        self.space = {k: p for s in specs for k, p in s.space().items()}

    def _table(self, nodes: list[Node]) -> tuple[Table, list[str]]:
        """The columns of all nodes; ts decides what trains and what judges."""
        names = list(dict.fromkeys(c for n in nodes for c in n.outputs()))
        frame = next_log_return(compute(self.bars, list(dict.fromkeys(nodes))))
        late = F.when(F.col("ts") < F.lit(self.train_to), 0).when(F.lit(True) if self.test_to is None else F.col("ts") < F.lit(self.test_to), 1).otherwise(2)
        return Table(frame.withColumn("row", late), names, folds=[Fold(0, 0, 1, 1, 2)]), names

    def _job(self, key: int, nodes: list[Node], names: list[str]) -> Job:
        own = [c for n in nodes for c in n.outputs()]
        return Job(key, Network.dense(own, self.layers, seed=self.seed), [names.index(c) for c in own])

    def _trained(self, trials: list[tuple[int, list[Node]]], after=None) -> list[Job]:
        table, names = self._table([n for _, nodes in trials for n in nodes])
        jobs = [self._job(number, nodes, names) for number, nodes in trials]
        fit_scalers(table, jobs)
        return train_side_by_side(table, jobs, after=after, **self.options)

    def _judged(self, job: Job, nodes: list[Node]) -> float | None:
        if self.metric == "test_loss":
            return job.test_losses[-1] if job.test_losses else None
        if self.metric == "correlation":
            return job.correlation
        return self._backtested(self._network(job), nodes, self.train_to, self.test_to)[self.metric]

    def _network(self, job: Job) -> Network:
        return job.network.scaled(self._scaler(job))

    @staticmethod
    def _scaler(job: Job) -> Scaler:
        return Scaler(tuple(job.network.features), tuple(job.offsets.tolist()), tuple(job.scales.tolist()))

    def _backtested(self, network: Network, nodes: list[Node], start, end) -> dict:
        """Means over series of the metrics of a backtest of bars in [start, end)."""
        signals = Learned(network, tuple(nodes), self.rules).signals(self.bars)  # indicators look back beyond start
        own = signals.filter((F.col("ts") >= F.lit(start)) & (F.lit(True) if end is None else F.col("ts") < F.lit(end)))

        @dataclass(frozen=True)
        class Given:
            rules: Rules

            def signals(self, bars):
                return bars

        return metrics(backtest(own, Given(self.rules), self.account)).agg(*[F.avg(m).alias(m) for m in METRICS]).first().asDict()

    def run(self, n_trials: int = 50, batch: int = 16, log: TrialLog | None = None) -> Found:
        """n_trials trials; a trial without an indicator, training rows or a value is pruned, as is one that a rung stops."""
        earlier: list[dict] = log.trials() if log else []

        def evaluate(trials: list[dict]) -> list[dict]:
            made = [(t, _nodes(self.specs, t["params"])) for t in trials]
            some = [(t["number"], nodes) for t, nodes in made if nodes]
            jobs = {j.key: j for j in self._trained(some, _rungs(earlier, self.rung, self.least))} if some else {}
            out = []
            for t, nodes in made:
                job = jobs.get(t["number"])
                epochs = len(job.losses) if job else 0
                value = self._judged(job, nodes) if job and epochs == self.options["epochs"] else None
                ok = value is not None and math.isfinite(value)
                out.append(t | {"state": "complete" if ok else "pruned", "value": float(value) if ok else None, "epochs": epochs, "losses": job.test_losses if job else []})
            earlier.extend(out)
            return out

        trials = search(self.space, evaluate, n_trials, batch, self.seed, self.rising, log=log)
        top = _best(trials, self.metric)
        nodes = _nodes(self.specs, top["params"])
        job = self._trained([(0, nodes)])[0]
        scores = {"judged": {"loss": job.test_losses[-1] if job.test_losses else None, "correlation": job.correlation}}
        if self.test_to is not None:
            scores["later"] = self._later(job, nodes)
        return Found(self.specs, self.metric, trials, nodes, job.network, self._scaler(job), scores["judged"]["loss"], job.correlation, scores)

    def _later(self, job: Job, nodes: list[Node]) -> dict:
        """Loss and correlation on the bars from test_to on, which no trial has seen."""
        frame = next_log_return(compute(self.bars, nodes)).filter(F.col("ts") >= F.lit(self.test_to))
        made = self._network(job).predict(frame, "__p").filter("__p IS NOT NULL AND target IS NOT NULL")
        row = made.agg(F.avg((F.col("__p") - F.col("target")) ** 2).alias("loss"), F.corr("__p", "target").alias("correlation")).first()
        return {k: None if row[k] is None or np.isnan(row[k]) else row[k] for k in ("loss", "correlation")}


def without(spec: IndicatorSpec) -> IndicatorSpec:
    """The spec, no longer optional."""
    return replace(spec, optional=False)
