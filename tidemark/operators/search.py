"""Search for parameters: proposals from two densities of good and bad trials, evaluated a batch at a time in one Spark job."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import trials as D
from tidemark.operators.base import compute, strength_name
from tidemark.operators.metrics import METRICS, metrics
from tidemark.operators.simulate import Account, backtest, simulate
from tidemark.operators.strategy import SIGNAL, Weighted

#: Metrics that are better when lower.
MINIMISED = frozenset(["annual_volatility", "total_commission"])
#: Trials drawn at random before the search looks at results.
RANDOM_TRIALS = 10
#: Draws from the good trials' density of which the best ratio is taken, and the most trials that count as good.
CANDIDATES, MOST_GOOD = 24, 25


# --- parameters; ``axis`` is the line on which a parameter's density stands


@dataclass(frozen=True)
class IntParam:
    low: int
    high: int
    step: int = 1

    def __post_init__(self):
        if self.low > self.high or self.step < 1:
            raise ValueError("low must not be above high, step from 1")

    @property
    def _steps(self) -> int:
        return (self.high - self.low) // self.step

    def sample(self, g):
        return int(self.low + int(g.integers(0, self._steps + 1)) * self.step)

    def column(self, seed, trial, stream):
        return (D.whole(seed, trial, stream, self._steps + 1) * self.step + self.low).cast("int")

    def axis(self):
        return -0.5, self._steps + 0.5

    def place(self, value):
        return (value - self.low) / self.step

    def value(self, place):
        return int(self.low + min(max(round(place), 0), self._steps) * self.step)


@dataclass(frozen=True)
class FloatParam:
    low: float
    high: float
    log: bool = False

    def __post_init__(self):
        if self.low > self.high or self.log and self.low <= 0:
            raise ValueError("low must not be above high, and positive with log")

    def sample(self, g):
        a, b = self.axis()
        return self.value(g.uniform(a, b))

    def column(self, seed, trial, stream):
        a, b = self.axis()
        at = D.share(seed, trial, stream) * (b - a) + a
        return F.exp(at) if self.log else at

    def axis(self):
        return (math.log(self.low), math.log(self.high)) if self.log else (float(self.low), float(self.high))

    def place(self, value):
        return math.log(value) if self.log else float(value)

    def value(self, place):
        return float(min(max(math.exp(place) if self.log else place, self.low), self.high))


@dataclass(frozen=True)
class CategoricalParam:
    choices: tuple

    def __post_init__(self):
        if len(self.choices) < 2:
            raise ValueError("at least two choices")

    def sample(self, g):
        return self.choices[g.integers(0, len(self.choices))]

    def column(self, seed, trial, stream):
        return F.element_at(F.array(*map(F.lit, self.choices)), (D.whole(seed, trial, stream, len(self.choices)) + 1).cast("int"))


class _Line:
    """Parzen density on an axis: normal kernels at the values, cut off at its ends, and one as wide as the axis that stands for what is not known."""

    def __init__(self, param, values: list):
        self.a, self.b = param.axis()
        width = max(self.b - self.a, 1e-12)
        centres = np.array([*(param.place(v) for v in values), (self.a + self.b) / 2])
        order = np.argsort(centres, kind="stable")
        line = np.concatenate([[self.a], centres[order], [self.b]])
        gaps = np.diff(line)
        sd = np.empty(len(centres))
        sd[order] = np.clip(np.maximum(gaps[:-1], gaps[1:]), width / min(100, len(centres) + 1), width)
        sd[-1] = width
        self.centres, self.sd = centres, sd
        cdf = lambda z: 0.5 * (1 + np.array([math.erf(x / math.sqrt(2)) for x in z]))
        self.inside = cdf((self.b - centres) / sd) - cdf((self.a - centres) / sd)

    def draw(self, g) -> float:
        k = int(g.integers(0, len(self.centres)))
        for _ in range(100):
            x = g.normal(self.centres[k], self.sd[k])
            if self.a <= x <= self.b:
                return float(x)
        return float(g.uniform(self.a, self.b))

    def log_density(self, x: float) -> float:
        z = (x - self.centres) / self.sd
        return float(np.log(np.mean(np.exp(-0.5 * z * z) / (self.sd * self.inside * math.sqrt(2 * math.pi))) + 1e-300))


class _Choices:
    """Shares of the choices among the values, as if each had come up once before."""

    def __init__(self, param: CategoricalParam, values: list):
        self.choices = param.choices
        counts = np.array([1.0 + sum(v == c for v in values) for c in param.choices])
        self.shares = counts / counts.sum()

    def draw(self, g):
        return self.choices[int(g.choice(len(self.choices), p=self.shares))]

    def log_density(self, x) -> float:
        return math.log(self.shares[self.choices.index(x)])


def propose(space: dict, done: list[tuple[dict, float]], seed: int, number: int, maximise: bool) -> dict:
    """Parameters of a trial, drawn by its number's own generator.

    At random until RANDOM_TRIALS have a value. Then the best tenth are good
    and the others bad; of CANDIDATES values from a parameter's density among
    the good ones the one with the largest ratio to that among the bad is taken.
    """
    g = np.random.default_rng([seed, number])
    ranked = sorted((d for d in done if math.isfinite(d[1])), key=lambda d: -d[1] if maximise else d[1])
    if len(ranked) < RANDOM_TRIALS:
        return {k: p.sample(g) for k, p in space.items()}
    n = min(MOST_GOOD, -(-len(ranked) // 10))
    out = {}
    for name, param in space.items():
        kind = _Choices if isinstance(param, CategoricalParam) else _Line
        good, bad = (kind(param, [d[0][name] for d in part]) for part in (ranked[:n], ranked[n:]))
        drawn = [good.draw(g) for _ in range(CANDIDATES)]
        best_of = max(drawn, key=lambda x: good.log_density(x) - bad.log_density(x))
        out[name] = best_of if kind is _Choices else param.value(best_of)
    return out


# --- the log of a study


class TrialLog:
    """Trials as files of a shared folder, which several drivers may add to and which outlives any of them.

    A driver claims a number by creating its file, which succeeds once: on
    HDFS and POSIX folders that is atomic. A result is written aside and renamed.
    A claim without a result is a trial that its driver did not end; its number
    is not given out again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def _names(self, start: str) -> list[str]:
        return sorted(n for s in self._fs.listStatus(self._path(self.folder)) if (n := s.getPath().getName()).startswith(start))

    def claim(self, count: int) -> list[int]:
        """So many numbers that no one else has."""
        taken = self._names("claim-")
        number, mine = int(taken[-1][6:]) + 1 if taken else 0, []
        while len(mine) < count:
            if self._fs.createNewFile(self._path(f"{self.folder}/claim-{number:09d}")):
                mine.append(number)
            number += 1
        return mine

    def add(self, trial: dict) -> None:
        name = f"{self.folder}/trial-{trial['number']:09d}"
        out = self._fs.create(self._path(f"{name}.tmp"), True)
        out.write(json.dumps(trial).encode())
        out.close()
        self._fs.rename(self._path(f"{name}.tmp"), self._path(f"{name}.json"))

    def trials(self) -> list[dict]:
        """All results so far, by number."""
        if not any(n.endswith(".json") for n in self._names("trial-")):
            return []
        rows = self.spark.read.text(f"{self.folder}/trial-*.json", wholetext=True).collect()  # one short row a trial
        return sorted((json.loads(r["value"]) for r in rows), key=lambda t: t["number"])


# --- search


def search(space: dict, evaluate: Callable[[list[dict]], Iterable[dict]], n_trials: int = 100, batch: int = 16, seed: int = 0, maximise: bool = True, done: list[dict] | None = None, log: TrialLog | None = None) -> list[dict]:
    """Trials, each a dict of number, params, state (complete, pruned, failed) and value, until n_trials are there.

    evaluate gets the trials of a batch, with number and params, and gives them
    back with state and value, and whatever else they have. ``done`` takes up earlier
    trials; with a log its trials are taken up, and each is added to it as its batch ends.
    """
    trials = log.trials() if log else list(done or [])
    while len(trials) < n_trials:
        count = min(batch, n_trials - len(trials))
        numbers = log.claim(count) if log else range(len(trials), len(trials) + count)
        seen = [(t["params"], t["value"]) for t in trials if t["state"] == "complete"]
        made = list(evaluate([{"number": n, "params": propose(space, seen, seed, n, maximise), "state": "failed", "value": None} for n in numbers]))
        for t in made if log else ():
            log.add(t)
        trials = log.trials() if log else trials + made  # other drivers' too
    return trials


def _valued(trial: dict, value) -> dict:
    ok = value is not None and math.isfinite(value)
    return trial | {"state": "complete" if ok else "pruned", "value": float(value) if ok else None}


def _groups(made: list[tuple[dict, object]]) -> list[list[tuple[dict, object]]]:
    """Trials whose strategies can share one plan: weighted ones of equal rules whose nodes don't clash; others alone."""
    groups: list[tuple[object, dict, list]] = []
    for trial, strategy in made:
        if not isinstance(strategy, Weighted):
            groups.append((None, {}, [(trial, strategy)]))
            continue
        own = {name: node.spec() for node, _ in strategy.parts for name in node.outputs()}
        for rules, names, members in groups:
            if rules == strategy.rules and all(names.get(k, v) == v for k, v in own.items()):
                names.update(own)
                members.append((trial, strategy))
                break
        else:
            groups.append((strategy.rules, own, [(trial, strategy)]))
    return [members for _, _, members in groups]


def _backtested(bars: DataFrame, members: list[tuple[dict, object]], account: Account) -> DataFrame:
    """(number, metrics by series) of trials that share a plan: all nodes once, a signal for each trial, one simulation keyed by trial."""
    if not isinstance(members[0][1], Weighted):
        trial, strategy = members[0]
        return metrics(backtest(bars, strategy, account)).withColumn("number", F.lit(trial["number"]))
    nodes = list({name: node for _, s in members for node, _ in s.parts for name in node.outputs()[:1]}.values())
    frame = compute(bars, nodes, strengths=True)
    signal = lambda s: F.tanh(sum((F.col(strength_name(n)) * F.lit(float(w)) for n, w in s.parts), F.lit(0.0)))
    each = F.explode(F.array(*[F.struct(F.lit(t["number"]).alias("number"), signal(s).alias(SIGNAL)) for t, s in members]))
    others = [F.col(f"`{c}`") for c in frame.columns if c != "symbol"]
    rows = frame.select("symbol", *others, each.alias("__trial")).select("__trial.*", F.concat_ws("#", "__trial.number", "symbol").alias("symbol"), *others)
    return metrics(simulate(rows, members[0][1].rules, account, ("number", "symbol")), ("number", "symbol"))


def optimize(bars: DataFrame, space: dict, factory: Callable[[dict], object], metric: str = "sharpe_ratio", n_trials: int = 100, batch: int = 16, seed: int = 0, account: Account = Account(), maximise: bool | None = None, done: list[dict] | None = None, log: TrialLog | None = None) -> list[dict]:
    """``search`` for strategies by a metric of their backtests, its mean over series.

    Weighted strategies of a batch share one plan and one simulation, whatever
    the batch's size. A factory that raises fails its trial; a value that is no
    number prunes it. bars should be cached or cheap to read.
    """
    if metric not in METRICS:
        raise KeyError(metric)

    def evaluate(trials: list[dict]) -> list[dict]:
        made, failed = [], []
        for t in trials:
            try:
                made.append((t, factory(t["params"])))
            except Exception as error:
                failed.append(t | {"error": str(error)})
        out = []
        for members in _groups(made):
            try:
                rows = _backtested(bars, members, account).groupBy("number").agg(F.avg(metric).alias("value")).collect()  # one row a trial
            except Exception as error:
                failed += [t | {"error": str(error)[:500]} for t, _ in members]
                continue
            values = {r["number"]: r["value"] for r in rows}
            out += [_valued(t, values.get(t["number"])) for t, _ in members]
        return sorted([*out, *failed], key=lambda t: t["number"])

    return search(space, evaluate, n_trials, batch, seed, metric not in MINIMISED if maximise is None else maximise, done, log)


def optimize_signals(bars: DataFrame, space: dict, parts: Callable[[dict], list[tuple[str, int, float]]], split=None, n_trials: int = 100, batch: int = 16, seed: int = 0, column: str = "close", block_rows: int | None = None, done: list[dict] | None = None, log: TrialLog | None = None) -> list[dict]:
    """``search`` by the correlation of signals with the next return (``trials.scores``); one scan of the bars a batch.

    parts gives a trial's (family, period, weight). Each trial also has its
    valid_value, of the bars from ``split`` on, which the search does not look at.
    """
    spark = bars.sparkSession

    def evaluate(trials: list[dict]) -> list[dict]:
        rows = [(t["number"], f, int(p), float(w)) for t in trials for f, p, w in parts(t["params"])]
        table = spark.createDataFrame(rows, "trial long, family string, period int, weight double")
        found = {r["trial"]: r for r in D.scores(bars, table, split, column, block_rows).collect()}  # one row a trial
        return [_valued(t, found[t["number"]]["score"]) | {"valid_value": found[t["number"]]["valid_score"]} for t in trials]

    return search(space, evaluate, n_trials, batch, seed, True, done, log)


def best(trials: list[dict], metric: str = "sharpe_ratio", maximise: bool | None = None) -> dict:
    up = metric not in MINIMISED if maximise is None else maximise
    good = [t for t in trials if t["state"] == "complete"]
    if not good:
        raise ValueError("no trial is complete")
    return (max if up else min)(good, key=lambda t: t["value"])


def trials_table(spark, trials: list[dict]) -> DataFrame:
    """number, state, value, valid_value, params (as JSON) of the trials, to be written and read back with load_trials()."""
    rows = [(t["number"], t["state"], t["value"], t.get("valid_value"), json.dumps(t["params"])) for t in trials]
    return spark.createDataFrame(rows, "number int, state string, value double, valid_value double, params string")


def load_trials(table: DataFrame) -> list[dict]:
    return [{"number": r["number"], "state": r["state"], "value": r["value"], "valid_value": r["valid_value"], "params": json.loads(r["params"])} for r in table.orderBy("number").collect()]
