"""Networks trained side by side: one pass over the rows is a step of all of them.

A job is a network with the columns that it reads, a fold and a scaler. The
rows are stored once with all columns that any job reads. In each pass a task
sums the gradients of every job's own rows (those of its fold that lack none of
its columns), sums of tasks are added by job, and the driver moves the weights. What
reaches the driver is one vector of weights a job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.storage import stored
from tidemark.operators.features import Fold

#: Numbers that the networks of one call may have together; they are sent to every task at each step.
MAX_NUMBERS = 20_000_000
TRAIN, TEST = 1, 2


@dataclass
class Job:
    """A network to train on some columns (by their place) and one fold of a table."""

    key: int
    network: object
    columns: list[int]
    fold: int = 0
    offsets: np.ndarray | None = None
    scales: np.ndarray | None = None
    losses: list[float] = field(default_factory=list)
    test_losses: list[float] = field(default_factory=list)
    correlation: float | None = None


class Table:
    """Rows to train on, stored: features f0, f1, ..., target y, a key for each row, and for each fold whether it trains or tests."""

    def __init__(self, frame: DataFrame, features: list[str], target: str = "target", folds: list[Fold] | None = None, row: str = "row", keys: tuple[str, ...] = ("symbol", "ts")):
        part = lambda f: F.when((F.col(row) >= f.train_from) & (F.col(row) < f.train_to), TRAIN).when((F.col(row) >= f.test_from) & (F.col(row) < f.test_to), TEST).otherwise(0)
        parts = [part(f) for f in folds] if folds else [F.lit(TRAIN)]
        known = [c for c in keys if c in frame.columns] or features
        columns = [F.col(f"`{c}`").cast("double").alias(f"f{k}") for k, c in enumerate(features)]
        rows = frame.select(*columns, F.col(f"`{target}`").cast("double").alias("y"), F.xxhash64(*[F.col(f"`{c}`") for c in known]).alias("key"), *[p.cast("int").alias(f"p{k}") for k, p in enumerate(parts)])
        used = F.greatest(F.lit(0), *[F.col(f"p{k}") for k in range(len(parts))]) > 0
        self.rows = stored(rows.filter(F.col("y").isNotNull() & ~F.isnan("y") & used), "training")
        self.features, self.tasks = list(features), self.rows.rdd.getNumPartitions()

    @property
    def spark(self):
        return self.rows.sparkSession


def _arrays(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names], axis=1)


# --- dropout from counters


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 scrambled bits of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def dropout_masks(keys: np.ndarray, widths: list[int], share: float, seed: int, step: int) -> list[np.ndarray] | None:
    """For each hidden layer what its units are multiplied by: 0 for about ``share`` of them, else 1 / (1 - share).

    A number drawn from (seed, step, row's key, layer, unit) decides, so that
    it does not matter which task a row is in.
    """
    if not share:
        return None
    out = []
    with np.errstate(over="ignore"):
        row = _mixed(keys.astype(np.int64).view(np.uint64) + _mixed(np.array([seed * 2_654_435_761 + step], np.uint64))[0])
        for layer, width in enumerate(widths):
            unit = _mixed(np.arange(width, dtype=np.uint64) + np.uint64(layer << 32) + _ODD)
            drawn = _mixed(row[:, None] ^ unit[None, :]) >> np.uint64(11)
            out.append(np.where(drawn.astype(np.float64) * 2.0**-53 < share, 0.0, 1.0 / (1.0 - share)))
    return out


# --- passes


_SUMS = "key int, part int, n long, total double, numbers binary, test_n long, test_total double, test_sums binary"


def _pass(table: Table, jobs: list[Job], each: Callable) -> dict[int, dict]:
    """Sums by job over all rows: each(job, x, y, keys, parts) gives (n, total, numbers, test_n, test_total, test_sums) of some rows."""
    width = len(table.features)
    sent = table.spark.sparkContext.broadcast(jobs)

    def run(batches):
        from pyspark import TaskContext

        own = sent.value
        sums: list = [None] * len(own)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _arrays(batch, [f"f{k}" for k in range(width)]), _arrays(batch, ["y"])[:, 0]
            keys = batch.column("key").to_numpy()
            for k, job in enumerate(own):
                part = batch.column(f"p{job.fold}").to_numpy(zero_copy_only=False)
                rows = np.flatnonzero((part > 0) & ~np.isnan(x[:, job.columns]).any(axis=1))
                if not len(rows):
                    continue
                found = each(job, x[np.ix_(rows, job.columns)], y[rows], keys[rows], part[rows])
                sums[k] = found if sums[k] is None else tuple(a + b for a, b in zip(sums[k], found, strict=True))
        part = TaskContext.get().partitionId()
        out = [{"key": job.key, "part": part % 32, "n": int(s[0]), "total": float(s[1]), "numbers": s[2].tobytes(), "test_n": int(s[3]), "test_total": float(s[4]), "test_sums": s[5].tobytes()} for job, s in zip(own, sums, strict=True) if s is not None]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("key", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("total", pa.float64()), ("numbers", pa.binary()), ("test_n", pa.int64()), ("test_total", pa.float64()), ("test_sums", pa.binary())])

    def add(found: pa.Table) -> pa.Table:
        rows = found.to_pylist()
        one = {c: sum(r[c] for r in rows) for c in ("n", "total", "test_n", "test_total")} | {c: np.sum([np.frombuffer(r[c]) for r in rows], axis=0).tobytes() for c in ("numbers", "test_sums")}
        return pa.Table.from_pylist([rows[0] | one], schema)

    made = table.rows.mapInArrow(run, _SUMS)
    if table.tasks > 32:  # else a job's sums are few enough to be added at once
        made = made.groupBy("key", "part").applyInArrow(add, _SUMS)
    rows = made.groupBy("key").applyInArrow(add, _SUMS).collect()  # one row a job
    sent.unpersist()
    return {r["key"]: r.asDict() | {c: np.frombuffer(r[c]) for c in ("numbers", "test_sums")} for r in rows}


def fit_scalers(table: Table, jobs: list[Job]) -> None:
    """Mean and deviation of each job's columns over its own training rows; a constant column is scaled by 1."""

    def first(job, x, y, keys, part):
        own = x[part == TRAIN]
        return len(own), 0.0, own.sum(axis=0), 0, 0.0, np.zeros(1)

    means = {k: r["numbers"] / max(1, r["n"]) for k, r in _pass(table, jobs, first).items()}

    def second(job, x, y, keys, part):
        own = x[part == TRAIN] - means[job.key]
        return len(own), 0.0, (own * own).sum(axis=0), 0, 0.0, np.zeros(1)

    found = _pass(table, jobs, second)
    for job in jobs:
        r = found.get(job.key)
        if r is None:
            job.offsets, job.scales = np.zeros(len(job.columns)), np.ones(len(job.columns))
            continue
        sd = np.sqrt(r["numbers"] / max(1, r["n"]))
        job.offsets, job.scales = means[job.key], np.where(sd > 1e-12 * (1 + np.abs(means[job.key])), sd, 1.0)


def train_side_by_side(table: Table, jobs: list[Job], epochs: int = 20, rate: float = 0.01, loss: str = "mse", option: float = 0.1, dropout: float = 0.0, seed: int = 0, after: Callable[[int, list[Job]], set[int]] | None = None) -> list[Job]:
    """Adam over whole passes for all jobs; each gets its losses on training and test rows by epoch.

    A test loss is that of the weights after the epoch; its last correlation
    is that of outputs and targets on test rows. after(epoch, live jobs) gives
    the keys of jobs to stop. Jobs without training rows stay as they are.
    """
    from tidemark.operators.network import LOSSES

    if loss not in LOSSES:
        raise ValueError(f"unknown loss {loss!r}; one of {LOSSES}")
    if not 0 <= dropout < 1:
        raise ValueError("dropout must be from 0 up to, not with, 1")
    if sum(p.size for j in jobs for p in (*j.network.weights, *j.network.biases)) > MAX_NUMBERS:
        raise ValueError(f"the networks have more than {MAX_NUMBERS} weights together")
    moments = {j.key: [(np.zeros_like(p), np.zeros_like(p)) for p in (*j.network.weights, *j.network.biases)] for j in jobs}
    live = list(jobs)
    for step in range(1, epochs + 2):  # the last pass only looks at the test rows
        last = step == epochs + 1

        def each(job, x, y, keys, part, step=step, last=last):
            net = job.network
            if job.offsets is not None:
                x = (x - job.offsets) / job.scales
            train, test = part == TRAIN, part == TEST
            total, grads = 0.0, np.zeros(sum(p.size for p in (*net.weights, *net.biases)))
            if train.any() and not last:
                masks = dropout_masks(keys[train], [len(b) for b in net.biases[:-1]], dropout, seed, step)
                total, found = net.gradients(x[train], y[train], loss, option, masks)
                grads = np.concatenate([g.ravel() for g in found])
            test_total, sums = 0.0, np.zeros(5)
            if test.any():
                p, t = net.forward(x[test])[-1], y[test]
                test_total = net.loss(p, t, loss, option)
                p = p[:, 0]
                sums = np.array([p.sum(), t.sum(), (p * p).sum(), (t * t).sum(), (p * t).sum()])
            return int(train.sum()), total, grads, int(test.sum()), test_total, sums

        found = _pass(table, live, each)
        for job in live:
            r = found.get(job.key)
            if r is None:
                continue
            if step > 1 and r["test_n"]:  # what the epoch before has left
                job.test_losses.append(r["test_total"] / r["test_n"])
                n, (p, t, pp, tt, pt) = r["test_n"], r["test_sums"]
                a, b = n * pp - p * p, n * tt - t * t
                job.correlation = float((n * pt - p * t) / np.sqrt(a * b)) if a > 1e-12 * n * pp and b > 1e-12 * n * tt else None
        if after is not None and step > 1:
            gone = after(step - 1, live)
            live = [j for j in live if j.key not in gone]
        for job in live if not last else ():
            r = found.get(job.key)
            if r is not None and r["n"]:
                job.losses.append(r["total"] / r["n"])
                _move(job.network, r["numbers"] / r["n"], moments[job.key], step, rate)
        if not live:
            break
    return jobs


def _move(net, gradient: np.ndarray, moments: list, step: int, rate: float) -> None:
    """One step of Adam; gradients come weights and biases of a layer in turn."""
    at = 0
    for k in range(len(net.weights)):
        for p, (m, v) in ((net.weights[k], moments[k]), (net.biases[k], moments[len(net.weights) + k])):
            g = gradient[at : at + p.size].reshape(p.shape)
            at += p.size
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
