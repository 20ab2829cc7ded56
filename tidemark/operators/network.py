"""Dense networks fitted with Spark: each step sums gradients over all partitions (``training``)."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.features import Fold, Scaler, with_folds
from tidemark.operators.training import Job, Table, fit_scalers, train_side_by_side

LOSSES = ("mse", "directional", "pinball")


def _act(name: str, x: np.ndarray) -> np.ndarray:
    return np.tanh(x) if name == "tanh" else np.maximum(x, 0) if name == "relu" else x


def _slope(name: str, y: np.ndarray) -> np.ndarray:
    return 1 - y * y if name == "tanh" else (y > 0).astype(float) if name == "relu" else np.ones_like(y)


@dataclass
class Network:
    """Layers of weights and biases; hidden layers share one activation, the head has its own."""

    features: list[str]
    weights: list[np.ndarray]
    biases: list[np.ndarray]
    hidden: str = "relu"
    head: str = "tanh"
    history: list[float] = field(default_factory=list)

    @staticmethod
    def dense(features: list[str], layers: tuple[int, ...] = (64, 32), head: str = "tanh", hidden: str = "relu", outputs: int = 1, seed: int = 0) -> Network:
        g = np.random.default_rng(seed)
        sizes = [len(features), *layers, outputs]
        return Network(list(features), [g.standard_normal((a, b)) * np.sqrt(2 / (a + b)) for a, b in zip(sizes, sizes[1:], strict=False)], [np.zeros(b) for b in sizes[1:]], hidden, head)

    def forward(self, x: np.ndarray, masks: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """The input and the output of each layer; hidden ones multiplied by their masks."""
        out = [x]
        for k, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            last = k == len(self.weights) - 1
            y = _act(self.head if last else self.hidden, out[-1] @ w + b)
            out.append(y if last or masks is None else y * masks[k])
        return out

    def loss(self, p: np.ndarray, y: np.ndarray, loss: str, option: float) -> float:
        """Sum over rows."""
        y = y.reshape(len(y), -1)
        if loss == "mse":
            return float(((p - y) ** 2).mean(axis=1).sum())
        if loss == "directional":
            return float((np.maximum(-np.sign(y) * p, 0) + option * (p - y) ** 2).mean(axis=1).sum())
        return float(np.maximum(option * (y - p), (option - 1) * (y - p)).mean(axis=1).sum())

    def gradients(self, x: np.ndarray, y: np.ndarray, loss: str, option: float, masks: list[np.ndarray] | None = None) -> tuple[float, list[np.ndarray]]:
        """Sum over rows of the loss, and of its gradients by weights and biases; masks are those of dropout."""
        out = self.forward(x, masks)
        p, y = out[-1], y.reshape(len(y), -1)
        total = self.loss(p, y, loss, option)
        if loss == "mse":
            d = 2 * (p - y) / p.shape[1]
        elif loss == "directional":
            d = (np.where(-np.sign(y) * p > 0, -np.sign(y), 0) + 2 * option * (p - y)) / p.shape[1]
        else:
            d = np.where(y - p > 0, -option, 1 - option) / p.shape[1]
        grads: list[np.ndarray] = []
        for k in range(len(self.weights) - 1, -1, -1):
            last = k == len(self.weights) - 1
            if last or masks is None:
                d = d * _slope(self.head if last else self.hidden, out[k + 1])
            else:  # the slope is that of the value before its mask
                m = masks[k]
                d = d * m * _slope(self.hidden, np.divide(out[k + 1], m, out=np.zeros_like(m), where=m != 0))
            grads = [out[k].T @ d, d.sum(axis=0), *grads]
            d = d @ self.weights[k].T
        return total, grads

    def fit(self, frame: DataFrame, target: str = "target", epochs: int = 20, rate: float = 0.01, loss: str = "mse", option: float = 0.1, dropout: float = 0.0, seed: int = 0) -> Network:
        """Adam over whole passes; a task sends one sum of gradients, the size of the weights.

        Rows with a null feature or target are left out. dropout is the share of
        hidden units that a row does without at a step.
        """
        job = Job(0, self, list(range(len(self.features))))
        train_side_by_side(Table(frame, self.features, target), [job], epochs, rate, loss, option, dropout, seed)
        self.history += job.losses
        return self

    def predict(self, frame: DataFrame, name: str = "prediction") -> DataFrame:
        """frame with the (first) output as a column; null where a feature is null. Works on Arrow batches."""
        sent = frame.sparkSession.sparkContext.broadcast(self)
        schema = T.StructType([*frame.schema.fields, T.StructField(name, T.DoubleType())])
        return frame.mapInArrow(_outputs(sent, name), schema)

    def scaled(self, scaler: Scaler) -> Network:
        """The network on unscaled features: the scaler folded into the first layer."""
        offsets, scales = (np.array(x) for x in scaler.affine())
        first = self.weights[0] / scales[:, None]
        return Network(self.features, [first, *self.weights[1:]], [self.biases[0] - offsets @ first, *self.biases[1:]], self.hidden, self.head)

    def pruned(self, percentile: float = 10.0, per_layer: bool = False) -> tuple[Network, list[str]]:
        """Weights whose size is below a percentile set to zero; and the features that nothing reads any more."""
        every = np.concatenate([np.abs(w).ravel() for w in self.weights])
        cut = lambda w: np.percentile(np.abs(w) if per_layer else every, percentile)
        new = [np.where(np.abs(w) < cut(w), 0.0, w) for w in self.weights]
        dead = [c for c, row in zip(self.features, new[0], strict=True) if not row.any()]
        return Network(self.features, new, [b.copy() for b in self.biases], self.hidden, self.head), dead

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "weights": [w.tolist() for w in self.weights], "biases": [b.tolist() for b in self.biases], "hidden": self.hidden, "head": self.head})

    @staticmethod
    def from_json(text: str) -> Network:
        d = json.loads(text)
        return Network(d["features"], [np.array(w) for w in d["weights"]], [np.array(b) for b in d["biases"]], d["hidden"], d["head"])

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "network string").coalesce(1).write.mode("overwrite").json(path)

    @staticmethod
    def load(spark, path: str) -> Network:
        return Network.from_json(spark.read.schema("network string").json(path).first()[0])


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names], axis=1)


def _outputs(sent, name: str):
    def run(batches):
        net = sent.value
        for batch in batches:
            x = _matrix(batch, net.features).astype(float)
            bad = np.isnan(x).any(axis=1)
            y = net.forward(np.where(np.isnan(x), 0.0, x))[-1][:, 0]
            yield batch.append_column(name, pa.array(y, pa.float64(), mask=bad))

    return run


def _outputs_by(sent, by: str, name: str):
    """The output of the network that a column names; null where a feature is or there is no such network."""

    def run(batches):
        nets = sent.value
        for batch in batches:
            which = batch.column(by).to_numpy(zero_copy_only=False)
            out = np.full(batch.num_rows, np.nan)
            for key, net in nets.items():
                rows = np.flatnonzero(which == key)
                if len(rows):
                    x = _matrix(batch.take(pa.array(rows)), net.features)
                    good = ~np.isnan(x).any(axis=1)
                    out[rows[good]] = net.forward(x[good])[-1][:, 0]
            yield batch.append_column(name, pa.array(out, pa.float64(), from_pandas=True))

    return run


def ensemble(frame: DataFrame, networks: list[Network], name: str = "prediction") -> DataFrame:
    """frame with the mean output of networks."""
    columns = frame.columns
    for k, net in enumerate(networks):
        frame = net.predict(frame, f"__p{k}")
    return frame.select(*columns, (sum((F.col(f"__p{k}") for k in range(len(networks))), F.lit(0.0)) / len(networks)).alias(name))


def train(frame: DataFrame, features: list[str], target: str = "target", layers: tuple[int, ...] = (64, 32), scale: str = "standard", seed: int = 0, **options) -> tuple[Network, Scaler]:
    """A network fitted to scaled features, and the scaler, of the same rows."""
    job = Job(0, Network.dense(features, layers, seed=seed), list(range(len(features))))
    table = Table(frame, features, target)
    if scale == "standard":
        fit_scalers(table, [job])
    else:
        job.offsets, job.scales = (np.array(x) for x in Scaler.fit(table.rows, [f"f{k}" for k in range(len(features))], scale).affine())
    train_side_by_side(table, [job], seed=seed, **options)
    job.network.history += job.losses
    return job.network, Scaler(tuple(features), tuple(job.offsets.tolist()), tuple(job.scales.tolist()))


def walk_forward_train(frame: DataFrame, features: list[str], folds: list[Fold], target: str = "target", layers: tuple[int, ...] = (64, 32), seed: int = 0, **options) -> DataFrame:
    """Test rows of every fold with fold and prediction, of networks that saw the fold's training rows alone.

    All folds are trained side by side: a pass over the rows is a step of each.
    """
    jobs = [Job(k, Network.dense(features, layers, seed=seed), list(range(len(features))), k) for k in range(len(folds))]
    table = Table(frame, features, target, folds)
    fit_scalers(table, jobs)
    train_side_by_side(table, jobs, seed=seed, **options)
    test = with_folds(frame, folds).filter("part = 'test'")
    nets = {f.fold: j.network.scaled(Scaler(tuple(features), tuple(j.offsets.tolist()), tuple(j.scales.tolist()))) for f, j in zip(folds, jobs, strict=True)}
    sent = frame.sparkSession.sparkContext.broadcast(nets)
    return test.mapInArrow(_outputs_by(sent, "fold", "prediction"), T.StructType([*test.schema.fields, T.StructField("prediction", T.DoubleType())]))
