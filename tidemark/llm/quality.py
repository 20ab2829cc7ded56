"""Quality classifier: gated attention over passages, learned from labels of whole documents.

A document is a bag of passages of PASSAGE bytes. A passage is encoded by the
shares of byte classes and of pairs of neighbouring classes in it, and by the sum of
learned vectors of its words, hashed into BUCKETS; a tanh layer makes its
representation, a gate and a tanh branch its attention weight, and the weighted
mean of the document's passages its score (multiple-instance learning).

The fit runs over a bounded sample of labelled documents, whose bags stay in the
shared folder: in each round the tasks, one for each of PARTS parts, take Adam
steps over their own bags from common weights, and the driver averages what comes
back, which is the size of the weights. Scoring runs over all passages of all
documents where they lie.
"""

from __future__ import annotations

from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import slices, staged, text_bytes, unlike, word_hashes

PASSAGE = 512
#: Labelled documents that a fit reads at most; all passages of each are read.
MAX_TRAIN_DOCS = 4000
#: Vectors that words are hashed to.
BUCKETS = 4096
#: Passages whose features a step of the fit holds at once; a longer document's are made a part at a time.
STEP_PASSAGES = 4096
#: Parts that learn side by side, rounds, and documents of a step.
PARTS, ROUNDS, STEP_DOCS = 2, 16, 16
#: Adam's rate, and the share of it at which words' vectors learn: most words are seen seldom.
RATE, WORD_RATE = 8e-3, 0.1
THRESHOLD = 0.3
#: Byte classes, in order of precedence; what is in none is class 0.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b".", b",", b"!?", b";:", b"\"'`", b"-_/\\", b"|*#~^=+", b"%&$@", b"()[]{}<>", bytes(range(128, 256))]
_KINDS = len(CLASSES) + 1
_CLASS = np.zeros(256, np.int64)
for _k, _bytes in enumerate(CLASSES):
    _CLASS[list(_bytes)] = _k + 1
#: Features of a passage: class shares, pair shares, its length.
WIDTH = _KINDS + _KINDS**2 + 1


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts by passage (rows) and where each document's passages begin; an empty text is one empty passage."""
    sizes = np.diff(offsets)
    each = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(each)])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = first[doc] + (np.arange(len(data)) - offsets[doc] + offsets[0]) // PASSAGE
    kind = _CLASS[data]
    n = int(first[-1])
    single = np.bincount(place * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS)
    inner = place[1:] == place[:-1] if len(data) else np.zeros(0, bool)
    pair = (place[1:] * _KINDS + kind[1:])[inner] * _KINDS + kind[:-1][inner]
    double = np.bincount(pair, minlength=n * _KINDS**2).reshape(n, _KINDS**2)
    return np.concatenate([single, double], axis=1), first


def features(counts: np.ndarray) -> np.ndarray:
    size = counts[:, :_KINDS].sum(axis=1, keepdims=True)
    shares = np.sqrt(counts / np.maximum(1, size))
    return np.concatenate([shares, size / PASSAGE], axis=1).astype(np.float32)


def words_of(data: np.ndarray, offsets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word (up to white space, A-Z lower-cased) of many texts, and where each passage's words begin.

    A word belongs to the passage that it begins in.
    """
    hashes, _ = word_hashes(data, offsets)
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    begins = ~space
    starts = np.zeros(len(data), bool)
    starts[(offsets[:-1] - offsets[0])[np.diff(offsets) > 0]] = True
    begins[1:] &= space[:-1] | starts[1:]
    at = np.flatnonzero(begins)
    doc = np.searchsorted(offsets - offsets[0], at, "right") - 1
    place = first[doc] + (at - (offsets[doc] - offsets[0])) // PASSAGE
    return (hashes % np.uint64(BUCKETS)).astype(np.uint16), np.searchsorted(place, np.arange(int(first[-1]) + 1))


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Bags:
    """Passages of some documents: counts by passage, where each document's passages begin, word buckets, where each passage's words begin."""

    counts: np.ndarray
    first: np.ndarray
    words: np.ndarray
    word_first: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Bags:
        counts, first = passages(data, offsets)
        return Bags(counts, first, *words_of(data, offsets, first))

    def parts(self):
        """Ranges of passages whose features are held at once."""
        n = len(self.counts)
        return [(k, min(n, k + STEP_PASSAGES)) for k in range(0, n, STEP_PASSAGES)]

    def word_sums(self, vectors: np.ndarray, start: int, stop: int) -> np.ndarray:
        """By passage the sum of its words' vectors over the root of their number."""
        at, end = int(self.word_first[start]), int(self.word_first[stop])
        each = np.diff(self.word_first[start : stop + 1])
        out = np.zeros((stop - start, vectors.shape[1]), vectors.dtype)
        some = each > 0
        if end > at:
            out[some] = np.add.reduceat(vectors[self.words[at:end]], (self.word_first[start:stop] - at)[some]) / np.sqrt(each[some])[:, None]
        return out


class AttentionModel:
    """Gated attention pooling with a tanh encoder; plain arrays, so that it can be broadcast."""

    HIDDEN, GATE = 32, 16

    def __init__(self, seed: int = 11) -> None:
        g = np.random.default_rng(seed)
        d, m = self.HIDDEN, self.GATE
        scale = lambda n, *s: (g.standard_normal(s) / np.sqrt(n)).astype(np.float32)
        self.p = {"W": scale(WIDTH, WIDTH, d), "b": np.zeros(d, np.float32), "V": scale(d, d, m), "U": scale(d, d, m), "bv": np.zeros(m, np.float32), "bu": np.zeros(m, np.float32), "w": scale(m, m), "c": scale(d, d), "c0": np.zeros(1, np.float32), "E": np.zeros((BUCKETS, d), np.float32)}
        self.mean, self.std = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)

    def _features(self, bags: Bags, start: int, stop: int) -> np.ndarray:
        return (features(bags.counts[start:stop]) - self.mean) / self.std

    def encode(self, bags: Bags) -> np.ndarray:
        """The representation of each passage."""
        p = self.p
        return np.concatenate([np.tanh(self._features(bags, k, e) @ p["W"] + p["b"] + bags.word_sums(p["E"], k, e)) for k, e in bags.parts()])

    def attention(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The branches t and s, and each passage's weight among those of its document."""
        p = self.p
        t, s = np.tanh(h @ p["V"] + p["bv"]), _sigmoid(h @ p["U"] + p["bu"])
        e, starts, each = (t * s) @ p["w"], first[:-1], np.diff(first)
        a = np.exp((e - np.repeat(np.maximum.reduceat(e, starts), each)).astype(np.float64))
        return t, s, a / np.repeat(np.add.reduceat(a, starts), each)

    def score(self, bags: Bags) -> np.ndarray:
        """Probability of label 1 by document."""
        h = self.encode(bags)
        _, _, a = self.attention(h, bags.first)
        z = np.add.reduceat(a[:, None] * h, bags.first[:-1])
        return _sigmoid(z @ self.p["c"].astype(np.float64) + float(self.p["c0"][0]))

    def gradients(self, bags: Bags, y: np.ndarray) -> dict:
        """Of the mean cross-entropy of documents, by weights."""
        p, first = self.p, bags.first
        h = self.encode(bags)
        t, s, a = self.attention(h, first)
        each = np.diff(first)
        wide = lambda x: np.repeat(x, each, axis=0)
        z = np.add.reduceat(a[:, None] * h, first[:-1])
        off = (_sigmoid(z @ p["c"] + p["c0"]) - y) / len(y)
        dz = wide(off[:, None] * p["c"])
        da = (h * dz).sum(axis=1)
        de = a * (da - wide(np.add.reduceat(a * da, first[:-1])))
        dg = de[:, None] * p["w"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T
        dx = (dh * (1 - h * h)).astype(p["W"].dtype)
        out = {"W": sum(self._features(bags, k, e).T @ dx[k:e] for k, e in bags.parts()), "b": dx.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "bv": dt.sum(axis=0), "bu": ds.sum(axis=0), "w": ((t * s) * de[:, None]).sum(axis=0), "c": z.T @ off, "c0": off.sum(keepdims=True)}
        out["E"] = np.zeros_like(p["E"])
        for k, e in bags.parts():
            at, end = int(bags.word_first[k]), int(bags.word_first[e])
            if end > at:
                own = np.diff(bags.word_first[k : e + 1])
                passage = np.repeat(np.arange(k, e), own)
                order = np.argsort(bags.words[at:end], kind="stable")
                sorted_words = bags.words[at:end][order]
                heads = np.flatnonzero(np.r_[True, sorted_words[1:] != sorted_words[:-1]])
                out["E"][sorted_words[heads]] += np.add.reduceat((dx / np.sqrt(np.maximum(1, np.diff(bags.word_first)))[:, None])[passage[order]], heads)
        return out


@dataclass
class Learner:
    """A model with Adam's moments."""

    model: AttentionModel
    moments: dict
    steps: int = 0

    @staticmethod
    def new(model: AttentionModel) -> Learner:
        return Learner(model, {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()})

    def step(self, bags: Bags, y: np.ndarray, rate: float = RATE, decay: float = 1e-3) -> None:
        self.steps += 1
        for k, grad in self.model.gradients(bags, y).items():
            m, v = self.moments[k]
            m += (0.1 * (grad - m)).astype(m.dtype)
            v += (0.001 * (grad * grad - v)).astype(v.dtype)
            own = rate * (WORD_RATE if k == "E" else 1.0)
            self.model.p[k] -= (own * ((m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8) + decay * self.model.p[k])).astype(m.dtype)

    def packed(self) -> bytes:
        return np.concatenate([x.ravel() for k in self.model.p for x in (self.model.p[k], *self.moments[k])]).astype(np.float64).tobytes()

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k in self.model.p:
            for x in (self.model.p[k], *self.moments[k]):
                x[...] = flat[at : at + x.size].reshape(x.shape)
                at += x.size


# --- the fit


def _bags(batches):
    """Each document's bag, as bytes."""
    for whole in batches:
        for batch in slices(whole, 128):
            bags = Bags.of(*text_bytes(batch.column("text")))
            rows = []
            for a, b in zip(bags.first[:-1].tolist(), bags.first[1:].tolist(), strict=True):
                words = bags.words[bags.word_first[a] : bags.word_first[b]]
                rows.append((bags.counts[a:b].astype(np.uint16).tobytes(), words.tobytes(), np.diff(bags.word_first[a : b + 1]).astype(np.uint16).tobytes()))
            columns = [pa.array(x, pa.binary()) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("label"), *columns], _BAG)


_BAG = ["part", "label", "counts", "words", "sizes"]
_BAG_SCHEMA = "part int, label int, counts binary, words binary, sizes binary"


def _joined(rows: list[dict]) -> tuple[Bags, np.ndarray]:
    """Stored bags as one, and their labels."""
    counts = [np.frombuffer(r["counts"], np.uint16).reshape(-1, WIDTH - 1) for r in rows]
    sizes = np.concatenate([np.frombuffer(r["sizes"], np.uint16) for r in rows]).astype(np.int64)
    words = np.concatenate([np.frombuffer(r["words"], np.uint16) for r in rows])
    first = np.concatenate([[0], np.cumsum([len(c) for c in counts])])
    return Bags(np.concatenate(counts), first, words, np.concatenate([[0], np.cumsum(sizes)])), np.array([r["label"] for r in rows], np.float32)


def _steps(batches):
    """(part, bags, labels) of stored bags in order, in steps of STEP_DOCS documents, or fewer if these have more than STEP_PASSAGES passages."""
    held, size = [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            n = len(row["counts"]) // (2 * (WIDTH - 1))
            if held and (len(held) == STEP_DOCS or size + n > STEP_PASSAGES or row["part"] != held[0]["part"]):
                yield held[0]["part"], *_joined(held)
                held, size = [], 0
            held.append(row)
            size += n
    if held:
        yield held[0]["part"], *_joined(held)


def _sums(batches):
    """Of each part of a task: passages, sums of their features and of the squares, documents, and those of label 1."""
    found: dict[int, np.ndarray] = {}
    for part, bags, y in _steps(batches):
        own = found.setdefault(part, np.zeros(2 * WIDTH + 3))
        for k, e in bags.parts():
            x = features(bags.counts[k:e]).astype(np.float64)
            own[:WIDTH] += x.sum(axis=0)
            own[WIDTH:-3] += (x * x).sum(axis=0)
        own[-3:] += len(bags.counts), len(y), y.sum()
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], ["part", "state"])


def _round(sent):
    """A pass over each part's bags from the common weights: the weights and moments that come of it, after the number of documents."""

    def run(batches):
        part, learner, n = None, None, 0

        def done():
            state = np.concatenate([[n], np.frombuffer(learner.packed())])
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([state.tobytes()], pa.binary())], ["part", "state"])

        for own, bags, y in _steps(batches):
            if own != part:
                if part is not None:
                    yield done()
                part, learner, n = own, deepcopy(sent.value), 0
            learner.step(bags, y)
            n += len(y)
        if part is not None:
            yield done()

    return run


def fit(docs: DataFrame, labels: DataFrame, train=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_TRAIN_DOCS, rounds: int = ROUNDS) -> AttentionModel:
    """A model from at most max_docs labelled documents, those with the least hash of their id.

    ``train`` is a condition on ``doc_id`` that says which rows may be learned
    from. Null labels and ids are left out; a document with several labels
    counts as 1 if any is, and of rows that repeat a doc_id one text is read.
    With labels of one kind or none the model gives that kind (or one half)
    throughout; empty tables are such a case. All passages of a text of any length
    are read, some at a time. The model does not depend on how rows are dealt out:
    a document's part is its id's hash, and parts are read in order.
    """
    chosen = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    if train is not None:
        chosen = chosen.filter(train)
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    made = one.select(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(PARTS)).cast("int").alias("part"), "label", "text").mapInArrow(_bags, _BAG_SCHEMA)
    rows = staged(made, "bags").repartition(PARTS, "part").sortWithinPartitions("part", F.xxhash64("counts", "words"), "label").persist(StorageLevel.DISK_ONLY)
    model = AttentionModel()
    states = lambda run: [np.frombuffer(r["state"]) for r in rows.mapInArrow(run, "part int, state binary").orderBy("part").collect()]  # noqa: E731  one row a part, of the weights' size
    try:
        sums = sum(states(_sums), np.zeros(2 * WIDTH + 3))
        n, count, ones = sums[-3:]
        if not 0 < ones < count:
            model.p["c"][:] = 0
            model.p["c0"][:] = 0 if not count else 4 if ones else -4
            return model
        mean = sums[:WIDTH] / n
        model.mean, model.std = mean.astype(np.float32), (np.sqrt(np.maximum(0, sums[WIDTH:-3] / n - mean * mean)) + 0.02).astype(np.float32)
        share = float(np.clip(ones / count, 0.01, 0.99))
        model.p["c0"][:] = np.log(share / (1 - share))
        learner = Learner.new(model)
        for _ in range(rounds):
            sent = docs.sparkSession.sparkContext.broadcast(learner)  # some hundred thousand floats
            found = states(_round(sent))
            sent.unpersist()
            weights = np.array([x[0] for x in found])
            learner.unpack(np.tensordot(weights / weights.sum(), np.array([x[1:] for x in found]), 1))
            learner.steps += max(1, round(float(count) / len(found) / STEP_DOCS))
        return model
    finally:
        rows.unpersist()


def _scores(model, keep: list[str], text_col: str, at_least: float | None):
    def run(batches):
        m = model.value
        for whole in batches:
            for batch in slices(whole, 128):
                if not batch.num_rows:
                    continue
                score = m.score(Bags.of(*text_bytes(batch.column(text_col))))
                out = pa.RecordBatch.from_arrays([batch.column(c) for c in keep], keep)
                if at_least is not None:
                    yield out.filter(pa.array(score >= at_least))
                else:
                    yield out.append_column("score", pa.array(score))

    return run


def score(docs: DataFrame, model: AttentionModel, keep: list[str] | None = None, text_col: str = "text", at_least: float | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all unless given) and score, from 0 to 1; one row per row.

    With at_least, instead the rows that reach it, without the score. A null
    text counts as empty and has a score too. Rows that repeat a text have equal
    scores, an empty table gives an empty one, a text of any length is read whole.
    A kept column named score gives way to the result; other columns are not read.
    """
    keep = docs.columns if keep is None else keep
    keep = unlike(keep, ["score"]) if at_least is None else keep
    fields = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([fields[c] for c in keep] + ([T.StructField("score", T.DoubleType())] if at_least is None else []))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some ten thousand floats
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(_scores(sent, keep, text_col, at_least), schema)
