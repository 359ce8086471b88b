"""Quality scores by support vectors on naive Bayes features.

A document is the set of its n-grams: of words, and of word shapes (kinds of characters at the ends of a word, and
whether it repeats the word before), as shapes are shared by texts that share no words.  Each indicator is scaled by the
logarithm of the ratio of its shares in the two classes, vectors are brought to length one, and a linear hinge-loss
model is fitted to them by dual coordinate descent.  A logistic of the margin, fitted to documents that a first model has
not seen, is the score.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, on_workers, slices

_BASE = np.uint64(0x9E3779B97F4A7C15)
# Kinds of bytes in a shape: letters in upper and lower case, digits; all other signs stand for themselves.  The second
# bytes of the Latin letters beyond ASCII are kinds too, and their first bytes go.
_KIND = bytes.maketrans(bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x30, 0x3A)) + bytes(range(0x80, 0xC0)),
                        b"A" * 26 + b"a" * 26 + b"0" * 10 + b"A" * 31 + b"a" * 33)
_FIRST = bytes(range(0xC2, 0xF5))


@dataclass(frozen=True)
class Quality:
    """The classifier's size and training.

    It is fitted on at most ``per_class`` labelled documents of each class, those with the smallest hashes, and on no
    more of them than hold ``most_features`` n-grams together.  Scores of ``threshold`` or more are label 1.
    """

    per_class: int = 3000
    most_features: int = 20_000_000
    bits: int = 18
    word_grams: int = 2
    shape_grams: int = 3
    smoothing: float = 1.0
    cost: float = 4.0
    epochs: int = 30
    threshold: float = 0.3
    held_out: tuple[int, int] = (5, 0)
    seed: int = 7


def held_out(id: Column, rule: Quality) -> Column:
    """Whether a document's label may not be learned from: the CRC-32 of its id as text; a null id is empty text."""
    modulus, rest = rule.held_out
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit(""))), F.lit(modulus)) == rest


class Shapes(dict):
    """Number of the shape of a word whose bytes are kinds: its first one and its last two."""

    def __missing__(self, kinds: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        shape = self[kinds] = zlib.crc32(kinds[:1] + b"." + kinds[1:][-2:])
        return shape


def grams(text: str | None, rule: Quality, shapes: Shapes) -> np.ndarray:
    """The places of a text's n-grams among the features, each once and in order."""
    raw = (text or "").encode()
    own = raw.split()
    words = np.fromiter(map(zlib.crc32, own), np.uint64, len(own))
    kinds = raw.translate(_KIND, _FIRST).split()
    if len(kinds) == len(own):
        shape = np.fromiter(map(shapes.__getitem__, kinds), np.uint64, len(own))
    else:  # a word of bytes that have no kind
        shape = np.fromiter((shapes[w.translate(_KIND, _FIRST)] for w in own), np.uint64, len(own))
    shape[1:] += np.uint64(1 << 32) * (words[1:] == words[:-1])
    found = []
    with np.errstate(over="ignore"):
        for salt, sequence, most in ((1, words, rule.word_grams), (2, shape, rule.shape_grams)):
            rolled = sequence + np.uint64(salt << 40)
            for n in range(1, most + 1):
                if n > 1:
                    rolled = rolled[:-1] * _BASE + sequence[n - 1:]
                if not len(rolled):
                    break
                mixed = (rolled ^ (rolled >> np.uint64(29))) * _BASE
                found.append((mixed >> np.uint64(64 - rule.bits)).astype(np.int32))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def ratios(sets: list[np.ndarray], good: np.ndarray, rule: Quality) -> np.ndarray:
    """Logarithm of each feature's share of the documents of label 1 over its share of the others."""
    shares = []
    for kind in (True, False):
        own = [s for s, y in zip(sets, good) if y == kind]
        counts = np.bincount(np.concatenate(own), minlength=1 << rule.bits) if own else np.zeros(1 << rule.bits)
        shares.append((counts + rule.smoothing) / (len(own) + 2 * rule.smoothing))
    return np.log(shares[0] / shares[1]).astype(np.float32)


def descend(sets: list[np.ndarray], values: list[np.ndarray], good: np.ndarray, rule: Quality) -> np.ndarray:
    """Weights, and a bias at the end, that minimise the hinge loss by dual coordinate descent.

    The classes weigh the same in total.
    """
    size = 1 << rule.bits
    weights = np.zeros(size + 1)
    sign = np.where(good, 1.0, -1.0)
    cost = rule.cost * len(good) / 2 / np.where(good, max(good.sum(), 1), max((~good).sum(), 1))
    squares = np.array([float(v @ v) + 1.0 for v in values])
    alpha = np.zeros(len(good))
    random = np.random.default_rng(rule.seed)
    for _ in range(rule.epochs):
        moved = 0.0
        for i in random.permutation(len(good)).tolist():
            margin = weights[sets[i]] @ values[i] + weights[size]
            new = min(max(alpha[i] - (sign[i] * margin - 1) / squares[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                weights[sets[i]] += step * values[i]
                weights[size] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights


class Model:
    """Weights on indicators, and the logistic of the margin."""

    def __init__(self, weights: np.ndarray, scale: np.ndarray, logistic: tuple[float, float]):
        self.weights, self.scale, self.logistic = weights, scale, logistic

    def margin(self, own: np.ndarray) -> float:
        value = self.scale[own]
        return float(self.weights[own] @ value / max(float(np.sqrt(value @ value)), 1e-9) + self.weights[-1])

    def score(self, own: np.ndarray) -> float:
        a, b = self.logistic
        return float(1 / (1 + np.exp(-np.clip(a * self.margin(own) + b, -30, 30))))


def _linear(sets: list[np.ndarray], good: np.ndarray, rule: Quality) -> Model:
    scale = ratios(sets, good, rule)
    values = [scale[s] / max(float(np.sqrt(scale[s] @ scale[s])), 1e-9) for s in sets]
    return Model(descend(sets, values, good, rule), scale, (1.0, 0.0))


def _logistic(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, towards targets that leave room for error."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([margins, np.ones(len(margins))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(curve, x.T @ (p - target) + 1e-3 * w)
    return max(float(w[0]), 0.0), float(w[1])


def train(sets: list[np.ndarray], good: list[bool], rule: Quality) -> Model:
    """The model of labelled documents; with one class only, every score is that of the class."""
    y = np.array(good, bool)
    if not y.any() or y.all():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros((1 << rule.bits) + 1), np.zeros(1 << rule.bits, np.float32), (0.0, float(np.log(rate / (1 - rate)))))
    seen = np.arange(len(y)) % 4 != 0
    logistic = (2.0, 0.0)
    if 0 < y[~seen].sum() < (~seen).sum() and 0 < y[seen].sum() < seen.sum():
        first = _linear([s for s, k in zip(sets, seen) if k], y[seen], rule)
        logistic = _logistic(np.array([first.margin(s) for s, k in zip(sets, seen) if not k]), y[~seen])
    model = _linear(sets, y, rule)
    model.logistic = logistic
    return model


def fit(docs: DataFrame, labels: DataFrame, rule: Quality, id: str, text: str, label: str, label_id: str) -> Model:
    """The model of the labelled documents that are not held out.

    Their n-grams are taken in parallel; one task fits the model to the bounded sample.
    """
    own = labels.select(named(label_id).alias("id"), named(label).cast("int").alias("y")).filter("id is not null and y is not null")
    own = own.filter(~held_out(F.col("id"), rule)).groupBy("id").agg(F.max("y").alias("y"))
    chosen = None
    for value in (1, 0):
        part = own.filter(F.col("y") == value).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(rule.per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.select(named(id).alias("id"), named(text).cast("string").alias("t")).join(F.broadcast(chosen), "id")
    texts = texts.select(F.xxhash64(F.col("id").cast("string")).alias("k"), "y", "t")

    def take(batches):
        shapes = Shapes()
        for batch in batches:
            for part in slices(batch, 2):
                found = [grams(t, rule, shapes).tobytes() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(found, pa.binary())], ["k", "y", "g"])

    def run(batches):
        rows, held, before = [], 0, None
        for batch in batches:  # sorted by hash
            for k, y, g in zip(*[c.to_pylist() for c in batch.columns]):
                if (k, g) != before and held < rule.most_features:  # a repeated row counts once
                    rows.append((y, np.frombuffer(g, np.int32)))
                    held += len(rows[-1][1])
                before = (k, g)
        model = train([s for _, s in rows], [y == 1 for y, _ in rows], rule)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    sample = on_workers(texts).mapInArrow(take, "k long, y int, g binary")
    row = sample.repartition(1).sortWithinPartitions("k", "g").mapInArrow(run, "model binary").first()
    return pickle.loads(row["model"]) if row else train([], [], rule)


def quality(docs: DataFrame, labels: DataFrame, rule: Quality | None = None, id: str = "doc_id", text: str = "text",
            label: str = "quality", label_id: str = "doc_id") -> DataFrame:
    """(id, held_out, score, predicted, margin) of every row; a higher score makes label 1 likelier.

    A null or empty text has no n-grams and the score of the bias.  Without labels of both classes the score is the
    share of label 1, and a half without any.  Repeated rows are scored alike, of several labels of a document the
    highest counts, a null id is hashed as empty text, other columns are not looked at, and no rows give no rows.
    """
    rule = rule or Quality()
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rule, id, text, label, label_id))
    schema = (T.StructType([T.StructField("id", docs.schema[id].dataType)]).add("held_out", T.BooleanType())
              .add("score", T.DoubleType()).add("predicted", T.IntegerType()).add("margin", T.DoubleType()))

    def run(batches):
        model, shapes = shared.value, Shapes()
        for batch in batches:
            for part in slices(batch, 2):
                sets = [grams(t, rule, shapes) for t in part.column(2).to_pylist()]
                scores = [model.score(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(scores, pa.float64()),
                     pa.array([int(s >= rule.threshold) for s in scores], pa.int32()),
                     pa.array([model.margin(s) for s in sets], pa.float64())], schema.names)

    own = docs.select(named(id).alias("id"), held_out(named(id), rule).alias("h"), named(text).cast("string").alias("t"))
    return on_workers(own).mapInArrow(run, schema).withColumnRenamed("id", id)
