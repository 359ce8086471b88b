"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are per document, so tokens are labelled first: the fewest word stems that hardly occur in clean documents and
together cover the toxic ones mark the tokens of toxic documents.  The field has two states; a token's potential sums
weights of its word, its beginnings and ending and its neighbours, so endings not seen in training are recognised.
Forward and backward messages are the odds of the two states, and run over many documents side by side.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, on_workers, slices

_TOKEN = re.compile(r"\S+")
# Characters taken off both ends of a token.
EDGES = ".,;:!?\"'()[]{}<>*#$%&|"
_MAX_ODDS = 1e12
_KNOWN_WORDS = 300_000


@dataclass(frozen=True)
class Field:
    """The model's size and training.

    It is fitted on at most ``per_class`` toxic and as many clean labelled documents, those with the smallest hashes, and
    of these on no more whole texts of each kind than ``most_bytes`` hold; a text that does not fit in is passed over.
    A stem marks tokens if it is in that share of the toxic ones, and in two, with four words.
    """

    per_class: int = 1000
    most_bytes: int = 16 << 20
    bits: int = 18
    iterations: int = 40
    rate: float = 0.5
    decay: float = 1e-6
    least_share: float = 0.004
    keep: float = 0.75
    seed: int = 7
    held_out: tuple[int, int] = (5, 0)


def held_out(id: Column, rule: Field) -> Column:
    """Whether a document's label may not be learned from: the CRC-32 of its id as text; a null id is empty text."""
    modulus, rest = rule.held_out
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit(""))), F.lit(modulus)) == rest


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def stems(word: str) -> list[str]:
    """The word itself, and what it shares with words that begin like it."""
    return ["=" + word, *[word[:n] for n in (4, 5, 6) if len(word) > n]]


def features(word: str, bits: int) -> tuple[list[int], int, int]:
    """Places of a word's own weights, and of its weights as the neighbour before and after."""
    core = word.strip(EDGES)
    own = ["=" + core, "<" + core[:3], "<" + core[:4], "<" + core[:5], "<" + core[:6], ">" + core[-3:], "bias"]
    mask = (1 << bits) - 1
    return ([zlib.crc32(f.encode()) & mask for f in own], zlib.crc32(b"-" + core.encode()) & mask,
            zlib.crc32(b"+" + core.encode()) & mask)


def toxic_stems(texts: list[list[str]], toxic: list[bool], rule: Field) -> set[str]:
    """Stems that next to no clean document has, chosen until they cover the toxic documents that can be covered.

    Stems that no clean document has are chosen as well if it is unlikely that chance kept any stem so often to toxic
    documents.
    """
    clean, where, times = Counter(), defaultdict(set), Counter()
    for i, (words, bad) in enumerate(zip(texts, toxic)):
        own = Counter(s for w in {w.strip(EDGES) for w in words} if len(w) > 2 for s in stems(w))
        if bad:
            times.update(own)
            for s in own:
                where[s].add(i)
        else:
            clean.update(own.keys())
    least = max(2, round(rule.least_share * sum(toxic)))
    share = max(1, len(toxic) - sum(toxic)) / max(1, sum(toxic))
    where = {s: d for s, d in where.items()
             if len(d) >= least and times[s] >= 4 and clean[s] <= 0.01 * len(d) * share}
    toxic_share = sum(toxic) / max(1, len(toxic))
    chance = math.log(0.01 / max(1, len(times))) / math.log(min(max(toxic_share, 1e-9), 0.99))
    chosen = {s for s in where if not clean[s] and times[s] > chance}
    while where:
        best = max(where, key=lambda s: (len(where[s]), times[s], -len(s), s))
        chosen.add(best)
        gone = where[best]
        where = {s: d - gone for s, d in where.items() if len(d - gone) >= least}
    return chosen


class _Words(dict):
    """Row of each word in the table of its weights; words seen for the first time get the next row."""

    def __init__(self, model: Model):
        self.model, self.rows, self.table = model, [], np.empty((0, 3))

    def __missing__(self, word: str) -> int:
        own, before, after = features(word, self.model.rule.bits)
        w = self.model.weights
        row = self[word] = len(self.table) + len(self.rows)
        self.rows.append((w[own].sum(), w[before], w[after]))
        return row

    def settle(self) -> np.ndarray:
        """The table with all rows asked for so far."""
        if self.rows:
            self.table = np.concatenate([self.table, np.array(self.rows)])
            self.rows = []
        return self.table

    def trim(self, most: int) -> None:
        """Forget the words that came after the first ``most``."""
        if len(self) > most:
            for word in [w for w, row in self.items() if row >= most]:
                del self[word]
            self.table = self.table[:most]


class Model:
    """Weights of the field, and of the logistic that turns marginals into a document's score."""

    def __init__(self, rule: Field):
        self.rule = rule
        self.weights = np.zeros((1 << rule.bits) + 1)  # the last stays 0
        self.moves = np.zeros(4)  # log potentials of the pairs of states 00, 01, 10, 11
        self.logistic = np.array([-6.0, 0.0, 0.0])
        self.words: _Words | None = None

    def __getstate__(self):
        return {**self.__dict__, "words": None}

    def potentials(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Log potential of the toxic state at every token of every text."""
        if self.words is None:
            self.words = _Words(self)
        rows = [np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)) for words in texts]
        table, out = self.words.settle(), []
        for own in rows:
            parts = table[own]
            total = parts[:, 0].copy()
            total[1:] += parts[:-1, 1]
            total[:-1] += parts[1:, 2]
            out.append(total)
        self.words.trim(_KNOWN_WORDS)
        return out

    def document(self, marginals: np.ndarray) -> float:
        """Score of a document from its tokens' marginals; a document without tokens has the least."""
        z = float(self.logistic @ _summary(marginals))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _summary(marginals: np.ndarray) -> np.ndarray:
    if not len(marginals):
        return np.array([1.0, 0.0, 0.0])
    likely = marginals[marginals > 0.05]
    return np.array([1.0, float(marginals.max()), math.log1p(float(likely.sum()))])


def marginals(potentials: list[np.ndarray], moves: np.ndarray, lanes: int = 512, pairs: bool = False):
    """P(toxic) of every token of every chain; with ``pairs`` also the expected counts of the pairs of states.

    Chains of like length run side by side.  ``ahead`` holds the odds of the forward messages, ``back`` those of the
    backward ones.
    """
    t00, t01, t10, t11 = np.exp(moves)
    out: list = [None] * len(potentials)
    counts = np.zeros(4)
    order = sorted(range(len(potentials)), key=lambda i: -len(potentials[i]))
    for at in range(0, len(order), lanes):
        own = order[at:at + lanes]
        lengths = np.array([len(potentials[i]) for i in own])
        steps = int(lengths[0])
        if not steps:
            for i in own:
                out[i] = np.empty(0)
            continue
        starts = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.exp(np.clip(np.concatenate([potentials[i] for i in own]), -25, 25))
        live = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right").tolist()
        ahead, back = np.empty(len(flat)), np.empty(len(flat))
        r = flat[starts[:live[0]]]
        ahead[starts[:live[0]]] = r
        for t in range(1, steps):
            n = live[t]
            r = r[:n]
            place = starts[:n] + t
            r = np.minimum(flat[place] * (t01 + r * t11) / (t00 + r * t10), _MAX_ODDS)
            ahead[place] = r
        b = np.ones(len(own))
        for t in range(steps - 1, -1, -1):
            n = live[t]
            place = starts[:n] + t
            own_b = b[:n]
            back[place] = own_b
            e = flat[place] * own_b
            b[:n] = np.minimum((t10 + t11 * e) / (t00 + t01 * e), _MAX_ODDS)
        odds = ahead * back
        p = odds / (1 + odds)
        for k, i in enumerate(own):
            out[i] = p[starts[k]:starts[k + 1]]
        if pairs:
            inner = np.ones(len(flat), bool)
            inner[starts[:-1][lengths > 0]] = False
            j = np.flatnonzero(inner)
            a, e = ahead[j - 1], flat[j] * back[j]
            four = np.stack([np.full(len(j), t00), t01 * e, a * t10, a * t11 * e])
            counts += (four / four.sum(0)).sum(1)
    return (out, counts) if pairs else out


def train(texts: list[list[str]], toxic: list[bool], rule: Field) -> Model:
    """Fit the field on labelled tokens by its likelihood, then the logistic on the documents."""
    model = Model(rule)
    chosen = toxic_stems(texts, toxic, rule)
    if not chosen or all(toxic):
        rate = (sum(toxic) + 0.5) / (len(toxic) + 1)
        model.logistic = np.array([math.log(rate / (1 - rate)), 0.0, 0.0])
        return model
    known: dict[str, tuple] = {}
    marked: dict[str, bool] = {}
    for words in texts:
        for w in words:
            if w not in known:
                known[w] = features(w, rule.bits)
                marked[w] = not chosen.isdisjoint(stems(w.strip(EDGES)))
    number = {w: i for i, w in enumerate(known)}
    own = np.array([f for f, _, _ in known.values()])
    # A word met once learns nothing about itself, only about what it shares, as a word not met will need.
    size = 1 << rule.bits
    often = Counter(w for words in texts for w in words)
    own[np.ix_([often[w] == 1 for w in known], [0])] = size
    before = np.array([b for _, b, _ in known.values()])
    after = np.array([a for _, _, a in known.values()])
    chains = [np.array([number[w] for w in words], np.int64) for words in texts]
    flat = np.concatenate(chains)
    truth = np.concatenate([np.array([bad and marked[w] for w in words], float) for words, bad in zip(texts, toxic)])
    lengths = np.array([len(c) for c in chains])
    ends = np.cumsum(lengths)
    first = np.zeros(len(flat), bool)
    first[(ends - lengths)[lengths > 0]] = True
    inner = np.flatnonzero(~first)
    pairs = 2 * truth[inner - 1].astype(int) + truth[inner].astype(int)
    seen = np.bincount(pairs, minlength=4).astype(float)
    squares, move_squares = np.full(size + 1, 1e-4), np.full(4, 1e-4)
    model.weights[zlib.crc32(b"bias") & (size - 1)] = -3.0
    random = np.random.default_rng(rule.seed)
    for _ in range(rule.iterations):
        w = model.weights
        # Some kinds of features sit out each time, so that none relies on the others being known.
        used = np.append(random.random(own.shape[1] - 1) < rule.keep, True)
        scores = (w[own] * used).sum(1)[flat]
        scores[inner] += w[before][flat[inner - 1]]
        scores[inner - 1] += w[after][flat[inner]]
        found, counts = marginals(np.split(scores, ends[:-1]), model.moves, pairs=True)
        wrong = np.concatenate(found) - truth
        by_word = np.bincount(flat, wrong, len(known))
        gradient = np.bincount(own.ravel(), (by_word[:, None] * used).ravel(), size + 1)
        gradient += np.bincount(before, np.bincount(flat[inner - 1], wrong[inner], len(known)), size + 1)
        gradient += np.bincount(after, np.bincount(flat[inner], wrong[inner - 1], len(known)), size + 1)
        gradient = gradient / len(texts) + rule.decay * w
        squares += gradient * gradient
        model.weights = w - rule.rate * gradient / np.sqrt(squares)
        model.weights[size] = 0
        move = (counts - seen) / len(texts)
        move_squares += move * move
        model.moves = model.moves - 0.2 * move / np.sqrt(move_squares)
    found = marginals(model.potentials(texts), model.moves)
    x, y = np.array([_summary(m) for m in found]), np.array(toxic, float)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    logistic = np.zeros(3)
    for _ in range(60):  # Newton's method with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ logistic, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 1e-3 * logistic
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3)
        logistic = logistic - np.linalg.solve(curve, slope)
    model.logistic = logistic
    return model


def fit(docs: DataFrame, labels: DataFrame, rule: Field, id: str, text: str, label: str, label_id: str) -> Model:
    """The model of the labelled documents that are not held out; trained by one task on its bounded sample."""
    own = labels.select(named(label_id).alias("id"), named(label).cast("int").alias("y")).filter("id is not null and y is not null")
    own = own.filter(~held_out(F.col("id"), rule)).groupBy("id").agg(F.max("y").alias("y"))
    chosen = None
    for value in (1, 0):
        part = own.filter(F.col("y") == value).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(rule.per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.select(named(id).alias("id"), named(text).cast("string").alias("t")).join(F.broadcast(chosen), "id")
    texts = texts.filter(F.coalesce(F.octet_length("t"), F.lit(0)) <= rule.most_bytes)
    sample = texts.groupBy("id", "y").agg(F.min("t").alias("t")).select("y", "t", F.xxhash64(F.col("id").cast("string")).alias("k"))

    def run(batches):
        texts, toxic, left = [], [], {1: rule.most_bytes, 0: rule.most_bytes}
        for b in batches:
            for part in slices(b, 1):
                for y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    size = len((t or "").encode())
                    if size <= left[y]:
                        left[y] -= size
                        texts.append(tokens(t))
                        toxic.append(y == 1)
        model = train(texts, toxic, rule) if texts else Model(rule)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    sample = sample.repartition(1).sortWithinPartitions("k", "y", F.coalesce("t", F.lit("")))
    row = on_workers(sample).mapInArrow(run, "model binary").first()
    return pickle.loads(row["model"]) if row else Model(rule)


def toxicity(docs: DataFrame, labels: DataFrame, rule: Field | None = None, id: str = "doc_id", text: str = "text",
             label: str = "toxic", label_id: str = "doc_id", spans: bool = True) -> DataFrame:
    """(id, held_out, score, predicted, n_toxic[, spans]) of every row; spans are ``start:end`` in code points.

    A null or empty text has no toxic tokens.  Without labels of both kinds the score is the share of toxic labels.
    Repeated rows are scored alike, of several labels of a document the highest counts, a null id is hashed as empty
    text, other columns are not looked at, and no rows give no rows.
    """
    rule = rule or Field()
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rule, id, text, label, label_id))
    schema = T.StructType([
        T.StructField("id", docs.schema[id].dataType), T.StructField("held_out", T.BooleanType()),
        *T._parse_datatype_string("score double, predicted int, n_toxic long" + (", spans string" if spans else "")).fields])

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch, 2, 32 << 20):
                texts = part.column(2).to_pylist()
                found = marginals(model.potentials([tokens(t) for t in texts]), model.moves)
                scores = [model.document(m) for m in found]
                columns = [part.column(0), part.column(1), pa.array(scores, pa.float64()),
                           pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                           pa.array([int((m >= 0.5).sum()) for m in found], pa.int64())]
                if spans:
                    columns.append(pa.array([_spans(t, m) for t, m in zip(texts, found)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    own = docs.select(named(id).alias("id"), held_out(named(id), rule).alias("h"), named(text).cast("string").alias("t"))
    return on_workers(own).mapInArrow(run, schema).withColumnRenamed("id", id)


def _spans(text: str | None, marginal: np.ndarray) -> str:
    """Offsets of the tokens that are likelier toxic than not."""
    bad = np.flatnonzero(marginal >= 0.5).tolist()
    if not bad:
        return ""
    places = [m.span() for m in _TOKEN.finditer(text)]
    return ",".join(f"{places[i][0]}:{places[i][1]}" for i in bad)
