"""Log-likelihood of documents under a gated recurrent language model, trained and run in numpy inside Spark tasks.

Words are counted over all training documents.  The most frequent ones are symbols of the model, whose output softmax
is factored into classes of equal size; any other word is the symbol for rare words times its share of their counts,
so the model gives every text a probability.  Biases start at the counted frequencies, and training moves on from
there: replicas run truncated backpropagation over streams of documents and are averaged after every round.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, named, on_workers, slices, written

RARE, END = 0, 1
# Logits are cut here, so that their exponentials stay finite.
_MOST = np.float32(60)


@dataclass(frozen=True)
class Recurrent:
    """Sizes of the model, and how it is trained.

    ``head_words`` most frequent words and their counts travel to every task; counts of all others are joined.  The
    model is fitted on every training document, or with ``train_share`` above 1 on every ``train_share``-th.
    """

    hidden: int = 16
    classes: int = 24
    per_class: int = 24
    head_words: int = 150_000
    train_share: int = 1
    rounds: int = 1
    tokens_per_replica: int = 800_000
    window: int = 32
    lanes: int = 128
    rate: float = 0.15
    held_out: tuple[int, int] = (7, 2)
    seed: int = 7


def held_out(id: Column, rule: Recurrent) -> Column:
    """Whether a document is kept from training: the CRC-32 of its id as text; a null id counts as empty text."""
    modulus, rest = rule.held_out
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit(""))), F.lit(modulus)) == rest


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all rows, with one end per row under the empty word; counted in each task before the shuffle."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(tokens_of(t))
                counts[b""] += 1
                if len(counts) > 300_000:
                    yield _counted(counts)
                    counts = Counter()
        if counts:
            yield _counted(counts)

    own = on_workers(docs.select(named(text).cast("string")))
    return own.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())],
                                      ["word", "n"])


class Vocabulary:
    """Ranks and counts of the head words; symbols of the model are rare, end, then words by rank."""

    def __init__(self, head: list[tuple[bytes, int]], tokens: int, distinct: int, rule: Recurrent):
        self.rule = rule
        self.tokens, self.distinct = tokens, distinct
        self.ends = next((n for w, n in head if not w), 0)
        head = [(w, n) for w, n in head if w]
        self.rank = {w: i for i, (w, _) in enumerate(head)}
        counts = np.array([n for _, n in head], float)
        self.symbols = rule.classes * rule.per_class
        own = min(self.symbols - 2, len(head))
        total = tokens + distinct + 1
        # All that is no symbol, unseen words included, shares what the symbols leave.
        self.rare_mass = total - (counts[:own].sum() + own) - (self.ends + 1)
        self.base = np.append(np.log10((counts + 1) / total), 0.0)  # the last is for words outside the head
        self.base_end = math.log10((self.ends + 1) / total)
        self.share = np.append(np.where(np.arange(len(head)) < own, 0.0, np.log10((counts + 1) / max(self.rare_mass, 1.0))), 0.0)
        self.symbol = np.append(np.where(np.arange(len(head)) < own, np.arange(len(head)) + 2, RARE), RARE).astype(np.int16)
        frequency = np.full(self.symbols, 1e-9)
        frequency[RARE], frequency[END] = max(self.rare_mass, 1e-9), self.ends + 1
        frequency[2:own + 2] = counts[:own] + 1
        self.frequency = frequency / frequency.sum()

    def ranks(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.rank.get, words, repeat(-1)), np.int64, len(words))

    def symbols_of(self, ranks: np.ndarray) -> np.ndarray:
        return np.append(self.symbol[ranks], np.int16(END))


class Gru:
    """Parameters as one vector: input table, recurrent weights, class and word outputs.

    The update gate, reset gate and proposal lie one behind the other, so each is one piece of memory to numpy.
    """

    def __init__(self, rule: Recurrent, vector: np.ndarray | None = None, frequency: np.ndarray | None = None):
        h, c, s = rule.hidden, rule.classes, rule.per_class
        self.rule = rule
        shapes = {"x": (3, c * s, h), "u": (3, h, h), "wc": (h, c), "bc": (c,), "ww": (c, h, s), "bw": (c, s)}
        size = sum(math.prod(v) for v in shapes.values())
        self.vector = np.zeros(size, np.float32) if vector is None else np.array(vector, np.float32)
        self.p = self.views(self.vector, shapes)
        self.shapes = shapes
        if vector is None:
            random = np.random.default_rng(rule.seed)
            self.p["x"][:] = random.normal(0, 0.2, shapes["x"])
            self.p["u"][:] = random.normal(0, 0.6 / math.sqrt(h), shapes["u"])
            by_class = frequency.reshape(c, s)
            self.p["bc"][:] = np.log(by_class.sum(1))
            self.p["bw"][:] = np.log(by_class / by_class.sum(1, keepdims=True))

    @staticmethod
    def views(vector: np.ndarray, shapes: dict) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in shapes.items():
            n = math.prod(shape)
            out[name] = vector[at:at + n].reshape(shape)
            at += n
        return out

    def step(self, symbols: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The state after reading one more symbol in every lane."""
        out = np.empty_like(h)
        self.advance(self.p["x"].take(symbols, 1), h, np.empty((3, *h.shape), np.float32), np.empty_like(h), out)
        return out

    def advance(self, x: np.ndarray, h: np.ndarray, g: np.ndarray, new: np.ndarray, out: np.ndarray) -> None:
        """Write the next state to ``out``, both gates and the proposal's recurrent part to ``g``, the proposal to ``new``."""
        np.matmul(h, self.p["u"], out=g)
        gates = g[:2]
        gates += x[:2]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        np.multiply(g[1], g[2], out=new)
        new += x[2]
        np.tanh(new, out=new)
        np.subtract(h, new, out=out)
        out *= g[0]
        out += new

    def outputs(self, h: np.ndarray, targets: np.ndarray, weights: np.ndarray | None = None):
        """Natural log probability of each target; with weights also the gradients of their weighted loss."""
        c, s = self.rule.classes, self.rule.per_class
        order = np.argsort((targets // s).astype(np.int16), kind="stable")  # classes side by side
        h, targets = h[order], targets[order]
        classes, words = targets // s, targets % s
        rows = np.arange(len(h))
        at, by_class = rows * c + classes, np.ones(c, np.float32)
        logits = h @ self.p["wc"]
        logits += self.p["bc"]
        np.minimum(logits, _MOST, out=logits)
        picked = logits.take(at)
        e = np.exp(logits, out=logits)
        total = e @ by_class
        logp = picked - np.log(total)
        if weights is not None:
            weights = weights[order]
            e *= (weights / total)[:, None]
            e.reshape(-1)[at] -= weights
            grads = {"wc": h.T @ e, "bc": e.sum(0), "ww": np.zeros(self.shapes["ww"], np.float32),
                     "bw": np.zeros(self.shapes["bw"], np.float32)}
            dh = e @ self.p["wc"].T
        at, by_word = rows * s + words, np.ones(s, np.float32)
        cuts = np.searchsorted(classes, np.arange(c + 1)).tolist()
        for k, (start, stop) in enumerate(zip(cuts, cuts[1:])):
            if start == stop:
                continue
            ho, own = h[start:stop], at[start:stop] - start * s
            logits = ho @ self.p["ww"][k]
            logits += self.p["bw"][k]
            np.minimum(logits, _MOST, out=logits)
            picked = logits.take(own)
            e = np.exp(logits, out=logits)
            total = e @ by_word
            picked -= np.log(total)
            logp[start:stop] += picked
            if weights is not None:
                e *= (weights[start:stop] / total)[:, None]
                e.reshape(-1)[own] -= weights[start:stop]
                grads["ww"][k], grads["bw"][k] = ho.T @ e, e.sum(0)
                dh[start:stop] += e @ self.p["ww"][k].T
        found = np.empty_like(logp)
        found[order] = logp
        if weights is None:
            return found
        back = np.empty_like(dh)
        back[order] = dh
        return found, back, grads

    def score(self, texts: list[np.ndarray], lanes: int = 512, window: int = 64) -> np.ndarray:
        """log10 probability of every sequence of symbols.

        Sequences of like length run side by side, window by window; their states are carried on from one window to
        the next, so each is scored as a whole.
        """
        out = np.zeros(len(texts))
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        for at in range(0, len(order), lanes):
            own = order[at:at + lanes]
            lengths = np.array([len(texts[i]) for i in own])
            h = np.zeros((len(own), self.rule.hidden), np.float32)
            last = np.full(len(own), END, np.int64)
            sums = np.zeros(len(own))
            for start in range(0, int(lengths[0]), window):
                steps = min(window, int(lengths[0]) - start)
                live = int((lengths > start).sum())
                lanes_first = np.zeros((live, steps), np.int64)
                for k in range(live):
                    piece = texts[own[k]][start:start + steps]
                    lanes_first[k, :len(piece)] = piece
                block = np.ascontiguousarray(lanes_first.T)
                states, targets, owners = [], [], []
                for live in np.searchsorted(-lengths, -np.arange(start, start + steps)).tolist():
                    if not live:
                        break
                    h, last = self.step(last[:live], h[:live]), block[len(states), :live]
                    states.append(h)
                    targets.append(last)
                    owners.append(np.arange(live))
                logp = self.outputs(np.concatenate(states), np.concatenate(targets))
                sums += np.bincount(np.concatenate(owners), logp, len(own))
            out[own] = sums / math.log(10)
        return out

    def train(self, texts) -> int:
        """One pass of truncated backpropagation over an iterator of sequences; returns the number of targets.

        Every lane reads one sequence after the other, the state is zero where a sequence begins and is carried, but
        not its gradient, from window to window.
        """
        rule, texts = self.rule, iter(texts)
        n, b, steps = rule.hidden, rule.lanes, rule.window
        lanes = [np.empty(0, np.int16)] * b
        squares = np.full(len(self.vector), 1e-3, np.float32)
        h, last, seen, open_ = np.zeros((b, n), np.float32), np.full(b, END, np.int16), 0, True
        while True:
            block, fresh, weight = (np.zeros((steps, b), k) for k in (np.int16, bool, np.float32))
            for k in range(b):
                t = 0
                while t < steps:
                    if not len(lanes[k]):
                        lanes[k] = next(texts, lanes[k]) if open_ else lanes[k]
                        if not len(lanes[k]):
                            open_ = False
                            break
                        fresh[t, k] = True
                    take = min(steps - t, len(lanes[k]))
                    block[t:t + take, k] = lanes[k][:take]
                    weight[t:t + take, k] = 1
                    lanes[k] = lanes[k][take:]
                    t += take
            used = int(weight.sum())
            if not used:
                return seen
            seen += used
            # Lanes that have run out, as all but one do beside a long last text, are left out of the work.
            live = np.flatnonzero(weight.any(0))
            block, fresh, weight = block[:, live], fresh[:, live], weight[:, live]
            m = len(live)
            symbols = np.concatenate([last[live][None], block[:-1]])
            symbols[fresh] = END
            symbols = symbols.ravel()
            x = self.p["x"].take(symbols, 1).reshape(3, steps, m, n)
            before, new, states = (np.empty((steps, m, n), np.float32) for _ in range(3))
            g, restarts = np.empty((steps, 3, m, n), np.float32), fresh.any(1).tolist()
            now = h[live]
            for t in range(steps):
                before[t] = now
                if restarts[t]:
                    before[t, fresh[t]] = 0
                now = states[t]
                self.advance(x[:, t], before[t], g[t], new[t], now)
            h[live], last[live] = now, block[-1]
            _, dh, grads = self.outputs(states.reshape(-1, n), block.ravel().astype(np.int64), weight.ravel() / b)
            dh = dh.reshape(steps, m, n)
            gradient = np.zeros(len(self.vector), np.float32)
            own = self.views(gradient, self.shapes)
            for name, value in grads.items():
                own[name][:] = value
            z, r = g[:, 0], g[:, 1]
            to_new, to_z, to_r = (1 - z) * (1 - new * new), (before - new) * z * (1 - z), g[:, 2] * r * (1 - r)
            back = np.ascontiguousarray(self.p["u"].transpose(0, 2, 1))
            # What reaches the gates and the proposal's recurrent part, and the proposal itself.
            d, dnew, carried = np.empty_like(g), np.empty_like(new), np.zeros((m, n), np.float32)
            for t in range(steps - 1, -1, -1):
                carried += dh[t]
                np.multiply(carried, to_new[t], out=dnew[t])
                np.multiply(carried, to_z[t], out=d[t, 0])
                np.multiply(dnew[t], to_r[t], out=d[t, 1])
                np.multiply(dnew[t], r[t], out=d[t, 2])
                carried *= z[t]
                for part in d[t] @ back:
                    carried += part
                if restarts[t]:
                    carried[fresh[t]] = 0
            order = np.argsort(symbols, kind="stable")
            rows, first = np.unique(symbols[order], return_index=True)
            inputs = before.reshape(-1, n).T
            for k, dx in enumerate((d[:, 0], d[:, 1], dnew)):
                own["u"][k] = inputs @ d[:, k].reshape(-1, n)
                own["x"][k, rows] = np.add.reduceat(dx.reshape(-1, n)[order], first, axis=0)
            np.clip(gradient, -5, 5, out=gradient)
            squares += gradient * gradient
            self.vector -= rule.rate * gradient / np.sqrt(squares)


def deal(docs: DataFrame, replicas: int, rule: Recurrent, id: str, text: str) -> DataFrame:
    """(t, k, replica): the documents to train on, dealt to replicas evenly by whole numbers from a hash."""
    number = F.xxhash64(named(id).cast("string"), named(text).cast("string"))
    sample = docs.select(named(text).cast("string").alias("t"), number.alias("k")).filter(
        (F.pmod("k", F.lit(rule.train_share)) == 0) & F.col("t").isNotNull())
    return sample.withColumn("replica", F.expr(f"cast(pmod(k div {rule.train_share}L, {replicas}L) as int)"))


def fit(docs: DataFrame, vocabulary: Vocabulary, rule: Recurrent, id: str, text: str) -> np.ndarray:
    """The model's parameters after ``rule.rounds`` rounds over the training documents.

    The number of replicas follows the counted tokens; their vectors are added up in about as many tasks as the root
    of it before they reach the driver.
    """
    spark = docs.sparkSession
    model = Gru(rule, frequency=vocabulary.frequency)
    replicas = max(1, math.ceil(vocabulary.tokens / rule.train_share / rule.tokens_per_replica))
    dealt = deal(docs, replicas, rule, id, text)
    dealt = written(dealt, "lm-sample")
    words = spark.sparkContext.broadcast(vocabulary)
    for _ in range(rule.rounds):
        start = spark.sparkContext.broadcast(model.vector)

        def run(batches, start=start):
            mine, n = None, 0
            held: list[int] = []

            def sequences(replica, rest):
                for own, t in rest:
                    if own != replica:
                        held.append((own, t))
                        return
                    yield words.value.symbols_of(words.value.ranks(tokens_of(t)))

            rows = ((r, t) for batch in batches for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            first = next(rows, None)
            while first is not None:
                held.clear()
                mine = Gru(rule, start.value)
                n = mine.train(sequences(first[0], _chain(first, rows)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n], pa.int64()), pa.array([(mine.vector * np.float32(n)).tobytes()], pa.binary())], ["n", "v"])
                first = held[0] if held else None

        ordered = dealt.repartition(replicas, "replica").sortWithinPartitions("replica", "k")
        trained = on_workers(ordered.select("replica", "t")).mapInArrow(run, "n long, v binary")
        added = trained.repartition(math.isqrt(replicas - 1) + 1).mapInArrow(_added, "n long, v binary").collect()
        total = sum(r["n"] for r in added)
        if total:
            model = Gru(rule, sum(np.frombuffer(r["v"], np.float32) for r in added) / np.float32(total))
    return model.vector


def _chain(first, rest):
    yield first
    yield from rest


def _added(batches):
    n, total = 0, None
    for batch in batches:
        for own, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n += own
            vector = np.frombuffer(v, np.float32)
            total = vector.copy() if total is None else total + vector
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "v"])


def _scored(docs: DataFrame, vocabulary: Vocabulary, vector: np.ndarray, rule: Recurrent, id: str, text: str) -> DataFrame:
    """(id, held_out, n_tokens, n_known, base, score, tail): sums over head words, and the other words with counts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, vector))
    schema = T.StructType([
        T.StructField("id", docs.schema[id].dataType), T.StructField("held_out", T.BooleanType()),
        *T._parse_datatype_string("n_tokens long, n_known long, base double, score double, "
                                  "tail array<struct<word:binary, n:long>>").fields])
    tail_type = pa.list_(pa.struct([pa.field("word", pa.binary()), pa.field("n", pa.int64())]))

    def run(batches):
        v, vector = shared.value
        model = Gru(rule, vector)
        for batch in batches:
            for part in slices(batch, 2, 32 << 20):
                n, known, base, share, symbols, tails = [], [], [], [], [], []
                for t in part.column(2).to_pylist():
                    words = tokens_of(t)
                    ranks = v.ranks(words)
                    tail = Counter(words[i] for i in np.flatnonzero(ranks < 0).tolist())
                    n.append(len(words) + 1)
                    known.append(len(words) - sum(tail.values()) + (v.ends > 0))
                    base.append(float(v.base[ranks].sum()) + v.base_end)
                    share.append(float(v.share[ranks].sum()))
                    symbols.append(v.symbols_of(ranks))
                    tails.append([{"word": w, "n": c} for w, c in tail.items()])
                with np.errstate(over="ignore"):
                    score = model.score(symbols) + np.array(share)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                     pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(tails, tail_type)], schema.names)

    own = docs.select(named(id).alias("id"), held_out(named(id), rule).alias("h"), named(text).cast("string").alias("t"))
    return on_workers(own).mapInArrow(run, schema)


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words above a count that at most ``most`` words exceed: a filter, where a sort would end in one task."""
    step = F.floor(F.log2("n") * 64).cast("int")
    left, least = most, None
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        left -= r["count"]
        if left < 0:
            break
        least = r["s"]
    return counts.filter(step >= least) if least is not None else counts.limit(0)


def log_likelihood(docs: DataFrame, rule: Recurrent | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, in log10.

    A null or empty text is its end alone.  Repeated rows count and are scored each, a null id is hashed as empty
    text, other columns are not looked at, and no rows give no rows.  With no training document every word is unseen.
    """
    rule = rule or Recurrent()
    train = docs.filter(~held_out(named(id), rule))
    counts = written(word_counts(train, text), "counts")
    tokens, distinct = (x or 0 for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
    end = counts.filter(F.length("word") == 0)
    top = _frequent(counts.filter(F.length("word") > 0), rule.head_words)
    head = sorted(((bytes(w), n) for w, n in top.unionAll(end).toArrow().to_pandas().itertuples(index=False)),
                  key=lambda x: (-x[1], x[0]))
    vocabulary = Vocabulary(head, tokens, distinct, rule)
    vector = fit(train, vocabulary, rule, id, text)
    scored = written(_scored(docs, vocabulary, vector, rule, id, text), "scored")
    scored = scored.withColumn("r", F.monotonically_increasing_id())  # fixed: the table is read in a fixed order
    tail = scored.select("r", F.explode("tail").alias("w")).select("r", "w.word", F.col("w.n").alias("times"))
    seen = F.coalesce("n", F.lit(0))
    total = float(tokens + distinct + 1)
    sums = tail.join(counts, "word", "left").groupBy("r").agg(
        F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10((seen + 1) / total)).alias("base_more"),
        F.sum(F.col("times") * F.log10((seen + 1) / max(vocabulary.rare_mass, 1.0))).alias("score_more"))
    out = scored.drop("tail").join(sums, "r", "left")
    return out.select(
        F.col("id").alias(id), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("score_more", F.lit(0.0))).alias("score"))
