import math
import zlib
from collections import Counter

import numpy as np
import pytest

from colscope.llm import recurrent
from colscope.llm.recurrent import Gru, Recurrent, Vocabulary, log_likelihood, tokens_of, word_counts

RULE = Recurrent(hidden=6, classes=4, per_class=4, head_words=9, train_share=1, window=5, lanes=3, tokens_per_replica=200)


def model(seed=1):
    rule = Recurrent(hidden=5, classes=3, per_class=4, window=6, lanes=2, seed=seed)
    gru = Gru(rule, frequency=np.full(12, 1 / 12))
    gru.vector += np.random.default_rng(seed).normal(0, 0.3, len(gru.vector)).astype(np.float32)
    return gru


def plain(gru, symbols):
    """Log probability of a sequence, one symbol at a time."""
    h, last, total, s = np.zeros((1, 5), np.float32), 1, 0.0, gru.rule.per_class
    for x in symbols:
        h = gru.step(np.array([last]), h)
        c = np.exp(h @ gru.p["wc"] + gru.p["bc"])[0]
        w = np.exp(h @ gru.p["ww"][x // s] + gru.p["bw"][x // s])[0]
        total += math.log10(c[x // s] / c.sum()) + math.log10(w[x % s] / w.sum())
        last = x
    return total


def test_scores_of_whole_sequences():
    gru, random = model(), np.random.default_rng(0)
    texts = [random.integers(0, 12, n).astype(np.int16) for n in (1, 40, 7, 7, 23, 0, 130)]
    for lanes, window in ((512, 64), (2, 3)):
        found = gru.score(texts, lanes, window)
        assert np.allclose(found, [plain(gru, t) for t in texts], atol=1e-3)


def test_the_model_is_a_distribution():
    gru = model()
    total = sum(10 ** plain(gru, [a, b]) for a in range(12) for b in range(12))
    assert abs(total - 1) < 1e-4


def test_gradients(monkeypatch):
    """One training step moves every parameter against its numerical gradient."""
    gru = model(3)
    text = [np.random.default_rng(5).integers(0, 12, 6).astype(np.int16), np.random.default_rng(6).integers(0, 12, 4).astype(np.int16)]
    start = gru.vector.copy()
    gru.train(iter([t.copy() for t in text]))
    moved = start - gru.vector

    def loss(v):
        g = Gru(gru.rule, v)
        return -sum(plain(g, t) for t in text) * math.log(10) / gru.rule.lanes

    big = np.argsort(-np.abs(moved))[:40]
    for i in big:
        up, down = start.copy(), start.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        slope = (loss(up) - loss(down)) / 2e-2
        assert np.sign(slope) == np.sign(moved[i])
        expected = gru.rule.rate * slope / math.sqrt(slope * slope + 1e-3)
        assert abs(expected - moved[i]) < 0.02


def brute(rows, rule):
    out = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter()
    for i, t in rows:
        if not out[i]:
            counts.update([*tokens_of(t), b""])
    n, v = sum(counts.values()), len(counts)
    result = []
    for i, t in rows:
        own = [*tokens_of(t), b""]
        result.append((i, out[i], len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)))
    return result


def test_counts_and_base_scores(spark):
    texts = [" ".join(f"w{(i * j) % (5 + i)}" for j in range(i)) + " Ä" for i in range(40)] + [None, "", "W1 w1 w1"]
    rows = [*enumerate(texts), (None, "only here"), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(log_likelihood(df, RULE).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    expected = sorted(brute(rows, RULE), key=lambda r: (r[0] is None, r[0]))
    assert len(found) == len(expected)
    for r, e in zip(found, expected):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == e[:5]
        assert r.base_score == pytest.approx(e[5], rel=1e-9) and r.score < 0


def test_model_learns_order(spark):
    texts = [" ".join(["a b c d e f g h"] * 6) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [r for r in log_likelihood(df, RULE).collect() if r.held_out]
    assert rows and all(r.score > 0.6 * r.base_score for r in rows)


def test_odd_rows(odd_docs, no_docs):
    rows = log_likelihood(odd_docs, RULE).collect()
    assert len(rows) == odd_docs.count() and all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert log_likelihood(no_docs, RULE).count() == 0


def test_head_never_exceeds_its_bound(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(50)) + " w1 w2 w3 w1",)], "text string")
    counts = word_counts(df).filter("length(word) > 0")
    assert recurrent._frequent(counts, 9).count() == 3 and recurrent._frequent(counts, 2).count() == 1
    assert recurrent._frequent(counts, 50).count() == 50 and recurrent._frequent(counts.limit(0), 5).count() == 0


def test_probabilities_of_words_sum_to_one():
    head = [(b"a", 5), (b"b", 3), (b"c", 2), (b"", 2), (b"d", 1), (b"e", 1)]
    rule = Recurrent(classes=2, per_class=2)
    v = Vocabulary(head, 14, 6, rule)
    rare = sum(10 ** v.share[v.rank[w]] for w in (b"c", b"d", b"e")) + 1 / v.rare_mass  # and the unseen
    assert abs(rare - 1) < 1e-9 and abs(v.frequency.sum() - 1) < 1e-9


def test_every_training_document_is_learnt_from(spark):
    rule = Recurrent(hidden=6, classes=4, per_class=4, head_words=9, window=5, lanes=3)
    df = spark.createDataFrame([(i, "a b c d e f g h") for i in range(300)], "doc_id long, text string")
    df = df.filter("pmod(xxhash64(cast(doc_id as string), text), 48) <> 0")
    counts = [(b"", df.count()), *((bytes([w]), df.count()) for w in b"abcdefgh")]
    vocabulary = Vocabulary(counts, 9 * df.count(), 9, rule)
    untrained = Gru(rule, frequency=vocabulary.frequency).vector
    assert np.abs(recurrent.fit(df, vocabulary, rule, "doc_id", "text") - untrained).max() > 0.1


@pytest.mark.parametrize("replicas", [1, 8, 128, 143, 144])
def test_replicas_are_of_like_size(spark, replicas):
    docs = spark.range(100_000).selectExpr("id as doc_id", "'t' || id as text")
    sizes = [r["count"] for r in recurrent.deal(docs, replicas, Recurrent(), "doc_id", "text").groupBy("replica").count().collect()]
    mean = 100_000 / replicas
    assert len(sizes) == replicas and max(sizes) < mean + 6 * mean ** 0.5 + 1 and min(sizes) > mean - 6 * mean ** 0.5 - 1


def test_lanes_that_have_run_out_change_nothing():
    """One text more than there are lanes, much longer than the others, is learnt from like a text alone."""
    rule = Recurrent(hidden=5, classes=3, per_class=4, window=6, lanes=2)
    text = np.random.default_rng(5).integers(0, 12, 60).astype(np.int16)
    one, two = (Gru(rule, frequency=np.full(12, 1 / 12)) for _ in range(2))
    assert one.train(iter([text])) == 60
    assert two.train(iter([text, np.empty(0, np.int16)])) == 60
    assert np.array_equal(one.vector, two.vector) and np.isfinite(one.vector).all()
