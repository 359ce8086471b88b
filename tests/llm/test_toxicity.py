import random

import numpy as np

from colscope.llm.toxicity import Field, marginals, toxic_stems, toxicity, train


def test_marginals_equal_enumeration():
    pick = random.Random(2)
    for _ in range(60):
        chains = [np.array([pick.uniform(-3, 3) for _ in range(pick.randint(0, 7))]) for _ in range(5)]
        moves = np.array([pick.uniform(-1, 1) for _ in range(4)])
        found, pairs = marginals(chains, moves, lanes=2, pairs=True)
        expected_pairs = np.zeros(4)
        for u, p in zip(chains, found):
            n = len(u)
            assert len(p) == n
            if not n:
                continue
            weight, total, counts = np.zeros(n), 0.0, np.zeros(4)
            for states in range(2 ** n):
                y = [(states >> t) & 1 for t in range(n)]
                steps = [2 * a + b for a, b in zip(y, y[1:])]
                w = np.exp(sum(u[t] for t in range(n) if y[t]) + sum(moves[s] for s in steps))
                total += w
                weight += w * np.array(y)
                counts += w * np.bincount(steps, minlength=4)
            assert np.allclose(p, weight / total)
            expected_pairs += counts / total
        assert np.allclose(pairs, expected_pairs)


def made(n, seed=4):
    pick, docs, labels = random.Random(seed), [], []
    for i in range(n):
        words = [f"w{int(pick.expovariate(0.02))}" for _ in range(pick.randint(5, 120))]
        toxic = pick.random() < 0.3
        for _ in range(pick.randint(2, 4) if toxic else 0):
            word = pick.choice(["grob", "Mist!", "zonk" + "".join(pick.choice("abcdefgh") for _ in range(3))])
            words.insert(pick.randrange(len(words)), word)
        docs.append((i, " ".join(words)))
        if pick.random() < 0.7:
            labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_documents(spark):
    docs, labels = made(900)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    truth = {i: y for i, y in labels if rows[i].held_out}
    right = sum(rows[i].predicted == y for i, y in truth.items())
    assert len(truth) > 80 and right >= 0.97 * len(truth)
    text = dict(docs)
    for r in rows.values():
        for span in filter(None, r.spans.split(",")):
            a, b = map(int, span.split(":"))
            assert text[r.doc_id][a:b].lower().startswith(("grob", "mist", "zonk"))


def test_held_out_labels_are_not_learned(spark):
    docs, labels = made(300)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    one = toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = {r.doc_id for r in one.filter("held_out").collect()}
    changed = [(i, 1 - y if i in out else y) for i, y in labels]
    two = toxicity(d, spark.createDataFrame(changed, "doc_id long, toxic int"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_endings_not_seen_are_recognised():
    docs, labels = made(600)
    text, y = dict(docs), dict(labels)
    model = train([text[i].lower().split() for i in y], [v == 1 for v in y.values()], Field())
    p = marginals(model.potentials(["w1 w2 zonkxyz w3 zonkqqq w4".split()]), model.moves)[0]
    assert (p > 0.5).tolist() == [False, False, True, False, True, False] and model.document(p) > 0.5


def test_stems_need_toxic_documents_only():
    texts = [["bad", "w1"], ["bad", "w2"], ["bad", "w3"], ["bad", "w4"], ["w1", "w2"], ["w3", "w4"]] * 3
    assert toxic_stems(texts, [True] * 4 + [False] * 2 + [True] * 4 + [False] * 2 + [True] * 4 + [False] * 2, Field()) == {"=bad"}


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, "x"), (5, 0, "x"), (6, 0, "x"), (None, 1, "x"), (7, None, "x"), (4, 0, "x"), (99, 1, "x")],
                                   "doc_id long, toxic int, text string")
    for own in (labels, labels.filter("toxic = 1"), labels.limit(0)):
        rows = toxicity(odd_docs, own).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
        assert all(r.spans == "" and r.n_toxic == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert toxicity(no_docs, labels).count() == 0


def test_the_fit_is_bounded_by_bytes(spark):
    """Texts that do not fit in are passed over whole, however many there are; they are scored all the same."""
    docs, labels = made(250)
    long = [(1000 + i, "mist grob " * 20_000) for i in range(5)]
    d = spark.createDataFrame(docs + long, "doc_id long, text string")
    rule, kind = Field(most_bytes=100_000), "doc_id long, toxic int"
    one = toxicity(d, spark.createDataFrame(labels + [(i, i % 2) for i, _ in long], kind), rule)
    two = toxicity(d, spark.createDataFrame(labels, kind), rule)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    few = toxicity(d, spark.createDataFrame(labels, kind), Field(most_bytes=2_000)).collect()
    assert len(few) == len(docs) + len(long) and all(0 <= r.score <= 1 for r in few)
