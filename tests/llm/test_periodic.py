import random

import numpy as np
import pytest

from colscope.llm.periodic import Periodicity, periodic_runs, runs_of


def brute(words, least):
    """Runs by comparing every place with every later one."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        start = 0
        while start + q < n:
            stop = start
            while stop + q < n and words[stop] == words[stop + q]:
                stop += 1
            if stop - start + q >= max(least, 2 * q):
                found.setdefault((start, stop - start + q), q)  # the smallest period comes first
            start = stop + 1
    return sorted((s, m, q) for (s, m), q in found.items())


def collapsed(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return [w for i, w in enumerate(words) if i not in gone]


def sequences(pick):
    for _ in range(400):  # few letters: many small circles inside large ones
        yield [pick.randrange(pick.choice([1, 2, 2, 3, 4, 30])) for _ in range(pick.randrange(0, 120))]
    for _ in range(200):  # repeated words of repeated words, with a word changed here and there
        own = [pick.randrange(3) for _ in range(pick.randrange(1, 9))]
        for _ in range(pick.randrange(1, 4)):
            own = own * pick.randrange(1, 5) + [pick.randrange(3) for _ in range(pick.randrange(0, 4))]
        own = own[:400]
        if own and pick.random() < 0.5:
            own[pick.randrange(len(own))] = 9
        yield [5] * pick.randrange(0, 3) + own
    a, b = [0], [0, 1]
    for _ in range(10):  # the words of Fibonacci hold the most runs
        a, b = b, b + a
        yield b


@pytest.mark.parametrize("least", [12, 5, 2, 13, 7])
def test_runs_equal_brute_force(least):
    for words in sequences(random.Random(least)):
        assert runs_of(np.array(words, np.int64), least) == brute(words, least), words


def test_work_stays_in_proportion_to_the_words(monkeypatch):
    from colscope.llm import periodic

    pairs = []
    plain = periodic._seeds
    monkeypatch.setattr(periodic, "_seeds", lambda *a: pairs.append(len((r := plain(*a))[0])) or r)
    for words in ([0] * 50_000, [0, 0, 0, 1] * 12_500, ([0] * 300 + [1]) * 170):
        pairs.clear()
        runs_of(np.array(words), 12)
        assert sum(pairs) <= 4 * len(words) * max(1, len(pairs)), len(pairs)


def test_documents(spark, odd_docs, no_docs):
    rows = {(r.doc_id, r.n_words) for r in periodic_runs(odd_docs, keep=["doc_id"]).collect()}
    assert {(1, 0), (2, 0), (3, 0), (4, 60), (6, 30_000), (None, 60), (None, 0), (9, 36)} <= rows
    out = periodic_runs(odd_docs)
    assert out.columns == ["doc_id", "text", "lang", "row", "a.b", "n_words", "runs", "collapsed"]
    found = {r.doc_id: r for r in out.collect()}
    assert [tuple(x) for x in found[9].runs] == [(0, 36, 3)] and found[9].collapsed == "Äöü ﬁ 😀"
    assert found[1].runs == [] and found[1].collapsed == "" and found[1].text is None and found[4].runs == []
    assert periodic_runs(no_docs).count() == 0
    assert periodic_runs(odd_docs.limit(5).unionAll(odd_docs)).count() == 5 + odd_docs.count()


def test_many_documents_in_one_batch_equal_each_alone(spark):
    pick = random.Random(3)
    texts = [" ".join(f"w{x}" for x in own) for own in sequences(pick)]
    texts[7], texts[9] = None, "a " * 300_000  # longer than a slice
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in periodic_runs(docs).collect():
        words = (r.text or "").split()
        if len(words) > 1000:
            assert [tuple(x) for x in r.runs] == [(0, 300_000, 1)] and r.collapsed == "a"
            continue
        expected = brute(words, Periodicity().least)
        assert [tuple(x) for x in r.runs] == expected and r.n_words == len(words)
        assert r.collapsed == " ".join(collapsed(words, expected))
