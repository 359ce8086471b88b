import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.llm import common, jaccard
from colscope.llm.jaccard import Jaccard, components, drop_near_duplicates, fragment_marks, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(zip(*[words[i:] for i in range(k)])) if len(words) >= k else frozenset([tuple(words)])


def brute(docs, rule):
    sets = [(i, shingles(t, rule.words)) for i, t in docs]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and rule.den * len(x & y) >= rule.num * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least.setdefault(find(a), []).append(i)
    return sorted((i, len(s), min(least[find(a)])) for a, (i, s) in enumerate(sets))


def corpus(pick, groups=6, copies=22):
    docs, passage = [], [f"p{i}" for i in range(60)]
    for g in range(groups):
        length = pick.choice([4, 9, 14, 40, 120, 300])
        words = [f"g{g}w{i}" for i in range(length)]
        if pick.random() < 0.5:
            words[length // 2:length // 2] = passage
        for _ in range(copies):
            own = list(words)
            for _ in range(pick.choice([0, 0, 1, 1, 2, 3, 5, 9])):
                at, kind = pick.randrange(len(own)), pick.random()
                if kind < 0.4:
                    own[at] = f"e{pick.randint(0, 40)}"
                elif kind < 0.6 and len(own) > 1:
                    del own[at]
                elif kind < 0.8:
                    own.insert(at, f"e{pick.randint(0, 40)}")
                else:
                    own = own[:at] + own[at + pick.randint(1, 4):] or own
            docs.append(" ".join(own))
    docs += ["", " ", "one", "ONE", "one two", "one two three", "One Two\nThree"]
    pick.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("rule", [Jaccard(), Jaccard(2, 80, 100), Jaccard(3, 70, 100)], ids=str)
def test_components_equal_brute_force(spark, rule):
    docs = corpus(random.Random(rule.num))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df, rule).collect())) == brute(docs, rule)


def test_a_chain_of_copies_is_one_component(spark):
    words = [f"w{i}" for i in range(200)]
    chain = []
    for i in range(40):
        chain.append((100 - i, " ".join(words)))
        words[5 * i] = f"changed{i}"
    df = spark.createDataFrame(chain, "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(df).collect()} == {61}


def test_files_meet_for_all_linked_sizes():
    for rule in (Jaccard(), Jaccard(3, 80, 100)):
        for a in range(1, 400):
            for b in range(a, a * rule.den // rule.num + 1):
                if rule.most_different(a + b) == 0 or a * rule.den < rule.num * b:
                    continue
                shared = dict((k, (f, m)) for k, f, m in rule.files(a)).items() & dict((k, (f, m)) for k, f, m in rule.files(b)).items()
                assert any(f - m > rule.most_different(a + b) for _, (f, m) in shared)


@pytest.mark.parametrize("rule", [Jaccard(), Jaccard(5, 80, 100)], ids=str)
def test_linked_sets_meet_whatever_they_leave(rule):
    pick = np.random.default_rng(5)
    left = 0
    for n in (2, 3, 7, 20, 61, 150, 299, 450, 900):
        for _ in range(60):
            grams = np.unique(pick.integers(0, 2**64, n, dtype=np.uint64))
            gone = pick.integers(0, n // 5 + 1)
            new = pick.integers(0, 2**64, pick.integers(0, n // 5 + 1), dtype=np.uint64)
            other = np.unique(np.concatenate([pick.permutation(grams)[gone:], new]))
            both = len(np.intersect1d(grams, other))
            if rule.den * both < rule.num * (len(grams) + len(other) - both) or not rule.most_different(len(grams) + len(other)):
                continue
            marks, spare = zip(*[fragment_marks(x, rule) for x in (grams, other)])
            common = np.intersect1d(*marks)
            by_class = [(common % 8 == k).sum() - spare[0][k] - spare[1][k] for k in range(8)]
            assert max(by_class) > 0
            left += sum(spare[0])
    assert left > 0


def test_odd_rows(odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in rows}
    assert {(1, 0, 1), (2, 0, 2), (None, 0, None), (4, 58, 4), (5, 58, 4), (None, 58, None), (6, 29_998, 6), (7, 1, 7), (8, 1, 8)} <= found
    assert near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("most", [10**6, 0])
def test_one_row_of_each_component_stays(odd_docs, no_docs, monkeypatch, most):
    monkeypatch.setattr(jaccard, "MAX_BROADCAST_ROWS", most)
    kept = drop_near_duplicates(odd_docs)
    assert kept.schema == odd_docs.schema
    assert sorted((r.doc_id or 0, r.text is None) for r in kept.collect()) == [
        (0, False), (0, True), (1, True), (2, False), (3, False), (4, False), (6, False), (7, False), (8, False), (9, False)]
    assert drop_near_duplicates(no_docs).count() == 0


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {(r.node, r.root) for r in found} == {(n, 0) for n in range(51)} | {(100 + i, 100) for i in range(30)} | {
        (200 + i, 200) for i in range(9)}


def test_differences_are_fetched_for_members_of_pairs_only(spark, monkeypatch):
    rows = [(0, 100, c, 100, 30, list(range(start, start + 30)), False) for c, start in ((1, 0), (2, 0), (3, 100), (4, 200))]
    differences = spark.createDataFrame(rows, "hub long, hub_n long, c long, n long, d long, other array<long>, linked boolean")
    tables, plain = {}, jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: tables.setdefault(name, plain(df, name)))
    links = jaccard._member_links(differences, jaccard.Jaccard(words=5, num=80, den=100))
    assert [tuple(r) for r in links.collect()] == [(1, 2)]
    assert sorted(map(tuple, tables["members-of-pairs"].collect())) == [(0, 1), (0, 2)]


def test_members_far_from_a_large_hub_make_no_pairs(spark, monkeypatch):
    # Each lacks the same 60 n-grams of the hub and has 30 of its own: their differences agree in more than half.
    hub = 1000
    rows = [(hub, 116, c, 86, 90, [*range(60), *range(100 * c, 100 * c + 30)], False) for c in range(1, 41)]
    differences = spark.createDataFrame(rows, "hub long, hub_n long, c long, n long, d long, other array<long>, linked boolean")
    tables, plain = {}, jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: tables.setdefault(name, plain(df, name)))
    assert jaccard._member_links(differences, Jaccard(5, 80, 100)).count() == 0
    assert tables["member-pairs"].count() == 0


def test_members_that_links_with_hubs_connect_make_no_pairs(spark, monkeypatch):
    docs, words = [], [f"w{i}" for i in range(200)]
    for i in range(60):
        own = list(words)
        for at in range(i % 10, 200, 50 - i // 2):
            own[at] = f"e{at}"
        docs.append((i, " ".join(own)))
    tables, plain = {}, jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: tables.__setitem__(name, plain(df, name)) or tables[name])
    rule = Jaccard(5, 80, 100)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df, rule).collect())) == brute(docs, rule)
    roots = {}
    for hub, c, root in tables["members"].select("hub", "c", "root").collect():
        roots[c] = root
    pairs = tables["member-pairs"].collect()
    assert len({(r.u, r.v) for r in pairs}) == len(pairs)
    assert all(roots[r.u] != roots[r.v] for r in pairs)


def test_crowded_passages_lose_no_link(spark):
    pick = random.Random(0)
    passage = [f"p{i}" for i in range(70)]
    docs = []
    for g in range(25):
        words = [f"g{g}w{i}" for i in range(pick.randint(5, 60))] + passage[:pick.randint(20, 70)]
        for _ in range(6):
            own = list(words)
            for _ in range(pick.randint(0, 6)):
                own[pick.randrange(len(own))] = f"e{pick.randint(0, 20)}"
            docs.append((len(docs), " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rule = Jaccard(5, 80, 100)
    assert sorted(map(tuple, near_duplicates(df, rule).collect())) == brute(docs, rule)


def test_a_written_table_leaves_no_shuffle_files(spark):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in files.mkString("\n").split("\n") if "shuffle_" in f}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(key), shuffled()
    table = common.written(spark.range(1000).groupBy((F.col("id") % 100).alias("g")).count(), "counts")
    for _ in range(50):  # files go a little after the write
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert table.count() == 100 and spark.conf.get(key) == setting
