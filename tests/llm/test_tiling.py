import random

import numpy as np
import pytest

from colscope.llm.tiling import Block, Tiling, contamination, drop_contaminated, greedy_tiles


def brute(item, doc, k):
    used_item, used_doc, tiles = [False] * len(item), [x == 0 for x in doc], []
    while True:
        best, found = k - 1, []
        for j in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while (i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]
                       and not used_item[i + n] and not used_doc[j + n]):
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best and n >= k:
                    found.append((i, j))
        if best < k:
            return tiles
        for i, j in found:
            if not any(used_item[i:i + best]) and not any(used_doc[j:j + best]):
                used_item[i:i + best] = used_doc[j:j + best] = [True] * best
                tiles.append((best, i, j))


def test_tiles_equal_brute_force():
    pick = random.Random(3)
    for n in range(500):
        item = [pick.randint(1, 4) for _ in range(pick.randint(0, 14))]
        doc = [pick.randint(0, 4) for _ in range(pick.randint(0, 30))]
        k = 2 + n % 2
        found = greedy_tiles(np.array(item, int), np.array(doc, int), k)
        assert sorted(t[0] for t in found) == sorted(t[0] for t in brute(item, doc, k))
        for length, i, j in found:
            assert item[i:i + length] == doc[j:j + length]


@pytest.fixture(scope="module")
def items(spark):
    texts = [" ".join(f"q{k}w{i}" for i in range(30)) for k in range(5)]
    return spark.createDataFrame([*enumerate(texts), (5, None), (6, ""), (7, "of the"), (None, "n1 n2 n3 n4 n5 n6")],
                                 "item_id int, text string")


def test_leaks_are_found_in_any_order(spark, items):
    def item(k, a=0, b=30):
        return " ".join(f"q{k}w{i}" for i in range(a, b))

    noise = " ".join(f"z{i}" for i in range(200))
    docs = spark.createDataFrame([
        (1, f"{noise} {item(0)} {noise}"), (2, f"{item(1, 20)} {noise} {item(1, 0, 10).upper()}, {item(1, 10, 20)}"),
        (3, f"{noise} {item(2, 0, 10)}"), (4, noise), (5, None), (6, ""), (7, f"{item(3)} {item(4)}"), (7, f"{item(3)} {item(4)}"),
        (None, "N1 n2-n3, n4 n5 n6."), (8, "of the of the"),
    ], "doc_id long, text string")
    for block_bytes in (1 << 20, 300):
        rule = Tiling(block_bytes=block_bytes)
        found = contamination(docs, items, rule).collect()
        assert sorted((r.doc_id or -1, -1 if r.item_id is None else r.item_id, r.covered_words, r.n_tiles) for r in found) == [
            (-1, -1, 6, 1), (1, 0, 30, 1), (2, 1, 30, 2), (7, 3, 30, 1), (7, 3, 30, 1), (7, 4, 30, 1), (7, 4, 30, 1)]
        kept = drop_contaminated(docs, items, rule)
        assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 8]


def test_seed_bound_never_loses_an_item():
    pick, rule = random.Random(8), Tiling(min_tile=3, coverage=0.5)
    texts = [" ".join(f"v{pick.randint(0, 30)}" for _ in range(pick.randint(3, 25))) for _ in range(40)]
    block = Block(list(enumerate(texts)), rule)
    for _ in range(200):
        words = pick.choice(texts).split()
        pick.shuffle(words) if pick.random() < 0.2 else None
        text = " ".join(words[pick.randint(0, 5):] + [f"v{pick.randint(0, 40)}" for _ in range(20)])
        doc = np.array([block.vocabulary.get(w, 0) for w in text.split()])
        expected = {i for i, ids in zip(block.ids, block.items)
                    if sum(t[0] for t in brute(ids.tolist(), doc.tolist(), 3)) >= 0.5 * len(ids)}
        assert {leak[0] for leak in block.leaks(text)} == expected


def test_empty_sides(odd_docs, no_docs, items):
    assert contamination(no_docs, items).count() == 0
    assert contamination(odd_docs, items.limit(0)).count() == 0
    assert drop_contaminated(odd_docs, items.limit(0)).count() == odd_docs.count()
    assert drop_contaminated(odd_docs, items).columns == odd_docs.columns


def test_long_texts_of_one_word():
    """Matches are taken up where they begin on their diagonal, so equal words do not start one each."""
    rule = Tiling()
    block = Block([(0, "ha " * 200), (1, " ".join(f"w{i}" for i in range(40)))], rule)
    for n in (150, 200, 300_000):
        assert block.leaks("ha " * n) == [(0, 200, min(n, 200), 1, min(n, 200))]
    pieces = " - ".join(["ha " * 30 + f"z{i}" for i in range(2_000)])
    assert block.leaks(pieces) == [(0, 200, 200, 7, 30)]
