import random
import re
import zlib
from collections import Counter

from colscope.llm.variants import Spelling, letter_runs, nearest, variants


def near(a, b):
    """One code point inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    return any(a == b[:i] + b[i + 1:] for i in range(len(b))) if len(a) < len(b) else sum(x != y for x, y in zip(a, b)) == 1


def brute(counts, rule):
    counts = {w: n for w, n in counts.items() if w and n >= rule.least_count}
    form, number = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        number[w], form[w] = len(others), best if best and counts[best] >= rule.ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, number[w], form[w], counts.get(form[w]), root))
    return out


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def test_words_equal_brute_force(spark):
    for seed, letters in ((1, "ab"), (2, "abcé"), (3, "aß😀ÿ")):
        pick = random.Random(seed)
        words = {"".join(pick.choice(letters) for _ in range(pick.randrange(1, 7))) for _ in range(400)}
        counts = {w: int(10 ** pick.uniform(0, 5)) for w in words}
        for rule in (Spelling(), Spelling(ratio=2, least_count=1)):
            found = {tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root"))
                     for r in variants(table(spark, counts), rule).collect()}
            assert found == brute(counts, rule)


def test_long_chains_end_at_their_roots(spark):
    counts = {"a" * (i + 1): 2 ** (i + 1) for i in range(30)}
    found = {r.word: r.root for r in variants(table(spark, counts), Spelling(ratio=2)).collect()}
    assert set(found.values()) == {"a" * 30} and len(found) == 30


def test_groups_make_a_row_for_each_member(spark):
    """Words that all differ in one place make rows in proportion to their number, not to their pairs."""
    for m in (40, 80):
        words = {"abcdef" + chr(0x100 + i): 5 for i in range(m)}
        rotated = nearest(table(spark, words)).collect()
        assert {r.n_near for r in rotated} == {m - 1} and len(rotated) == m
        assert {r.best for r in rotated} == {"abcdefĀ", "abcdefā"}


def test_odd_words(spark):
    rows = [(None, 5, 1), ("", 5, 1), ("same", 3, 1), ("same", 4, 2), ("sane", 80, None), ("once", 1, 1), ("none", None, 1)]
    words = spark.createDataFrame(rows, "word string, n long, root int")
    assert {(r.word, r.n, r.form, r.root) for r in variants(words).collect()} == {("same", 7, "sane", "sane"), ("sane", 80, None, "sane")}
    assert variants(words.limit(0)).count() == 0


def test_runs_of_letters_equal_brute_force(spark, odd_docs, no_docs):
    pick = random.Random(4)
    rows = [(pick.choice([None, 1, 22, 333]), pick.choice([None, "", "".join(
        pick.choice("abcdefABÀÿ×÷ßé 1Ωﬁ-") * pick.choice([1, 1, 2]) for _ in range(200))])) for _ in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs, allowMissingColumns=True)
    expected = Counter()
    for r in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{low}".encode())
            low = low if h % 31 else low[:h % len(low)] + low[h % len(low) + 1:]
            if len(low) >= 7:
                expected[low] += 1
    found = {r.word: r.n for r in letter_runs(docs.repartition(5), Spelling(), damage=31).collect()}
    assert found == expected
    assert letter_runs(no_docs, Spelling()).count() == 0
