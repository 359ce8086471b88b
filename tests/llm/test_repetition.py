import random
import re
from collections import Counter

from colscope.llm.repetition import RepetitionRules, drop_repetitive, measure, repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, rules):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]

    def inside(n):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        counts = Counter(grams)
        return {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(n)}

    counts = Counter(lines)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(counts),
            len(inside(rules.window)), sum(len("".join(WORD.findall(x))) for x in lines if counts[x] > 1),
            *[sum(len(words[p]) for p in inside(n)) for n in sorted(rules.max_ngram_chars)]]


def test_measures_equal_brute_force():
    rules, pick = RepetitionRules(), random.Random(5)
    for _ in range(300):
        text = "".join(pick.choice(["a", "bc", "ü", "😀|", "#x"]) + pick.choice([" ", " ", " ", "\n", "\t ", "\n\n", "\x0b"])
                       for _ in range(pick.randint(0, 90)))
        assert measure(text, rules) == brute(text, rules)


def test_odd_rows(odd_docs):
    rows = repetition(odd_docs, keep=["doc_id"]).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_words == by_id[2].n_words == by_id[3].n_words == 0 and by_id[1].base_failed
    assert by_id[6].n_words == 30_000 and by_id[6].kept and by_id[4].kept
    assert by_id[9].word_chars == 12 * (3 + 1 + 1)


def test_filter_keeps_rows_and_columns_as_they_are(odd_docs, no_docs):
    kept = drop_repetitive(odd_docs)
    assert kept.schema == odd_docs.schema
    assert sorted((r.doc_id or 0, r.n_words or 0) for r in kept.collect()) == [(0, 0), (4, 5), (4, 5), (5, 6), (6, 7)]
    assert drop_repetitive(no_docs).count() == 0 and repetition(no_docs).count() == 0


def test_repeated_passages_and_lines_fail(spark):
    unique = " ".join(f"u{i}" for i in range(40))
    rows = [(1, unique), (2, " ".join([unique] * 2)), (3, "\n".join(["same line here now"] * 9 + [unique])),
            (4, unique + " " + " ".join(f"u{i}" for i in range(6)))]
    kept = {r.doc_id: (r.base_failed, r.kept) for r in repetition(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1: (False, True), 2: (True, False), 3: (True, False), 4: (False, True)}
