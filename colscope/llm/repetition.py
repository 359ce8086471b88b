"""Quality rules on repetition: characters inside repeated lines and repeated word n-grams.

N-grams are compared by rolling hashes: the hash of a window of n + 1 words is that of n words, times a base, plus
the next word, so all lengths come from one pass of numpy operations per length over the words of a text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, annotate, byte_words, named

# The symbols that are counted.
SYMBOLS = "#*$%&|<>"
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class RepetitionRules:
    """Limits in percent: of the words in repeated windows, and of the characters in repeated n-grams and lines.

    A line or sentence said twice stays below them; texts that go round in short circles do not.
    """

    min_words: int = 20
    window: int = 8
    max_window_words: int = 30
    max_ngram_chars: dict[int, int] = field(default_factory=lambda: {5: 45, 6: 44, 7: 43, 9: 41, 10: 40})
    max_line_chars: int = 40


def window_hashes(words: np.ndarray, lengths: list[int]):
    """(n, hashes of all windows of n words) for increasing ``lengths``."""
    rolled, n = words, 1
    with np.errstate(over="ignore"):
        for length in sorted(lengths):
            while n < length and n < len(words):
                rolled = rolled[:-1] * _BASE + words[n:]
                n += 1
            yield length, (rolled if n == length else rolled[:0])


def repeated(hashes: np.ndarray) -> np.ndarray:
    """For each position, whether its value occurs twice or more."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    same = ordered[1:] == ordered[:-1]
    out = np.zeros(len(hashes), dtype=bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside the windows of n that start where ``starts`` is set."""
    steps = np.zeros(words + 1, dtype=np.int64)
    steps[:len(starts)] += starts
    steps[n:n + len(starts)] -= starts
    return np.cumsum(steps[:-1]) > 0


def measure(text: str | None, rules: RepetitionRules) -> list[int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, then characters by n-gram length."""
    lengths = sorted(rules.max_ngram_chars)
    if not text:
        return [0] * (6 + len(lengths))
    words = byte_words(text)
    lines = Counter(line for line in text.split("\n") if line.strip(BLANKS))
    blanks = sum(text.count(c) for c in BLANKS)
    dup_lines = sum(n - 1 for n in lines.values())
    dup_line_chars = sum(n * (len(x) - sum(x.count(c) for c in BLANKS)) for x, n in lines.items() if n > 1) if dup_lines else 0
    repeat_words, chars, sizes = 0, dict.fromkeys(lengths, 0), None
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    for n, windows in window_hashes(hashes, sorted({*lengths, rules.window})):
        starts = repeated(windows)
        if not starts.any():
            break  # a longer window that repeats would hold a shorter one that does
        inside = covered(starts, n, len(words))
        if n == rules.window:
            repeat_words = int(inside.sum())
        if n in chars:
            if sizes is None:
                sizes = np.fromiter((len(w.decode()) for w in words), np.int64, len(words))
            chars[n] = int(sizes[inside].sum())
    return [len(words), len(text) - blanks, sum(text.count(c) for c in SYMBOLS), dup_lines, repeat_words, dup_line_chars,
            *chars.values()]


def repetition(docs: DataFrame, text: str = "text", rules: RepetitionRules | None = None,
               keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) with the measures, ``base_failed`` and ``kept``; rows stay where they are.

    A null or empty text has no words and fails.  Repeated rows are judged alike, other nulls pass through, a
    column with the name of a measure is replaced, and an empty table stays empty.  One text at a time is held.
    """
    rules = rules or RepetitionRules()
    lengths = sorted(rules.max_ngram_chars)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars",
             *[f"dup_{n}gram_chars" for n in lengths]]
    fields = [T.StructField(n, T.LongType()) for n in names]

    def make(texts):
        return list(zip(*[measure(t, rules) for t in texts])) or [[] for _ in names]

    measured = annotate(docs, text, make, fields, keep)
    failed = ((F.col("n_words") < rules.min_words)
              | (100 * F.col("n_repeat_words") > rules.max_window_words * F.col("n_words")))
    verdict = ~failed & (100 * F.col("dup_line_chars") <= rules.max_line_chars * F.col("word_chars"))
    for n in lengths:
        verdict &= 100 * F.col(f"dup_{n}gram_chars") <= rules.max_ngram_chars[n] * F.col("word_chars")
    return measured.withColumn("base_failed", failed).withColumn("kept", verdict)


def drop_repetitive(docs: DataFrame, text: str = "text", rules: RepetitionRules | None = None) -> DataFrame:
    """The rows that ``repetition`` keeps, with their own columns whatever their names."""
    packed = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), named(text).alias("text"))
    return repetition(packed, "text", rules, ["row"]).filter("kept").select("row.*")
