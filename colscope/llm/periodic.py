"""Periodic runs of words by seeds that are extended along diagonals.

A run of period q matches itself at lag q over ``max(least - q, q)`` words or more, so for lags in [k, 2k) equal k-grams
are its seeds, with k doubling from half the least length.  K-grams get exact names, pairs of names of half the length.

Not all pairs of equal k-grams are looked at.  Where a k-gram occurs again within k / 2 words, the text goes round in
that smaller circle; if each k-gram of a run did so, the smaller circle would be its period (theorem of Fine and Wilf).
So some k-gram of each run is alone for k / 2 words, and only those are paired with the occurrences in [k, 2k) after
them: at most two pairs end at any word.  Lags below the first k are those of neighbouring occurrences, by the same
theorem.  Seeds inside what the extension of an earlier one covered at their lag are not extended again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import named, on_workers, slices

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@dataclass(frozen=True)
class Periodicity:
    """A run has ``least`` words or more, and two periods or more."""

    least: int = 12


def _paired(names: np.ndarray, shift: int) -> np.ndarray:
    """Names of the grams made of the gram at i and the one at i + shift; -1 where a gram occurs once only."""
    out = np.full(max(0, len(names) - shift), -1, np.int64)
    at = np.flatnonzero((names[:len(out)] >= 0) & (names[shift:] >= 0))
    if not len(at):
        return out
    _, own, counts = np.unique(names[at] * (names.max() + 1) + names[at + shift], return_inverse=True, return_counts=True)
    out[at] = np.where(counts[own] > 1, own, -1)
    return out


def _seeds(names: np.ndarray, k: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of the pairs of equal k-grams to extend; ``first`` adds the lags below k."""
    at = np.flatnonzero(names >= 0)
    at = at[np.argsort(names[at], kind="stable")]
    key = names[at] * (len(names) + 2 * k + 1) + at  # ascending, further apart between names than any lag
    gap = np.append(np.where(names[at[1:]] == names[at[:-1]], at[1:] - at[:-1], 2 * k), 2 * k)[:len(at)]
    alone = np.flatnonzero(2 * gap > k)
    low, high = np.searchsorted(key, key[alone] + k), np.searchsorted(key, key[alone] + 2 * k)
    counts = high - low
    others = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    place = np.repeat(at[alone], counts)
    lag = at[others] - place
    if first:
        near = np.flatnonzero(gap < k)
        place, lag = np.append(place, at[near]), np.append(lag, gap[near])
    order = np.lexsort((place, lag))
    return place[order], lag[order]


def _matching(words: np.ndarray, place: int, lag: int) -> int:
    """The first place from ``place`` on whose word differs from the one ``lag`` words later."""
    step, stop = 64, len(words) - lag
    while place < stop:
        wrong = words[place:min(place + step, stop)] != words[place + lag:min(place + step, stop) + lag]
        if wrong.any():
            return place + int(wrong.argmax())
        place, step = place + len(wrong), 2 * step
    return stop


def _matching_back(words: np.ndarray, place: int, lag: int) -> int:
    """The first of the places that match ``lag`` words later, without a gap, up to ``place``."""
    step = 64
    while place > 0:
        low = max(0, place - step)
        wrong = words[low:place] != words[low + lag:place + lag]
        if wrong.any():
            return low + len(wrong) - int(wrong[::-1].argmax())
        place, step = low, 2 * step
    return 0


def runs_of(words: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run in a sequence of word numbers, in order."""
    k = (least + 1) // 2
    names, size = _paired(words, 0), 1
    while 2 * size <= k:
        names, size = _paired(names, size), 2 * size
    if size < k:
        names = _paired(names, k - size)
    found: dict[tuple[int, int], int] = {}
    first = True
    while len(names) and names.max() >= 0:
        place, lag = _seeds(names, k, first)
        # Seeds side by side at one lag are one.
        new = np.ones(len(place), bool)
        new[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(place)) - 1
        covered: dict[int, int] = {}  # lag -> how far it has been compared
        for p, e, q in zip(place[starts].tolist(), place[ends[:len(starts)]].tolist(), lag[starts].tolist()):
            if p < covered.get(q, 0):
                continue
            stop = covered[q] = _matching(words, e + k, q)
            start = _matching_back(words, p, q)
            if stop - start >= max(least - q, q):
                own = (start, stop - start + q)
                found[own] = min(q, found.get(own, q))
        names, k, first = _paired(names, k), 2 * k, False
    return sorted((s, n, q) for (s, n), q in found.items())


def _documents(texts: list[str | None], least: int) -> Iterator[tuple[int, list, str]]:
    """(words, runs, collapsed text) of each text; all texts are searched as one sequence of words of their own."""
    split = [(t or "").encode().split() for t in texts]
    numbers: dict[tuple, int] = {}
    words = np.fromiter((numbers.setdefault((i, w), len(numbers)) for i, own in enumerate(split) for w in own),
                        np.int64, sum(map(len, split)))
    found = runs_of(words, least)
    start = at = 0
    for own in split:
        mine = []
        while at < len(found) and found[at][0] < start + len(own):
            mine.append((found[at][0] - start, *found[at][1:]))
            at += 1
        kept = own
        if mine:
            steps = np.zeros(len(own) + 1, np.int64)
            for s, n, q in mine:
                steps[s + q] += 1
                steps[s + n] -= 1
            kept = [own[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
        yield len(own), mine, b" ".join(kept).decode()
        start += len(own)


def periodic_runs(docs: DataFrame, text: str = "text", rule: Periodicity | None = None,
                  keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default), ``n_words``, ``runs`` (start, length, period) in order, and ``collapsed``.

    The collapsed text has no word that a run holds after its first period; its words are joined by one space.  A null
    or empty text has no words, no runs and an empty collapsed text.  Repeated rows are searched alike, other nulls
    pass through, a column with the name of a new one gives way, and no rows give no rows.  Rows stay where they are;
    about a megabyte of texts, or one longer text, is held at a time, with memory in proportion to its words.
    """
    least = (rule or Periodicity()).least
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "runs", "collapsed")]
    inner = docs.select(named(text).cast("string").alias("t"), *[named(c).alias(f"c{i}") for i, c in enumerate(keep)])
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    schema = T.StructType([T.StructField(f"c{i}", kinds[c]) for i, c in enumerate(keep)])
    schema = schema.add("n_words", T.LongType()).add("runs", T.ArrayType(RUN)).add("collapsed", T.StringType())

    def run(batches):
        for batch in batches:
            for part in slices(batch, most_bytes=1 << 20):
                n, runs, collapsed = zip(*_documents(part.column(0).to_pylist(), least))
                runs = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(n, pa.int64()), pa.array(runs, pa.list_(_RUN)),
                     pa.array(collapsed, pa.string())], schema.names)

    return on_workers(inner).mapInArrow(run, schema).toDF(*keep, "n_words", "runs", "collapsed")
