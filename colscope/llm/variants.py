"""Spelling variants by permuterm rotations.

A word with a terminator is rotated so that the character to be edited comes last.  Words that differ by that
character alone then share all of the rotation before it, and a word that lacks the character is the whole rotation of
itself.  So the rotations that begin alike, sorted, are one group per gap: at most one word for each character of the
alphabet, and one without.  A scan of the sorted rotations gives each member its number of neighbours and the best of
them from the two best of the group, so no pairs are made.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, named, on_workers, written

END = "\0"


@dataclass(frozen=True)
class Spelling:
    """Which words are compared, and how many times more frequent a form must be."""

    least_length: int = 7
    least_count: int = 2
    ratio: int = 10


def letter_runs(docs: DataFrame, rule: Spelling, id: str = "doc_id", text: str = "text",
                damage: int | None = None) -> DataFrame:
    """(word, n): runs of Latin letters with A-Z in lower case, of the least length, and how often they occur.

    With ``damage``, the CRC-32 of ``<id>:<run>`` decides which code point a run loses where ``damage`` divides it.
    A null id is empty text, a null text has no runs, and repeated rows count each.  Words are counted in each task
    before the shuffle.
    """
    least = rule.least_length
    runs = re.compile(rf"[A-Za-zÀ-ÿ]{{{least},}}")

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for id_, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = Counter(runs.findall(t or ""))
                start = zlib.crc32(f"{id_ or ''}:".encode())
                for word, n in own.items():
                    low = word.encode().translate(LOWER)
                    if damage:
                        h = zlib.crc32(low, start)
                        if h % damage == 0:
                            if len(word) == least:
                                continue
                            at, whole = h % len(word), low.decode()
                            low = (whole[:at] + whole[at + 1:]).encode()
                    total[low] += n
                if len(total) > 300_000:
                    yield _counted(total)
                    total = Counter()
        if total:
            yield _counted(total)

    own = on_workers(docs.select(named(id).cast("string"), named(text).cast("string")))
    return own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: Counter) -> pa.RecordBatch:
    words = pa.array(counts.keys(), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "n"])


def _rotations(batches) -> Iterator[pa.RecordBatch]:
    """(k, c, n): rotations without their last character ``c``, and whole rotations, for which ``c`` is null."""
    for batch in batches:
        for start in range(0, batch.num_rows, 20_000):
            part = batch.slice(start, 20_000)
            keys, last, counts = [], [], []
            for word, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                size = len(word)
                round_ = word + END + word
                # The rotation that begins after place i, up to what stands before i.
                keys += [round_[i + 1:i + 1 + size] for i in range(size)]
                last += word
                keys += [round_[i:i + 1 + size] for i in range(size + 1)]
                last += [None] * (size + 1)
                counts.append(2 * size + 1)
            n = np.repeat(part.column(1).to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(last, pa.string()), pa.array(n)],
                                             ["k", "c", "n"])


def _better(a: tuple | None, b: tuple | None) -> tuple | None:
    """The word of larger count, or the smaller word; entries are (-count, word)."""
    return b if a is None or (b is not None and b < a) else a


def _group(key: str, members: list[tuple[str | None, int]]) -> Iterator[tuple]:
    """(word, neighbours, their best) of every member of the group of one gap."""
    after, before = key.split(END)
    without, words = None, []
    for c, n in members:
        if c is None:
            without = (-n, before + after)
        else:
            # Of equal letters side by side only the last counts as the one to leave out, so no pair counts twice.
            words.append((-n, before + c + after, not after.startswith(c)))
    words.sort()
    if without:
        out = [w for w in words if w[2]]
        if out:
            yield without[1], len(out), out[0][:2]
    for i, (_, word, leaves) in enumerate(words):
        best = words[i == 0][:2] if len(words) > 1 else None
        near = len(words) - 1
        if leaves and without:
            best, near = _better(best, without), near + 1
        if near:
            yield word, near, best


def _scan(batches) -> Iterator[pa.RecordBatch]:
    """Neighbours from rotations that come sorted; a group may go on in the next batch."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]).combine_chunks()
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        k = table.column(0).chunk(0)
        new = np.append(True, pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False))
        starts = np.flatnonzero(new)
        yield from _neighbours(table.slice(0, int(starts[-1])), starts)
        rest = table.slice(int(starts[-1]))
    if rest is not None:
        yield from _neighbours(rest, np.zeros(1, np.int64))


def _neighbours(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    starts = starts[starts < table.num_rows]
    sizes = np.diff(np.append(starts, table.num_rows))
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    if not len(starts):
        return
    rows = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    some = table.take(pa.array(rows))
    keys = table.column(0).take(pa.array(starts)).to_pylist()
    members = list(zip(some.column(1).to_pylist(), some.column(2).to_pylist()))
    found, at = [], 0
    for key, size in zip(keys, sizes.tolist()):
        found += _group(key, members[at:at + size])
        at += size
    if found:
        word, near, best = zip(*found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(word, pa.string()), pa.array(near, pa.int64()), pa.array([n for n, _ in best], pa.int64()),
             pa.array([w for _, w in best], pa.string())], ["word", "near", "less", "best"])


def nearest(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best, best_n) for distinct words: neighbours by one edit, and the most frequent of them."""
    rotated = on_workers(words.select("word", "n")).mapInArrow(_rotations, "k string, c string, n long")
    found = rotated.repartition("k").sortWithinPartitions("k").mapInArrow(
        _scan, "word string, near long, less long, best string")
    own = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("less"),
                       F.lit(None).cast("string").alias("best"))
    best = F.when(F.col("best").isNotNull(), F.struct("less", "best"))
    all_ = own.unionByName(found, allowMissingColumns=True).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min(best).alias("b"))
    return all_.select("word", "n", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def variants(words: DataFrame, rule: Spelling | None = None) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for the rows of ``words`` (word, n) of the least count.

    Words are near if they differ by one inserted, deleted or replaced code point.  The form is the most frequent near
    word, the smaller one of equals, if it is ``ratio`` times as frequent; the root is where forms of forms end.
    Null and empty words are left out, rows of the same word are added up, other columns are not looked at, and no
    words give no rows.  Words hold no U+0000.
    """
    rule = rule or Spelling()
    words = words.filter("length(word) > 0").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= rule.least_count)
    words = written(words, "words")
    near = nearest(words)
    given = F.col("best_n") >= rule.ratio * F.col("n")
    judged = written(near.select("word", "n", "n_near", F.when(given, F.col("best")).alias("form"),
                                 F.when(given, F.col("best_n")).alias("form_n")), "forms")
    # Counts grow by the ratio with every form, which bounds the steps from a word to its root; each round doubles them.
    most = words.agg(F.max("n")).first()[0] or 1
    steps = math.ceil(math.log(most, rule.ratio)) + 1 if rule.ratio > 1 else most
    roots = judged.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        roots = written(roots, "roots")
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return judged.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
