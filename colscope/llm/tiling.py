"""Benchmark decontamination by greedy string tiling.

The benchmark is the stated query set: it is cut into blocks of bounded size, and every document meets every block.  A
document and an item that share seeds, ``min_tile`` words in a row, are tiled: the longest matches of words that no
tile covers yet are marked first, found by running Karp-Rabin over ever shorter windows.  Tiles may lie in any order,
so a passage whose sentences were moved about is covered all the same.
"""

from __future__ import annotations

import heapq
import math
import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import annotate, named, on_workers, slices

_WORDS = re.compile(r"\w+")
_BASE = 0x9E3779B97F4A7C15
_BITS = 20


@dataclass(frozen=True)
class Tiling:
    """Words of the shortest tile, and the share of an item's words that tiles must cover."""

    min_tile: int = 4
    coverage: float = 0.5
    block_bytes: int = 8 << 20


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return _WORDS.findall((text or "").lower())


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(_BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))])
                                      for b in (_BASE, inverse))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``n`` ids."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = _powers.get(len(ids))
        spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        spread ^= spread >> np.uint64(32)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread * up)])
        return (sums[n:] - sums[:-n]) * down[:len(ids) - n + 1]


def _free(marked: np.ndarray, n: int) -> np.ndarray:
    """Which windows of ``n`` have no marked word."""
    sums = np.concatenate([[0], np.cumsum(marked)])
    return sums[n:] == sums[:-n]


def greedy_tiles(item: np.ndarray, doc: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """(length, item start, document start) of the tiles, longest first; word id 0 in ``doc`` matches nothing.

    Windows of s words are hashed on both sides; equal ones are extended to maximal matches, which are marked from the
    longest on.  What a mark leaves of a shorter match waits for its own turn.  Then s is halved, down to ``min_tile``.
    """
    used_item, used_doc = np.zeros(len(item), bool), doc == 0
    tiles = []
    size = max(min_tile, min(len(item), len(doc)))
    while True:
        for length, i, j in _matches(item, doc, used_item, used_doc, size):
            used_item[i:i + length] = used_doc[j:j + length] = True
            tiles.append((length, i, j))
        if size == min_tile:
            return tiles
        size = max(min_tile, size // 2)


def _matches(item, doc, used_item, used_doc, size):
    """Matches of ``size`` words or more, longest first; the caller marks each before it asks for the next."""
    if len(item) < size or len(doc) < size:
        return
    hashes, theirs = rolling(item, size), rolling(doc, size)
    ours = np.flatnonzero(_free(used_item, size))
    found = np.flatnonzero(_free(used_doc, size) & np.isin(theirs, hashes[ours]))
    found = found[np.argsort(theirs[found], kind="stable")]
    keys, queue = theirs[found], []
    for i in ours.tolist():
        j = found[np.searchsorted(keys, hashes[i]):np.searchsorted(keys, hashes[i], "right")]
        if i and not used_item[i - 1]:  # a match that began earlier on its diagonal is left to its beginning
            j = j[(j == 0) | used_doc[j - 1] | (doc[j - 1] != item[i - 1])]
        for at in j.tolist():
            n = _run(item, doc, used_item, used_doc, i, at, len(item))
            if n >= size:
                queue.append((-n, at, i))
    heapq.heapify(queue)
    while queue:
        n, j, i = heapq.heappop(queue)
        n = -n
        own = _run(item, doc, used_item, used_doc, i, j, n)
        if own == n:
            yield n, i, j
            if not _free(used_item, size).any():
                return
            continue
        k = 0
        while k < n:  # the parts that are still free wait with their own length
            own = _run(item, doc, used_item, used_doc, i + k, j + k, n - k)
            if own >= size:
                heapq.heappush(queue, (-own, j + k, i + k))
            k += max(own, 1)


def _run(item, doc, used_item, used_doc, i, j, most) -> int:
    """Length of the match of unused words from here on, ``most`` at most."""
    n = min(most, len(item) - i, len(doc) - j)
    bad = (item[i:i + n] != doc[j:j + n]) | used_item[i:i + n] | used_doc[j:j + n]
    stop = int(bad.argmax()) if n else 0
    return stop if n and bad[stop] else n


class Block:
    """Items of the benchmark and the seeds they hold."""

    def __init__(self, items: list[tuple], rule: Tiling):
        self.rule = rule
        self.vocabulary: dict[str, int] = {}
        self.ids, self.items = [], []
        seeds, owners, starts = [], [], []
        for number, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int64)
            if len(ids) >= rule.min_tile:
                seeds.append(rolling(ids, rule.min_tile))
                owners.append(np.full(len(seeds[-1]), len(self.items)))
                starts.append(np.arange(len(seeds[-1])))
                self.ids.append(number)
                self.items.append(ids)
        every = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.seeds, first = np.unique(every[order], return_index=True)
        self.cuts = np.append(first, len(every))
        self.owners = (np.concatenate(owners) if owners else np.empty(0, np.int64))[order]
        self.starts = (np.concatenate(starts) if starts else np.empty(0, np.int64))[order]
        self.likely = np.zeros(1 << _BITS, bool)
        self.likely[self.seeds >> np.uint64(64 - _BITS)] = True

    def candidates(self, doc: np.ndarray) -> list[int]:
        """Items whose words the document's seeds cover to the extent asked for, at most."""
        hashes = rolling(doc, self.rule.min_tile)
        hashes = np.unique(hashes[self.likely[hashes >> np.uint64(64 - _BITS)]])
        at = np.searchsorted(self.seeds, hashes)
        at = at[at < len(self.seeds)] if len(self.seeds) else at[:0]
        at = at[np.isin(self.seeds[at], hashes)]
        if not len(at):
            return []
        spots = np.concatenate([np.arange(self.cuts[a], self.cuts[a + 1]) for a in at])
        owner, start = self.owners[spots], self.starts[spots]
        order = np.lexsort((start, owner))
        owner, start = owner[order], start[order]
        step = np.full(len(owner), self.rule.min_tile)
        same = owner[1:] == owner[:-1]
        step[:-1][same] = np.minimum(self.rule.min_tile, start[1:][same] - start[:-1][same])
        firsts = np.flatnonzero(np.append(True, ~same))
        covered = np.add.reduceat(step, firsts)
        return [int(o) for o, n in zip(owner[firsts], covered) if n >= self.rule.coverage * len(self.items[o])]

    def leaks(self, text: str | None) -> list[tuple]:
        """(item, its words, words covered, tiles, longest tile) of each item that the text covers enough of."""
        words = words_of(text)
        if len(words) < self.rule.min_tile or not self.items:
            return []
        doc = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        out = []
        for k in self.candidates(doc):
            item = self.items[k]
            tiles = greedy_tiles(item, doc, self.rule.min_tile)
            covered = sum(n for n, _, _ in tiles)
            if tiles and covered >= self.rule.coverage * len(item):
                out.append((self.ids[k], len(item), covered, len(tiles), max(tiles)[0]))
        return out


def blocks(benchmark: DataFrame, rule: Tiling, id: str = "item_id", text: str = "text"):
    """The benchmark in blocks of about ``rule.block_bytes`` of text, one on the driver at a time."""
    own = benchmark.select(named(id).alias("id"), named(text).cast("string").alias("t")).filter("t is not null")
    total = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = max(1, math.ceil(total / rule.block_bytes))
    for k in range(count):
        part = own.filter(F.pmod(F.xxhash64("id", "t"), F.lit(count)) == k)
        yield Block([tuple(r) for r in part.collect()], rule)


def contamination(docs: DataFrame, benchmark: DataFrame, rule: Tiling | None = None, id: str = "doc_id",
                  text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, item_words, covered_words, n_tiles, longest_tile, coverage) of every leak.

    Null and empty texts leak nothing, nor do items of fewer than ``min_tile`` words; repeated documents or items are
    reported each, null ids stay null, other columns are not looked at, and an empty side gives no rows.
    """
    rule = rule or Tiling()
    item_kind = benchmark.schema[item].dataType
    schema = T.StructType([
        T.StructField("doc", docs.schema[id].dataType), T.StructField("item", item_kind),
        *T._parse_datatype_string("item_words long, covered_words long, n_tiles long, longest_tile long").fields])
    own = on_workers(docs.select(named(text).cast("string"), named(id)))
    item_arrow = to_arrow_schema(schema).field(1).type
    result = None
    for block in blocks(benchmark, rule, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                for part in slices(batch):
                    found = [(i, *leak) for i, t in enumerate(part.column(0).to_pylist()) for leak in shared.value.leaks(t)]
                    if found:
                        at, *columns = zip(*found)
                        kinds = [item_arrow, *[pa.int64()] * 4]
                        yield pa.RecordBatch.from_arrays(
                            [part.column(1).take(pa.array(at)), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                            schema.names)

        part = own.mapInArrow(run, schema)
        result = part if result is None else result.unionAll(part)
    return result.select(F.col("doc").alias(id), F.col("item").alias(item), "item_words", "covered_words", "n_tiles",
                         "longest_tile", (F.col("covered_words") / F.col("item_words")).alias("coverage"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rule: Tiling | None = None, text: str = "text",
                      item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that leak no item, with their own columns; rows stay where they are."""
    rule = rule or Tiling()
    row = F.struct(*[named(c) for c in docs.columns]).alias("row")
    kept = docs.select(row, named(text).cast("string").alias("text"))
    for block in blocks(benchmark, rule, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def leaks(texts, shared=shared):
            return [[bool(shared.value.leaks(t)) for t in texts]]

        kept = annotate(kept, "text", leaks, [T.StructField("leaks", T.BooleanType())]).filter("not leaks").drop("leaks")
    return kept.select("row.*")
