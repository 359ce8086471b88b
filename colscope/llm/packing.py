"""Best-fit packing of token pieces into sequences by hierarchical residual packing.

Groups of pieces are packed by best fit, each in its own task.  Bins that are nearly full leave; the others become
items of the next round, in which a few groups are merged into one, up to the root of that tree.  Few bins are left
after each round, so only pieces of underfull bins move again.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, on_workers, slices, written

END = "<|endoftext|>"
_CACHE = 400_000
_TOGETHER = 10_000
# What byte-level vocabularies write for a space and a line feed.
_BLANK_BYTES = ("\u0120", "\u010a")


class Encoder:
    """Token ids of texts.  Ids of space-separated parts are kept, as the tokenizer never looks across such a space.

    That holds where a single space or line feed stands between two characters that are not blank.  Any other text is
    given to the tokenizer as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes | None] = {}
        self.mark = self.tokenizer.token_to_id(END)
        self.feed = len(self._whole("\n"))
        self.starts = self._starts()

    def _starts(self) -> np.ndarray | None:
        """Which ids begin with a space or line feed, if the tokenizer works on bytes and leaves them as they are."""
        from tokenizers.pre_tokenizers import ByteLevel

        if self.tokenizer.normalizer is not None or not isinstance(self.tokenizer.pre_tokenizer, ByteLevel):
            return None
        vocabulary = self.tokenizer.get_vocab()
        starts = np.zeros(max(vocabulary.values()) + 1, bool)
        starts[[i for token, i in vocabulary.items() if token[:1] in _BLANK_BYTES]] = True
        return starts

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype="<u4").tobytes()

    def _learn(self, parts: list[str]) -> None:
        plain = []
        for p in parts:
            core = p[1:] if p[:1] == "\n" else p
            if not core or core[0].isspace() or core[-1].isspace():
                self.known[p] = None
            elif END in p:
                self.known[p] = self._whole(p if p[0] == "\n" else " " + p)
            else:
                plain.append(p)
        for i in range(0, len(plain), _TOGETHER):
            some = plain[i:i + _TOGETHER]
            self.known.update(zip(some, self._apart([p if p[0] == "\n" else " " + p for p in some])))

    def _apart(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; every one begins with a space or line feed and has no other.

        They are encoded as one text.  If as many ids begin with such a character as there are texts, each text begins
        an id; otherwise marks are put between them.
        """
        if self.starts is not None:
            raw = self._whole("".join(texts))
            cuts = np.flatnonzero(self.starts[np.frombuffer(raw, "<u4")])
            if len(cuts) == len(texts):
                bounds = [*(4 * cuts).tolist(), len(raw)]
                return [raw[a:b] for a, b in zip(bounds, bounds[1:])]
        if self.mark is None:
            return [self._whole(t) for t in texts]
        raw = self._whole(END.join(texts))
        joined = np.frombuffer(raw, "<u4")
        cuts = [-1, *np.flatnonzero(joined == self.mark).tolist(), len(joined)]
        return [raw[4 * a + 4:4 * b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; null is the empty text."""
        parts = [("\n" + t.replace("\n", " \n")).split(" ") if t else [] for t in texts]
        new = list(set().union(*parts).difference(self.known)) if parts else []
        self._learn(new)
        out = []
        for text, own in zip(texts, parts):
            ids = list(map(self.known.__getitem__, own))
            out.append(b"".join(ids)[self.feed:] if None not in ids else self._whole(text))
        if len(self.known) > _CACHE:
            for p in new:
                del self.known[p]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", capacity: int = 2048,
                 end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document's ids followed by ``end_id``.

    Only documents longer than ``capacity`` are cut, the first piece taking what is over.  Null and empty texts give
    one piece of the end alone.  Repeated rows are documents of their own, a null id stays null, other columns are not
    looked at, and no rows give no rows.  ``tokenizer`` is the path of a tokenizer file on every machine.
    """
    kind = docs.schema[id].dataType
    fields = [T.StructField("id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                for i, ids in enumerate(encoder(tokenizer).encode(part.column(0).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    for k, stop in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                        start = max(0, stop - capacity)
                        own = ids[4 * start:4 * stop]
                        rows.append((i, k, start, stop - start, zlib.crc32(own), own))
                at, piece, start, length, crc, own = zip(*rows)
                columns = [part.column(1).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array(own, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    cuts = on_workers(docs.select(named(text).cast("string"), named(id))).mapInArrow(cut, T.StructType(fields))
    return cuts.withColumnRenamed("id", id)


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size, in the order given, and the fill of each bin.

    The bin with the least room that is enough is found as the lowest bit of a number whose bit r says that some bin
    has room r.
    """
    bins, offsets, fill = [], [], []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for size in sizes:
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            own, room = len(fill), capacity
            fill.append(0)
        bins.append(own)
        offsets.append(fill[own])
        fill[own] += size
        if room > size:
            by_room[room - size].append(own)
            rooms |= 1 << (room - size)
    return bins, offsets, fill


def _round(items: DataFrame, level: int, capacity: int, slack: int) -> DataFrame:
    """Each group's units packed into bins: their rows with the bin as unit, and whether the bin leaves."""
    schema = T.StructType([*items.schema.fields, T.StructField("done", T.BooleanType())])
    arrow = ("group", "unit", "at", "fill")

    def pack(table: pa.Table) -> pa.Table:
        group, unit, at, fill = (table.column(c).to_numpy() for c in arrow)
        units, first, back = np.unique(unit, return_index=True, return_inverse=True)
        order = np.lexsort((units, -fill[first]))
        bins, offsets, fills = best_fit(fill[first][order].tolist(), capacity)
        bin_of, offset_of = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
        bin_of[order], offset_of[order] = bins, offsets
        own = bin_of[back]
        filled = np.array(fills)[own]
        columns = [table.column("row").combine_chunks(), pa.array(group),
                   pa.array((np.int64(level) << np.int64(56)) + (group << np.int64(24)) + own),
                   pa.array(at + offset_of[back]), pa.array(filled), pa.array(filled >= capacity - slack)]
        return pa.Table.from_arrays(columns, schema.names)

    return on_workers(items).groupBy("group").applyInArrow(pack, schema)


def pack(pieces: DataFrame, length: str = "length", capacity: int = 2048, slack: int = 16, per_group: int = 16_384,
         fan_in: int = 8) -> DataFrame:
    """``pieces`` with sequence_id and offset (both replaced if there), gapless from 0 within each sequence.

    Every length must lie between 1 and ``capacity``.  Equal lengths are packed in a fixed order, repeated rows are
    separate items, and an empty table stays empty.  A task holds at most about ``per_group`` units of a round.
    """
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    row = F.struct(*[named(c) for c in keep]).alias("row")
    items = written(pieces.select(row, named(length).cast("long").alias("fill")), "pieces")
    # The written table is read in a fixed order, so these numbers are the same whenever a task is run again.
    items = items.withColumn("unit", F.monotonically_increasing_id()).withColumn("at", F.lit(0).cast("long"))
    full = items.filter(F.col("fill") == capacity).select("row", "unit", "at")
    units = items.filter(F.col("fill") < capacity).count()
    groups = max(1, math.ceil(units / per_group))
    items = items.filter(F.col("fill") < capacity).select(
        "row", F.pmod(F.xxhash64("unit"), F.lit(groups)).alias("group"), "unit", "at", "fill")
    parts, level = [full], 1
    while True:
        packed = written(_round(items, level, capacity, slack), f"packed-{level}")
        if groups == 1:
            parts.append(packed.select("row", "unit", "at"))
            break
        left = packed.filter(~F.col("done"))
        before, units = units, left.select("unit").distinct().count()
        following = max(1, math.ceil(units / per_group), math.ceil(groups / fan_in))
        if following >= groups and units >= before:  # nothing merges any more
            parts.append(packed.select("row", "unit", "at"))
            break
        parts.append(packed.filter("done").select("row", "unit", "at"))
        items = left.select("row", F.floor(F.col("group") * following / groups).alias("group"), "unit", "at", "fill")
        groups, level = following, level + 1
    result = parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return result.select("row.*", F.col("unit").alias("sequence_id"), F.col("at").alias("offset"))


def sequences(packed: DataFrame, piece: str = "ids") -> DataFrame:
    """(sequence_id, ids) with the pieces of each sequence put together; a sequence has ``capacity`` ids at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", named(piece).alias("ids"))))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
