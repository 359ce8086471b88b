"""N-gram Jaccard join by vertical partitioning.

The order of n-grams is that of their 64-bit fingerprints, and cutting it into ranges cuts every set into fragments.

1. *Candidates.* Sets of similar sizes that differ in at most D n-grams agree in at least one of D + 1 fragments, so
   sets are filed under the fingerprint of each fragment.  In each file one set, the one whose fragments are the most
   common, is the hub, and only pairs of hub and member go on: a number linear in the members, however large a group.
   Some fragments are spare, so linked sets agree in several, and each set leaves as many of its most crowded files as
   it can without losing one of them: passages that many sets share crowd few files, and these are the ones left.
2. *Counting.* The overlap of a pair is counted fragment by fragment and summed per pair; what differs is kept.
3. *Pairs of members.* Two members x and y of a hub differ in the symmetric difference of their differences X and Y
   from it.  Members that links with hubs connect need no link of their own.  Of two others at most one is linked to
   the hub, and a link needs about half of X and Y to be shared: the first shared element in the order of rarity has so
   many elements behind it in both.  Pairs with such an element are checked, once however many hubs they share.

So no link between different texts that could change a component is lost.  Files make no pairs of their members; step 3
makes those that share an element with enough behind it.  Two large groups of near copies that are apart from each other
by little more than the rule allows, in the same places, still make all pairs between them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, annotate, emptied, named, on_workers, slices, written

FRAGMENTS = 8
_CLASSES = 8  # a mark's low bits tell its class of sizes among the few neighbouring ones that a set is filed in
_PASSES = 4
MAX_BROADCAST_ROWS = 1_000_000
_KNOWN_WORDS = 300_000
# Odd multipliers and the finaliser of splitmix64.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


@dataclass(frozen=True)
class Jaccard:
    """Word n-grams and the least similarity, ``num / den``."""

    words: int = 3
    num: int = 90
    den: int = 100

    def most_different(self, total):
        """Largest symmetric difference of linked sets whose sizes sum to ``total``."""
        return total * (self.den - self.num) // (self.den + self.num)

    def most_apart(self, total: Column) -> Column:
        """``most_different`` of a column, not yet rounded down."""
        return total * (self.den - self.num) / (self.den + self.num)

    def classes(self, n: int) -> list[tuple[int, int]]:
        """(class of sizes, its largest size) for all classes in which a set of ``n`` has linked ones."""
        out, low, k = [], 1, 0
        while low * self.num <= n * self.den:
            high = max(low, low * 3 // 2)
            if n <= high:
                out.append((k, high))
            low, k = high + 1, k + 1
        return out

    def files(self, n: int) -> list[tuple[int, int, int]]:
        """(class of sizes, fragments, spare ones) that a set of ``n`` is filed in; linked sets always meet in one."""
        each = [(k, self.most_different(2 * high)) for k, high in self.classes(n)]
        return [(k, most + 1 + most // 4, most // 4) for k, most in each if most]  # else only equal sets are linked

    def reach(self, n: int, high: int) -> int:
        """Largest difference of a set of ``n`` from linked ones of at most ``high``.

        Linked sets differ in no more fragments than this.  So a set with more full ones agrees in a full one with each
        of them, and need not be filed under empty ones, which sets agree in that have nothing in common.
        """
        return self.most_different(n + min(high, n * self.den // self.num))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Fingerprints of words, remembered up to a limit."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < _KNOWN_WORDS:
            self[word] = value
        return value


_words = _Words()


def ngrams(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct fingerprints of the word ``k``-grams of a text; a shorter text is one n-gram, an empty one none."""
    words = (text or "").encode().translate(LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    with np.errstate(over="ignore"):
        if n < k:
            return _mixed(np.array([(h * _ODD[:n]).sum() + np.uint64(n)], np.uint64))
        total = h[:n - k + 1] * _ODD[0]
        for j in range(1, k):
            total += h[j:n - k + 1 + j] * _ODD[j]
        return np.unique(_mixed(total))


def set_digest(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that are equal for equal sets."""
    with np.errstate(over="ignore"):
        a, b = _mixed(grams ^ _ODD[3]).sum(dtype=np.uint64), _mixed(grams + _ODD[4]).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def fragment_marks(grams: np.ndarray, rule: Jaccard) -> tuple[np.ndarray, list[int]]:
    """Fingerprints of the fragments a set is filed under, and by class how many of them it may leave.

    A linked set agrees in all but ``reach`` of the full fragments.  If both leave less than half of the others, one is
    left that both keep.  Sets filed under empty fragments leave none, as others need not be filed there.
    """
    out, spare = [], [0] * _CLASSES
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(grams ^ _ODD[5]))])
        highs = dict(rule.classes(len(grams)))
        for k, parts, _ in rule.files(len(grams)):
            at = ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            cuts = np.searchsorted(at, np.arange(parts + 1, dtype=np.uint64))
            place = np.arange(parts, dtype=np.uint64) * _ODD[6] + np.uint64(k) * _ODD[7]
            marks, full = _mixed(sums[cuts[1:]] - sums[cuts[:-1]] + place), cuts[1:] > cuts[:-1]
            reach = rule.reach(len(grams), highs[k])
            if full.sum() > reach:
                marks, spare[k % _CLASSES] = marks[full], int(full.sum() - reach - 1) // 2
            out.append(marks & ~np.uint64(_CLASSES - 1) | np.uint64(k % _CLASSES))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64), spare


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def described(docs: DataFrame, rule: Jaccard, id: str, text: str, marks: bool) -> DataFrame:
    """(id, n, a, b[, marks, spare]) of every row: size and digest of its set, what it is filed under and may leave."""
    fields = [T.StructField("id", docs.schema[id].dataType), T.StructField("n", T.LongType()),
              T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]
    if marks:
        fields.append(T.StructField("marks", T.ArrayType(T.LongType())))
        fields.append(T.StructField("spare", T.ArrayType(T.IntegerType())))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = [ngrams(t, rule.words) for t in part.column(0).to_pylist()]
                digests = [set_digest(s) for s in sets]
                columns = [part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                           pa.array([a for a, _ in digests], pa.int64()), pa.array([b for _, b in digests], pa.int64())]
                if marks:
                    filed = [fragment_marks(s, rule) for s in sets]
                    columns += [_lists([m for m, _ in filed]), pa.array([s for _, s in filed], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    own = docs.select(named(text).cast("string").alias("t"), named(id).alias("id"))
    return on_workers(own).mapInArrow(run, T.StructType(fields))


def _files(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(mark, c, size) of all files with two classes or more, without the most crowded ones that classes may leave.

    Classes leave marks in one order, so the last in it that two of them share is kept by both even if each leaves twice
    the number that it may leave in any order: all but one of those they share.  Most marks are those of one class, so
    they are dealt out in ``_PASSES`` parts, of which one at a time is shuffled.
    """
    own = classes.select("c").hint("merge")
    parts = []
    for i in range(_PASSES):
        some = F.filter("marks", lambda mark: F.pmod(F.shiftright(mark, _CLASSES.bit_length() - 1), F.lit(_PASSES)) == i)
        part = sets.select(F.col("r").alias("c"), some.alias("marks")).join(own, "c", "left_semi")
        part = part.select(F.explode("marks").alias("mark"), "c")
        part = part.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("mark"))).filter(F.col("size") > 1)
        parts.append(written(part, "filed"))
    filed = reduce(DataFrame.unionAll, parts)
    spare = sets.select(F.col("r").alias("c"), "spare").join(own, "c", "left_semi")
    kind = F.pmod("mark", F.lit(_CLASSES)).cast("int")
    crowded = Window.partitionBy("c", "kind").orderBy(F.desc("size"), "mark")
    ranked = filed.withColumn("kind", kind).withColumn("rank", F.row_number().over(crowded))
    kept = ranked.join(spare, "c").filter(F.col("rank") > 2 * F.col("spare")[F.col("kind")])
    kept = written(kept.select("mark", "c", "size"), "files")
    for part in parts:
        emptied(part)
    return kept


def _hub_pairs(files: DataFrame) -> DataFrame:
    """(hub, c): in each file, its hub with every other class; a pair once."""
    common = files.groupBy("c").agg(F.sum("size").alias("score"))
    scored = files.join(common, "c")
    hubs = scored.groupBy("mark").agg(F.max(F.struct("score", "c")).alias("top")).select("mark", F.col("top.c").alias("hub"))
    return scored.join(hubs, "mark").filter(F.col("c") != F.col("hub")).select("hub", "c").distinct()


def _fragments(docs: DataFrame, wanted: DataFrame, rule: Jaccard, id: str, text: str) -> DataFrame:
    """(c, f, grams): the sets of the ``wanted`` (c, id, a, b) cut into ``FRAGMENTS`` ranges, empty ones left out."""
    if wanted.count() <= MAX_BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    own = docs.select(named(text).cast("string").alias("t"), named(id).alias("own"))
    own = own.join(wanted, F.col("own").eqNullSafe(F.col("id"))).select("t", "c", "a", "b")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                c, f, grams = [], [], []
                for t, number, a, b in zip(*[x.to_pylist() for x in part.columns]):
                    own = ngrams(t, rule.words)
                    if set_digest(own) != (a, b):
                        continue  # another text of the same id
                    cuts = np.searchsorted(own, np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(61))
                    for k, piece in enumerate(np.split(own, cuts)):
                        if len(piece):
                            c.append(number), f.append(k), grams.append(piece)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(f, pa.int32()), _lists(grams)],
                                                 ["c", "f", "grams"])

    return on_workers(own).mapInArrow(run, "c long, f int, grams array<long>").dropDuplicates(["c", "f"])


def _counted(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """(hub, c, f, common, other): the overlap of each pair in each fragment, and the n-grams that only one has."""
    every = pairs.select("hub", "c", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("f"))
    mine = fragments.withColumnRenamed("grams", "x")
    theirs = fragments.select(F.col("c").alias("hub"), "f", F.col("grams").alias("y"))
    both = every.join(mine, ["c", "f"], "left").join(theirs, ["hub", "f"], "left")
    none = F.array().cast("array<bigint>")
    both = both.select("hub", "c", "f", F.coalesce("x", none).alias("x"), F.coalesce("y", none).alias("y"))
    return both.select("hub", "c", "f", F.size(F.array_intersect("x", "y")).alias("common"),
                       F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("other"))


def _linked(overlap: Column, total: Column, rule: Jaccard) -> Column:
    return rule.den * overlap >= rule.num * (total - overlap)


def _member_links(differences: DataFrame, rule: Jaccard) -> DataFrame:
    """(u, v) links between members of one hub that links with hubs do not connect.

    ``differences`` has hub, hub_n, c, n, d (size of the difference), other (its n-grams) and linked.  Of two members in
    different components at most one is linked to their hub.
    """
    roots = components(differences.filter("linked"), "hub", "c")
    known = differences.select("hub", "hub_n", "c", "n", "d", "linked").join(roots.toDF("c", "root"), "c", "left")
    known = written(known.withColumn("root", F.coalesce("root", "c")), "members")
    apart = F.min("root") != F.max("root")
    open_hubs = written(known.groupBy("hub").agg(apart.alias("apart")).filter("apart").select("hub"), "open-hubs")
    few = open_hubs.count() <= MAX_BROADCAST_ROWS
    members = differences.join(F.broadcast(open_hubs) if few else open_hubs, "hub", "left_semi")
    each = members.select("hub", "c", F.explode("other").alias("g"))
    seen = each.withColumn("seen", F.count(F.lit(1)).over(Window.partitionBy("hub", "g"))).filter(F.col("seen") > 1)
    # N-grams in order of their members; those of one member come first and meet nobody.
    own = Window.partitionBy("hub", "c")
    ranked = seen.join(known, ["hub", "c"]).withColumn("own", F.count(F.lit(1)).over(own))
    ranked = ranked.withColumn("rank", F.col("d") - F.col("own") + F.row_number().over(own.orderBy("seen", "g")))
    # Linked sets share at least (d + their d - most) / 2 n-grams of their differences, and d - their d is most at most.
    last = F.floor(rule.most_apart(F.col("n") + F.floor(F.col("n") * rule.den / rule.num))) + 1
    slack = F.ceil(rule.most_apart(F.greatest(F.col("n") - F.col("hub_n"), F.lit(0))))
    prefix = F.col("d") - F.ceil((F.col("d") + 1 - slack) / 2) + 1  # of a set that only ones without a link to the hub need
    near = ranked.filter(F.col("rank") <= F.when(F.col("linked"), F.least(prefix, last)).otherwise(last))
    near = written(near.select("hub", "g", "c", "n", "d", "rank", "root"), "shared")
    u, v = (near.toDF("hub", "g", *[c + x for c in ("", "n", "d", "rank", "root")]) for x in "uv")
    total = F.col("nu") + F.col("nv")
    most = F.floor(rule.most_apart(total))
    needed = (F.col("du") + F.col("dv") - most) / 2
    # The first n-gram that two members share has all others behind it, so both have as many as needed from there on.
    enough = (F.col("du") - F.col("ranku") + 1 >= needed) & (F.col("dv") - F.col("rankv") + 1 >= needed)
    met = (F.col("u") < F.col("v")) & (F.col("rootu") != F.col("rootv")) & (F.abs(F.col("nu") - F.col("nv")) <= most) & enough
    pairs = u.alias("l").join(v.alias("r"), (F.col("l.hub") == F.col("r.hub")) & (F.col("l.g") == F.col("r.g")) & met)
    found = F.min(F.struct(F.col("l.hub").alias("hub"), "nu", "nv", "du", "dv")).alias("found")
    pairs = written(pairs.groupBy("u", "v").agg(found).select("u", "v", "found.*"), "member-pairs")
    wanted = pairs.select("hub", F.col("u").alias("c")).unionAll(pairs.select("hub", F.col("v").alias("c"))).distinct()
    wanted = written(wanted, "members-of-pairs")
    few = wanted.count() <= MAX_BROADCAST_ROWS
    fetched = members.select("hub", "c", "other").join(F.broadcast(wanted) if few else wanted, ["hub", "c"], "left_semi")
    for c, x in (("u", "x"), ("v", "y")):
        pairs = pairs.join(fetched.select("hub", F.col("c").alias(c), F.col("other").alias(x)), ["hub", c])
    apart = F.col("du") + F.col("dv") - 2 * F.size(F.array_intersect("x", "y"))
    return pairs.filter(_linked((total - apart) / 2, total, rule)).select("u", "v").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root): the smallest node that links lead to, for every node of an edge.

    Each round hangs nodes on their smallest neighbour, follows two steps up, and goes on with the edges between what
    is left; tables are written each round, so a lost executor costs one round.
    """
    edges = written(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u != v"), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p"))
        parent = written(parent, "parents")
        for _ in range(2):
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
            parent = parent.join(up, "p", "left").select("u", F.coalesce("q", "p").alias("p"))
        parent = written(parent, "parents")
        if labels is None:
            labels = parent.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            up = parent.select(F.col("u").alias("root"), "p")
            labels = labels.join(up, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        labels = written(labels, "labels")
        left, right = (parent.select(F.col("u").alias(c), F.col("p").alias(f"p{c}")) for c in "uv")
        edges = edges.join(left, "u").join(right, "v").select(F.col("pu").alias("u"), F.col("pv").alias("v"))
        edges = written(edges.filter("u != v").distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def similar_sets(docs: DataFrame, rule: Jaccard | None = None, id: str = "doc_id", text: str = "text"
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, n, a, b, c), classes of equal sets (c, id, n, a, b) and the links between classes (u, v).

    The links connect exactly the classes that the join of all pairs connects.
    """
    rule = rule or Jaccard()
    numbered = written(described(docs, rule, id, text, True).withColumn("r", F.monotonically_increasing_id()), "sets")
    rows = written(numbered.select("id", "n", "a", "b"), "rows")
    key = F.struct(F.col("id").isNull().alias("missing"), "id", "r")
    classes = numbered.filter("n > 0").groupBy("a", "b", "n").agg(F.min(key).alias("top"))
    classes = written(classes.select(F.col("top.r").alias("c"), "top.id", "n", "a", "b"), "classes")
    files = _files(numbered, classes)
    emptied(numbered)  # marks are most of what is held, and no longer needed
    pairs = written(_hub_pairs(files), "pairs")
    wanted = classes.join(pairs.select("c").unionAll(pairs.select("hub")).distinct(), "c", "left_semi")
    fragments = _fragments(docs, wanted.select("c", "id", "a", "b"), rule, id, text)
    counted = written(_counted(pairs, fragments), "overlaps")
    sizes = classes.select("c", "n")
    summed = counted.groupBy("hub", "c").agg(F.sum("common").alias("overlap"), F.flatten(F.collect_list("other")).alias("other"))
    summed = summed.join(sizes, "c").join(sizes.select(F.col("c").alias("hub"), F.col("n").alias("hub_n")), "hub")
    total = F.col("n") + F.col("hub_n")
    differences = summed.withColumn("linked", _linked(F.col("overlap"), total, rule)).withColumn("d", total - 2 * F.col("overlap"))
    differences = written(differences, "differences")
    emptied(counted)
    links = differences.filter("linked").select(F.col("hub").alias("u"), F.col("c").alias("v"))
    return rows, classes, links.unionAll(_member_links(differences, rule))


def near_duplicates(docs: DataFrame, rule: Jaccard | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: the smallest id that links lead to.

    A null or empty text has no n-grams and is linked with nothing.  Rows with equal sets are linked, rows repeated as
    a whole too; a null id ranks behind all others and is a component's id only if it has no other.  Other columns
    are not looked at, and no rows give no rows.
    """
    rows, classes, links = similar_sets(docs, rule, id, text)
    roots = components(links).withColumnRenamed("node", "c")
    rooted = classes.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named_classes = rooted.join(least, "root").select("a", "b", "n", "component_id")
    full = rows.filter("n > 0").join(named_classes.hint("merge"), ["a", "b", "n"]).select("id", "n", "component_id")
    empty = rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    out = full.unionAll(empty)
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id")


def drop_near_duplicates(docs: DataFrame, rule: Jaccard | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, that of its smallest id, with its own columns; rows without n-grams all stay.

    Rows find out whether they stay by id and digest.  Those that go, or are repeated, are listed; the list is broadcast
    if it is counted to be short and joined by shuffle if not.
    """
    rule = rule or Jaccard()
    rows, classes, links = similar_sets(docs, rule, id, text)
    roots = components(links).withColumnRenamed("node", "c")
    rooted = classes.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "c")).alias("top"))
    stays = classes.join(best.select(F.col("top.c").alias("c"), F.lit(True).alias("best")), "c", "left")
    stays = stays.select("a", "b", "n", F.col("id").alias("first"), "best")
    each = rows.filter("n > 0").groupBy("id", "a", "b", "n").agg(F.count(F.lit(1)).alias("times"))
    each = each.join(stays.hint("merge"), ["a", "b", "n"])
    stay = F.coalesce("best", F.lit(False)) & F.col("id").eqNullSafe(F.col("first"))
    listed = each.select("id", "a", "b", stay.alias("stay"), "times").filter(~F.col("stay") | (F.col("times") > 1))
    listed = written(listed.drop("times"), "listed")
    row = F.struct(*[named(c) for c in docs.columns]).alias("row")
    packed = docs.select(row, named(id).alias("i"), named(text).alias("text"))

    def digests(texts):
        return list(zip(*[set_digest(ngrams(t, rule.words)) for t in texts]))

    own = annotate(packed, "text", digests, [T.StructField("da", T.LongType()), T.StructField("db", T.LongType())], ["row", "i"])
    marks = F.broadcast(listed) if listed.count() <= MAX_BROADCAST_ROWS else listed
    same = own["i"].eqNullSafe(marks["id"]) & (own["da"] == marks["a"]) & (own["db"] == marks["b"])
    judged = own.join(marks, same, "left").select("row", "i", "da", "db", "stay")
    out = judged.filter("stay is null").select("row.*")
    if listed.filter("stay").isEmpty():
        return out
    first = F.row_number().over(Window.partitionBy("i", "da", "db").orderBy(F.xxhash64("row")))
    return out.unionAll(judged.filter("stay").withColumn("k", first).filter("k = 1").select("row.*"))
