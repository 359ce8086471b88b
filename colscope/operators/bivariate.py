"""Bivariate profiling: correlation, covariance and two-way contingency tables of column pairs."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import bin_category, bin_number, lower_edge
from ..session import small_table
from ..specs import CATEGORY, NUMBER, PERCENTAGE

MAX_CATEGORY_VALUES = 20


@dataclass(frozen=True)
class BinnedColumn:
    """A column with its bin labels; numeric labels start with their lower edge."""

    name: str
    labels: tuple[str, ...]
    numeric: bool = True

    @property
    def ordered_labels(self) -> list[str]:
        return sorted(self.labels, key=lower_edge) if self.numeric else list(self.labels)

    def index(self) -> Column:
        """0-based position of the row's bin, -1 for a value in no listed bin, null for null."""
        x, labels = F.col(self.name), self.ordered_labels
        if self.numeric:
            return bin_number(x, labels)
        binned = bin_category(x.cast("string"), [s for s in labels if s != "Others"])
        place = None
        for i, label in enumerate(labels):
            place = F.when(binned == label, i) if place is None else place.when(binned == label, i)
        return F.when(binned.isNotNull(), place.otherwise(-1))


def column_pairs(columns: DataFrame, changed: list[str] | None = None) -> DataFrame:
    """Unordered pairs, self-pairs included, of a column table (position, column).

    With ``changed``, only pairs that touch one of those columns.
    """
    # The list of columns is schema-sized; a scalar subquery hands it to every row.
    listed = columns.agg(F.sort_array(F.collect_list(F.struct("position", "column")))).scalar()
    others = columns.select("position", F.col("column").alias("c1"), F.explode(listed).alias("o"))
    pairs = others.filter(F.col("position") <= F.col("o.position")).select("c1", F.col("o.column").alias("c2"))
    if changed is not None:
        pairs = pairs.filter(F.col("c1").isin(changed) | F.col("c2").isin(changed))
    return pairs


def eligible_columns(summary: DataFrame) -> DataFrame:
    """Columns of a summary fit for contingency tables: numbers, and categories with few values."""
    return summary.filter(F.col("datatype").isin(NUMBER, PERCENTAGE)
                          | ((F.col("datatype") == CATEGORY) & (F.col("distinct") < MAX_CATEGORY_VALUES)))


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(c1, c2, n, correlation, covariance) over the rows where both columns are present.

    Each task adds up products of whole batches, as matrices over all columns with the nulls masked, and sends a row
    per pair.  Values are taken from their column's mean first, so that sums of squares stay exact enough.  Text is
    read as numbers where it is one.
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    places = {c: i for i, c in enumerate(columns)}
    left, right = np.array([places[a] for a, _ in pairs]), np.array([places[b] for _, b in pairs])
    numbers = df.select(*[F.col(c).try_cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    means = numbers.agg(*[F.avg(F.nanvl(c, F.lit(None).cast("double"))) for c in numbers.columns]).first()
    centre = np.array([m if m is not None and math.isfinite(m) else 0.0 for m in means])
    names = ["n", "x", "y", "xx", "yy", "xy"]

    def sums(batches):
        total = None
        for batch in batches:
            present = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            values = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns])
            values = np.where(present > 0, values - centre, 0.0)
            n, x, xx, xy = present.T @ present, values.T @ present, (values * values).T @ present, values.T @ values
            own = np.stack([n[left, right], x[left, right], x[right, left], xx[left, right], xx[right, left], xy[left, right]])
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(left), dtype=np.int32)), *map(pa.array, total)], ["pair", *names])

    rows = numbers.mapInArrow(sums, "pair int, " + ", ".join(f"{c} double" for c in names))
    added = rows.groupBy("pair").agg(*[F.sum(c).alias(c) for c in names])
    listed = small_table(df.sparkSession, [{"pair": i, "c1": a, "c2": b} for i, (a, b) in enumerate(pairs)],
                         pa.schema([("pair", pa.int32()), ("c1", pa.string()), ("c2", pa.string())]))

    def about(product: str, a: str, b: str) -> Column:
        return F.col(product) - F.try_divide(F.col(a) * F.col(b), F.col("n"))

    spread = F.sqrt(about("xx", "x", "x")) * F.sqrt(about("yy", "y", "y"))
    enough = F.col("n") > 1
    return listed.join(added, "pair", "left").select(
        "c1", "c2", F.coalesce("n", F.lit(0.0)).cast("long").alias("n"),
        F.when(enough, F.try_divide(about("xy", "x", "y"), spread)).alias("correlation"),
        F.when(enough, F.try_divide(about("xy", "x", "y"), F.col("n") - 1)).alias("covariance"))


def correlation_matrix(long: DataFrame, columns: list[str]) -> DataFrame:
    """Square matrix from long correlations: either order of a pair, 1 on the diagonal, 0 where missing."""
    flat = long.select("c1", "c2", "correlation")
    mirrored = flat.unionByName(flat.select(F.col("c2").alias("c1"), F.col("c1").alias("c2"), "correlation"))
    wide = mirrored.filter(F.col("c1") != F.col("c2")).groupBy(F.col("c1").alias("column")).pivot("c2", columns).agg(
        F.max("correlation"))
    return wide.select("column", *[
        F.when(F.col("column") == c, 1.0).otherwise(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in columns])


def mosaic(df: DataFrame, pairs: list[tuple[BinnedColumn, BinnedColumn]]) -> DataFrame:
    """Contingency tables of many pairs in one scan: (c1, c2, x, y, n, x_share, y_share).

    Every combination of the listed bins appears, with 0 where no row falls; values outside the lists and
    rows where either column is null do not count.  ``x_share`` is the bin's part of the pair's total and
    ``y_share`` the cell's part of its bin.  Each task adds up its cells in arrays and sends those that occur; the grid
    of cells is joined from the columns' labels.
    """
    pairs = [(a, b) for a, b in pairs if a.name != b.name]
    columns = {c.name: c for pair in pairs for c in pair}
    ids = {name: i for i, name in enumerate(columns)}
    binned = df.select(*[columns[c].index().alias(f"b{i}") for c, i in ids.items()])
    width = [len(columns[c].labels) for c in ids]
    sides = [(ids[a.name], ids[b.name]) for a, b in pairs]

    def tally(batches):
        counts = [0] * len(sides)
        for batch in batches:
            bins = [c.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            for p, (a, b) in enumerate(sides):
                inside = (bins[a] >= 0) & (bins[b] >= 0)
                counts[p] = counts[p] + np.bincount((bins[a] * width[b] + bins[b])[inside], minlength=width[a] * width[b])
        for p, own in enumerate(counts):
            cells = np.flatnonzero(own)
            if len(cells):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cells), p, np.int32)), pa.array(cells.astype(np.int32)), pa.array(own[cells].astype(np.int64))],
                    ["pair", "cell", "n"])

    counts = binned.mapInArrow(tally, "pair int, cell int, n long").groupBy("pair", "cell").agg(F.sum("n").alias("n"))
    spark = df.sparkSession
    labels = small_table(spark, [{"id": ids[c], "place": i, "label": x} for c in ids for i, x in enumerate(columns[c].ordered_labels)],
                         pa.schema([("id", pa.int32()), ("place", pa.int32()), ("label", pa.string())]))
    listed = small_table(spark, [{"pair": p, "a": ids[a.name], "b": ids[b.name], "c1": a.name, "c2": b.name, "width": len(b.labels)}
                                 for p, (a, b) in enumerate(pairs)],
                         pa.schema([(c, pa.string() if c in ("c1", "c2") else pa.int32()) for c in ("pair", "a", "b", "c1", "c2", "width")]))
    first = labels.select(F.col("id").alias("a"), F.col("place").alias("i"), F.col("label").alias("x"))
    second = labels.select(F.col("id").alias("b"), F.col("place").alias("j"), F.col("label").alias("y"))
    cells = listed.join(first, "a").join(second, "b").withColumn("cell", F.col("i") * F.col("width") + F.col("j"))
    filled = cells.join(counts, ["pair", "cell"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # One window partition holds one pair's cells, which the bin lists bound.
    per_pair = F.sum("n").over(Window.partitionBy("pair"))
    per_bin = F.sum("n").over(Window.partitionBy("pair", "x"))
    return filled.select(
        "c1", "c2", "x", "y", "n",
        F.coalesce(F.try_divide(per_bin, per_pair), F.lit(0.0)).alias("x_share"),
        F.coalesce(F.try_divide(F.col("n"), per_bin), F.lit(0.0)).alias("y_share"))


def all_pairs(names: list[str], changed: list[str] | None = None) -> list[tuple[str, str]]:
    """Unordered pairs of different names, optionally only those that touch ``changed``."""
    return [p for p in combinations(names, 2) if changed is None or p[0] in changed or p[1] in changed]


def pair_summary(summaries: DataFrame, a: str, b: str) -> DataFrame:
    """The rows of one pair, stored under either order of its columns."""
    lo, hi = sorted((a, b))
    return summaries.filter((F.least("c1", "c2") == lo) & (F.greatest("c1", "c2") == hi))
