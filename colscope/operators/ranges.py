"""Joins of points with the bands that hold them, over a grid of steps with like numbers of points."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bins import edges_at_or_below
from ..session import quoted


_INLINE = 256  # more cuts than these are searched in Arrow batches, not by an expression


@dataclass(frozen=True)
class Grid:
    """Cuts between steps, and for each step the parts that its points are dealt to, 0 where there are no points."""

    cuts: list[float]
    parts: list[int]


def _number(x: Column, kind: T.DataType) -> Column:
    """A double that never falls where ``x`` rises, to tell steps by; the join itself compares the values as they are."""
    if isinstance(kind, T.DateType):
        return F.unix_date(x).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(x.cast("timestamp")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(x).cast("double")
    number = x.cast("double")
    return F.when(F.isnan(number), float("inf")).otherwise(number)


def _step(number: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts are <= the number; null for null."""
    if len(cuts) <= _INLINE:
        return edges_at_or_below(number, cuts)
    edges = np.array(cuts)

    @F.pandas_udf("int")
    def below(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, x.to_numpy(), side="right")).where(x.notna())

    return below(number)


def _per_step(step: Column, values: list[int]) -> Column:
    if len(values) <= _INLINE:
        return F.element_at(F.array(*[F.lit(n) for n in values]), step + 1)
    known = np.array(values)

    @F.pandas_udf("int")
    def of_step(i: pd.Series) -> pd.Series:
        return pd.Series(known[i.to_numpy()])

    return of_step(step)


def _cuts(quantiles: list[float]) -> set[float]:
    """Cuts at quantiles; a value that makes several of them gets a step of its own."""
    repeated = [x for x, n in Counter(quantiles).items() if n > 1 and math.isfinite(x)]
    return {*quantiles, *[math.nextafter(x, math.inf) for x in repeated]}


def point_grid(points: DataFrame, x: str, steps: int = 128, share: float = 2.0, ends: DataFrame | None = None,
               per_step: int = 4096) -> Grid:
    """A grid by quantiles of the points, so dense stretches get more steps.

    ``ends`` (one column of doubles) are cut like points.  Steps that would hold more than ``per_step`` numbers in the
    mean are cut again at quantiles of their own.  Points are counted by step; a step with more than ``share`` times the
    mean, as one value in many points makes, is dealt to several parts.  The grid is a sketch's: it only has to be even,
    not exact.
    """
    number = _number(F.col(quoted(x)), points.schema[x].dataType)
    numbers = points.select(number.alias("x"))
    numbers = (numbers if ends is None else numbers.unionAll(ends)).filter(F.col("x").isNotNull())
    found = numbers.agg(F.percentile_approx("x", [i / steps for i in range(1, steps)], 100 * steps), F.count("x")).first()
    cuts = sorted(_cuts(found[0] or []))
    finer = math.ceil(found[1] / (steps * per_step))
    if finer > 1:
        inner = F.percentile_approx("x", [i / finer for i in range(1, finer)], 20 * finer)
        within = numbers.groupBy(edges_at_or_below(F.col("x"), cuts).alias("step")).agg(inner.alias("cuts")).collect()
        cuts = sorted(reduce(set.union, [_cuts(r["cuts"]) for r in within], set(cuts)))
    counted = points.groupBy(_step(number, cuts).alias("step")).count().filter("step is not null").collect()
    counts = {r["step"]: r["count"] for r in counted}
    most = max(1.0, share * sum(counts.values()) / (steps * max(1, finer)))
    return Grid(cuts, [math.ceil(counts.get(i, 0) / most) for i in range(len(cuts) + 1)])


def stepped_points(points: DataFrame, x: str, grid: Grid) -> DataFrame:
    """Points with the step of their value and the part of it they are dealt to by a hash of the row."""
    step = _step(_number(F.col(quoted(x)), points.schema[x].dataType), grid.cuts)
    own = points.filter(F.col(quoted(x)).isNotNull()).withColumn("__step", step)
    row = F.xxhash64(*[F.col(quoted(c)) for c in points.columns])
    return own.withColumn("__part", F.pmod(row, _per_step(F.col("__step"), grid.parts).cast("long")).cast("int"))


def range_join(points: DataFrame, bands: DataFrame, x: str, low: str, high: str, closed: bool = True,
               grid: Grid | None = None, steps: int = 128) -> DataFrame:
    """Every pair of a point and a band with ``low <= x <= high`` (``< high`` if not ``closed``).

    Numbers, dates and timestamps will do; points and bands share no column names.  The grid is cut by the points and by
    the ends of bands, into ``steps`` or more.  A band goes once to every part of each step it covers that holds points,
    so it costs the points it meets and a step at each end.  Null values and bands whose low is above their high meet
    nothing, repeated rows meet each, and an empty side gives no rows.
    """
    if clash := set(points.columns) & set(bands.columns):
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    lo, hi = F.col(quoted(low)), F.col(quoted(high))
    own = bands.filter(lo <= hi)
    first, last = (_number(F.col(quoted(c)), bands.schema[c].dataType) for c in (low, high))
    grid = grid or point_grid(points, x, steps, ends=own.select(F.explode(F.array(first, last)).alias("x")))
    # Steps with points, numbered: those below each step, and in ``held`` the step of each number.
    below = [0, *accumulate(int(n > 0) for n in grid.parts)]
    held = [i for i, n in enumerate(grid.parts) if n] or [0]
    own = own.withColumns({"__first": _step(first, grid.cuts), "__last": _step(last, grid.cuts)})
    own = own.withColumns({"__first": _per_step(F.col("__first"), below), "__last": _per_step(F.col("__last") + 1, below) - 1})
    own = own.filter("__first <= __last").withColumn("__step", F.explode(F.sequence("__first", "__last"))).drop("__first", "__last")
    own = own.withColumn("__step", _per_step(F.col("__step"), held))
    own = own.withColumn("__part", F.explode(F.sequence(F.lit(0), _per_step(F.col("__step"), grid.parts) - 1)))
    pairs = stepped_points(points, x, grid).join(own, ["__step", "__part"])
    value = F.col(quoted(x))
    inside = (value >= lo) & ((value <= hi) if closed else (value < hi))
    return pairs.filter(inside).drop("__step", "__part")
