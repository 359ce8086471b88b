"""Binning expressions that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..specs import OTHERS


def edges_at_or_below(x: Column, edges: list[float]) -> Column:
    """How many of the sorted ``edges`` are <= x, as a balanced tree of comparisons; null for null."""

    def branch(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(edges[mid]), branch(lo, mid)).otherwise(branch(mid + 1, hi))

    if any(a > b for a, b in zip(edges, edges[1:])):
        raise ValueError("edges must be sorted")
    return F.when(x.isNotNull(), branch(0, len(edges)))


def bucket(x: Column, edges: list[float]) -> Column:
    """0-based bucket of x: half-open buckets, the last one closed; null outside the edges."""
    inside = (x >= F.lit(edges[0])) & (x <= F.lit(edges[-1]))
    return F.when(inside, edges_at_or_below(x, edges[1:-1]))


def lower_edge(label: str) -> float:
    """Lower end of a ``lo - hi`` label (or the value itself when the label is a single value)."""
    return float(label.split(" - ")[0])


def bin_number(x: Column, labels: list[str]) -> Column:
    """Index of the label with the greatest lower edge <= x; values below all edges go to the first.

    ``labels`` must be in ascending order of their lower edges.
    """
    edges = [lower_edge(s) for s in labels]
    return edges_at_or_below(x.cast("double"), edges[1:])


def bin_category(x: Column, values: list[str]) -> Column:
    """The value itself where it is listed, ``Others`` elsewhere; null stays null."""
    return F.when(x.isNotNull(), F.when(x.isin(*values), x).otherwise(F.lit(OTHERS)))


