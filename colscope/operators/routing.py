"""Rows routed down a tree that is held as arrays, in Arrow batches: a row costs the depth it reaches."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import quoted

# Tasks get this module's functions with the query, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class NodeArrays:
    """The nodes of one tree by position, the root first.

    ``feature`` is a position in ``features``, or -1 at a leaf.  A category is its place in ``labels`` of its feature,
    or the place after the last; ``members`` tells for each categorical node (by ``member_row``) which places go left.
    """

    ids: np.ndarray
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    member_row: np.ndarray
    members: np.ndarray
    features: list[str]
    labels: list[list[str] | None]

    @classmethod
    def of(cls, nodes: list) -> NodeArrays:
        """From nodes with id, left, right, feature, threshold, categories (see ``explain.TreeNode``)."""
        nodes = sorted(nodes, key=lambda n: n.id)
        place = {n.id: i for i, n in enumerate(nodes)}
        inner = [n for n in nodes if not n.leaf]
        keys = sorted({(n.feature, n.categories is not None) for n in inner})
        number = {k: i for i, k in enumerate(keys)}
        labels = [sorted({c for n in inner if (n.feature, n.categories is not None) == k for c in n.categories}) if k[1] else None
                  for k in keys]
        by_category = [n for n in inner if n.categories is not None]
        row = {n.id: i for i, n in enumerate(by_category)}
        members = np.zeros((max(1, len(by_category)), 1 + max([len(x) for x in labels if x] or [0])), bool)
        for n in by_category:
            own = labels[number[n.feature, True]]
            members[row[n.id], [own.index(c) for c in n.categories]] = True

        def each(value, missing, kind) -> np.ndarray:
            return np.array([missing if n.leaf else value(n) for n in nodes], kind)

        return cls(
            np.array([n.id for n in nodes], np.int32), each(lambda n: place[n.left], -1, np.int32),
            each(lambda n: place[n.right], -1, np.int32),
            each(lambda n: number[n.feature, n.categories is not None], -1, np.int32),
            each(lambda n: n.threshold if n.categories is None else 0.0, 0.0, float),
            each(lambda n: row.get(n.id, -1), -1, np.int32), members, [f for f, _ in keys], labels)

    def values(self, position: int, column: pd.Series) -> np.ndarray:
        """A feature as numbers; null is NaN."""
        labels = self.labels[position]
        if labels is None:
            return column.to_numpy(dtype=float, na_value=np.nan)
        codes = pd.Categorical(column, categories=labels).codes.astype(float)
        codes[codes < 0] = len(labels)
        codes[column.isna().to_numpy()] = np.nan
        return codes

    def stops(self, x: np.ndarray) -> np.ndarray:
        """Id of the node where each row of ``x`` (one column per feature) stops: a leaf, or where its value is null."""
        at = np.zeros(len(x), np.int32)
        going = np.arange(len(x)) if len(self.ids) > 1 else np.arange(0)
        while len(going):
            here = at[going]
            value = x[going, self.feature[here]]
            known = ~np.isnan(value)
            going, here, value = going[known], here[known], value[known]
            row = self.member_row[here]
            goes_left = value <= self.threshold[here]
            listed = row >= 0
            goes_left[listed] = self.members[row[listed], value[listed].astype(np.int64)]
            at[going] = np.where(goes_left, self.left[here], self.right[here])
            going = going[self.feature[at[going]] >= 0]
        return self.ids[at]


def stop_node(nodes: list) -> Column:
    """Id of the deepest node a row reaches; a null in a split column stops it there.

    Not-a-number is greater than any threshold, text that is no number is null to a threshold, and a category that the
    tree does not know goes right.
    """
    tree = NodeArrays.of(nodes)
    if not tree.features:
        return F.lit(int(tree.ids[0]))
    columns = []
    for name, labels in zip(tree.features, tree.labels):
        x = F.col(quoted(name))
        number = x.try_cast("double")
        columns.append(F.when(F.isnan(number), float("inf")).otherwise(number) if labels is None else x.cast("string"))

    @F.pandas_udf("int")
    def routed(*parts: pd.Series) -> pd.Series:
        return pd.Series(tree.stops(np.column_stack([tree.values(i, p) for i, p in enumerate(parts)])))

    return routed(*columns)
