"""Isolation forest: trees grown on small samples in parallel tasks, rows scored where they are."""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import quoted
from .split import unit

# Tasks get this module's functions with the query, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_SIZE = 256
EULER_GAMMA = 0.57721566490153286
# Fixed value: the truncated constant of the legacy form.
LEGACY_GAMMA = 0.5772156649
NODE_SCHEMA = "tree int, node int, left int, right int, feature int, threshold double, size long, sample long"


def average_path(n: float, legacy: bool = False) -> float:
    """Mean depth of an unsuccessful search among n rows, which normalises path lengths.

    ``legacy`` truncates the value (and the ratio inside it) to whole numbers.
    """
    if legacy:
        return float(int(2 * (math.log(n - 1) + LEGACY_GAMMA) - (2 * (n - 1) // n))) if n > 1 else 1.0
    if n <= 1:
        return 0.0
    return 1.0 if n <= 2 else 2 * (math.log(n - 1) + EULER_GAMMA) - 2 * (n - 1) / n


def _grow(points: np.ndarray, rng: np.random.Generator, height: int) -> list[tuple]:
    """(node, left, right, feature, threshold, size) of one tree on at most a few hundred points."""
    nodes: list[tuple] = []
    waiting = [(points, 0)]
    places = [0]
    used = 1
    while waiting:
        rows, depth = waiting.pop(0)
        node = places.pop(0)
        if depth >= height or len(rows) <= 1:
            nodes.append((node, -1, -1, -1, 0.0, len(rows)))
            continue
        feature = int(rng.integers(points.shape[1]))
        low, high = rows[:, feature].min(), rows[:, feature].max()
        cut = float(low + rng.random() * (high - low))
        below = rows[:, feature] < cut
        nodes.append((node, used, used + 1, feature, cut, len(rows)))
        waiting += [(rows[below], depth + 1), (rows[~below], depth + 1)]
        places += [used, used + 1]
        used += 2
    return nodes


def sample_for_trees(features: DataFrame, trees: int, sample_size: int, seed: int,
                     keys: list[str] | None = None) -> DataFrame:
    """Rows tagged with the trees they are drawn for: each tree draws each key with the same chance, independently.

    A row goes from one of its trees to the next by geometric gaps drawn by its key (by default all columns), so the
    sample does not depend on partitions or order.  The first gap alone decides for most rows that they are in no tree;
    only the others compute more.  Rows of equal keys count once in a tree, so that no key can fill one.
    """
    keys = keys or features.columns
    rate = min(1.0, sample_size / max(features.count(), 1))
    if rate == 1:
        every = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
        return features.select("*", every).dropDuplicates(["tree", *keys])
    mean = trees * rate
    # All steps that a row can take, but for a chance beyond 1e-12.
    steps = min(trees, math.ceil(mean + 12 * math.sqrt(mean) + 25))

    def gap(step: Column | int) -> Column:
        return F.least(F.floor(F.log(unit(keys, seed, step)) / math.log1p(-rate)), F.lit(trees)).cast("int") + 1

    places = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(steps)), gap), F.array().cast("array<int>"),
                         lambda done, g: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(-1)) + g)))
    drawn = features.filter(gap(1) <= trees)
    chosen = F.filter(places, lambda t: t < trees)
    return drawn.select(*[F.col(quoted(c)) for c in features.columns], F.explode(chosen).alias("tree")).dropDuplicates(["tree", *keys])


def feature_columns(df: DataFrame, columns: list[str]) -> list[Column]:
    """Features as doubles; a null behaves as 0."""
    return [F.coalesce(F.col(quoted(c)).try_cast("double"), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(columns)]


def build_forest(df: DataFrame, columns: list[str], trees: int = 100, sample_size: int = SAMPLE_SIZE,
                 seed: int = 1337, legacy_height: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Node table of an isolation forest, each tree grown in its own task from its own sample.

    ``keys`` names the columns that tell rows apart, by default all of them; see :func:`sample_for_trees`.
    """
    own = [F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keys or df.columns)]
    features = df.select(*feature_columns(df, columns), *own)
    sampled = sample_for_trees(features, trees, sample_size, seed, [f"k{i}" for i in range(len(own))])
    sampled = sampled.select("tree", *[f"f{i}" for i in range(len(columns))])
    height = math.ceil(math.log(sample_size) if legacy_height else math.log2(sample_size))
    names = [f"f{i}" for i in range(len(columns))]

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        rng = np.random.default_rng([seed, tree])
        points = pdf[names].to_numpy(dtype=float)
        # Rows arrive in no fixed order; sorting makes the tree depend on the sample alone.
        points = points[np.lexsort(points.T[::-1])]
        nodes = _grow(points, rng, height)
        out = pd.DataFrame(nodes, columns=["node", "left", "right", "feature", "threshold", "size"])
        return out.assign(tree=tree, sample=len(points))[
            ["tree", "node", "left", "right", "feature", "threshold", "size", "sample"]]

    return sampled.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


@dataclass(frozen=True)
class Forest:
    """Node arrays of a forest; a few hundred nodes per tree, so it travels with the scoring tasks."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    addition: np.ndarray
    normaliser: float
    height: int


def collect_forest(nodes: DataFrame, legacy: bool = False, rows: int | None = None) -> Forest:
    """Forest from its node table.  ``legacy`` normalises by ``rows``, the size of the whole dataset."""
    table = nodes.toPandas().sort_values(["tree", "node"])
    trees = [g for _, g in table.groupby("tree")]
    width = max(len(g) for g in trees)

    def padded(column: str, dtype) -> np.ndarray:
        out = np.zeros((len(trees), width), dtype)
        for i, g in enumerate(trees):
            out[i, : len(g)] = g[column].to_numpy()
        return out

    left, right, size = padded("left", np.int32), padded("right", np.int32), padded("size", np.int64)
    leaf_extra = np.vectorize(lambda n: (average_path(n, legacy) if n > 1 else (1.0 if legacy else 0.0)), otypes=[float])
    own = np.arange(width, dtype=np.int32)[None, :].repeat(len(trees), 0)
    is_leaf = left < 0
    height = int(math.ceil(math.log2(max(2, size.max())))) + 1
    sample = float(np.mean([g["sample"].iloc[0] for g in trees]))
    return Forest(padded("feature", np.int32), padded("threshold", float), np.where(is_leaf, own, left),
                  np.where(is_leaf, own, right), np.where(is_leaf, leaf_extra(size), 0.0),
                  average_path(rows if legacy and rows else sample, legacy), max(height, 16))


def _paths(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Mean path length per row; all rows walk down one tree at a time, leaves stay where they are."""
    total = np.zeros(len(x))
    every = np.arange(len(x))
    for t in range(forest.left.shape[0]):
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(forest.height):
            goes_left = x[every, np.maximum(forest.feature[t, at], 0)] < forest.threshold[t, at]
            following = np.where(goes_left, forest.left[t, at], forest.right[t, at])
            moved = following != at
            if not moved.any():
                break
            total += moved
            at = following
        total += forest.addition[t, at]
    return total / forest.left.shape[0]


def anomaly_score(forest: Forest, columns: list[Column]) -> Column:
    """Score in (0, 1], higher for rows that are easier to isolate; an Arrow-batched expression."""

    @F.pandas_udf("double")
    def scored(*parts: pd.Series) -> pd.Series:
        x = np.column_stack([p.to_numpy(dtype=float) for p in parts])
        return pd.Series(np.power(2.0, -_paths(forest, x) / forest.normaliser))

    return scored(*columns)


def score_anomalies(df: DataFrame, columns: list[str], trees: int = 100, sample_size: int = SAMPLE_SIZE,
                    seed: int = 1337, keep: list[str] | None = None, legacy: bool = False,
                    partitions: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """``anomaly_score`` in front of the feature columns (and ``keep``) for every row; no rows give no rows.

    The trees' samples are drawn by ``keys``, by default ``keep`` and the features.  ``partitions`` deals the rows out anew, for an input that comes in few large pieces.
    """
    kept = [c for c in (keep or []) if c not in columns]
    rows = df.select(*kept, *columns)
    if df.isEmpty():
        return rows.select(F.lit(None).cast("double").alias("anomaly_score"), *kept, *columns)
    nodes = build_forest(df, columns, trees, sample_size, seed, legacy, keys or [*kept, *columns])
    forest = collect_forest(nodes, legacy, df.count() if legacy else None)
    score = anomaly_score(forest, feature_columns(df, columns)).alias("anomaly_score")
    return (rows.repartition(partitions) if partitions else rows).select(score, *kept, *columns)


def sorted_anomalies(scored: DataFrame, key: list[str] | None = None) -> DataFrame:
    """All rows from most to least anomalous (a range-partitioned sort)."""
    return scored.orderBy(F.desc("anomaly_score"), *(key or []))


def top_anomalies(scored: DataFrame, n: int, key: list[str]) -> DataFrame:
    return scored.orderBy(F.desc("anomaly_score"), *key).limit(n)

