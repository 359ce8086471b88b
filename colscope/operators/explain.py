"""Trees as tables: nodes, readable rules, and how a dataset spreads over the nodes."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, small_table
from .quantiles import approximate_quantiles, exact_quantiles
from .routing import stop_node
from .trees import CLASSIFICATION, TreeModel


@dataclass(frozen=True)
class TreeNode:
    """A node of a fitted tree; inner nodes split on a threshold or on a set of categories going left."""

    id: int
    prediction: float = 0.0
    left: int = -1
    right: int = -1
    feature: str | None = None
    threshold: float | None = None
    categories: tuple[str, ...] | None = None
    tree: int = 0
    impurity: float = 0.0
    gain: float = -1.0

    @property
    def leaf(self) -> bool:
        return self.left == -1

    def condition_texts(self) -> tuple[str, str]:
        if self.categories is None:
            return f"{self.feature} <= {self.threshold}", f"{self.feature} > {self.threshold}"
        values = ",".join(f"'{c}'" for c in self.categories)
        return f"{self.feature} IN ({values})", f"{self.feature} NOT IN ({values})"


def node_table(spark: SparkSession, estimator) -> DataFrame:
    """Nodes of a fitted model as MLlib saves them, with a tree number (0 for a single tree)."""
    path = shared_folder(spark, "tree")
    estimator.write().overwrite().save(path)
    saved = spark.read.parquet(f"{path}/data")
    if "nodeData" in saved.columns:
        return saved.select(F.col("treeID").alias("tree"), "nodeData.*")
    return saved.select(F.lit(0).alias("tree"), "*")


def nodes_of(spark: SparkSession, model: TreeModel) -> list[TreeNode]:
    """All nodes of a fitted model with feature names and category labels in place of indexes."""
    nodes = []
    for r in node_table(spark, model.estimator).collect():
        feature = threshold = categories = None
        if r["leftChild"] != -1:
            split = r["split"]
            feature = model.features[split["featureIndex"]]
            if split["numCategories"] > -1:
                labels = model.feature_labels.get(feature, [])
                categories = tuple(labels[int(c)] for c in split["leftCategoriesOrThreshold"] if int(c) < len(labels))
            else:
                threshold = split["leftCategoriesOrThreshold"][0]
        nodes.append(TreeNode(r["id"], r["prediction"], r["leftChild"], r["rightChild"], feature, threshold,
                              categories, r["tree"], r["impurity"], r["gain"]))
    return sorted(nodes, key=lambda n: (n.tree, n.id))


def _parents(nodes: list[TreeNode]) -> dict[int, tuple[TreeNode, str]]:
    """Node id -> (parent, condition text that leads here), for one tree."""
    by_id = {n.id: n for n in nodes}
    links = {}
    for n in by_id.values():
        if not n.leaf:
            to_left, to_right = n.condition_texts()
            links[n.left], links[n.right] = (n, to_left), (n, to_right)
    return links


def _path(node_id: int, links: dict) -> list[int]:
    path = [node_id]
    while path[-1] in links:
        path.append(links[path[-1]][0].id)
    return path


def tree_table(spark: SparkSession, nodes: list[TreeNode], class_labels: list[str] | None = None) -> DataFrame:
    """One row per node: tree, node_id, its children with the conditions that lead to them, and its outcome."""
    rows = []
    for n in nodes:
        to_left, to_right = (None, None) if n.leaf else n.condition_texts()
        outcome = class_labels[int(n.prediction)] if class_labels else str(n.prediction)
        rows.append({"tree": n.tree, "node_id": n.id, "left_id": None if n.leaf else n.left, "to_left": to_left,
                     "right_id": None if n.leaf else n.right, "to_right": to_right, "outcome": outcome})
    kinds = {"tree": pa.int32(), "node_id": pa.int32(), "left_id": pa.int32(), "right_id": pa.int32()}
    names = ("tree", "node_id", "left_id", "to_left", "right_id", "to_right", "outcome")
    return small_table(spark, rows, pa.schema([(c, kinds.get(c, pa.string())) for c in names]))


def node_paths(nodes: DataFrame) -> DataFrame:
    """(tree, node_id, depth, rule) of every node of ``tree_table`` rows that its root (0) leads to.

    The conditions on the way are joined level by level, for all trees at once.
    """
    return nodes.sparkSession.sql("""
        WITH RECURSIVE links AS (
          SELECT tree, node_id AS parent, left_id AS child, to_left AS condition FROM {nodes} WHERE left_id IS NOT NULL
          UNION ALL SELECT tree, node_id, right_id, to_right FROM {nodes} WHERE right_id IS NOT NULL),
        paths (tree, node_id, depth, rule) AS (
          SELECT tree, node_id, 0, CAST('' AS STRING) FROM {nodes} WHERE node_id = 0
          UNION ALL
          SELECT p.tree, l.child, p.depth + 1, CASE WHEN p.depth = 0 THEN l.condition ELSE p.rule || ' AND ' || l.condition END
          FROM paths p JOIN links l ON l.tree = p.tree AND l.parent = p.node_id)
        SELECT * FROM paths""", nodes=nodes)


def rules_table(spark: SparkSession, nodes: list[TreeNode], class_labels: list[str] | None = None) -> DataFrame:
    """One row per leaf: tree, node, depth, the conditions on its path, and the predicted value or class."""
    own = tree_table(spark, nodes, class_labels)
    leaves = own.filter("left_id IS NULL").select("tree", "node_id", "outcome")
    return node_paths(own).join(leaves, ["tree", "node_id"]).select("tree", "node_id", "depth", "rule", "outcome")


def _node_rows(spark: SparkSession, nodes: list[TreeNode]) -> tuple[DataFrame, DataFrame]:
    links = _parents(nodes)
    nodes_df = small_table(spark, [
        {"node_id": n.id, "parent_id": links[n.id][0].id if n.id in links else None,
         "split_condition": links[n.id][1] if n.id in links else None} for n in nodes
    ], pa.schema([("node_id", pa.int32()), ("parent_id", pa.int32()), ("split_condition", pa.string())]))
    above = small_table(spark, [{"stop": n.id, "node_id": i} for n in nodes for i in _path(n.id, links)],
                        pa.schema([("stop", pa.int32()), ("node_id", pa.int32())]))
    return nodes_df, above


def node_class_counts(df: DataFrame, nodes: list[TreeNode], label: str) -> DataFrame:
    """(node_id, label, n, percentage): classes of all rows that pass each node.

    Each row is routed once; only (stop node, class) counts are shuffled and then added
    up along the paths to the root.
    """
    _, above = _node_rows(df.sparkSession, nodes)
    counts = df.groupBy(stop_node(nodes).alias("stop"), F.col(label).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    per_node = counts.join(F.broadcast(above), "stop").groupBy("node_id", "label").agg(F.sum("n").alias("n"))
    totals = per_node.groupBy("node_id").agg(F.sum("n").alias("total"))
    return per_node.join(totals, "node_id").select(
        "node_id", "label", "n", (F.col("n") / F.col("total") * 100).alias("percentage"))


def _link_weights(nodes_df: DataFrame, counts: DataFrame) -> DataFrame:
    filled = nodes_df.join(counts, "node_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    parents = filled.select(F.col("node_id").alias("parent_id"), F.col("n").alias("parent_n"))
    # The root has no parent; its weight is its own count.
    weight = F.coalesce(F.try_divide(F.col("n"), F.coalesce("parent_n", F.lit(1))), F.lit(0.0))
    return filled.join(parents, "parent_id", "left").withColumn("link_weight", weight).drop("parent_n")


def node_report(df: DataFrame, nodes: list[TreeNode], label: str, kind: str = CLASSIFICATION,
                exact_median: bool = False) -> DataFrame:
    """One row per node: parent, split condition, rows, link weight, and mean and median for regression.

    All rows of the dataset count, those with nulls included, in one scan (two with medians).
    """
    nodes_df, above = _node_rows(df.sparkSession, nodes)
    y = F.col(label).cast("double") if kind != CLASSIFICATION else F.lit(None).cast("double")
    routed = df.select(stop_node(nodes).alias("stop"), y.alias("y"))
    stops = routed.groupBy("stop").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"), F.count("y").alias("k"))
    counts = stops.join(F.broadcast(above), "stop").groupBy("node_id").agg(
        F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("k")).alias("mean"))
    report = _link_weights(nodes_df, counts).select("node_id", "parent_id", "split_condition", "n", "link_weight", "mean")
    if kind == CLASSIFICATION:
        return report.drop("mean")
    passed = routed.filter(F.col("y").isNotNull()).join(F.broadcast(above), "stop").select("node_id", "y")
    medians = (exact_quantiles if exact_median else approximate_quantiles)(passed, ["node_id"], "y", [0.5])
    return report.join(medians.select("node_id", F.col("quantile").alias("median")), "node_id", "left")
