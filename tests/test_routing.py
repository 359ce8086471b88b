"""Rows routed down trees: equal to nested conditions, and deep trees cost what their rows walk."""

import random
import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.operators.explain import TreeNode, node_class_counts, node_report, rules_table
from colscope.operators.routing import NodeArrays, stop_node

KINDS = ["red", "green", "blue", "", "grey"]


def grown(pick, depth, least=0):
    """A random tree, by thresholds on two numbers and sets of a category."""
    nodes, used = [], [0]

    def grow(own, left):
        if left == 0 or (left < depth - least and pick.random() < 0.2):
            nodes.append(TreeNode(own))
            return
        a, b = used[0] + 1, used[0] + 2
        used[0] += 2
        if pick.random() < 0.4:
            some = tuple(pick.sample(KINDS[:4], pick.randrange(0, 4)))
            nodes.append(TreeNode(own, left=a, right=b, feature="c.d", categories=some))
        else:
            nodes.append(TreeNode(own, left=a, right=b, feature=pick.choice(["x", "t"]), threshold=round(pick.uniform(-1, 1), 2)))
        grow(a, left - 1)
        grow(b, left - 1)

    grow(0, depth)
    return nodes


def nested(nodes):
    """The same as one condition per node."""
    by_id = {n.id: n for n in nodes}

    def descend(n):
        if n.leaf:
            return F.lit(n.id)
        x = F.col(f"`{n.feature}`")
        if n.categories is None:
            x = x.try_cast("double")
            left, right = x <= F.lit(n.threshold), x > F.lit(n.threshold)
        else:
            left = x.isin(*n.categories) if n.categories else F.lit(False)
            right = ~left if n.categories else x.isNotNull()
        return F.when(left, descend(by_id[n.left])).when(right, descend(by_id[n.right])).otherwise(F.lit(n.id))

    return descend(by_id[0])


@pytest.fixture(scope="module")
def rows(spark):
    pick = random.Random(1)
    data = [(pick.choice([None, float("nan"), float("inf"), -1.0, 1.0, *[round(pick.uniform(-1, 1), 2)] * 9]),
             pick.choice([None, "no number", "0.25", *[str(round(pick.uniform(-1, 1), 2))] * 9]), pick.choice([None, *KINDS]))
            for _ in range(3000)]
    return spark.createDataFrame(data, "x double, t string, `c.d` string").repartition(4).cache()


def test_equal_to_nested_conditions(rows):
    pick = random.Random(2)
    for _ in range(12):
        nodes = grown(pick, pick.randrange(1, 6))
        wrong = rows.filter(~stop_node(nodes).eqNullSafe(nested(nodes)))
        assert wrong.count() == 0
    assert rows.filter(stop_node([TreeNode(0)]) != 0).count() == 0


def test_reports_of_no_rows_and_of_rows_that_stop_early(rows):
    nodes = [TreeNode(0, left=1, right=2, feature="x", threshold=0.0), TreeNode(1), TreeNode(2)]
    report = {r.node_id: r.n for r in node_report(rows, nodes, "t").collect()}
    assert report[0] == 3000 and report[1] + report[2] == rows.filter("x is not null").count()
    assert {r.n for r in node_report(rows.limit(0), nodes, "t").collect()} == {0}
    assert node_class_counts(rows.limit(0), nodes, "t").count() == 0


def test_deep_trees_cost_their_depth(spark):
    x = np.random.default_rng(1).uniform(-1, 1, (200_000, 1))

    def seconds(depth):
        """A full tree that halves the interval at each level."""
        nodes, queue = [], [(0, -1.0, 1.0, 0)]
        used = 0
        for own, low, high, level in queue:
            if level == depth:
                nodes.append(TreeNode(own))
                continue
            middle = (low + high) / 2
            nodes.append(TreeNode(own, left=used + 1, right=used + 2, feature="x", threshold=middle))
            queue += [(used + 1, low, middle, level + 1), (used + 2, middle, high, level + 1)]
            used += 2
        tree = NodeArrays.of(nodes)
        best = min(_timed(lambda: tree.stops(x)) for _ in range(3))
        leaf = {n.id for n in nodes if n.leaf}
        assert set(tree.stops(x[:1000]).tolist()) <= leaf
        return best

    assert seconds(14) < 10 * seconds(5)  # 512 times the nodes, 2.8 times the depth


def _timed(run):
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def test_rules_of_a_forest_follow_its_nodes(spark):
    pick = random.Random(4)
    forest = [[replace(n, tree=t, prediction=float(n.id)) for n in grown(pick, depth, 1)] for t, depth in enumerate((0, 3, 8))]
    expected = set()
    for nodes in forest:
        by_id = {n.id: n for n in nodes}

        def walk(n, path):
            if n.leaf:
                expected.add((n.tree, n.id, len(path), " AND ".join(path), str(float(n.id))))
                return
            left, right = n.condition_texts()
            walk(by_id[n.left], [*path, left])
            walk(by_id[n.right], [*path, right])

        walk(by_id[0], [])
    found = rules_table(spark, [n for nodes in forest for n in nodes]).collect()
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)
