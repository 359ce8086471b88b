"""Training, explaining, scoring and anomaly detection."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.operators import anomaly as an
from colscope.operators import explain as ex
from colscope.operators import trees as tr
from colscope.operators.score import score
from colscope.operators.split import bernoulli_sample, hash_split, modulo_split, random_split, unit
from colscope.plans import model_report
from colscope.suite import QUERIES


@pytest.fixture(scope="module")
def points(spark):
    x, c = F.col("id") % 100, F.when(F.col("id") % 3 == 0, "red").otherwise("blue")
    label = F.when((x > 50) & (c == "red"), "yes").otherwise("no")
    return spark.range(2000).select("id", x.cast("double").alias("x"), c.alias("c"), label.alias("y"),
                                    (x * 2 + F.when(c == "red", 500).otherwise(0)).cast("double").alias("z")).cache()


@pytest.fixture(scope="module")
def classifier(points):
    return tr.fit(points, tr.TreeSettings(["x", "c"], "y", max_depth=3, max_bins=128))[0]


def test_kinds(points):
    assert tr.split_features(points, ["x", "c"]) == (["c"], ["x"])
    assert tr.split_features(points, ["x", "c"], 101) == (["x", "c"], [])
    assert [tr.task_kind(points, c) for c in ("y", "z", "x")] == ["classification", "regression", "regression"]


def test_tree_learns_the_rule(points, classifier):
    scored = score(points, classifier, "guess", keep=["id", "y"])
    assert scored.columns == ["id", "y", "c", "x", "guess_1", "guess_2", "guess"]
    assert scored.filter("guess <> y").count() == 0 and scored.count() == 2000


def test_saved_model_scores_the_same(spark, points, classifier, tmp_path):
    tr.save_model(classifier, str(tmp_path / "model"))
    loaded = tr.load_model(str(tmp_path / "model"), "y")
    assert (loaded.features, loaded.class_labels, loaded.feature_labels, loaded.kind) == (
        classifier.features, classifier.class_labels, classifier.feature_labels, classifier.kind)
    new = spark.createDataFrame([(1, 60.0, "red"), (2, 60.0, "green"), (3, None, "red")], "id int, x double, c string")
    assert {r.id: r.y for r in score(new, loaded, keep=["id"]).collect()}.keys() == {1, 2}
    assert score(new, loaded, keep=["id"]).filter("id = 1").first().y == "yes"


def test_rows_follow_the_models_own_tree(spark, points, classifier):
    nodes = ex.nodes_of(spark, classifier)
    rules = {r.node_id: r.outcome for r in ex.rules_table(spark, nodes, classifier.class_labels).collect()}
    predicted = score(points, classifier, "guess", keep=["id"])
    routed = predicted.select("guess", ex.stop_node(nodes).alias("node")).distinct().collect()
    assert all(rules[r.node] == r.guess for r in routed)
    report = {r.node_id: r for r in ex.node_report(points, nodes, "y").collect()}
    assert report[0].n == 2000 and report[0].link_weight == 2000.0
    assert all(r.link_weight == r.n / report[r.parent_id].n for r in report.values() if r.parent_id is not None)


def test_regression_report(points):
    model, report = model_report(points, tr.TreeSettings(["x", "c"], "z", max_depth=4))
    assert model.kind == tr.REGRESSION
    assert set(report) == {"train_error", "test_error", "importance", "rules", "nodes"}
    assert report["test_error"].first().error < 60
    root = report["nodes"].filter("node_id = 0").first()
    assert root["mean"] == pytest.approx(points.agg(F.avg("z")).first()[0])
    assert [r.feature for r in report["importance"].collect()] == ["c", "x"]


def test_no_test_part(points):
    _, report = model_report(points, tr.TreeSettings(["x", "c"], "y", max_depth=2, max_bins=128, train=100, test=0))
    assert "test_error" not in report and report["train_error"].first().error == 0.0


def test_limits_are_checked_up_front(points):
    with pytest.raises(ValueError, match="max_bins"):
        tr.fit(points.withColumn("id", F.col("id").cast("string")), tr.TreeSettings(["id"], "y"))
    with pytest.raises(ValueError, match="classes"):
        tr.fit(points.withColumn("l", (F.col("id") % 3).cast("string")), tr.TreeSettings(["x"], "l", algorithm=tr.BOOSTED))


def test_splits(points):
    for train, test in (hash_split(points, ["id"], 80), modulo_split(points, "id", 80), random_split(points, 80, 20)):
        assert train.count() + test.count() == 2000 and 1500 < train.count() < 1700
        assert train.join(test, "id").count() == 0


def test_test_rows_were_not_trained_on(spark):
    """Also after a sort-merge join, whose rows lie elsewhere each time, and on any number of partitions."""
    left = spark.range(4000).select(F.col("id"), F.sin("id").alias("x"))
    right = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("y"))
    df = left.join(right.hint("merge"), "id")
    parts = []
    for n in (1, 2, 8):
        _, train, test = tr.fit(df.repartition(n), tr.TreeSettings(["x"], "y", max_depth=1, key=("id",)))
        parts.append((sorted(r.id for r in train.select("id").collect()), sorted(r.id for r in test.select("id").collect())))
        assert not set(parts[-1][0]) & set(parts[-1][1]) and len(parts[-1][0]) + len(parts[-1][1]) == 4000
    assert parts[0] == parts[1] == parts[2] and 3000 < len(parts[0][0]) < 3400


def test_no_task_gets_more_rows_than_its_share(points):
    for per_part, parts in ((500, 4), (500_000, 2)):
        settings = tr.TreeSettings(["x"], "y", max_depth=1, key=("id",), partitions=2, rows_per_partition=per_part)
        _, train, _ = tr.fit(points.coalesce(1), settings)
        assert train.rdd.getNumPartitions() == parts
        assert max(train.rdd.glom().map(len).collect()) <= 2000 / parts


def test_large_pieces_are_dealt_out_without_being_asked(points):
    for per_part, pieces, parts in ((500, 1, 4), (1900, 1, 2), (500, 3, 4), (500, 8, 8), (500_000, 1, 1)):
        settings = tr.TreeSettings(["x"], "y", max_depth=1, key=("id",), rows_per_partition=per_part)
        _, train, test = tr.fit(points.repartition(pieces), settings)
        assert train.rdd.getNumPartitions() == parts
        assert max(train.rdd.glom().map(len).collect()) <= per_part
        assert sorted(r.id for d in (train, test) for r in d.select("id").collect()) == list(range(2000))


def test_boosted_regressor_runs_all_rounds_at_full_depth(spark, tmp_path, monkeypatch):
    """Too few rounds, or too shallow trees, stay far from prices that go up and down with the quantity."""
    n = F.col("id")
    quantity, discount, status = (n % 50 + 1).cast("double"), n % 11 / 100, F.when(n % 3 == 0, "F").otherwise("O")
    price = 1000 * F.sin(quantity) + 20000 * discount + F.when(status == "F", 500).otherwise(0)
    spark.range(3300).select(quantity.alias("l_quantity"), discount.alias("l_discount"), status.alias("l_linestatus"),
                             price.alias("l_extendedprice")).write.parquet(f"{tmp_path}/lineitem.parquet")
    models, fit = [], tr.fit
    monkeypatch.setattr(tr, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    rows = QUERIES["boosted_trees_regressor"](spark, str(tmp_path))
    trees = models[0][0].estimator.trees
    assert len(trees) == 20 and {t.depth for t in trees} == {5}
    error = F.sqrt(F.avg((F.col("predicted") - F.col("l_extendedprice")) ** 2)) / F.stddev("l_extendedprice")
    count, share = rows.agg(F.count(F.lit(1)), error).first()
    # 0.70 after 3 rounds of depth 3, 0.43 after 20 of them, 0.63 after 3 rounds of depth 5.
    assert count == 3300 and share < 0.3


def test_rows_without_a_key_are_training_rows(spark):
    df = spark.createDataFrame([(1,), (None,), (95,)], "k int")
    train, test = modulo_split(df, "k", 80)
    assert sorted(r.k or 0 for r in train.collect()) == [0, 1] and [r.k for r in test.collect()] == [95]


def path_length(nodes, row):
    node, depth = 0, 0
    while nodes[node]["left"] >= 0:
        n = nodes[node]
        node, depth = (n["left"] if row[n["feature"]] < n["threshold"] else n["right"]), depth + 1
    size = nodes[node]["size"]
    return depth + (an.average_path(size) if size > 1 else 0.0)


def test_scores_match_walking_the_trees(spark):
    df = spark.range(3000).select("id", F.sin("id").alias("a"), F.when(F.col("id") == 5, 40.0).otherwise(F.cos("id")).alias("b"))
    table = an.build_forest(df, ["a", "b"], trees=10)
    trees = {}
    for r in table.collect():
        trees.setdefault(r.tree, {})[r.node] = r.asDict()
    assert len(trees) == 10 and all(150 < t[0]["sample"] < 400 for t in trees.values())
    forest = an.collect_forest(table)
    rows = df.select("id", "a", "b", an.anomaly_score(forest, an.feature_columns(df, ["a", "b"])).alias("s")).filter("id < 200").collect()
    sample = np.mean([t[0]["sample"] for t in trees.values()])
    for r in rows:
        mean = np.mean([path_length(t, (r.a, r.b)) for t in trees.values()])
        assert r.s == pytest.approx(2 ** (-mean / an.average_path(sample)))
    # The lone point far out shows in every tree that happened to sample it, and never scores low.
    assert sorted(r.s for r in rows)[-40] <= next(r.s for r in rows if r.id == 5)


@pytest.mark.parametrize("rows", [300, 5_000, 120_000])
def test_sample_size_does_not_depend_on_the_number_of_rows(spark, rows):
    df = spark.range(rows).select(F.col("id").cast("double").alias("f0"))
    drawn = an.sample_for_trees(df, 40, 256, 1)
    sizes = [r["count"] for r in drawn.groupBy("tree").count().collect()]
    assert len(sizes) == 40 and 185 < min(sizes) and max(sizes) < 330 and abs(np.mean(sizes) - 256) < 12
    assert drawn.groupBy("f0", "tree").count().filter("count > 1").count() == 0


def test_no_rows_have_no_scores(spark):
    assert an.score_anomalies(spark.createDataFrame([], "a double, b string"), ["a"], keep=["b"]).collect() == []


def test_forest_does_not_depend_on_partitioning_of_the_sample(spark):
    df = spark.range(200).select(F.sin("id").alias("a"))
    one = an.build_forest(df.coalesce(1), ["a"], trees=3).orderBy("tree", "node").collect()
    many = an.build_forest(df.repartition(7), ["a"], trees=3).orderBy("tree", "node").collect()
    assert one == many


def test_tiny_and_text_features(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "4")], "id int, v string")
    scored = an.score_anomalies(df, ["v"], trees=5, keep=["id"])
    assert scored.columns == ["anomaly_score", "id", "v"] and scored.count() == 3


def test_samples_and_forests_are_the_same_on_any_number_of_partitions(spark):
    df = spark.range(20_000).select("id", F.sin("id").alias("a.b"), (F.col("id") % 7).cast("string").alias("v"))
    samples, forests = set(), []
    for n in (1, 4, 8):
        own = df.repartition(n)
        samples.add(tuple(sorted(r.id for r in bernoulli_sample(own, 0.1, keys=["id"]).collect())))
        forests.append(an.build_forest(own, ["a.b", "v"], trees=5, keys=["id"]).orderBy("tree", "node").collect())
    assert len(samples) == 1 and 1800 < len(samples.pop()) < 2200
    assert forests[0] == forests[1] == forests[2]


def test_draws_are_even_and_differ_by_step_and_seed(spark):
    rows = spark.range(50_000).select(unit(["id"], 1).alias("a"), unit(["id"], 1, 1).alias("b"), unit(["id"], 2).alias("c"))
    values = rows.toPandas()
    assert abs(values.corr().to_numpy() - np.eye(3)).max() < 0.02
    for c in "abc":
        assert 0 < values[c].min() and values[c].max() < 1
        assert (abs(np.histogram(values[c], 20, (0, 1))[0] - 2500) < 250).all()


def test_nulls_and_repeated_keys_in_samples(spark):
    rows = [(None, 1.0), ("", 1.0), ("x", None)] + [("hot", 5.0)] * 3000 + [(str(i), float(i)) for i in range(6000)]
    df = spark.createDataFrame(rows, "key string, f0 double").repartition(4)
    drawn = an.sample_for_trees(df, 30, 256, 1, ["key"])
    assert drawn.groupBy("tree", "key").count().filter("count > 1").count() == 0
    sizes = [r["count"] for r in drawn.groupBy("tree").count().collect()]
    assert len(sizes) == 30 and max(sizes) < 300  # a key of a third of the rows is one row to a tree
    few = df.filter("key in ('', 'x') or key is null")
    assert an.sample_for_trees(few, 2, 256, 1, ["key"]).count() == 6
