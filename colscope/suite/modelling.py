"""Tree models: preparation, quality, explanation, training and scoring."""

import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import explain as ex
from ..operators import trees as tr
from ..operators.score import score
from ..session import shared_folder, small_table
from .registry import query, r6, table

# --- preparation ---------------------------------------------------------------------------------------------


def _few(column: str, values: int) -> str:
    return f"typeof(any_value({column})) = 'VARCHAR' OR count(DISTINCT {column}) < {values}"


_KIND_COLUMNS = ["l_quantity", "l_discount", "l_orderkey", "l_linenumber", "l_returnflag"]


@query("feature_kinds", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {_few(c, 20)} AS categorical FROM lineitem" for c in _KIND_COLUMNS))
def feature_kinds(spark, folder):
    categorical, _ = tr.split_features(table(spark, folder, "lineitem"), _KIND_COLUMNS)
    return small_table(spark, [{"column": c, "categorical": c in categorical} for c in _KIND_COLUMNS],
                       pa.schema([("column", pa.string()), ("categorical", pa.bool_())]))


@query("category_indexes", """
    SELECT p_brand AS value, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS index, count(*) AS n
    FROM part GROUP BY 1""")
def category_indexes(spark, folder):
    return tr.index_values(table(spark, folder, "part"), "p_brand")


@query("category_indexes_fitted", """
    SELECT o_orderkey, cast(i.index AS double) AS priority_index FROM orders JOIN (
        SELECT o_orderpriority AS v, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS index
        FROM orders GROUP BY 1) i ON o_orderpriority = i.v""")
def category_indexes_fitted(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    indexed = tr.index_categories(df, ["o_orderpriority"]).transform(df)
    return indexed.select("o_orderkey", F.col("o_orderpriority__index").alias("priority_index"))


@query("assembled_features", """
    SELECT l_orderkey, l_linenumber, cast(place AS double) AS f0, cast(l_quantity AS double) AS f1, cast(l_tax AS double) AS f2
    FROM lineitem JOIN (SELECT l_returnflag AS flag, row_number() OVER (ORDER BY count(*) DESC, l_returnflag) - 1 AS place
                        FROM lineitem GROUP BY 1) ON l_returnflag = flag""")
def assembled_features(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_tax")
    indexed = tr.index_categories(df, ["l_returnflag"]).transform(df)
    rows = tr.assemble(["l_returnflag"], ["l_quantity", "l_tax"]).transform(indexed)
    parts = vector_to_array("__features")
    return rows.select("l_orderkey", "l_linenumber", *[parts[i].alias(f"f{i}") for i in range(3)])


_TASKS = [("l_returnflag", tr.TREE, 11), ("l_extendedprice", tr.TREE, 11), ("l_linenumber", tr.TREE, 11),
          ("l_linenumber", tr.BOOSTED, 3)]


@query("task_kinds", " UNION ALL ".join(
    f"SELECT '{c}' AS label, '{a}' AS algorithm, CASE WHEN {_few(c, n)} THEN 'classification' ELSE 'regression' END AS kind FROM lineitem"
    for c, a, n in _TASKS))
def task_kinds(spark, folder):
    df = table(spark, folder, "lineitem")
    rows = [{"label": c, "algorithm": a, "kind": tr.task_kind(df, c, a)} for c, a, _ in _TASKS]
    return small_table(spark, rows, pa.schema([(c, pa.string()) for c in ("label", "algorithm", "kind")]))


# --- quality, on predictions made by rule --------------------------------------------------------------------

PREDICTED_SQL = """
    SELECT l_returnflag AS label, CASE WHEN l_quantity > 35 THEN 'A' WHEN l_tax > 0.04 THEN 'N' WHEN l_discount < 0.01 THEN 'Z'
                                       ELSE 'R' END AS prediction FROM lineitem"""


def predicted(spark, folder):
    guess = (F.when(F.col("l_quantity") > 35, "A").when(F.col("l_tax") > 0.04, "N").when(F.col("l_discount") < 0.01, "Z")
             .otherwise("R"))
    return table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("label"), guess.alias("prediction"))


@query("classification_error", f"SELECT round(avg((label <> prediction)::int), 6) AS error FROM ({PREDICTED_SQL})")
def classification_error(spark, folder):
    return ev.classification_error(predicted(spark, folder), "label", "prediction").select(r6("error"))


@query("regression_error", """
    SELECT round(sqrt(avg(pow(l_quantity * 2000 - l_extendedprice, 2))), 4) AS error FROM lineitem""")
def regression_error(spark, folder):
    df = table(spark, folder, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 2000).alias("guess"))
    return ev.regression_error(df, "l_extendedprice", "guess").select(F.round("error", 4).alias("error"))


_LABELS_SQL = f"""
    WITH p AS ({PREDICTED_SQL}), t AS (SELECT count(*) AS total FROM p),
    m AS (SELECT l.label, (SELECT count(*) FROM p WHERE p.label = l.label) AS actual,
                 (SELECT count(*) FROM p WHERE prediction = l.label) AS predicted,
                 (SELECT count(*) FROM p WHERE p.label = l.label AND prediction = l.label) AS hits
          FROM (SELECT DISTINCT label FROM p) l),
    q AS (SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS precision, hits / actual AS recall,
                 coalesce((predicted - hits) / nullif(total - actual, 0), 0) AS false_positive_rate FROM m, t),
    f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM q)"""


@query("label_metrics", _LABELS_SQL + """
    SELECT label, actual, predicted, hits, round(precision, 6) AS precision, round(recall, 6) AS recall,
           round(false_positive_rate, 6) AS false_positive_rate, round(f1, 6) AS f1 FROM f""")
def label_metrics(spark, folder):
    rows = ev.label_metrics(ev.confusion_counts(predicted(spark, folder), "label", "prediction"))
    return rows.withColumns({c: r6(F.col(c)) for c in ("precision", "recall", "false_positive_rate", "f1")})


@query("overall_metrics", _LABELS_SQL + """
    SELECT round(sum(hits) / sum(actual), 6) AS accuracy, round(sum(precision * actual) / sum(actual), 6) AS weighted_precision,
           round(sum(recall * actual) / sum(actual), 6) AS weighted_recall,
           round(sum(false_positive_rate * actual) / sum(actual), 6) AS weighted_false_positive_rate,
           round(sum(f1 * actual) / sum(actual), 6) AS weighted_f1 FROM f""")
def overall_metrics(spark, folder):
    rows = ev.overall_metrics(ev.label_metrics(ev.confusion_counts(predicted(spark, folder), "label", "prediction")))
    return rows.select(*[r6(c) for c in rows.columns])


@query("confusion_matrix", f"""
    WITH p AS ({PREDICTED_SQL}), l AS (SELECT DISTINCT label FROM p)
    SELECT a.label, b.label AS prediction, (SELECT count(*) FROM p WHERE p.label = a.label AND p.prediction = b.label) AS n
    FROM l a CROSS JOIN l b""")
def confusion_matrix(spark, folder):
    return ev.confusion_matrix(ev.confusion_counts(predicted(spark, folder), "label", "prediction"))


# --- explanation, on a tree given as data --------------------------------------------------------------------

TREE = [
    ex.TreeNode(0, 0, 1, 4, "l_quantity", 24.5), ex.TreeNode(1, 1, 2, 3, "l_linestatus", categories=("F",)),
    ex.TreeNode(2, 0), ex.TreeNode(3, 2), ex.TreeNode(4, 0, 5, 6, "l_discount", 0.055), ex.TreeNode(5, 1),
    ex.TreeNode(6, 2, 7, 8, "l_linenumber", categories=("1", "3", "5")), ex.TreeNode(7, 0), ex.TreeNode(8, 1),
]
_PATHS = {0: "1 = 1", 1: "l_quantity <= 24.5", 2: "l_quantity <= 24.5 AND l_linestatus IN ('F')",
          3: "l_quantity <= 24.5 AND l_linestatus NOT IN ('F')", 4: "l_quantity > 24.5",
          5: "l_quantity > 24.5 AND l_discount <= 0.055", 6: "l_quantity > 24.5 AND l_discount > 0.055",
          7: "l_quantity > 24.5 AND l_discount > 0.055 AND l_linenumber IN (1, 3, 5)",
          8: "l_quantity > 24.5 AND l_discount > 0.055 AND l_linenumber NOT IN (1, 3, 5)"}
_PARENT = {1: 0, 4: 0, 2: 1, 3: 1, 5: 4, 6: 4, 7: 6, 8: 6}
_CONDITION = {1: "l_quantity <= 24.5", 4: "l_quantity > 24.5", 2: "l_linestatus IN ('F')", 3: "l_linestatus NOT IN ('F')",
              5: "l_discount <= 0.055", 6: "l_discount > 0.055", 7: "l_linenumber IN ('1','3','5')",
              8: "l_linenumber NOT IN ('1','3','5')"}
HOLES_SQL = """SELECT l_linestatus, l_linenumber, l_returnflag, l_extendedprice, nullif(l_quantity, 10) AS l_quantity,
    nullif(l_discount, 0.07) AS l_discount FROM lineitem"""


def _holes(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_linestatus", "l_linenumber", "l_returnflag", "l_extendedprice",
        F.nullif(F.col("l_quantity"), F.lit(10.0)).alias("l_quantity"),
        F.nullif(F.col("l_discount"), F.lit(0.07)).alias("l_discount"))


_NODE_VALUES = ", ".join(
    f"({n.id}, {n.left if not n.leaf else 'NULL'}, {n.right if not n.leaf else 'NULL'}, "
    + (f"'{n.feature}', {'NULL' if n.threshold is None else n.threshold}, "
       f"{'NULL' if n.categories is None else list(n.categories)}, " if not n.leaf else "NULL, NULL, NULL, ")
    + f"{n.prediction})" for n in TREE)


@query("tree_rules_with_rows", f"""
    WITH RECURSIVE nodes(id, l, r, feature, threshold, categories, prediction) AS (VALUES {_NODE_VALUES}),
    links AS (
      SELECT id, l AS child, CASE WHEN categories IS NULL THEN feature || ' <= ' || threshold::DOUBLE
        ELSE feature || ' IN (' || array_to_string(list_transform(categories, lambda c: chr(39) || c || chr(39)), ',') || ')' END AS condition
      FROM nodes WHERE l IS NOT NULL
      UNION ALL
      SELECT id, r, CASE WHEN categories IS NULL THEN feature || ' > ' || threshold::DOUBLE
        ELSE feature || ' NOT IN (' || array_to_string(list_transform(categories, lambda c: chr(39) || c || chr(39)), ',') || ')' END
      FROM nodes WHERE r IS NOT NULL),
    paths(id, depth, rule) AS (
      SELECT 0, 0, '' UNION ALL
      SELECT child, depth + 1, CASE WHEN rule = '' THEN condition ELSE rule || ' AND ' || condition END FROM paths JOIN links USING (id)),
    src AS ({HOLES_SQL}),
    stops AS ({" UNION ALL ".join(f"SELECT {i} AS id, count(*) AS n FROM src WHERE {p}" for i, p in _PATHS.items())})
    SELECT id AS node_id, depth, rule, ['a', 'b', 'c'][prediction + 1] AS outcome, n
    FROM paths JOIN nodes USING (id) JOIN stops USING (id) WHERE l IS NULL""")
def tree_rules_with_rows(spark, folder):
    """The rules of a tree, by its node table alone, with the rows that end in each."""
    rules = ex.rules_table(spark, TREE, ["a", "b", "c"])
    stops = _holes(spark, folder).groupBy(ex.stop_node(TREE).alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    return rules.join(stops, "node_id", "left").select("node_id", "depth", "rule", "outcome", F.coalesce("n", F.lit(0)).alias("n"))


@query("tree_node_class_counts", f"WITH src AS ({HOLES_SQL}) " + " UNION ALL ".join(
    f"""SELECT {i} AS node_id, l_returnflag AS label, count(*) AS n, round(count(*) * 100.0::double / (SELECT count(*) FROM src WHERE {p}), 6) AS percentage
        FROM src WHERE {p} GROUP BY 2""" for i, p in _PATHS.items()))
def tree_node_class_counts(spark, folder):
    counts = ex.node_class_counts(_holes(spark, folder), TREE, "l_returnflag")
    return counts.withColumn("percentage", r6("percentage"))


def _report_sql(extra: str) -> str:
    def text(v) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"WITH src AS ({HOLES_SQL}) " + " UNION ALL ".join(
        f"""SELECT {i} AS node_id, cast({_PARENT.get(i, 'NULL')} AS integer) AS parent_id, {text(_CONDITION.get(i))} AS split_condition,
            count(*) AS n, round(count(*)::double / {f'(SELECT count(*) FROM src WHERE {_PATHS[_PARENT[i]]})' if i else 1}, 6) AS link_weight
            {extra} FROM src WHERE {p}""" for i, p in _PATHS.items())


@query("tree_node_report", _report_sql(""))
def tree_node_report(spark, folder):
    return ex.node_report(_holes(spark, folder), TREE, "l_returnflag").withColumn("link_weight", r6("link_weight"))


@query("tree_node_report_regression", _report_sql(
    ", round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS median"))
def tree_node_report_regression(spark, folder):
    report = ex.node_report(_holes(spark, folder), TREE, "l_extendedprice", tr.REGRESSION, exact_median=True)
    return report.withColumns({"link_weight": r6("link_weight"), "mean": F.round("mean", 4), "median": F.round("median", 4)})


@query("tree_node_report_regression_sketched")
def tree_node_report_regression_sketched(spark, folder):
    return ex.node_report(_holes(spark, folder), TREE, "l_extendedprice", tr.REGRESSION)


@query("tree_leaf_of_rows", f"""
    SELECT node_id, count(*) AS n FROM (SELECT CASE {' '.join(f'WHEN {_PATHS[i]} THEN {i}' for i in (7, 8, 6, 5, 4, 3, 2, 1))}
        ELSE 0 END AS node_id FROM ({HOLES_SQL})) GROUP BY 1""")
def tree_leaf_of_rows(spark, folder):
    return _holes(spark, folder).groupBy(ex.stop_node(TREE).alias("node_id")).agg(F.count(F.lit(1)).alias("n"))


# --- training and scoring ------------------------------------------------------------------------------------

_INPUTS = ["l_quantity", "l_extendedprice", "l_discount", "l_linestatus"]
_CLASSIFY = {"features": _INPUTS, "label": "l_returnflag", "max_depth": 3}
_REGRESS = {"features": ["l_quantity", "l_discount", "l_linestatus"], "label": "l_extendedprice", "max_depth": 3}


# The test tables come as one row group, so training deals them out to this many tasks.
_PARTITIONS = 8


def _scored(spark, folder, name="lineitem", source=None, **settings):
    df = source if source is not None else table(spark, folder, name)
    model, _, _ = tr.fit(df, tr.TreeSettings(partitions=_PARTITIONS, **settings))
    return model, score(df, model, "predicted", keep=[settings["label"]])


@query("decision_tree_classifier")
def decision_tree_classifier(spark, folder):
    return _scored(spark, folder, impurity="entropy", **_CLASSIFY)[1]


@query("decision_tree_regressor")
def decision_tree_regressor(spark, folder):
    return _scored(spark, folder, **_REGRESS)[1]


@query("random_forest_classifier")
def random_forest_classifier(spark, folder):
    return _scored(spark, folder, algorithm=tr.FOREST, trees=5, feature_subset="Auto", **_CLASSIFY)[1]


@query("random_forest_regressor")
def random_forest_regressor(spark, folder):
    return _scored(spark, folder, algorithm=tr.FOREST, trees=5, **_REGRESS)[1]


def _quality_rows(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, folder, "labels"), "doc_id")


@query("boosted_trees_classifier")
def boosted_trees_classifier(spark, folder):
    """Learned from the labelled documents, applied to all."""
    settings = tr.TreeSettings(algorithm=tr.BOOSTED, features=["n_chars", "lang", "source"], label="quality", iterations=3, max_depth=3)
    model, _, _ = tr.fit(_quality_rows(spark, folder), settings)
    return score(table(spark, folder, "documents"), model, "predicted", keep=["doc_id"])


@query("boosted_trees_regressor")
def boosted_trees_regressor(spark, folder):
    """All rounds of boosting, each tree at full depth."""
    return _scored(spark, folder, algorithm=tr.BOOSTED, max_bins=64, **{**_REGRESS, "iterations": 20, "max_depth": 5})[1]


@query("cross_validated_grid")
def cross_validated_grid(spark, folder):
    """Mean accuracy of each candidate depth."""
    settings = tr.TreeSettings(**_CLASSIFY, folds=3, grid={"maxDepth": [2, 3]}, partitions=_PARTITIONS)
    model, _, _ = tr.fit(table(spark, folder, "lineitem"), settings)
    return spark.createDataFrame([(d, float(m)) for d, m in zip((2, 3), model.model.avgMetrics)], "max_depth int, accuracy double")


@query("tree_nodes_of_model")
def tree_nodes_of_model(spark, folder):
    model, _ = _scored(spark, folder, **_CLASSIFY)
    return ex.node_table(spark, model.estimator)


@query("tree_rules_of_model")
def tree_rules_of_model(spark, folder):
    model, _ = _scored(spark, folder, **_CLASSIFY)
    return ex.rules_table(spark, ex.nodes_of(spark, model), model.class_labels)


@query("forest_rules_of_model")
def forest_rules_of_model(spark, folder):
    model, _ = _scored(spark, folder, algorithm=tr.FOREST, trees=3, **_CLASSIFY)
    return ex.rules_table(spark, ex.nodes_of(spark, model), model.class_labels)


@query("variable_importance")
def variable_importance(spark, folder):
    model, _ = _scored(spark, folder, **_CLASSIFY)
    return tr.variable_importance(model, spark)


@query("saved_model_scores")
def saved_model_scores(spark, folder):
    """Scores of a model that was saved and loaded again, with its class probabilities."""
    df = table(spark, folder, "lineitem")
    model, _, _ = tr.fit(df, tr.TreeSettings(partitions=_PARTITIONS, **_CLASSIFY))
    path = shared_folder(spark, "model")
    tr.save_model(model, path)
    return score(df, tr.load_model(path, "l_returnflag"), "predicted", keep=["l_orderkey", "l_linenumber"], classes=None)


# --- models of an exact rule: what they predict can be said in SQL -------------------------------------------

_RULE = "CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END"
_VALUE = "10 * floor(l_quantity / 4) + CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END"
_KEYS = ["l_orderkey", "l_linenumber"]


def _rule_rows(spark, folder):
    return table(spark, folder, "lineitem").select(
        *_KEYS, "l_quantity", "l_discount", "l_linestatus", F.expr(_RULE).alias("size"), F.expr(_VALUE).alias("value"))


def _fit_rule(spark, folder, label="size", **settings):
    df = _rule_rows(spark, folder)
    features = ["l_quantity", "l_discount"] if label == "size" else ["l_quantity", "l_linestatus"]
    model, _, _ = tr.fit(df, tr.TreeSettings(features=features, label=label, train=100, test=0, max_bins=64,
                                             partitions=_PARTITIONS, **settings))
    return df, model


def _predicted_rule(spark, folder, **settings):
    df, model = _fit_rule(spark, folder, **settings)
    return score(df, model, "predicted", keep=_KEYS).select(*_KEYS, "predicted")


_RULE_SQL = f"SELECT l_orderkey, l_linenumber, {_RULE} AS predicted FROM lineitem"
_VALUE_SQL = f"SELECT l_orderkey, l_linenumber, round(cast({_VALUE} AS double), 6) AS predicted FROM lineitem"


@query("exact_rule_tree", _RULE_SQL)
def exact_rule_tree(spark, folder):
    return _predicted_rule(spark, folder, max_depth=2)


@query("exact_rule_forest", _RULE_SQL)
def exact_rule_forest(spark, folder):
    return _predicted_rule(spark, folder, algorithm=tr.FOREST, trees=3, feature_subset="all", max_depth=2)


@query("exact_rule_boosted", _RULE_SQL)
def exact_rule_boosted(spark, folder):
    return _predicted_rule(spark, folder, algorithm=tr.BOOSTED, iterations=2, max_depth=2)


@query("exact_rule_regression_tree", _VALUE_SQL)
def exact_rule_regression_tree(spark, folder):
    return _predicted_rule(spark, folder, label="value", max_depth=8).withColumn("predicted", r6("predicted"))


@query("exact_rule_saved_scores", f"""
    WITH r AS (SELECT l_orderkey, l_linenumber, {_RULE} AS size FROM lineitem),
    top AS (SELECT size AS first FROM r GROUP BY 1 ORDER BY count(*) DESC, size LIMIT 1)
    SELECT l_orderkey, l_linenumber, (size = first)::int::double AS predicted_1, (size <> first)::int::double AS predicted_2,
           size AS predicted FROM r, top""")
def exact_rule_saved_scores(spark, folder):
    """Labels and class probabilities of a model that was saved and loaded again."""
    df, model = _fit_rule(spark, folder, max_depth=2)
    path = shared_folder(spark, "model")
    tr.save_model(model, path)
    scored = score(df, tr.load_model(path, "size"), "predicted", keep=_KEYS)
    return scored.select(*_KEYS, "predicted_1", "predicted_2", "predicted")


@query("exact_rule_importance", """
    SELECT * FROM (VALUES ('l_quantity', 1.0::double), ('l_discount', 0.0::double)) v(feature, importance) WHERE (SELECT count(*) FROM lineitem) > 0""")
def exact_rule_importance(spark, folder):
    _, model = _fit_rule(spark, folder, max_depth=2)
    return tr.variable_importance(model, spark)


@query("train_test_parts", """
    SELECT count(*) AS rows, 0::BIGINT AS in_both, 0::BIGINT AS in_none, true AS share_as_asked
    FROM lineitem WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL""")
def train_test_parts(spark, folder):
    """The parts that training returns: every row is in one of them, in about the shares that were asked for."""
    df = table(spark, folder, "lineitem")
    _, train, test = tr.fit(df, tr.TreeSettings(["l_quantity"], "l_returnflag", max_depth=1, key=tuple(_KEYS), partitions=_PARTITIONS))
    flags = ("source", "train", "test")
    parts = [d.select(*_KEYS, *[F.lit(int(f == name)).alias(f) for f in flags]) for d, name in zip((df, train, test), flags)]
    each = parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy(*_KEYS).agg(*[F.sum(f).alias(f) for f in flags])
    share = F.sum("train") / F.sum("source")
    return each.agg(F.sum("source").alias("rows"), F.count_if((F.col("train") > 0) & (F.col("test") > 0)).alias("in_both"),
                    F.sum(F.abs(F.col("source") - F.col("train") - F.col("test"))).alias("in_none"),
                    share.between(0.75, 0.85).alias("share_as_asked"))
