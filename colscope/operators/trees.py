"""Training decision trees, random forests and gradient-boosted trees on tables."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from .clean import complete_rows
from .distinct import small_distinct_counts
from .split import TEST, TRAIN, with_part

PART = "__part"
TREE, FOREST, BOOSTED = "decision_tree", "random_forest", "gradient_boosted_trees"
CLASSIFICATION, REGRESSION = "classification", "regression"
# A numeric input with fewer values is a category; a numeric label with more is regressed.
CATEGORY_THRESHOLD = {TREE: 20, FOREST: 20, BOOSTED: 3}
MAX_LABEL_CLASSES = {TREE: 10, FOREST: 10, BOOSTED: 2}


@dataclass(frozen=True)
class TreeSettings:
    """What is trained, and how.

    ``key`` names the columns whose hash decides between training and test rows (the inputs and the label if there is
    none).  ``partitions`` deals the training rows out anew, for an input that comes in few large pieces.  With or without
    it, no task trains on more than ``rows_per_partition``: rows that lie in larger pieces are dealt out to more tasks.
    """

    features: list[str]
    label: str
    algorithm: str = TREE
    impurity: str | None = None
    max_bins: int = 32
    max_depth: int = 5
    min_instances: int = 1
    trees: int = 20
    feature_subset: str = "auto"
    max_classes: int = 100
    iterations: int = 20
    train: float = 80
    test: float = 20
    folds: int = 2
    seed: int = 1337
    parallelism: int = 2
    key: tuple[str, ...] = ()
    partitions: int | None = None
    rows_per_partition: int = 500_000
    grid: dict[str, list] = field(default_factory=dict)


@dataclass
class TreeModel:
    """A fitted cross-validated pipeline and what its features mean."""

    model: CrossValidatorModel
    kind: str
    label: str
    features: list[str]
    feature_labels: dict[str, list[str]]
    class_labels: list[str]

    @property
    def estimator(self):
        """The fitted tree model inside the pipeline."""
        return next(s for s in self.model.bestModel.stages if hasattr(s, "featureImportances"))


def is_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def split_features(df: DataFrame, columns: list[str], threshold: int = 20,
                   distinct: dict[str, int] | None = None) -> tuple[list[str], list[str]]:
    """(categorical, continuous) inputs: non-numbers, and numbers with fewer than ``threshold`` values.

    ``distinct`` may hold small distinct counts that are already known, complete up to the threshold.
    """
    numeric = [c for c in columns if is_number(df, c)]
    counts = small_distinct_counts(df, numeric, threshold) if distinct is None else distinct
    categorical = [c for c in columns if c not in numeric or counts.get(c, threshold) < threshold]
    return categorical, [c for c in columns if c not in categorical]


def task_kind(df: DataFrame, label: str, algorithm: str = TREE, distinct: dict[str, int] | None = None) -> str:
    """Regression for a numeric label with many values, classification otherwise."""
    most = MAX_LABEL_CLASSES[algorithm]
    counts = small_distinct_counts(df, [label], most + 1) if distinct is None else distinct
    return REGRESSION if is_number(df, label) and counts.get(label, most + 1) > most else CLASSIFICATION


def index_values(df: DataFrame, column: str, max_values: int = 1000) -> DataFrame:
    """(value, index, n): category indexes by descending frequency, ties by value."""
    if column not in small_distinct_counts(df, [column], max_values + 1):
        raise ValueError(f"{column} has more than {max_values} values")
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # At most max_values rows are ranked together.
    ranked = F.row_number().over(Window.orderBy(F.desc("n"), "value")) - 1
    return counts.filter(F.col("value").isNotNull()).select("value", ranked.cast("long").alias("index"), "n")


def index_categories(df: DataFrame, columns: list[str], suffix: str = "__index") -> StringIndexerModel:
    """Indexers of all categorical inputs, fitted in one pass; unseen values get an index of their own."""
    return StringIndexer(inputCols=columns, outputCols=[c + suffix for c in columns], handleInvalid="keep",
                         stringOrderType="frequencyDesc").fit(df)


def assemble(categorical: list[str], continuous: list[str], output: str = "__features",
             suffix: str = "__index") -> VectorAssembler:
    return VectorAssembler(inputCols=[c + suffix for c in categorical] + continuous, outputCol=output)


def _estimator(s: TreeSettings, kind: str):
    common = {"featuresCol": "__features", "labelCol": "__label", "maxBins": s.max_bins, "maxDepth": s.max_depth,
              "minInstancesPerNode": s.min_instances, "seed": s.seed}
    classify = kind == CLASSIFICATION
    impurity = s.impurity or ("gini" if classify else "variance")
    if s.algorithm == TREE:
        return (DecisionTreeClassifier if classify else DecisionTreeRegressor)(impurity=impurity, **common)
    if s.algorithm == FOREST:
        make = RandomForestClassifier if classify else RandomForestRegressor
        return make(impurity=impurity, numTrees=s.trees, featureSubsetStrategy=s.feature_subset.lower(), **common)
    return (GBTClassifier if classify else GBTRegressor)(maxIter=s.iterations, **common)


def _check_categories(distinct: dict[str, int], categorical: list[str], kind: str, s: TreeSettings) -> None:
    """Refuse unbounded categories before any of their values are gathered for indexing."""
    wide = [c for c in categorical if distinct.get(c, s.max_bins) >= s.max_bins]
    if wide:
        raise ValueError(f"max_bins={s.max_bins} is too small for the categories of {wide}")
    most = 2 if s.algorithm == BOOSTED else s.max_classes
    if kind == CLASSIFICATION and distinct.get(s.label, most + 1) > most:
        raise ValueError(f"label {s.label} has more than {most} classes")


def fit(df: DataFrame, s: TreeSettings) -> tuple[TreeModel, DataFrame, DataFrame]:
    """Train with k-fold cross-validation; returns the model and its training and test rows.

    The part of a row is a column made from a hash, so the returned rows are those that were and were not trained on,
    also when they are computed again.
    """
    inputs = [*s.features, s.label]
    data = complete_rows(df, inputs) if not s.key else df.select(
        *dict.fromkeys([*inputs, *s.key])).na.drop(subset=inputs)
    data = with_part(data, list(s.key) or inputs, s.train, s.test, s.seed, PART)
    parts = _parts(df, s)
    data = (data.repartition(parts) if parts else data).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit(data, s)
    finally:
        data.unpersist()


def _parts(df: DataFrame, s: TreeSettings) -> int | None:
    """Tasks to deal rows out to, None to leave them where they lie.

    Training keeps what it makes of a task's rows, several times over, as one block.
    """
    pieces = df.groupBy(F.spark_partition_id().alias("piece")).agg(F.count(F.lit(1)).alias("rows"))
    n, rows, most = pieces.agg(F.count(F.lit(1)), F.sum("rows"), F.max("rows")).first()
    if not s.partitions and (most or 0) <= s.rows_per_partition:
        return None
    return max(s.partitions or n, math.ceil((rows or 0) / s.rows_per_partition))


def _fit(data: DataFrame, s: TreeSettings) -> tuple[TreeModel, DataFrame, DataFrame]:
    enough = max(s.max_bins, s.max_classes + 1, CATEGORY_THRESHOLD[s.algorithm], MAX_LABEL_CLASSES[s.algorithm] + 1)
    distinct = small_distinct_counts(data, [*s.features, s.label], enough)
    kind = task_kind(data, s.label, s.algorithm, distinct)
    categorical, continuous = split_features(data, s.features, CATEGORY_THRESHOLD[s.algorithm], distinct)
    _check_categories(distinct, categorical, kind, s)
    stages, feature_labels, class_labels = [], {}, []
    if categorical:
        indexer = index_categories(data, categorical)
        feature_labels = {c: list(labels) for c, labels in zip(categorical, indexer.labelsArray)}
        stages.append(indexer)
    stages.append(assemble(categorical, continuous))
    if kind == CLASSIFICATION:
        # Fitted on all rows, so that no fold meets a class it has not seen.
        label_indexer = StringIndexer(inputCol=s.label, outputCol="__label").fit(data)
        class_labels = list(label_indexer.labels)
        labelled = label_indexer.transform(data)
    else:
        labelled = data.withColumn("__label", F.col(s.label).cast("double"))
    train, test = labelled.filter(F.col(PART) == TRAIN), labelled.filter(F.col(PART) == TEST)
    estimator = _estimator(s, kind)
    stages.append(estimator)
    if kind == CLASSIFICATION:
        stages.append(IndexToString(inputCol="prediction", outputCol="predictedLabel", labels=class_labels))
        evaluator = MulticlassClassificationEvaluator(labelCol="__label", metricName="accuracy")
    else:
        evaluator = RegressionEvaluator(labelCol="__label", metricName="rmse")
    grid = ParamGridBuilder()
    for name, values in s.grid.items():
        grid = grid.addGrid(estimator.getParam(name), values)
    validator = CrossValidator(estimator=Pipeline(stages=stages), estimatorParamMaps=grid.build(), evaluator=evaluator,
                               numFolds=max(2, s.folds), seed=s.seed, parallelism=s.parallelism)
    # Folds keep copies of their rows; only what the stages read goes into them.
    model = validator.fit(train.select(*s.features, "__label"))
    return TreeModel(model, kind, s.label, categorical + continuous, feature_labels, class_labels), train, test


def save_model(model: TreeModel, path: str) -> None:
    model.model.write().overwrite().save(path)


def load_model(path: str, label: str) -> TreeModel:
    """Load a saved model; what its features mean is read from its own pipeline stages."""
    loaded = CrossValidatorModel.load(path)
    feature_labels: dict[str, list[str]] = {}
    class_labels: list[str] = []
    indexed: dict[str, str] = {}
    features: list[str] = []
    for stage in loaded.bestModel.stages:
        if isinstance(stage, StringIndexerModel):
            feature_labels = {c: list(v) for c, v in zip(stage.getInputCols(), stage.labelsArray)}
            indexed = dict(zip(stage.getOutputCols(), stage.getInputCols()))
        elif isinstance(stage, VectorAssembler):
            features = [indexed.get(c, c) for c in stage.getInputCols()]
        elif isinstance(stage, IndexToString):
            class_labels = list(stage.getLabels())
    kind = CLASSIFICATION if class_labels else REGRESSION
    return TreeModel(loaded, kind, label, features, feature_labels, class_labels)


def variable_importance(model: TreeModel, spark) -> DataFrame:
    """(feature, importance) for each original column."""
    rows = list(zip(model.features, model.estimator.featureImportances.toArray().tolist()))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
