"""Model quality from (label, prediction) rows: counted once, the rest is arithmetic on a few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classification_error(df: DataFrame, label: str, prediction: str) -> DataFrame:
    wrong = (F.col(label) != F.col(prediction)).cast("int")
    return df.agg(F.coalesce(F.avg(wrong), F.lit(0.0)).alias("error"))


def regression_error(df: DataFrame, label: str, prediction: str) -> DataFrame:
    miss = F.col(prediction).cast("double") - F.col(label).cast("double")
    return df.agg(F.coalesce(F.sqrt(F.avg(miss * miss)), F.lit(0.0)).alias("error"))


def confusion_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, n) for the combinations that occur."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def error_of_counts(counts: DataFrame) -> DataFrame:
    """The share of wrong predictions among counted ones."""
    wrong = F.sum(F.when(F.col("label") != F.col("prediction"), F.col("n")).otherwise(0))
    return counts.agg(F.coalesce(F.try_divide(wrong, F.sum("n")), F.lit(0.0)).alias("error"))


def confusion_matrix(counts: DataFrame) -> DataFrame:
    """Confusion counts for every pair of actual labels, zeros included; labels are classes, so few."""
    classes = counts.select("label").distinct()
    all_classes = classes.agg(F.sort_array(F.collect_set("label"))).scalar()
    cells = classes.select("label", F.explode(all_classes).alias("prediction"))
    return cells.join(counts, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def label_metrics(counts: DataFrame) -> DataFrame:
    """(label, actual, predicted, hits, precision, recall, false_positive_rate, f1) per actual label."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = counts.select(F.inline(F.array(
        F.struct(F.col("label").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("predicted"),
                 hit.alias("hits")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("long").alias("actual"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
    )))
    total = counts.agg(F.sum("n")).scalar()
    per_label = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "hits")]).filter("actual > 0")
    precision = _ratio(F.col("hits"), F.col("predicted"))
    recall = _ratio(F.col("hits"), F.col("actual"))
    false_positives = F.col("predicted") - F.col("hits")
    return per_label.select(
        "label", "actual", "predicted", "hits", precision.alias("precision"), recall.alias("recall"),
        _ratio(false_positives, total - F.col("actual")).alias("false_positive_rate"),
        _ratio(F.lit(2.0) * precision * recall, precision + recall).alias("f1"))


def overall_metrics(per_label: DataFrame) -> DataFrame:
    """Accuracy (micro precision, recall and F1 are the same) and averages weighted by label frequency."""
    total = F.sum("actual")

    def weighted(c: str) -> Column:
        return (F.sum(F.col(c) * F.col("actual")) / total).alias(f"weighted_{c}")

    return per_label.agg((F.sum("hits") / total).alias("accuracy"),
                         *[weighted(c) for c in ("precision", "recall", "false_positive_rate", "f1")])
