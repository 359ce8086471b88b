"""Everything a trained model is reported with."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import evaluate as ev
from ..operators import explain as ex
from ..operators import trees as tr
from ..session import on_driver


def model_report(df: DataFrame, settings: tr.TreeSettings) -> tuple[tr.TreeModel, dict[str, DataFrame]]:
    """Train a model and describe it: errors and label metrics on both parts, importances, rules, nodes."""
    spark = df.sparkSession
    model, train, test = tr.fit(df, settings)
    parts = {"train": train} if settings.test == 0 else {"train": train, "test": test}
    report: dict[str, DataFrame] = {}
    for name, rows in parts.items():
        scored = model.model.transform(rows)
        if model.kind == tr.CLASSIFICATION:
            # A part is scored once: everything else follows from a few counts.
            counts = on_driver(ev.confusion_counts(scored, settings.label, "predictedLabel"))
            labels = ev.label_metrics(counts)
            report[f"{name}_error"] = ev.error_of_counts(counts)
            report[f"{name}_labels"], report[f"{name}_overall"] = labels, ev.overall_metrics(labels)
            report[f"{name}_confusion"] = ev.confusion_matrix(counts)
        else:
            report[f"{name}_error"] = ev.regression_error(scored, "__label", "prediction")
    report["importance"] = tr.variable_importance(model, spark)
    nodes = ex.nodes_of(spark, model)
    report["rules"] = ex.rules_table(spark, nodes, model.class_labels if settings.algorithm != tr.BOOSTED else None)
    if settings.algorithm == tr.TREE:
        report["nodes"] = ex.node_report(df, nodes, settings.label, model.kind)
        if model.kind == tr.CLASSIFICATION:
            report["node_classes"] = ex.node_class_counts(df, nodes, settings.label)
    return model, report
