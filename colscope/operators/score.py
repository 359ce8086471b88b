"""Applying fitted tree models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trees import CLASSIFICATION, TreeModel


def score(df: DataFrame, model: TreeModel, target: str | None = None, keep: list[str] | None = None,
          classes: int | None = 2) -> DataFrame:
    """Inputs (and ``keep`` columns) of the complete rows with the prediction as the ``target`` column.

    Classifiers give the class label and up to ``classes`` probabilities (``None`` for all).
    """
    target = target or model.label
    # An input column of the same name must not clash with the prediction.
    keep = [c for c in (keep or []) if c not in model.features and c != target]
    rows = df.select(*keep, *model.features).na.drop(subset=model.features)
    scored = model.model.transform(rows)
    outcome = "predictedLabel" if model.kind == CLASSIFICATION else "prediction"
    shares: list[Column] = []
    if model.kind == CLASSIFICATION:
        known = len(model.class_labels)
        wanted = known if classes is None else min(classes, known)
        values = vector_to_array(F.col("probability"))
        shares = [values[i].alias(f"{target}_{i + 1}") for i in range(wanted)]
    return scored.select(*keep, *model.features, *shares, F.col(outcome).alias(target))
