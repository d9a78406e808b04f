"""Confusion counts and the scores made from them."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interviewflow.functions.columns import require_columns
from interviewflow.functions.labels import decode_labels

# Columns of the three reports.
REPORTS = {
    "depression": ("model", "tp", "fp", "fn", "tn", "mean_f1"),
    "accuracy": ("model", "tp", "fp", "fn", "tn", "accuracy", "mean_f1"),
    "full": (
        "model",
        "tp",
        "fp",
        "fn",
        "tn",
        "accuracy",
        "sensitivity",
        "specificity",
        "f1_positive",
        "f1_negative",
        "mean_f1",
    ),
}


def prediction_columns(columns: Sequence[str], pattern: str = r"predict\d+") -> list[str]:
    """Columns that hold one model's predictions."""
    return [c for c in columns if re.fullmatch(pattern, c)]


def _binary(col: Column, name: str, strict: bool) -> Column:
    if not strict:
        return col
    text = F.concat(F.lit(f"{name} is not 0 or 1: "), F.coalesce(col.cast("string"), F.lit("null")))
    return F.when(col.isin(0, 1), col).otherwise(F.raise_error(text).cast("int"))


def confusion_counts(
    df: DataFrame,
    label_col: str = "label",
    pred_cols: Sequence[str] | None = None,
    mapping: Mapping[str, int] | None = None,
    strict: bool = True,
) -> DataFrame:
    """One row per model: tp, fp, fn, tn.

    All models are counted in one pass with four counters each, so rows are
    neither multiplied nor shuffled; one row per task is.
    """
    models = list(pred_cols) if pred_cols is not None else prediction_columns(df.columns)
    require_columns(df, [label_col, *models])
    types = dict(df.dtypes)

    def decoded(name: str) -> Column:
        value = decode_labels(F.col(name), mapping or {}, types[name], strict)
        return _binary(value, name, strict).alias(name)

    coded = df.select(decoded(label_col), *[decoded(m) for m in models])
    cells = {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}
    counters = [
        F.count_if((F.col(label_col) == actual) & (F.col(m) == predicted)).alias(f"{i}_{cell}")
        for i, m in enumerate(models)
        for cell, (actual, predicted) in cells.items()
    ]
    rows = [
        F.struct(F.lit(m).alias("model"), *[F.col(f"{i}_{cell}").alias(cell) for cell in cells])
        for i, m in enumerate(models)
    ]
    return coded.agg(*counters).select(F.inline(F.array(*rows)))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def score(
    df: DataFrame,
    label_col: str = "label",
    pred_cols: Sequence[str] | None = None,
    mapping: Mapping[str, int] | None = None,
    strict: bool = True,
) -> DataFrame:
    """Counts, accuracy, sensitivity, specificity, F1 of both classes and their mean, per model.

    A ratio with nothing below the line is 0.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        confusion_counts(df, label_col, pred_cols, mapping, strict)
        .withColumn("accuracy", _ratio(tp + tn, tp + fp + fn + tn))
        .withColumn("sensitivity", _ratio(tp, tp + fn))
        .withColumn("specificity", _ratio(tn, tn + fp))
        .withColumn("f1_positive", _ratio(2 * tp, 2 * tp + fp + fn))
        .withColumn("f1_negative", _ratio(2 * tn, 2 * tn + fp + fn))
        .withColumn("mean_f1", (F.col("f1_positive") + F.col("f1_negative")) / 2)
    )


def report(scores: DataFrame, preset: str) -> DataFrame:
    """The columns of one report."""
    if preset not in REPORTS:
        raise ValueError(f"preset is one of {sorted(REPORTS)}, not {preset!r}")
    return scores.select(*REPORTS[preset])


def confusion_rows(
    df: DataFrame,
    label_col: str = "label",
    pred_cols: Sequence[str] | None = None,
    mapping: Mapping[str, int] | None = None,
    strict: bool = True,
) -> DataFrame:
    """The confusion matrix as four rows (model, actual, predicted, n) per model."""
    counts = confusion_counts(df, label_col, pred_cols, mapping, strict)
    cells = [("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)]
    rows = [F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n")) for c, a, p in cells]
    return counts.select("model", F.inline(F.array(*rows)))
