"""Scores of a prediction table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from interviewflow.defaults import LABELS_DEPRESSION, LABELS_DEPRESSION_SPOKEN, LABELS_PTSD
from interviewflow.operators.scoring import report, score

# Corpus -> (label spellings, report).
CORPORA = {
    "depression": (LABELS_DEPRESSION, "depression"),
    "depression_spoken": (LABELS_DEPRESSION_SPOKEN, "accuracy"),
    "ptsd": (LABELS_PTSD, "full"),
}


def score_corpus(df: DataFrame, corpus: str, pred_cols: Sequence[str] | None = None, label_col: str = "label") -> DataFrame:
    """The report of a corpus over all prediction columns."""
    mapping, preset = CORPORA[corpus]
    return report(score(df, label_col, pred_cols, mapping), preset)
