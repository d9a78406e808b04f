"""Token counts of prompt tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interviewflow.functions.text import token_count


def with_tokens(
    df: DataFrame,
    text: str = "Prompt",
    out: str = "token_count",
    tokenizer: Callable[[], Callable[[str], list]] | None = None,
    given: str = "Token_Length",
    difference: str = "token_difference",
) -> DataFrame:
    """Token count per row, and its difference from a given count if that column exists."""
    counted = df.withColumn(out, token_count(F.col(text), tokenizer))
    return token_difference(counted, out, given, difference)


def token_difference(df: DataFrame, counted: str = "token_count", given: str = "Token_Length", out: str = "token_difference") -> DataFrame:
    """Counted minus given tokens; the table as it is without a given count."""
    return df.withColumn(out, F.col(counted) - F.col(given)) if given in df.columns else df


def token_stats(df: DataFrame, counted: str = "token_count", difference: str = "token_difference") -> DataFrame:
    """One row: number of prompts, and mean, highest and lowest of counts and differences."""
    stats = [F.count(F.lit(1)).alias("n_prompts")]
    for col in [c for c in (counted, difference) if c in df.columns]:
        stats += [F.avg(col).alias(f"mean_{col}"), F.max(col).alias(f"max_{col}"), F.min(col).alias(f"min_{col}")]
    return df.agg(*stats)
