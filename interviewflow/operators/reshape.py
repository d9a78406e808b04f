"""Between wide numbered columns and one row per number."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(
    df: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str] | Mapping[int, str],
    no_name: str = "candidate_no",
    value_name: str = "text",
) -> DataFrame:
    """One row per id and column, nulls kept.

    With a mapping the number is its key; with a list it is the column name.
    """
    if not isinstance(columns, Mapping):
        return df.unpivot(list(ids), list(columns), no_name, value_name)
    cells = F.array(
        *[F.struct(F.lit(n).alias(no_name), F.col(f"`{c}`").alias(value_name)) for n, c in columns.items()]
    )
    return df.select(*ids, F.inline(cells))


def to_wide(
    df: DataFrame,
    ids: Sequence[str],
    no_col: str,
    value_cols: str | Mapping[str, str],
    n: int,
    prefix: str = "Rational_",
) -> DataFrame:
    """One row per id with columns ``<prefix>1 .. <prefix>n``, null where a number is absent.

    ``value_cols`` is one column, or a mapping of value column to prefix. The
    column list is fixed by ``n``; no job looks for the numbers.
    """
    chosen = {value_cols: prefix} if isinstance(value_cols, str) else dict(value_cols)
    cells = [
        F.max(F.when(F.col(no_col) == i, F.col(value))).alias(f"{name}{i}")
        for value, name in chosen.items()
        for i in range(1, n + 1)
    ]
    return df.groupBy(*ids).agg(*cells)


def renumber(columns: Mapping[int, str]) -> dict[int, int]:
    """Position 1..n (by rising number) -> number in the column name."""
    return dict(enumerate(sorted(columns), start=1))
