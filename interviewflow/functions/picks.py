"""Numbers a model answered with, and numbers read back from table cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from interviewflow.defaults import PICKS_DEFAULT, PICKS_RULE, WHITESPACE, WHITESPACE_CLASS

_BRACKET = r"\[[0-9," + WHITESPACE_CLASS[1:-1] + r"]+\]"
_GAP = r"[ \t\n\r]*"
_NUMBER = r"(?:0|[1-9][0-9]*)"
_JSON_LIST = rf"^\[{_GAP}(?:{_NUMBER}(?:{_GAP},{_GAP}{_NUMBER})*)?{_GAP}\]\z"


def picks_for(n: int, rule: Mapping[int, int] = PICKS_RULE, default: int = PICKS_DEFAULT) -> int:
    """How many of ``n`` candidates are asked for."""
    return rule.get(n, default)


def parse_picks(response: Column) -> Column:
    """Numbers in a free-text answer, in order.

    The first bracket of digits, commas and spaces counts alone if it is a
    valid JSON list; otherwise all digit runs of the answer count. A number
    too long for BIGINT stays in place as null.
    """
    bracket = F.regexp_extract(response, _BRACKET, 0)
    source = F.when(bracket.rlike(_JSON_LIST), bracket).otherwise(response)
    runs = F.regexp_extract_all(source, F.lit(r"[0-9]+"), F.lit(0))
    return F.transform(runs, lambda x: x.try_cast("bigint"))


def pad_picks(picks: Column, k: int, prefix: str = "Selected_Rational_Number_") -> list[Column]:
    """Exactly ``k`` columns: the first ``k`` picks, null where there are fewer."""
    return [F.get(picks, F.lit(i)).alias(f"{prefix}{i + 1}") for i in range(k)]


def _cell(df: DataFrame, name: str, strict: bool) -> Column:
    col, dtype = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col), col).try_cast("bigint")
    if isinstance(dtype, T.StringType):
        if strict:
            text = F.btrim(col, F.lit(WHITESPACE))
            return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
        return F.nullif(F.regexp_extract(col, r"[0-9]+", 0), F.lit("")).try_cast("bigint")
    return col.try_cast("bigint")


def picks_from_cells(df: DataFrame, columns: Sequence[str], strict: bool = False) -> Column:
    """Distinct picks of a row, ascending.

    Numbers are cut to integers; texts give their first digit run, or with
    ``strict`` must be a whole number. Anything else is skipped.
    """
    cells = F.array_compact(F.array(*[_cell(df, c, strict) for c in columns]))
    return F.array_sort(F.array_distinct(cells))
