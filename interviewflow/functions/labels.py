"""Labels as text and as 0/1."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from interviewflow.defaults import STATUS_TEXTS
from interviewflow.functions.ids import int_id


def label_of(df: DataFrame, name: str) -> Column:
    """The label as a whole number: numbers as they are, text such as ``1`` or ``1.0`` read; null where it is none."""
    numeric = isinstance(df.schema[name].dataType, T.NumericType)
    return F.col(name) if numeric else int_id(F.col(name))


def status_text(
    col: Column,
    positive: str = STATUS_TEXTS[1],
    negative: str = STATUS_TEXTS[0],
    null_status: str | None = None,
) -> Column:
    """1 is ``positive``, anything else ``negative``; null is ``null_status`` if one is given.

    ``col`` is a number; use ``label_of`` for a column that may be text.
    """
    known = F.when(col == 1, positive).otherwise(negative)
    return known if null_status is None else F.when(col.isNull(), null_status).otherwise(known)


def decode_labels(col: Column, mapping: Mapping[str, int], dtype: str = "string", strict: bool = True) -> Column:
    """Label texts as integers.

    Texts outside ``mapping`` must be whole numbers: ``strict`` raises for the
    others, else they become null. Numeric columns are only cut to an integer.
    """
    if dtype != "string":
        return col.cast("int")
    decoded = F.when(col.isNull(), F.lit(None).cast("int"))
    for text, value in mapping.items():
        decoded = decoded.when(col == text, F.lit(value))
    number = F.when(F.trim(col).rlike(r"^[+-]?[0-9]+$"), F.trim(col).try_cast("int"))
    if strict:
        number = F.coalesce(number, F.raise_error(F.concat(F.lit("label is not known: "), col)).cast("int"))
    return decoded.otherwise(number)
