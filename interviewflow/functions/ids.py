"""Readings of participant ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from interviewflow.functions.text import strip_ws


def normalize_id(col: Column) -> Column:
    """First digit run without leading zeros; the trimmed text where there is no digit.

    Stays text, so ids of any length survive.
    """
    trimmed = strip_ws(col.cast("string"))
    digits = F.regexp_extract(trimmed, r"(\d+)", 1)
    return F.when(digits == "", trimmed).otherwise(F.regexp_replace(digits, r"^0+(?=\d)", ""))


def id_from_filename(col: Column, strict: bool = False) -> Column:
    """The name up to its first ``_``; with ``strict`` only leading digits count, else null."""
    if strict:
        return F.nullif(F.regexp_extract(col, r"^\s*(\d+)_", 1), F.lit(""))
    return F.split_part(col, F.lit("_"), F.lit(1))


def int_id(col: Column) -> Column:
    """The id as a whole number, null where it is none (a fraction is none)."""
    text = strip_ws(col.cast("string"))
    number = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text)
    # Digits before a zero fraction are kept as they are: a double has only 53 bits of them.
    plain = F.regexp_extract(number, r"^([+-]?[0-9]+)(?:\.0*)?$", 1)
    real = number.try_cast("double")
    whole = F.when(real == F.floor(real), real.try_cast("bigint"))
    return F.when(plain != "", plain.try_cast("bigint")).otherwise(whole)


def text_id(col: Column) -> Column:
    """The id as trimmed text; leading zeros stay."""
    return strip_ws(col.cast("string"))


def read_id(col: Column, id_type: str) -> Column:
    """``int_id`` or ``text_id`` by name."""
    if id_type == "int":
        return int_id(col)
    if id_type == "string":
        return text_id(col)
    raise ValueError(f"id_type is 'int' or 'string', not {id_type!r}")


def id_of(df: DataFrame, name: str, id_type: str = "int") -> Column:
    """``read_id`` of a column. A whole-number column is its own integer id, so
    filters on it still reach the scan."""
    if id_type == "int" and isinstance(df.schema[name].dataType, T.IntegralType):
        return F.col(name).cast("bigint")
    return read_id(F.col(name), id_type)


def padded_id(col: Column, width: int = 16) -> Column:
    """Text key that sorts numbers by value: zeros in front, behind a sign; never cut."""
    sign = F.when(F.left(col, F.lit(1)).isin("+", "-"), F.left(col, F.lit(1))).otherwise("")
    rest = F.substring(col, F.length(sign) + 1, F.length(col))
    zeros = F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(col), F.lit(0)))
    return F.concat(sign, zeros, rest)


def exemplar_key(id_col: Column, no_col: Column) -> Column:
    """``<id>_<number>``, the number without a decimal point."""
    return F.concat(id_col.cast("string"), F.lit("_"), int_id(no_col).cast("string"))
