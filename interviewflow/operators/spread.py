"""Joins, concatenation and numbering that hold when one key has a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows per first-level piece of an ordered concatenation.
PIECE_BITS = 12


def spread_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join of a big ``left`` that may be skewed, null keys included, with a ``right`` of few rows per key.

    Only kinds of join are let in whose oversized partitions of ``left``
    Spark's adaptive skew join splits at run time, once their true size is
    known; keep ``spark.sql.adaptive.skewJoin.enabled`` on.
    """
    on = [on] if isinstance(on, str) else list(on)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"how is inner, left, left_semi or left_anti, not {how!r}")
    return left.join(right, on, how)


def concat_pieces(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    order: Sequence[str],
    separator: str = " ",
    bits: int = PIECE_BITS,
) -> tuple[DataFrame, list[str]]:
    """First level of ``concat_ordered``: bounded runs of rows joined into pieces.

    ``order`` ends in a whole-number column; a piece spans ``2**bits`` of its
    values. Returns the pieces and the columns that put them in order. Use it
    where one key's whole text would be over the 2 GB a cell can hold.
    """
    *outer, last = order
    cut = df.withColumn("__piece", F.shiftright(F.col(last).cast("bigint"), bits))
    joined = F.expr(f"listagg(`{text}`, '{separator}') WITHIN GROUP (ORDER BY `{last}`)")
    pieces = cut.groupBy(*keys, *[c for c in outer if c not in keys], "__piece").agg(joined.alias(text))
    return pieces, [*outer, "__piece"]


def concat_ordered(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    order: Sequence[str],
    separator: str = " ",
    bits: int = PIECE_BITS,
) -> DataFrame:
    """One row per key: its non-null texts in order, joined; ``''`` where there are none.

    Rows are joined into bounded pieces first, so the rows of a hot key are
    spread over many tasks and only its pieces meet in one.
    """
    pieces, by = concat_pieces(df, keys, text, order, separator, bits)
    ranked = F.struct(*by) if len(by) > 1 else F.col(by[0])
    joined = F.expr(f"listagg(`{text}`, '{separator}') WITHIN GROUP (ORDER BY __rank)")
    return (
        pieces.withColumn("__rank", ranked).groupBy(*keys).agg(F.coalesce(joined, F.lit("")).alias(text))
    )


def number_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], bucket: Column, name: str, below: int | None = None
) -> DataFrame:
    """0-based position of every row in its group, without one task per group.

    ``bucket`` is the leading hex digits of the first order column, hence a
    small fixed number of values in the same order. Rows are numbered inside
    their bucket; the start of each bucket is a running sum over bucket counts.
    With ``below`` only rows at smaller positions are kept, and buckets that
    begin later are neither shuffled nor sorted.
    """
    marked = df.withColumn("__bucket", bucket)
    starts = bucket_starts(marked, group)
    if below is not None:
        starts = starts.where(F.col("__start") < below)
    inside = Window.partitionBy(*group, "__bucket").orderBy(*order)
    placed = marked.join(starts, [*group, "__bucket"])
    position = F.row_number().over(inside) - 1 + F.col("__start")
    numbered = placed.withColumn(name, position.cast("bigint")).drop("__start", "__bucket")
    return numbered if below is None else numbered.where(F.col(name) < below)


def bucket_starts(cut: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows before each ``__bucket`` of a group: as many rows as groups times buckets."""
    counts = cut.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__bucket")
    return counts.select(*group, "__bucket", (F.sum("__n").over(before) - F.col("__n")).alias("__start"))
