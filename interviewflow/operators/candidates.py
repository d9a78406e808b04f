"""Picks among candidate columns, and their expansion to one row per pick.

A row of the wide table holds all candidates of one prompt, so everything here
works inside the row: no join, no shuffle, no group that could grow.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interviewflow.defaults import DEFAULT_PICKS, SELECTION_PATTERNS
from interviewflow.functions.columns import candidate_columns, find_columns, require_columns
from interviewflow.functions.ids import id_of, int_id
from interviewflow.functions.picks import picks_from_cells
from interviewflow.operators.reshape import renumber
from interviewflow.operators.spread import spread_join

CARRIED = ("Gender", "PHQ_Binary", "PHQ_Score")


def _number_and_text_arrays(candidates: Mapping[int, str]) -> tuple[Column, Column]:
    numbers = ", ".join(f"{n}L" for n in candidates)
    return F.expr(f"array({numbers})"), F.array(*candidates.values())


def positions_to_numbers(picks: Column, columns: Mapping[int, str]) -> Column:
    """Picks given as positions 1..n turned into the numbers of the candidate columns.

    Where the numbers have gaps, a position outside 1..n becomes null, so that
    it cannot be taken for a number.
    """
    numbers = renumber(columns)
    if all(position == number for position, number in numbers.items()):
        return picks
    known = F.array(*[F.lit(n).cast("bigint") for n in numbers.values()])
    return F.transform(
        picks,
        lambda p: F.when(p.between(1, len(numbers)), F.get(known, (p - 1).cast("int"))).otherwise(F.lit(None).cast("bigint")),
    )


def default_picks(picks: Column, id_col: Column, defaults: Mapping[int, Sequence[int]] = DEFAULT_PICKS) -> Column:
    """The listed picks for a listed id whose own picks are empty."""
    chosen = picks
    for i, numbers in defaults.items():
        listed = F.array_sort(F.array_distinct(F.array(*[F.lit(n).cast("bigint") for n in numbers])))
        chosen = F.when((F.size(picks) == 0) & (int_id(id_col) == i), listed).otherwise(chosen)
    return chosen


def default_picks_from_table(df: DataFrame, picks: str, defaults: DataFrame, id_col: str, numbers: str) -> DataFrame:
    """Like ``default_picks`` with the list in a table of (id, array of numbers)."""
    listed = defaults.select(
        id_of(defaults, id_col).alias("__id"),
        F.array_sort(F.array_distinct(F.array_compact(F.col(numbers).cast("array<bigint>")))).alias("__default"),
    )
    joined = spread_join(df.withColumn("__id", id_of(df, id_col)), listed, "__id", "left")
    empty = F.coalesce(F.size(picks), F.lit(0)) == 0
    filled = F.when(empty, F.coalesce("__default", F.col(picks))).otherwise(F.col(picks))
    return joined.select(*[filled.alias(c) if c == picks else F.col(c) for c in df.columns])


def expand_picks(
    df: DataFrame,
    picks: Column | None = None,
    candidates: Mapping[int, str] | None = None,
    carry: Sequence[str] | None = None,
    id_col: str = "Participant_ID",
    transcript_col: str = "Transcript",
    names: Sequence[str] = ("Selected_Rationale_Number", "Selected_Rationale"),
) -> DataFrame:
    """One row per pick with its text; picks without a column or with a null text are left out.

    Without ``picks`` they are read from the selection columns. Columns come
    in a fixed order: id, carried columns, transcript, number, text.
    """
    require_columns(df, [id_col, transcript_col])
    candidates = dict(candidates or candidate_columns(df.columns))
    if picks is None:
        picks = picks_from_cells(df, find_columns(df.columns, SELECTION_PATTERNS))
    carry = [c for c in CARRIED if c in df.columns] if carry is None else list(carry)
    # Only the picked texts are copied; a pick that names no column gives null.
    numbers, texts = _number_and_text_arrays(candidates)
    picked = F.transform(
        picks,
        lambda p: F.struct(
            p.try_cast("int").alias("no"), F.get(texts, F.array_position(numbers, p).cast("int") - 1).alias("text")
        ),
    )
    kept = F.filter(F.filter(picked, lambda s: s["text"].isNotNull()), lambda s: s["no"].isNotNull())
    rows = df.select(id_col, *carry, transcript_col, F.inline(kept))
    return rows.withColumnsRenamed({"no": names[0], "text": names[1]})


def dropped_picks(df: DataFrame, picks: Column, candidates: Mapping[int, str] | None = None) -> DataFrame:
    """One row: picks made, and picks that lead to no text."""
    candidates = dict(candidates or candidate_columns(df.columns))
    numbers, texts = _number_and_text_arrays(candidates)
    lost = F.filter(picks, lambda p: F.get(texts, F.array_position(numbers, p).cast("int") - 1).isNull())
    return df.agg(
        F.coalesce(F.sum(F.size(picks)), F.lit(0)).alias("n_picks"),
        F.coalesce(F.sum(F.size(lost)), F.lit(0)).alias("n_dropped"),
    )
