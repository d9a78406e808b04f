"""From utterances to transcripts, and onto a roster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interviewflow.defaults import WHITESPACE
from interviewflow.functions.ids import normalize_id
from interviewflow.functions.text import collapse_ws, null_tokens
from interviewflow.operators.spread import concat_ordered, spread_join


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    """Rows whose text is neither null nor only white space."""
    return df.where(F.col(col).isNotNull() & (F.btrim(F.col(col), F.lit(WHITESPACE)) != ""))


def build_transcripts(
    utterances: DataFrame,
    id_cols: str | Sequence[str],
    order: Sequence[str],
    collapse: bool = False,
    text: str = "text",
    out: str = "transcript",
) -> DataFrame:
    """One transcript per id: its utterances in order with one space between.

    Missing-value cells are left out. ``collapse`` also squeezes white space
    and leaves out what is then empty. An id with only missing cells keeps an
    empty transcript.
    """
    keys = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    cell = null_tokens(F.col(text))
    if collapse:
        cell = F.nullif(collapse_ws(cell), F.lit(""))
    wanted = list(dict.fromkeys([*keys, *order]))
    return concat_ordered(utterances.select(*wanted, cell.alias(out)), keys, out, order)


def join_transcripts(roster: DataFrame, transcripts: DataFrame, id_col: str = "Participant_ID", text: str = "transcript") -> DataFrame:
    """Roster rows with their transcript, ids compared as text; unmatched rows of both sides go."""
    left = roster.withColumn(id_col, F.col(id_col).cast("string"))
    right = transcripts.select(F.col(id_col).cast("string").alias(id_col), text)
    return spread_join(left, right, id_col, "inner")


def update_transcripts(
    roster: DataFrame,
    transcripts: DataFrame,
    mode: str = "overwrite",
    id_col: str = "Participant_ID",
    text: str = "transcript",
    target: str = "Transcript",
) -> DataFrame:
    """Roster with new transcripts and a flag ``updated`` for the rows that took one.

    ``overwrite`` replaces, ``fillna`` only fills nulls. Ids are compared in
    normalized form; rows without a new transcript keep what they have.
    """
    if mode not in ("overwrite", "fillna"):
        raise ValueError(f"mode is 'overwrite' or 'fillna', not {mode!r}")
    if target not in roster.columns:
        roster = roster.withColumn(target, F.lit(None).cast("string"))
    fresh = transcripts.select(normalize_id(F.col(id_col)).alias("__id"), F.col(text).alias("__new"))
    joined = spread_join(roster.withColumn("__id", normalize_id(F.col(id_col))), fresh, "__id", "left")
    takes = F.col("__new").isNotNull()
    if mode == "fillna":
        takes = takes & F.col(target).isNull()
    columns = [F.when(takes, F.col("__new")).otherwise(F.col(c)).alias(c) if c == target else F.col(c) for c in roster.columns]
    return joined.select(*columns, takes.alias("updated"))


def count_updated(updated: DataFrame) -> DataFrame:
    """One row: how many rows took a new transcript, of how many."""
    return updated.agg(F.count_if("updated").alias("rows_updated"), F.count(F.lit(1)).alias("rows_total"))
