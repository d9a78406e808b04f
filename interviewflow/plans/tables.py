"""Utilities from delimited file to delimited folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from interviewflow.defaults import CORRECTED_IDS
from interviewflow.functions.columns import require_columns
from interviewflow.operators.tables import correct_labels, id_order, keep_first, keep_ids, union_tables
from interviewflow.sources.ordered import read_ordered, write_ordered
from interviewflow.sources.sinks import write_formats
from interviewflow.sources.tables import ORDER, find_separator, read_table

# Position of a file in a list of files.
NUMBER = "__file"


def written(spark: SparkSession, rows: DataFrame, out: str, by: Sequence[Column], sep: str = ",") -> DataFrame:
    """Writes ``<out>.csv`` in the order ``by`` and returns the written rows in it, so that the plan runs once."""
    path = f"{out}.csv"
    write_ordered(rows, path, by, sep, [c for c in rows.columns if c not in (*ORDER, NUMBER)])
    return read_ordered(spark, path, sep)


def _places(rows: DataFrame) -> list[Column]:
    return [F.col(c) for c in ORDER]


def dedupe_table(
    spark: SparkSession,
    path: str,
    out: str,
    id_col: str = "Participant_ID",
    id_type: str = "int",
    in_sep: str | None = None,
    out_sep: str | None = None,
) -> DataFrame:
    """Keeps the first row of every id in file order; writes ``<out>.csv`` and returns the rows."""
    sep = find_separator(spark, path, in_sep)
    rows = read_table(spark, path, sep, order=True)
    require_columns(rows, [id_col], path)
    return written(spark, keep_first(rows, id_col, ORDER, id_type), out, _places(rows), out_sep or sep)


def filter_table(
    spark: SparkSession,
    path: str,
    ids_path: str,
    out: str,
    id_col: str = "Participant_ID",
    id_type: str = "int",
    in_sep: str | None = None,
    out_sep: str | None = None,
    ids_sep: str = ",",
    sort: bool = True,
) -> DataFrame:
    """Keeps the rows whose id is in a list file, sorted by id; writes ``<out>.csv`` and returns the rows."""
    sep = find_separator(spark, path, in_sep)
    ids = read_table(spark, ids_path, ids_sep)
    kept = keep_ids(read_table(spark, path, sep, order=True), ids, id_col, id_type)
    by = [id_order(kept, id_col, id_type)] if sort else []
    return written(spark, kept, out, [*by, *_places(kept)], out_sep or sep)


def correct_table(
    spark: SparkSession,
    path: str,
    out: str,
    ids: Sequence[int] = CORRECTED_IDS,
    formats: str = "both",
    id_col: str = "Participant_ID",
    label_col: str = "PHQ_Binary",
) -> list[str]:
    """Sets the label of the listed ids to 1 and writes the table; returns the paths."""
    return write_formats(correct_labels(read_table(spark, path), ids, id_col, label_col), out, formats)


def stack_tables(spark: SparkSession, paths: Sequence[str], out: str) -> DataFrame:
    """All rows of several files by column name, file after file; writes ``<out>.csv`` and returns the rows."""
    tables = [read_table(spark, p, order=True).withColumn(NUMBER, F.lit(i)) for i, p in enumerate(paths)]
    rows = union_tables(*tables)
    return written(spark, rows, out, [F.col(NUMBER), *_places(rows)])
