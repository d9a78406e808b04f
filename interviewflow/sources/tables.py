"""Delimited tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interviewflow.defaults import NULL_TOKENS
from interviewflow.functions.text import null_tokens
from interviewflow.session import cut
from interviewflow.sources.records import has_open_cells, lines_of, parsed, records, row_place, split_states, splittable

# Columns that put the rows of a file or folder in order.
ORDER = ("file_name", "block", "line")


def find_separator(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "utf-8") -> str:
    """The given separator; tab for .tsv, comma for .csv; else what the first line has more of."""
    if sep is not None:
        return sep
    name = path.lower()
    if name.endswith(".tsv"):
        return "\t"
    if name.endswith(".csv"):
        return ","
    first = raw_lines(spark, path, encoding).first()
    line = first[0] if first else ""
    return "\t" if line.count("\t") > line.count(",") else ","


def raw_lines(spark: SparkSession, path: str | list[str], encoding: str = "utf-8", **options) -> DataFrame:
    """The non-empty lines of delimited files as ``value``, decoded; quotes and separators mean nothing."""
    reader = spark.read.options(**options)
    return reader.csv(path, schema="value string", sep="\x01", quote="", encoding=encoding, multiLine=not splittable(encoding))


def read_table(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    multiline: bool | None = None,
    nulls: Iterable[str] = NULL_TOKENS,
    order: bool = False,
    encoding: str = "utf-8",
) -> DataFrame:
    """Delimited file or folder with a header line, every column as text.

    Cells equal to one of ``nulls`` are null. ``order`` adds the columns of
    ``ORDER``, which hold the place of each row. Without ``multiline`` the
    files are looked through once for cells that span lines. Files with such
    cells are read split as well, by ``sources.records``; only in an encoding
    whose line ends are no single bytes is a file read by one task. ``encoding``
    holds in every pass.
    """
    sep = find_separator(spark, path, sep, encoding)
    whole = not splittable(encoding)
    rows = spark.read.csv(
        path, sep=sep, header=True, quote='"', escape='"', multiLine=whole or multiline is not False, encoding=encoding, inferSchema=False
    )
    if whole:
        return null_cells(rows, nulls, order)
    if multiline is not False:
        splits = cut(split_states(lines_of(spark, path, encoding), sep))
        if multiline or has_open_cells(splits):
            found = parsed(records(spark, path, sep, encoding, splits), rows.columns, sep)
            return null_cells(found.select(*rows.columns, *ORDER), nulls, False, rows.columns).drop(*([] if order else ORDER))
    lines = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', encoding=encoding, schema=rows.schema)
    return null_cells(lines, nulls, order)


def null_cells(rows: DataFrame, nulls: Iterable[str], order: bool, columns: list[str] | None = None) -> DataFrame:
    """``rows`` with the texts ``nulls`` as null in ``columns`` (default: all), and the ``ORDER`` of a scan on request."""
    named = rows.columns if columns is None else columns
    cells = [null_tokens(F.col(f"`{c}`"), nulls).alias(c) if nulls else F.col(f"`{c}`") for c in named]
    return rows.select(*cells, *[F.col(f"`{c}`") for c in rows.columns if c not in named], *(row_place() if order else []))
