"""Folders of utterance files, one file per participant."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from interviewflow.defaults import TEXT_NAMES
from interviewflow.operators.spread import spread_join
from interviewflow.session import cut, small_files
from interviewflow.sources.records import open_quote, parsed, records, row_place, splittable
from interviewflow.sources.tables import raw_lines

PATTERN = "*_Transcript.csv"


def file_states(spark: SparkSession, folder: str, pattern: str = PATTERN) -> DataFrame:
    """``file_name, length, modified`` of the matching files that have bytes, by a scan that opens none of them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", F.col("modificationTime").alias("modified"))


def list_files(spark: SparkSession, folder: str, pattern: str = PATTERN, **options) -> DataFrame:
    """Names of the matching files, those of zero bytes too. Contents are not read.

    The names come from the file listing that Spark holds on the driver for
    every scan; its scans themselves skip files of zero bytes.
    """
    paths = spark.read.format("binaryFile").options(pathGlobFilter=pattern, **options).load(folder).inputFiles()
    names = [(unquote(p.rsplit("/", 1)[-1]),) for p in paths]
    return spark.createDataFrame(names, "file_name string")


def file_layouts(
    spark: SparkSession, folder: str, pattern: str, text_names: Sequence[str], sep: str, encoding: str, **options
) -> DataFrame:
    """(file_name, path, width, place, open): from one pass over the folder.

    ``width`` is the number of header cells, ``place`` the 1-based position of
    the first of ``text_names`` among them (null: none), ``open`` whether some
    cell spans lines.
    """
    lines = raw_lines(spark, folder, encoding, pathGlobFilter=pattern, **options).select(
        *row_place(), F.col("_metadata.file_path").alias("path"), "value"
    )
    first = F.min_by(F.when(F.col("block") == 0, F.col("value")), F.struct("block", "line"))
    per_file = lines.groupBy("file_name", "path").agg(first.alias("header"), F.bool_or(open_quote("value", sep)).alias("open"))
    mark = re.escape(sep)
    cells = F.regexp_extract_all(
        F.ltrim(F.col("header"), F.lit("﻿")), F.lit(rf'(?:^|{mark})("(?:[^"]|"")*"|[^{mark}]*)'), F.lit(1)
    )
    names = F.transform(cells, lambda c: F.replace(F.regexp_replace(c, r'^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))
    places = [F.nullif(F.array_position("names", F.lit(t)), F.lit(0)) for t in text_names]
    return per_file.withColumn("names", names).select(
        "file_name", "path", F.size("names").alias("width"), F.coalesce(*places).cast("int").alias("place"), "open"
    )


def _scan(spark, paths, pattern, width: int, sep, encoding, multiline, **options) -> DataFrame:
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    return spark.read.csv(
        paths,
        schema=schema,
        header=True,
        enforceSchema=True,
        sep=sep,
        encoding=encoding,
        quote='"',
        escape='"',
        multiLine=multiline,
        pathGlobFilter=pattern,
        **options,
    )


def read_utterances(
    spark: SparkSession,
    folder: str,
    pattern: str = PATTERN,
    text_names: Sequence[str] = TEXT_NAMES,
    sep: str = ",",
    encoding: str = "utf-8",
    columns: Sequence[str] | None = None,
    multiline: bool | None = None,
    need_text: bool = False,
    **options,
) -> DataFrame:
    """Utterances of all matching files: file_name, block, line (the order, see ORDER) and text.

    Files may order their columns differently, in any number of ways: a first
    job reads the header of each file and whether a cell spans lines, and the
    data are scanned once with the widest header. Files with such cells stay
    split as well (``sources.records``). Naming the ``columns`` all files
    share and ``multiline`` saves the first job. Each file also gives one row
    with null text, so files without utterances, without a text column or
    without bytes are not lost; with ``need_text`` the latter two are left out.
    ``options`` of Spark's file sources, like ``modifiedAfter``, hold in every pass.
    """
    files = list_files(spark, folder, pattern, **options)
    unsplit = not splittable(encoding)
    if columns is not None and multiline is not None:
        place = next((i for i, c in enumerate(columns) if c in [t for t in text_names if t in columns][:1]), None)
        cell: Column = F.lit(None).cast("string") if place is None else F.col(f"c{place}")
        if multiline and not unsplit:
            with small_files(spark):
                found = records(spark, folder, sep, encoding, pathGlobFilter=pattern, **options)
            rows = parsed(found, [f"c{i}" for i in range(len(columns))], sep)
            return _with_files(rows.select("file_name", "block", "line", cell.alias("text")), files)
        rows = _scan(spark, folder, pattern, len(columns), sep, encoding, unsplit, **options)
        return _with_files(rows.select(*row_place(), cell.alias("text")), files)

    with small_files(spark):
        layouts = cut(file_layouts(spark, folder, pattern, text_names, sep, encoding, **options))
    if need_text:
        files = files.join(layouts.where("place IS NOT NULL").select("file_name"), "file_name", "left_semi")
    span = F.lit(bool(multiline)) if multiline is not None else F.col("open")
    width, low, high, n_open = layouts.agg(
        F.max("width"), F.min(F.coalesce("place", F.lit(0))), F.max(F.coalesce("place", F.lit(0))), F.count_if(span)
    ).first()
    if not width or not high:
        return _with_files(files)
    if n_open and not unsplit:
        # Split files all the same: the place of each line in its cells comes from a pass over the quotes.
        with small_files(spark):
            found = records(spark, folder, sep, encoding, pathGlobFilter=pattern, **options)
        rows = parsed(found, [f"c{i}" for i in range(width)], sep)
        place_of = [F.col(c) for c in ("file_name", "block", "line")]
    else:
        rows = _scan(spark, folder, pattern, width, sep, encoding, unsplit, **options)
        place_of = row_place()
    if low == high:
        return _with_files(rows.select(*place_of, F.col(f"c{high - 1}").alias("text")), files)
    cells = rows.select(*place_of, F.array(*[f"c{i}" for i in range(width)]).alias("cells"))
    placed = spread_join(cells, layouts.where("place IS NOT NULL").select("file_name", "place"), "file_name")
    return _with_files(placed.select("file_name", "block", "line", F.get("cells", F.col("place") - 1).alias("text")), files)


def _with_files(*parts: DataFrame) -> DataFrame:
    *scans, files = parts
    out = files.select(
        "file_name",
        F.lit(0).cast("bigint").alias("block"),
        F.lit(-1).cast("bigint").alias("line"),
        F.lit(None).cast("string").alias("text"),
    )
    for rows in scans:
        out = rows.unionByName(out)
    return out
