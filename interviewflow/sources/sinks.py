"""Result tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interviewflow.defaults import CELL_LIMIT, CELL_SUFFIX
from interviewflow.sources.files import exists, put_text, read_text

# The file that names the current version of a table.
CURRENT = "_current"


def write_versioned(df: DataFrame, base: str, run_id: str) -> str:
    """Writes the table of this run, then makes it the current one. Returns its path.

    The switch is one small file that is renamed over the one before: readers
    see the version before or this one, whole, and a run that is stopped leaves
    the version before. Versions stay; a second run of one id is another version.
    """
    spark = df.sparkSession
    version = f"runs/run_id={run_id}/{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/{version}")
    put_text(spark, f"{base}/{CURRENT}", version)
    return f"{base}/{version}"


def read_versioned(spark: SparkSession, base: str) -> DataFrame:
    """The current version of a table of ``write_versioned``."""
    return spark.read.parquet(current_version(spark, base))


def has_version(spark: SparkSession, base: str) -> bool:
    return exists(spark, f"{base}/{CURRENT}")


def current_version(spark: SparkSession, base: str) -> str:
    """Path of the current version; an error if there is none yet."""
    return f"{base}/{read_text(spark, f'{base}/{CURRENT}')}"


def write_formats(df: DataFrame, base: str, formats: str, sep: str = ",") -> list[str]:
    """Writes ``csv``, ``parquet`` or ``both`` under the base path plus its format. Returns the paths.

    The plan runs once: of both formats the second is filled from the written first.
    """
    known = {"csv": ["csv"], "parquet": ["parquet"], "both": ["parquet", "csv"]}
    if formats.lower() not in known:
        raise ValueError(f"format is one of {sorted(known)}, not {formats!r}")
    paths = []
    for fmt in known[formats.lower()]:
        path = f"{base}.{fmt}"
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer.csv(path, header=True, sep=sep, quote='"', escape='"')
        else:
            writer.parquet(path)
            df = df.sparkSession.read.schema(df.schema).parquet(path)
        paths.append(path)
    return sorted(paths)


def with_preview(
    df: DataFrame,
    cols: Sequence[str] = ("Transcript", "Selected_Rationale"),
    limit: int = CELL_LIMIT,
    suffix: str = CELL_SUFFIX,
    name: str = "{}_Summary",
) -> DataFrame:
    """Adds a shortened column for each text column that has a value over ``limit`` characters.

    One job finds the longest values; the suffix tells the full length.
    """
    present = [c for c in cols if c in df.columns]
    if not present:
        return df
    longest = df.agg(*[F.max(F.length(c)).alias(c) for c in present]).first()
    for c in [c for c in present if (longest[c] or 0) > limit]:
        df = df.withColumn(name.format(c), short_cell(F.col(c), limit, suffix))
    return df


def short_cell(col, limit: int = CELL_LIMIT, suffix: str = CELL_SUFFIX):
    """The value, or its first ``limit`` characters with a note of the full length."""
    before, behind = suffix.split("{length}")
    note = F.concat(F.lit(before), F.length(col).cast("string"), F.lit(behind))
    return F.when(F.length(col) > limit, F.concat(F.left(col, F.lit(limit)), note)).otherwise(col)
