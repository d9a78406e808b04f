"""Delimited tables of many files whose rows have an order.

Spark packs files and their splits into tasks by size, so rows come back in any
order. A table written here has its order in the numbers of its part files and
the places of its rows, and is read back by both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from interviewflow.sources.tables import ORDER, read_table


def part_rank() -> Column:
    """The number of the part file a row was read from, as a number: five digits or more."""
    return F.regexp_extract("file_name", r"part-(\d+)", 1).cast("bigint")


def write_ordered(rows: DataFrame, path: str, by: list[Column], sep: str = ",", columns: list[str] | None = None) -> None:
    """Writes ``rows`` (of them ``columns``) in the order ``by``, part after part."""
    rows.orderBy(*by).select(*[F.col(f"`{c}`") for c in columns or rows.columns]).write.mode("overwrite").csv(path, header=True, sep=sep, quote='"', escape='"')


def read_places(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Rows of such a table with ``part, block, line``, which order them; in any order, and split however large a part is."""
    rows = read_table(spark, path, sep, nulls=(), order=True)
    return rows.withColumn("part", part_rank()).drop("file_name")


def read_ordered(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Rows of such a table, all cells as text, in their order."""
    places = ["part", *ORDER[1:]]
    return read_places(spark, path, sep).orderBy(*places).drop(*places)


def with_row_number(placed: DataFrame, name: str = "row_no") -> DataFrame:
    """``name``: the 0-based number of each row of ``read_places`` in the whole table.

    Rows are counted per split; a running sum over these few counts gives where
    a split begins, and the line ids of a split run on.
    """
    splits = placed.groupBy("part", "block").agg(F.count(F.lit(1)).alias("__n"), F.min("line").alias("__first"))
    before = Window.orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("part", "block", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("part", "block").orderBy("line")
    numbered = placed.withColumn("__at", F.row_number().over(inside) - 1).join(starts, ["part", "block"])
    columns = [c for c in placed.columns if c not in ("part", "block", "line")]
    return numbered.select(*columns, (F.col("__start") + F.col("__at")).alias(name))
