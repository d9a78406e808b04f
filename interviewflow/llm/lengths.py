"""Token counts for every context limit from one exact histogram of encoded lengths.

A null text has length 0. Repeated rows count each. An empty table gives no
rows. Columns other than the text are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from interviewflow.llm.bpe import encode_texts
from interviewflow.llm.store import stored

BUCKET_BITS = 10
QUANTILES = (0.5, 0.9, 0.99)
# Context limits of usual models.
LIMITS = tuple(1 << i for i in range(9, 18))


def length_histogram(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``length, n_docs``: documents by their number of tokens, summed in each task before the shuffle."""
    counted = encode_texts(docs.select(F.col(text).alias("text")), path, "text", ["n_tokens"])
    return counted.groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def _running(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``below_c`` for each column: its sum over smaller lengths.

    Sums run inside buckets of lengths and over the buckets.
    """
    rows = rows.withColumn("__bucket", F.shiftright("length", BUCKET_BITS))
    sums = rows.groupBy("__bucket").agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    over = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__bucket", *[F.coalesce(F.sum(f"__{c}").over(over), F.lit(0)).alias(f"__{c}") for c in columns])
    inside = Window.partitionBy("__bucket").orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    below = [
        (F.col(f"__{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"below_{c}") for c in columns
    ]
    return rows.join(starts, "__bucket").select("length", *columns, *below)


def context_table(histogram: DataFrame) -> DataFrame:
    """One row per distinct length taken as context limit.

    ``n_docs`` of this length, ``n_within`` up to it, ``n_longer`` beyond it,
    ``total_tokens`` of all documents, ``truncated_tokens`` if each is cut at
    the limit, and ``lost_tokens``. Limits between two lengths are answered by
    ``answer_limits``. Two totals come to the driver.
    """
    hist = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"))
    summed = _running(hist, ["n_docs", "n_tokens"])
    totals = hist.agg(F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("tokens")).first()
    all_docs, total = (F.lit(x or 0).cast("bigint") for x in totals)
    within = F.col("below_n_docs") + F.col("n_docs")
    longer = all_docs - within
    kept = F.col("below_n_tokens") + F.col("n_tokens") + longer * F.col("length")
    return summed.select(
        "length",
        "n_docs",
        within.alias("n_within"),
        longer.alias("n_longer"),
        total.alias("total_tokens"),
        kept.alias("truncated_tokens"),
        (total - kept).alias("lost_tokens"),
    )


def answer_limits(table: DataFrame, limits: Sequence[int]) -> DataFrame:
    """The columns of ``table`` for any limits, as ``limit`` and the others.

    What is true of the longest length below a limit is true of the limit, but
    that each longer document keeps the tokens between the two as well.
    """
    cells = F.array(*[F.lit(int(x)).cast("bigint") for x in limits])
    asked = table.withColumn("limit", F.explode(cells)).where(F.col("length") <= F.col("limit"))
    last = asked.groupBy("limit").agg(F.max(F.struct("length", "truncated_tokens", "n_within", "n_longer", "n_docs")).alias("s"))
    totals = table.agg(F.sum("n_docs").alias("docs"), F.max("total_tokens").alias("tokens")).first()
    docs, tokens = (F.lit(x or 0).cast("bigint") for x in totals)
    every = table.sparkSession.range(1).select(F.explode(cells).alias("limit")).join(last, "limit", "left")
    longer = F.coalesce(F.col("s.n_longer"), docs)
    kept = F.coalesce("s.truncated_tokens", F.lit(0)) + (F.col("limit") - F.coalesce("s.length", F.lit(0))) * longer
    return every.select(
        "limit",
        F.when(F.col("s.length") == F.col("limit"), F.col("s.n_docs")).otherwise(0).cast("bigint").alias("n_docs"),
        F.coalesce("s.n_within", F.lit(0)).cast("bigint").alias("n_within"),
        longer.alias("n_longer"),
        tokens.alias("total_tokens"),
        kept.alias("truncated_tokens"),
        (tokens - kept).alias("lost_tokens"),
    )


def token_answers(table: DataFrame, limits: Sequence[int] = LIMITS, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """``kind, quantile`` and the columns of ``table``: its rows (``length``), those of usual limits (``limit``) and of quantiles."""
    none = F.lit(None).cast("double")
    at_limits = answer_limits(table, limits).withColumnRenamed("limit", "length")
    at_quantiles = length_quantiles(table, quantiles).join(table, "length")
    parts = [(table, "length", none), (at_limits, "limit", none), (at_quantiles, "quantile", F.col("quantile"))]
    shown = [df.select(F.lit(kind).alias("kind"), q.alias("quantile"), *table.columns) for df, kind, q in parts]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


def length_quantiles(table: DataFrame, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """``quantile, length``: the least length that at least this share of the documents does not exceed."""
    cells = F.array(*[F.lit(float(q)) for q in quantiles])
    enough = F.col("n_within") >= F.col("quantile") * (F.col("n_within") + F.col("n_longer"))
    return table.withColumn("quantile", F.explode(cells)).where(enough).groupBy("quantile").agg(F.min("length").alias("length"))


def token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The table of context limits of a table of documents, kept for the questions of ``token_answers``."""
    return stored(context_table(stored(length_histogram(docs, path, text), "token-lengths")), "token-limits")
