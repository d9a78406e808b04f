"""Table utilities: dedupe, id lists, union, correction, counts, checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from interviewflow.defaults import CORRECTED_IDS
from interviewflow.functions.columns import require_columns
from interviewflow.functions.ids import id_of, padded_id
from interviewflow.functions.labels import label_of
from interviewflow.operators.spread import spread_join


def keep_first(df: DataFrame, key: str | Sequence[str], order_by: Sequence[str], id_type: str | None = "int") -> DataFrame:
    """The first row of every key in ``order_by``; all null keys are one key.

    ``id_type`` names the reading of a single key column, None takes the keys
    as they are. The rank filter is pushed below the shuffle (window group
    limit), so each task sends at most one row per key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    require_columns(df, [*keys, *order_by])
    read = [F.col(k) if id_type is None else id_of(df, k, id_type) for k in keys]
    rank = F.row_number().over(Window.partitionBy(*read).orderBy(*order_by))
    return df.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")


def distinct_keys(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct non-null keys."""
    return df.select(*columns).dropna("any", subset=list(columns)).distinct()


def keep_ids(df: DataFrame, ids: DataFrame, id_col: str, id_type: str = "int") -> DataFrame:
    """Rows whose id is in the list; a null id never matches."""
    require_columns(df, [id_col])
    require_columns(ids, [id_col], "id list")
    wanted = distinct_keys(ids.select(id_of(ids, id_col, id_type).alias("__id")), "__id")
    read = df.withColumn("__id", id_of(df, id_col, id_type))
    return spread_join(read, wanted, "__id", "left_semi").drop("__id")


def sort_ids(df: DataFrame, id_col: str, id_type: str = "int", ord: Sequence[str] = ()) -> DataFrame:
    """Ascending by id, nulls last; ``ord`` keeps ties stable (and splits a hot id over ranges)."""
    return df.orderBy(id_order(df, id_col, id_type), *ord)


def id_order(df: DataFrame, id_col: str, id_type: str = "int") -> Column:
    """What ids are sorted by: their value, or their text of one width; nulls last."""
    key = id_of(df, id_col) if id_type == "int" else padded_id(F.col(id_col).cast("string"))
    return key.asc_nulls_last()


def union_tables(*dfs: DataFrame) -> DataFrame:
    """All rows, matched by column name; absent columns are null, duplicates stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def unmatched(left: DataFrame, right: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Rows of ``left`` without a partner in ``right``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return spread_join(left, right.select(*keys).distinct(), keys, "left_anti")


def id_overlap(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Every distinct id with the side it is on: ``left``, ``right`` or ``both``."""
    sides = a.select(col, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        b.select(col, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    side = F.when(F.max("l") + F.max("r") == 2, "both").when(F.max("l") == 1, "left").otherwise("right")
    return sides.where(F.col(col).isNotNull()).groupBy(col).agg(side.alias("side"))


def _listed(df: DataFrame, ids: DataFrame | Sequence[int], id_col: str) -> DataFrame:
    if isinstance(ids, DataFrame):
        require_columns(ids, [id_col], "id list")
        return ids.select(id_of(ids, id_col).alias("__id")).where(F.col("__id").isNotNull()).distinct()
    rows = [(int(i),) for i in dict.fromkeys(ids)]
    return df.sparkSession.createDataFrame(rows, "__id bigint")


def correct_labels(
    df: DataFrame,
    ids: DataFrame | Sequence[int] = CORRECTED_IDS,
    id_col: str = "Participant_ID",
    label_col: str = "PHQ_Binary",
    value: int = 1,
) -> DataFrame:
    """``value`` as label of the listed ids; the table as it is when a column is absent."""
    if id_col not in df.columns or label_col not in df.columns:
        return df
    if not isinstance(ids, DataFrame):
        hit = id_of(df, id_col).isin(*[int(i) for i in ids])
        return df.withColumn(label_col, F.when(hit, F.lit(value).cast(df.schema[label_col].dataType)).otherwise(F.col(label_col)))
    listed = _listed(df, ids, id_col).withColumn("__listed", F.lit(True))
    joined = spread_join(df.withColumn("__id", id_of(df, id_col)), listed, "__id", "left")
    label = F.when(F.col("__listed"), F.lit(value).cast(df.schema[label_col].dataType)).otherwise(F.col(label_col))
    return joined.withColumn(label_col, label).select(*df.columns)


def correction_report(
    df: DataFrame,
    ids: DataFrame | Sequence[int] = CORRECTED_IDS,
    id_col: str = "Participant_ID",
    label_col: str = "PHQ_Binary",
    value: int = 1,
) -> DataFrame:
    """One row per listed id: rows found, rows whose label changes, and whether it is missing."""
    listed = _listed(df, ids, id_col)
    changes = F.when(F.col(label_col).eqNullSafe(F.lit(value)), 0).otherwise(1)
    found = (
        df.select(id_of(df, id_col).alias("__id"), changes.alias("__changed"))
        .where(F.col("__id").isNotNull())
        .groupBy("__id")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("__changed").alias("n_changed"))
    )
    return listed.join(found, "__id", "left").select(
        F.col("__id").alias("id"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("n_changed", F.lit(0)).alias("n_changed"),
        F.col("n_rows").isNull().alias("missing"),
    )


def change_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before, rows after and rows removed."""
    sides = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(
        after.select(F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    counts = sides.agg(
        F.coalesce(F.sum("b"), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("a"), F.lit(0)).alias("rows_after")
    )
    return counts.withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))


def profile(df: DataFrame, id_col: str = "Participant_ID", prefix: str = "Rational_") -> DataFrame:
    """One row: rows, columns, candidate columns, lowest and highest id by value."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(sum(c.startswith(prefix) for c in df.columns)).alias("n_candidates"),
        F.min(id_of(df, id_col)).alias("min_id"),
        F.max(id_of(df, id_col)).alias("max_id"),
    )


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5, text: str | None = None, width: int = 200) -> DataFrame:
    """The first ``n`` rows; with ``text``, long values of that column end in ``...``."""
    head = df.orderBy(*order_by).limit(n)
    if text is None:
        return head
    col = F.col(text)
    return head.withColumn(text, F.when(F.length(col) > width, F.concat(F.left(col, F.lit(width)), F.lit("..."))).otherwise(col))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """``df`` itself, or a ``ValueError`` when it has no row. Runs a job that stops at the first row."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def require_values(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Raises when an action meets a row that breaks ``condition``."""
    held = F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(
        F.raise_error(F.lit(message)).cast("boolean")
    )
    return df.where(held)


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """``df`` itself, or a ``ValueError`` naming a repeated key. Runs a job over the key column."""
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).take(1)
    if repeated:
        raise ValueError(f"{key} is not unique: {repeated[0][0]}")
    return df


def id_range(df: DataFrame, id_col: str, lo: int, hi: int) -> DataFrame:
    """Rows with ``lo <= id <= hi``."""
    if lo < 0 or hi < lo:
        raise ValueError(f"id range needs 0 <= start <= end, got {lo} and {hi}")
    return df.where(id_of(df, id_col).between(lo, hi))


def class_pool(df: DataFrame, label_col: str, value: int) -> DataFrame:
    """Rows of one class."""
    return df.where(label_of(df, label_col) == value)
