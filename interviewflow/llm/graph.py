"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interviewflow.llm.store import stored


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One round: neighbours are moved to the least node seen; the small star takes smaller neighbours only."""
    one_way = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    both = one_way if small else one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    met = both.join(least, "a")
    if small:
        moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    else:
        moved = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``a, b``: every node that is not the least of its component, with that least node.

    Edges in any direction, repeated ones and loops too. Each round is written
    to the shared folder; only a count and a check sum come to the driver. The
    number of rounds grows with the logarithm of the longest chain.
    """
    current = stored(edges.where("a <> b").select("a", "b").distinct(), name)
    before = _state(current)
    while before[0]:
        current = stored(_stars(_stars(current, small=False), small=True), name)
        after = _state(current)
        if after == before:
            break
        before = after
    return current
