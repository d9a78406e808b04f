"""Stores of results that are paid for: batches of rows, seen once a log names them.

``<store>/data/<batch>`` holds the rows of a batch, ``<store>/log/<name>.json``
what a commit adds and takes away. A batch whose writer was stopped is in no
log, so nobody reads it. Commits are files of their own that appear whole; the
table is all that commits added less all that they took away, in any order.
Keys are kept as text, so a later run may have them in another type.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from interviewflow.sources.files import delete, exists, names_in, put_text, read_text

COLUMNS = (
    "key string, candidate_no int, text string, status string, error string, attempts int, "
    "finished boolean, run_id string, asked_at timestamp"
)
# Batches in the log beyond which a run packs them into one.
PACK_AT = 32


def key_text(key: str | Column, kind: T.DataType) -> Column:
    """A key as the store keeps it: whole numbers without a fraction, whatever their type."""
    col = F.col(key) if isinstance(key, str) else key
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        whole = col.try_cast("bigint")
        return F.when(whole == col, whole.cast("string")).otherwise(col.cast("string"))
    return col.cast("string")


def commits(spark: SparkSession, store: str) -> dict[str, dict]:
    """The log by name of commit."""
    return {n: json.loads(read_text(spark, f"{store}/log/{n}")) for n in names_in(spark, f"{store}/log")}


def live_batches(spark: SparkSession, store: str) -> list[str]:
    log = commits(spark, store).values()
    return sorted({b for c in log for b in c["added"]} - {b for c in log for b in c["removed"]})


def commit(spark: SparkSession, store: str, added: list[str], removed: list[str] = (), name: str | None = None, **about) -> None:
    """``name`` says which commit this is; one that is repeated after a failure replaces the first."""
    entry = {"added": list(added), "removed": list(removed), **about}
    put_text(spark, f"{store}/log/{name or uuid.uuid4().hex}.json", json.dumps(entry))


def committed(spark: SparkSession, store: str, name: str) -> bool:
    return exists(spark, f"{store}/log/{name}.json")


def batches_of(spark: SparkSession, store: str, name: str) -> list[str]:
    """What the commit of this name added."""
    return json.loads(read_text(spark, f"{store}/log/{name}.json"))["added"]


def read_results(spark: SparkSession, store: str) -> DataFrame:
    """All committed rows; a request may have several, of several runs."""
    paths = [f"{store}/data/{b}" for b in live_batches(spark, store)]
    # Without rows a plan knows it, so the prompts of a first run are joined to nothing.
    return spark.read.schema(COLUMNS).parquet(*paths) if paths else spark.createDataFrame([], COLUMNS).limit(0)


def append_results(rows: DataFrame, store: str, name: str | None = None, **about) -> int:
    """Writes ``rows`` (of ``COLUMNS``) as a batch and commits it; returns how many there were. No rows, no commit."""
    spark, batch = rows.sparkSession, uuid.uuid4().hex
    path = f"{store}/data/{batch}"
    rows.write.parquet(path)
    n = spark.read.schema(COLUMNS).parquet(path).count()
    if n or name:
        commit(spark, store, [batch] if n else [], name=name, rows=n, **about)
    if not n:
        delete(spark, path)
    return n


def pack(spark: SparkSession, store: str, files: int | None = None) -> None:
    """Packs all batches into one of at most ``files`` files; rows stay as they are.

    Batches that are packed stay on disk until the next packing, for tables
    that were planned on them; the log keeps one entry for what is live and
    the named ones.
    """
    log, live = commits(spark, store), live_batches(spark, store)
    if len(live) < 2:
        return
    gone = sorted({b for c in log.values() for b in c["removed"]})
    batch = uuid.uuid4().hex
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    read_results(spark, store).repartition(files, "key").write.parquet(f"{store}/data/{batch}")
    commit(spark, store, [batch], [*live, *gone], packed=len(live))
    for old in gone:
        delete(spark, f"{store}/data/{old}")
    for name, entry in log.items():
        if "stream" not in entry:
            delete(spark, f"{store}/log/{name}")


def attempt_ledger(spark: SparkSession, store: str, max_attempts: int | None = None, retry_after: float = 0.0) -> DataFrame:
    """One row per request over all runs: attempts, its state, the last error, and when it is due again.

    ``state`` is ``ok``, ``open`` or, with ``max_attempts`` failed ones, ``dead``. The wait
    of ``retry_after`` seconds doubles with each attempt after the first.
    """
    rows = read_results(spark, store)
    last = F.struct("asked_at", "error")
    per_request = rows.groupBy("key", "candidate_no").agg(
        F.sum("attempts").alias("attempts"),
        F.max("finished").alias("finished"),
        F.max(F.when(~F.col("finished"), last)).alias("last"),
    )
    tired = F.lit(False) if max_attempts is None else F.col("attempts") >= max_attempts
    state = F.when(F.col("finished"), "ok").when(tired, "dead").otherwise("open")
    wait = F.make_dt_interval(secs=F.lit(float(retry_after)) * F.pow(F.lit(2.0), F.least(F.col("attempts"), F.lit(30)) - 1))
    due = F.when(state == "open", F.col("last.asked_at") + wait)
    return per_request.select(
        "key", "candidate_no", "attempts", state.alias("state"), F.col("last.error").alias("error"), due.alias("due")
    )
