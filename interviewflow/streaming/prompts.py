"""Prompt files processed as they arrive; requests stay open until they are answered."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from interviewflow.operators.generate import Generator, answer_requests, finished, stored_results
from interviewflow.operators.store import COLUMNS, batches_of, read_results
from interviewflow.operators.tables import keep_first
from interviewflow.sources.files import delete, exists, put_text, read_text
from interviewflow.sources.prompts import named_prompts

OPEN = "key string, prompt string, candidate_no int, attempts bigint"


def open_requests(spark: SparkSession, out: str) -> DataFrame:
    """``key, prompt, candidate_no, attempts`` of the requests that wait for an answer."""
    return _open_of(spark, _state(spark, out))


def stream_results(spark: SparkSession, out: str) -> DataFrame:
    """One row per request asked so far: the answer, or the last failure."""
    return stored_results(spark, out)


def _state(spark: SparkSession, out: str) -> dict:
    path = f"{out}/open.json"
    return json.loads(read_text(spark, path)) if exists(spark, path) else {"table": None, "batch": None}


def _open_of(spark: SparkSession, state: dict) -> DataFrame:
    return spark.read.schema(OPEN).parquet(state["table"]) if state["table"] else spark.createDataFrame([], OPEN)


def _round(
    spark: SparkSession,
    new: DataFrame | None,
    n: int,
    generator: Generator,
    out: str,
    name: str,
    done: DataFrame | None,
    partitions: int | None,
    max_attempts: int | None,
) -> None:
    """Asks what is open and what is new, keeps the answers, and then what is still open. Done again, it changes nothing."""
    state = _state(spark, out)
    if state["batch"] == name:
        return
    todo = _open_of(spark, state)
    if new is not None:
        # A key that came before is known by its answers or by what is open.
        known = read_results(spark, out).where("finished").select("key", "candidate_no").unionByName(todo.select("key", "candidate_no"))
        if done is not None:
            known = known.unionByName(done.where(finished()).select(F.col("key").cast("string").alias("key"), "candidate_no"))
        first = keep_first(new, "key", ["file_time", "file_path"], id_type=None)
        numbered = first.select("key", "prompt", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("candidate_no"))
        fresh = numbered.join(known, ["key", "candidate_no"], "left_anti")
        todo = todo.unionByName(fresh.withColumn("attempts", F.lit(0).cast("bigint")))
    asked = f"{out}/open/{uuid.uuid4().hex}"
    todo.write.parquet(asked)
    todo = spark.read.schema(OPEN).parquet(asked)
    answer_requests(todo.select("key", "candidate_no", "prompt"), generator, out, name, partitions=partitions, name=name, stream=name)
    paths = [f"{out}/data/{b}" for b in batches_of(spark, out, name)]
    answers = spark.read.schema(COLUMNS).parquet(*paths) if paths else spark.createDataFrame([], COLUMNS)
    tried = answers.groupBy("key", "candidate_no").agg(F.max("finished").alias("finished"), F.sum("attempts").alias("more"))
    left = todo.join(tried, ["key", "candidate_no"], "left").where(~F.coalesce("finished", F.lit(False)))
    left = left.select("key", "prompt", "candidate_no", (F.col("attempts") + F.coalesce("more", F.lit(0))).alias("attempts"))
    if max_attempts is not None:
        left = left.where(F.col("attempts") < max_attempts)
    table = f"{out}/open/{uuid.uuid4().hex}"
    left.write.parquet(table)
    put_text(spark, f"{out}/open.json", json.dumps({"table": table, "batch": name}))
    delete(spark, asked)
    if state["table"]:
        delete(spark, state["table"])


def stream_generate(
    spark: SparkSession,
    folder: str,
    n: int,
    generator: Generator,
    out: str,
    checkpoint: str,
    done: DataFrame | None = None,
    files_per_batch: int | None = None,
    partitions: int | None = None,
    max_attempts: int | None = None,
) -> StreamingQuery:
    """Generates ``n`` results for each new prompt file and keeps them in the result store ``out``.

    Takes what is there and stops; a restart with the same ``checkpoint`` takes
    only new files. A request that failed stays open, with its prompt, in a
    table that each micro-batch reads and replaces: it is asked again with the
    next files, and at every start, also without new files, until it is
    answered or has ``max_attempts`` failed attempts. Requests are dealt over
    ``partitions`` tasks like those of ``generate``.

    ``done`` holds results to skip. Of several files of one key the first
    counts. Answers of a micro-batch are committed under its number, so one
    that is repeated after a failure does not ask again what it has committed.
    """
    if not open_requests(spark, out).isEmpty():
        _round(spark, None, n, generator, out, f"open-{uuid.uuid4().hex}", done, partitions, max_attempts)
    reader = spark.readStream.schema("value string").options(
        wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    prompts = named_prompts(
        reader.format("text").load(folder),
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_path").alias("file_path"),
    )

    def take(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        _round(batch.sparkSession, batch, n, generator, out, f"stream-{query}-{number}", done, partitions, max_attempts)

    return prompts.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
