"""Session helpers for local runs, and the shared folder for written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "interviewflow", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster use the session you have."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="interviewflow-"))
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _leave_with_session(spark.sparkContext, path)
    return path


def _leave_with_session(context, path: str) -> None:
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffles_end_with_jobs(spark: SparkSession):
    """Shuffle files of jobs that run inside are removed when their job ends, not when the driver collects garbage.

    For jobs that write a table: what they wrote is read afterwards, never their shuffles.
    """
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_files(spark: SparkSession):
    """Scans planned inside pack up to some thousand small files in a task, where Spark by itself counts 4 MB for each."""
    return setting(spark, "spark.sql.files.openCostInBytes", "64k")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, for a plan that reads it several times.

    Meant for narrow tables of keys. The copy outlives lost executors and is
    removed when the session's JVM ends.
    """
    context = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    # The context has a folder of its own below the shared one.
    _leave_with_session(context, context.getCheckpointDir())
    return df.checkpoint()


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once and kept as Parquet in the shared folder, texts too, for a plan that reads it several times."""
    path = shared_path(df.sparkSession, name)
    with shuffles_end_with_jobs(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str, dealt: bool = True, codec: str | None = None) -> DataFrame:
    """Like ``kept``, in as many buckets of ``key`` as the session has shuffle partitions.

    Joins and groupings by ``key`` read the buckets in place: only the other
    side is shuffled. The table is in the catalog while it is written; it stays
    readable through the returned frame. Without ``dealt`` rows are not shuffled
    before they are written, for few large rows, or rows that lie by ``key`` already:
    each task writes its own files. ``codec`` is that of Parquet.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    writer = (df.repartition(buckets, key) if dealt else df).write.option("path", shared_path(spark, name))
    writer = writer.option("compression", codec) if codec else writer
    with shuffles_end_with_jobs(spark):
        writer.bucketBy(buckets, key).format("parquet").saveAsTable(table)
    found = spark.table(table)
    found.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {table}")
    return found
