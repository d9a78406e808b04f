"""Tables written once to the shared folder and read back, so that a long plan is cut there.

Every executor and the driver can read them, and they outlive lost executors.
They are removed when the session's JVM ends, or by ``release`` once nothing
reads them any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from interviewflow.session import setting, shared_path, shuffles_end_with_jobs  # noqa: F401, the operators take it from here


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` computed now, kept as Parquet in the shared folder."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def rows_at_once(spark: SparkSession, n: int):
    """Jobs that run inside send at most ``n`` rows to a Python worker at once: few megabytes, where rows are large."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(n))


def release(*tables: DataFrame) -> None:
    """Removes stored tables; frames built on them must have been computed."""
    for table in tables:
        context = table.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
