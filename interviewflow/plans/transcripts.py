"""Transcript tables from folders of utterance files."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interviewflow.functions.columns import resolve_column
from interviewflow.functions.ids import id_from_filename, normalize_id
from interviewflow.operators.transcripts import (
    build_transcripts,
    join_transcripts,
    update_transcripts,
)
from interviewflow.operators.spread import concat_ordered
from interviewflow.operators.tables import unmatched
from interviewflow.session import cut, kept, small_files
from interviewflow.sources.sinks import has_version, read_versioned, write_formats, write_versioned
from interviewflow.sources.tables import ORDER, read_table
from interviewflow.sources.transcripts import PATTERN, file_states, read_utterances

SPLITS = {"test": ("test",), "train": ("train",), "both": ("test", "train")}


def transcript_splits(spark: SparkSession, folder: str, metadata: Mapping[str, str], split: str = "both") -> dict[str, DataFrame]:
    """Metadata of each wanted split with transcripts; ``metadata`` maps a split to its file.

    The id is the file name up to its first ``_``; texts are taken as they are.
    """
    if split not in SPLITS:
        raise ValueError(f"split is one of {sorted(SPLITS)}, not {split!r}")
    found = read_utterances(spark, folder, text_names=("Text",))
    by_file = found.withColumn("Participant_ID", id_from_filename(F.col("file_name")))
    transcripts = build_transcripts(by_file, "Participant_ID", ORDER, out="Transcript")
    return {
        name: join_transcripts(read_table(spark, metadata[name]), transcripts, text="Transcript")
        for name in SPLITS[split]
    }


def transcripts_by_id(utterances: DataFrame, id_col: str = "Participant_ID") -> DataFrame:
    """Squeezed transcripts per normalized id, from files named ``<digits>_…``.

    Blank cells are null once squeezed, so the pieces of all files of an id
    are joined in file order at once; ids without any text are left out.
    """
    named = utterances.withColumn(id_col, normalize_id(id_from_filename(F.col("file_name"), strict=True)))
    built = build_transcripts(named.where(F.col(id_col).isNotNull()), id_col, ORDER, collapse=True)
    return built.where(F.col("transcript") != "")


def roster_update(
    spark: SparkSession,
    roster: DataFrame,
    folder: str,
    pattern: str = PATTERN,
    mode: str = "overwrite",
    id_col: str | None = None,
    sep: str = ",",
    encoding: str = "utf-8",
) -> DataFrame:
    """Roster with the transcripts of a folder, and which rows took one (``updated``).

    One job looks at the files while the plan is built.
    """
    id_col = resolve_column(roster.columns, chosen=id_col)
    found = read_utterances(spark, folder, pattern, sep=sep, encoding=encoding, need_text=True)
    return update_transcripts(roster, transcripts_by_id(found, id_col), mode, id_col)


# What a file ledger keeps of each file: which state of it was read, whose it is, and its text.
LEDGER = "file_name string, length bigint, modified timestamp, id string, transcript string"


def refresh_ledger(
    spark: SparkSession, folder: str, state: str, run_id: str, pattern: str = PATTERN, sep: str = ",", encoding: str = "utf-8"
) -> DataFrame:
    """Brings the ledger at ``state`` up to the files of a folder; returns the ids of files that came, changed or went.

    Names, lengths and times of all files are listed, and only files that are
    new or not as they were are opened. The ledger is a versioned table
    (``write_versioned``): a run that is stopped leaves the one before.
    """
    # All scans of the folder run in here: thousands of small files a task.
    with small_files(spark):
        return _refresh(spark, folder, state, run_id, pattern, sep, encoding)


def _refresh(spark: SparkSession, folder: str, state: str, run_id: str, pattern: str, sep: str, encoding: str) -> DataFrame:
    old = read_versioned(spark, state) if has_version(spark, state) else spark.createDataFrame([], LEDGER)
    now = cut(file_states(spark, folder, pattern))
    changed = cut(now.join(old, ["file_name", "length", "modified"], "left_anti"))
    gone = old.join(now, ["file_name", "length", "modified"], "left_anti").select("file_name", "id")
    first = changed.agg(F.min("modified")).first()[0]
    fresh = spark.createDataFrame([], "file_name string, id string, transcript string")
    if first is not None:
        after = (first - timedelta(seconds=2)).replace(microsecond=0).isoformat()
        found = read_utterances(spark, folder, pattern, sep=sep, encoding=encoding, need_text=True, modifiedAfter=after)
        found = found.join(changed.select("file_name"), "file_name", "left_semi")
        named = found.withColumn("id", normalize_id(id_from_filename(F.col("file_name"), strict=True)))
        fresh = build_transcripts(named.where(F.col("id").isNotNull()), ["file_name", "id"], ORDER[1:], collapse=True)
    entries = changed.join(fresh, "file_name", "left").select("file_name", "length", "modified", "id", "transcript")
    kept_rows = old.join(now, ["file_name", "length", "modified"], "left_semi").select(*entries.columns)
    write_versioned(kept_rows.unionByName(entries), state, run_id)
    touched = read_versioned(spark, state).join(changed.select("file_name"), "file_name", "left_semi").select("id")
    return touched.unionByName(gone.select("id")).where("id IS NOT NULL").distinct()


def ledger_transcripts(spark: SparkSession, state: str, id_col: str = "Participant_ID") -> DataFrame:
    """Transcripts per id out of a ledger: the texts of its files in the order of their names."""
    rows = read_versioned(spark, state).where("transcript <> ''")
    numbered = rows.select(F.col("id").alias(id_col), "file_name", F.lit(0).alias("line"), "transcript")
    return concat_ordered(numbered, [id_col], "transcript", ["file_name", "line"])


def roster_refresh(
    spark: SparkSession,
    roster: DataFrame,
    folder: str,
    state: str,
    run_id: str,
    pattern: str = PATTERN,
    mode: str = "overwrite",
    id_col: str | None = None,
    sep: str = ",",
    encoding: str = "utf-8",
) -> DataFrame:
    """Like ``roster_update``, of a folder that grows: a further run opens new and changed files only.

    Only rows whose files came, changed or went since the run before take a
    transcript; ``updated`` says which. The job runs at once.
    """
    id_col = resolve_column(roster.columns, chosen=id_col)
    touched = refresh_ledger(spark, folder, state, run_id, pattern, sep, encoding)
    fresh = ledger_transcripts(spark, state, id_col)
    # The ledger of the next run replaces this one; what this run gave stays.
    fresh = kept(fresh.join(touched.withColumnRenamed("id", id_col), id_col, "left_semi"), "transcripts")
    return update_transcripts(roster, fresh, mode, id_col)


def roster_update_files(
    spark: SparkSession,
    roster: str,
    folder: str,
    out: str,
    pattern: str = PATTERN,
    mode: str = "overwrite",
    id_col: str | None = None,
    sep: str = ",",
    encoding: str = "utf-8",
) -> DataFrame:
    """From a roster file and a folder to ``<out>.csv``; returns the ids of transcripts without a roster row."""
    rows = read_table(spark, roster, sep, encoding=encoding)
    name = resolve_column(rows.columns, chosen=id_col)
    found = read_utterances(spark, folder, pattern, sep=sep, encoding=encoding, need_text=True)
    fresh = transcripts_by_id(found, name)
    write_formats(update_transcripts(rows, fresh, mode, name).drop("updated"), out, "csv", sep)
    return unmatched(fresh.select(name), rows.select(normalize_id(F.col(name)).alias(name)), name)
