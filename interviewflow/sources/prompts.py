"""Prompts as one text file per key, by a data source of its own.

``<key>.txt`` holds the prompt, byte for byte, as other programs make and take
it. Only where a key cannot be a file name is a character written as a percent
code: ``/``, NUL, a leading ``.`` or ``_``, and a ``%`` that would be read as one.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from interviewflow.operators.tables import require_unique

# Characters with a percent code in file names.
CODES = {"%": "%25", "/": "%2F", "\0": "%00", ".": "%2E", "_": "%5F"}
SUFFIX = ".txt"
# Bytes and files of small files that one task reads.
PACK_BYTES = 32 << 20
PACK_FILES = 2000


def file_stem(key: str) -> str:
    """The name of a key's file, without ``.txt``."""
    marked = re.sub("%(?=25|2[FfEe]|00|5[Ff])", CODES["%"], key)
    marked = marked.replace("/", CODES["/"]).replace("\0", CODES["\0"])
    return CODES[marked[0]] + marked[1:] if marked[:1] in (".", "_") else marked


def key_of_stem(stem: str) -> str:
    return re.sub("%(25|2[FfEe]|00|5[Ff])", lambda m: chr(int(m[1], 16)), stem)


class LocalFolder:
    """Files of a path that every worker can open: local, or a shared mount."""

    def list(self, folder: str) -> list[tuple[str, int]]:
        return [(os.path.join(at, n), os.path.getsize(os.path.join(at, n))) for at, _, names in os.walk(folder) for n in names]

    def read(self, path: str) -> bytes:
        with open(path, "rb") as file:
            return file.read()

    def write(self, path: str, data: bytes) -> None:
        with open(path, "wb") as file:
            file.write(data)

    def open(self, path: str):
        """The file, to be read from any place of it."""
        return open(path, "rb")

    def create(self, path: str):
        """A new file, to be written from its start to its end."""
        return open(path, "wb")

    def make(self, folder: str) -> None:
        os.makedirs(folder, exist_ok=True)

    def remove(self, folder: str) -> None:
        shutil.rmtree(folder, ignore_errors=True)

    def move(self, folder: str, to: str) -> None:
        os.rename(folder, to)


class RemoteFolder:
    """The same for any address that Arrow knows, as of HDFS or an object store."""

    def __init__(self, system):
        self.system = system

    def list(self, folder: str) -> list[tuple[str, int]]:
        from pyarrow.fs import FileSelector, FileType

        found = self.system.get_file_info(FileSelector(folder, recursive=True))
        return [(f.path, f.size) for f in found if f.type == FileType.File]

    def read(self, path: str) -> bytes:
        with self.system.open_input_stream(path) as stream:
            return stream.readall()

    def write(self, path: str, data: bytes) -> None:
        with self.system.open_output_stream(path) as stream:
            stream.write(data)

    def open(self, path: str):
        return self.system.open_input_file(path)

    def create(self, path: str):
        return self.system.open_output_stream(path)

    def make(self, folder: str) -> None:
        self.system.create_dir(folder, recursive=True)

    def remove(self, folder: str) -> None:
        from pyarrow.fs import FileType

        if self.system.get_file_info(folder).type == FileType.Directory:
            self.system.delete_dir(folder)

    def move(self, folder: str, to: str) -> None:
        self.system.move(folder, to)


def system_of(folder: str) -> tuple[LocalFolder | RemoteFolder, str]:
    """What opens files of a folder, and the folder's path in it."""
    plain = re.sub("^file:/+", "/", folder)
    if "://" not in plain:
        return LocalFolder(), plain
    from pyarrow.fs import FileSystem

    system, path = FileSystem.from_uri(plain)
    return RemoteFolder(system), path


class Packed(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PromptReader(DataSourceReader):
    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix

    def partitions(self) -> list[Packed]:
        """Files in packs; their names and sizes are listed here, like those of any scan."""
        system, path = system_of(self.folder)
        inside = [(name, size, name[len(path) :].strip("/").split("/")) for name, size in system.list(path) if name.endswith(self.suffix)]
        files = sorted((name, size) for name, size, parts in inside if not any(p[0] in "._" for p in parts))
        seen: set[str] = set()
        packs: list[list[str]] = [[]]
        room = PACK_BYTES
        for name, size in files:
            stem = name.rsplit("/", 1)[-1]
            if stem in seen:
                raise ValueError(f"two files of one key: {stem}")
            seen.add(stem)
            if packs[-1] and (size > room or len(packs[-1]) >= PACK_FILES):
                packs.append([])
                room = PACK_BYTES
            packs[-1].append(name)
            room -= size
        return [Packed(p) for p in packs]

    def read(self, partition: Packed) -> Iterator[tuple[str, str]]:
        system, _ = system_of(self.folder)
        for path in partition.paths:
            text = system.read(path).decode("utf-8", "replace")
            yield key_of_stem(path.rsplit("/", 1)[-1].removesuffix(self.suffix)), text


class Staged(WriterCommitMessage):
    def __init__(self, files: int):
        self.files = files


class PromptWriter(DataSourceWriter):
    """Tasks write into a hidden folder, which a commit renames into place as a whole, or file by file to add to what is there."""

    def __init__(self, folder: str, suffix: str, overwrite: bool):
        self.folder, self.suffix, self.overwrite = folder.rstrip("/"), suffix, overwrite
        parent, _, name = self.folder.rpartition("/")
        self.staged = f"{parent}/.{name}.{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Staged:
        system, staged = system_of(self.staged)
        system.make(staged)
        n = 0
        for row in rows:
            # A task that runs again writes the same files.
            system.write(f"{staged}/{file_stem(row.key)}{self.suffix}", (row.prompt or "").encode())
            n += 1
        return Staged(n)

    def commit(self, messages: list[Staged | None]) -> None:
        system, staged = system_of(self.staged)
        path = system_of(self.folder)[1]
        system.make(staged)
        if not self.overwrite:
            system.make(path)
            for name, _ in system.list(staged):
                system.move(name, f"{path}/{name.rsplit('/', 1)[-1]}")
            system.remove(staged)
            return
        system.make(path.rpartition("/")[0])
        system.remove(path)
        system.move(staged, path)

    def abort(self, messages: list[Staged | None]) -> None:
        system, staged = system_of(self.staged)
        system.remove(staged)


class PromptFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "prompt_files"

    def schema(self) -> str:
        return "key string, prompt string"

    def reader(self, schema) -> PromptReader:
        return PromptReader(self.options["path"], self.options.get("suffix", SUFFIX))

    def writer(self, schema, overwrite: bool) -> PromptWriter:
        return PromptWriter(self.options["path"], self.options.get("suffix", SUFFIX), overwrite)


def named_prompts(files: DataFrame, *more: Column) -> DataFrame:
    """(key, prompt) of files read as whole texts by a stream, and ``more`` of the scan."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1)
    # Percent codes of the path are resolved, where a plus sign is itself, then those of the file name.
    stem = F.regexp_replace(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), r"\.txt$", "")
    key = F.regexp_replace(stem, "(?i)%2F", "/")
    for char, code in (("\0", CODES["\0"]), (".", CODES["."]), ("_", CODES["_"]), ("%", CODES["%"])):
        key = F.regexp_replace(key, f"(?i){code}", char)
    return files.select(key.alias("key"), F.col("value").alias("prompt"), *more)


def read_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """(key, prompt) of the text files below a folder, empty ones too; two files of one key are an error."""
    spark.dataSource.register(PromptFiles)
    return spark.read.format("prompt_files").load(folder)


def write_prompts(df: DataFrame, folder: str, key: str = "key", prompt: str = "prompt", mode: str = "overwrite", suffix: str = SUFFIX) -> None:
    """``<key>.txt`` for each row, in place of what the folder held; a key that is missing or repeated is an error.

    This makes as many files as there are keys, for hand-over to other
    programs. Between Spark jobs keep prompts in a table instead. The folder
    changes at once, when all files are written; with mode ``append`` files are
    added, and replaced, one by one. Texts of another kind have another ``suffix``.
    """
    df.sparkSession.dataSource.register(PromptFiles)
    text = F.col(key).cast("string")
    named = F.when(F.coalesce(text, F.lit("")) == "", F.raise_error(F.lit("a prompt has no key")).cast("string")).otherwise(text)
    rows = df.select(named.alias("key"), F.col(prompt).alias("prompt"))
    require_unique(rows, "key")
    rows.write.format("prompt_files").mode(mode).option("suffix", suffix).save(folder)
