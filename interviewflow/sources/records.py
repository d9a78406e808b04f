"""Records of delimited files whose quoted cells span lines, read by as many tasks as the files have splits.

A split does not tell whether it begins inside a quoted cell. Each line is a
function from that state to the state behind it: it keeps it, flips it, or sets
it. One pass composes the functions of each split; a running composition over
the splits of each file, one short row per split, gives the state in which
every split begins; then each split cuts its own lines into records. A record
that crosses splits is put together from one piece per split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from interviewflow.session import cut

# Pieces of records: whole, going on from the split before, going on into the next split.
WHOLE, GOING_ON, BEGUN = 0, 1, 2


def file_name() -> Column:
    """Name of the file a row was read from, as it is in the folder (Spark gives it URL-encoded)."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def row_place() -> list[Column]:
    """Columns that hold the place of a row; to be taken directly from a scan."""
    return [
        file_name().alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    ]


def splittable(encoding: str) -> bool:
    """Whether line ends, quotes and separators are single ASCII bytes in this encoding."""
    return 'a,"\n'.encode(encoding) == b'a,"\n'


def open_quote(line: Column | str, sep: str) -> Column:
    """Whether a cell begins with a quote on this line and does not end on it.

    Quotes elsewhere, as in ``5" tall``, are text.
    """
    mark = re.escape(sep)
    text = F.col(line) if isinstance(line, str) else line
    rest = F.regexp_replace(text, rf'(^|{mark})"(?:[^"]|"")*+"(?={mark}|$)', "$1")
    # Most lines have no cell that begins with a quote, and are looked at no further.
    some = text.startswith('"') | text.contains(f'{sep}"')
    return F.coalesce(some & rest.rlike(rf'(?:^|{mark})"'), F.lit(False))


def lines_of(spark: SparkSession, path: str | list[str], encoding: str = "utf-8", **options) -> DataFrame:
    """``file`` (a hash of the path), ``file_name, block, line`` and ``value``, with a carriage return if there is one."""
    read = spark.read.options(**options).option("lineSep", "\n").text(path)
    value = F.col("value") if encoding.lower() in ("utf-8", "utf8") else F.decode(F.col("value").cast("binary"), encoding)
    return read.select(F.xxhash64("_metadata.file_path").alias("file"), *row_place(), value.alias("value"))


def line_states(sep: str) -> list[Column]:
    """``out, inside``: whether a cell is open behind the line, if none or one was open before it."""
    text = F.regexp_replace("value", r"\r$", "")
    going_on = F.when(F.col("value").contains('"'), open_quote(F.concat(F.lit('"'), text), sep)).otherwise(F.lit(True))
    return [open_quote(text, sep).alias("out"), going_on.alias("inside")]


def composed(out, inside) -> tuple[bool, bool]:
    """The function of all lines together."""
    import numpy as np

    sets = np.flatnonzero(out == inside)
    flips = out & ~inside
    if len(sets):
        state = bool(out[sets[-1]]) ^ bool(flips[sets[-1] + 1 :].sum() & 1)
        return state, state
    odd = bool(flips.sum() & 1)
    return odd, not odd


def states_before(out, inside, start: bool):
    """The state before each line, and the one behind the last."""
    import numpy as np

    n = len(out)
    last_set = np.maximum.accumulate(np.where(out == inside, np.arange(n), -1))
    flips = np.cumsum(out & ~inside)
    at = np.maximum(last_set, 0)
    base = np.where(last_set >= 0, out[at], start)
    behind = base ^ (((flips - np.where(last_set >= 0, flips[at], 0)) & 1) == 1)
    return np.concatenate([[start], behind[:-1]]).astype(bool), bool(behind[-1])


def _runs(*columns):
    """Bounds of the runs of equal rows."""
    import numpy as np

    change = np.zeros(len(columns[0]) - 1, dtype=bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(columns[0])]
    return zip(edges, edges[1:])


def split_states(lines: DataFrame, sep: str) -> DataFrame:
    """One row per split: ``file, block, out, inside`` and ``opened``, whether some line may open a cell that it does not end."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            file, block, out, inside = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            done = []
            for low, high in _runs(file, block):
                a, b = composed(out[low:high], inside[low:high])
                opened = bool(out[low:high].any())
                if held is not None and held[:2] == (file[low], block[low]):
                    _, _, c, d, before = held
                    held = (*held[:2], (b if c else a), (b if d else a), before or opened)
                else:
                    done += [held] if held is not None else []
                    held = (file[low], block[low], a, b, opened)
            if done:
                yield table(done)
        if held is not None:
            yield table([held])

    def table(rows) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
        names = ["file", "block", "out", "inside", "opened"]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    schema = "file bigint, block bigint, out boolean, inside boolean, opened boolean"
    return lines.select("file", "block", *line_states(sep)).mapInArrow(run, schema)


def begin_states(splits: DataFrame) -> DataFrame:
    """``file, block, begins, ends``: the state before and behind each split, by a running composition per file."""
    in_file = Window.partitionBy("file").orderBy("block")
    flips = F.sum((F.col("out") & ~F.col("inside")).cast("bigint")).over(in_file)
    counted = splits.withColumn("flips", flips)
    last_set = F.last(F.when(F.col("out") == F.col("inside"), F.struct("out", "flips")), ignorenulls=True).over(in_file)
    placed = counted.withColumn("last", last_set)
    odd = (F.col("flips") - F.coalesce("last.flips", F.lit(0))) % 2 == 1
    ended = placed.withColumn("ends", F.coalesce("last.out", F.lit(False)) != odd)
    return ended.select("file", "block", F.coalesce(F.lag("ends").over(in_file), F.lit(False)).alias("begins"), "ends")


def pieces(lines: DataFrame, begins: DataFrame, sep: str) -> DataFrame:
    """``file, file_name, block, line, first, kind, value``: the records of each split, and the pieces of those that cross its ends.

    ``first`` marks the first record of a file that is not blank. ``begins``
    has a row for each split that begins inside a cell, and is sent to all tasks:
    two numbers for each split of a file, where the file itself has megabytes.
    """
    import pyarrow as pa

    names = ["file", "file_name", "block", "line", "first", "kind", "value"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        split, state, open_lines, place, kind, blank = None, False, [], None, WHOLE, True

        def close(over: bool) -> None:
            """Ends the piece at hand: the record ends here (``over``), or the split does."""
            nonlocal open_lines, kind, blank
            text = "\n".join(open_lines)
            if over:
                text = text.removesuffix("\r")
            if kind == GOING_ON or text.strip():
                made.append((*split, *place, blank and split[1] == 0 and kind == WHOLE, kind if over or kind == GOING_ON else BEGUN, text))
                blank = False
            open_lines, kind = [], WHOLE

        for batch in batches:
            if not batch.num_rows:
                continue
            file, block, out, inside, begun = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "block", "out", "inside", "begins"))
            file_names, lines, values = (batch.column(c).to_pylist() for c in ("file_name", "line", "value"))
            for low, high in _runs(file, block):
                if split != (file[low], block[low]):
                    if open_lines:
                        close(over=False)
                    split, state, blank = (file[low], block[low]), bool(begun[low]), True
                    kind = GOING_ON if state else WHOLE
                before, behind = states_before(out[low:high], inside[low:high], state)
                starts = (~before).nonzero()[0] + low
                bounds = [low, *starts.tolist(), high] if not len(starts) or starts[0] > low else [*starts.tolist(), high]
                for a, b in zip(bounds, bounds[1:]):
                    if not before[a - low] and open_lines:
                        close(over=True)
                    if not open_lines:
                        place = (file_names[a], lines[a])
                    open_lines += values[a:b]
                state = behind
                if not state and open_lines:
                    close(over=True)
            if made:
                yield table(made)
                made.clear()
        if open_lines:
            close(over=False)
        if made:
            yield table(made)

    def table(rows) -> pa.RecordBatch:
        by_name = [(f, n, b, i, first, kind, v) for f, b, n, i, first, kind, v in rows]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*by_name), types)], names=names)

    marked = lines.join(F.broadcast(begins.select("file", "block", F.lit(True).alias("begins"))), ["file", "block"], "left")
    wanted = ["file", "file_name", "block", "line", "value", F.coalesce("begins", F.lit(False)).alias("begins"), *line_states(sep)]
    schema = "file bigint, file_name string, block bigint, line bigint, first boolean, kind int, value string"
    return marked.select(*wanted).mapInArrow(run, schema)


def put_together(parts: DataFrame) -> DataFrame:
    """Records out of the pieces that cross splits: few rows, two per split at most."""
    in_file = Window.partitionBy("file").orderBy("block", "kind")
    numbered = parts.withColumn("record", F.sum((F.col("kind") == BEGUN).cast("int")).over(in_file))
    place = F.struct("block", "kind")
    ordered = F.array_sort(F.collect_list(F.struct("block", "kind", "value")))
    joined = numbered.groupBy("file", "record").agg(
        F.min_by("file_name", place).alias("file_name"),
        F.min("block").alias("block"),
        F.min_by("line", place).alias("line"),
        F.array_join(F.transform(ordered, lambda p: p["value"]), "\n").alias("value"),
    )
    return joined.select("file_name", "block", "line", F.regexp_replace("value", r"\r\z", "").alias("value"))


def has_open_cells(splits: DataFrame) -> bool:
    return not splits.where("opened").isEmpty()


def records(spark: SparkSession, path: str | list[str], sep: str, encoding: str = "utf-8", splits: DataFrame | None = None, **options) -> DataFrame:
    """``file_name, block, line, value``: the records of delimited files behind the header, those over several lines in one piece.

    ``splits`` are the states of a pass that was made already. A job composes
    the states; where no record crosses splits the files are then read once
    more, else twice.
    """
    lines = lines_of(spark, path, encoding, **options)
    if splits is None:
        splits = cut(split_states(lines, sep))
    states = cut(begin_states(splits).where("begins OR ends"))
    cells = pieces(lines, states.where("begins"), sep)
    whole = cells.where((F.col("kind") == WHOLE) & ~F.col("first")).select("file_name", "block", "line", "value")
    if states.isEmpty():
        return whole
    return whole.unionByName(put_together(cells.where(F.col("kind") != WHOLE)))


def parsed(rows: DataFrame, columns: list[str], sep: str) -> DataFrame:
    """``rows`` of ``records`` with their cells as text columns ``columns`` in place of ``value``."""
    schema = ", ".join(f"c{i} string" for i in range(len(columns)))
    cells = F.from_csv("value", schema, {"sep": sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"})
    found = rows.withColumn("value", cells)
    return found.select(*[F.col(c) for c in rows.columns if c != "value"], *[F.col(f"value.c{i}").alias(c) for i, c in enumerate(columns)])
