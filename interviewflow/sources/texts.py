"""Long texts written once and looked up where they are needed.

Rows carry the place of a text, ``<file>:<start>:<packed bytes>:<bytes>``,
through joins and shuffles; the text is read by the task that puts a row
together. So it takes its room on disk once, however many rows need it. Texts
lie packed, in files of a folder that every worker can open, like those of
prompts. Where a folder has an address that Python cannot open, the packed text
itself, ``=<bytes>:<text>``, stands for its place.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from interviewflow.functions.text import strip_bytes
from interviewflow.sources.prompts import system_of

# Packed bytes that a worker looks up at once, and bytes of whole texts that it hands on at once.
READ_BYTES = 16 << 20
SEND_BYTES = 4 << 20
# Texts of a file that lie this close are read in one go, of about this length at most.
GAP_BYTES = 16 << 10
RUN_BYTES = 4 << 20
LEVEL = 3
# What begins a text that goes with its row.
HERE = b"="


def _opens(folder: str) -> bool:
    """Whether workers can open a folder; its address names a file system."""
    if not re.match("/|file:|[^:/]+://", folder):
        return False
    try:
        system_of(folder)
    except (ValueError, OSError, NotImplementedError):
        return False
    return True


def put_texts(text: Column, folder: str) -> Column:
    """The places of binary texts, which the job that computes the column writes to ``folder``; null stays null.

    A task writes one file. Equal texts of an Arrow batch, and equal neighbours, are written once.
    """
    opens = _opens(folder)

    @F.arrow_udf("binary")
    def put(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = pa.Codec("zstd", LEVEL)
        name, file, end = uuid.uuid4().hex, None, 0
        last: tuple[bytes | None, bytes | None] = (None, None)
        try:
            for cells in batches:
                known, places = dict([last]), []
                for cell in cells:
                    text = cell.as_py()
                    if text is not None and text not in known:
                        packed = codec.compress(text, asbytes=True)
                        if not opens:
                            known[text] = HERE + b"%d:" % len(text) + packed
                        else:
                            if file is None:
                                system, path = system_of(folder)
                                system.make(path)
                                file = system.create(f"{path}/{name}")
                            file.write(packed)
                            known[text] = f"{folder}/{name}:{end}:{len(packed)}:{len(text)}".encode()
                            end += len(packed)
                    places.append(None if text is None else known[text])
                    last = (text, places[-1])
                yield pa.array(places, pa.binary())
        finally:
            if file is not None:
                file.close()

    return put(text)


def packed_at(places: Iterable[bytes]) -> dict[bytes, bytes]:
    """The texts at ``places``, still packed; those that lie close are read in one go."""
    files: dict[str, list] = {}
    for place in set(places):
        path, start, size, _ = place.decode().rsplit(":", 3)
        files.setdefault(path, []).append((int(start), int(start) + int(size), place))
    systems: dict = {}
    found = {}
    for path, texts in files.items():
        folder, _, name = path.rpartition("/")
        if folder not in systems:
            systems[folder] = system_of(folder)
        system, at = systems[folder]
        texts.sort()
        with system.open(f"{at}/{name}") as file:
            i = 0
            while i < len(texts):
                first, end, _ = texts[i]
                j = i + 1
                while j < len(texts) and texts[j][0] - end <= GAP_BYTES and texts[j][1] - first <= RUN_BYTES:
                    end = texts[j][1]
                    j += 1
                file.seek(first)
                run = memoryview(file.read(end - first))
                for start, stop, place in texts[i:j]:
                    found[place] = bytes(run[start - first : stop - first])
                i = j
    return found


def _size(place: bytes) -> int:
    return len(place) if place.startswith(HERE) else int(place.rsplit(b":", 2)[1])


def _unpacked(place: bytes, packed: dict[bytes, bytes], codec: pa.Codec) -> bytes:
    if place.startswith(HERE):
        size, _, text = place[1:].partition(b":")
    else:
        size, text = place.rsplit(b":", 1)[1], packed[place]
    return codec.decompress(text, int(size), asbytes=True)


def _units(recipes: list) -> Iterator[list]:
    """Runs of recipes whose texts have about ``READ_BYTES``."""
    unit, seen, size = [], set(), 0
    for recipe in recipes:
        places = {p for p in recipe[1::2] if p is not None}
        more = sum(map(_size, places - seen))
        if unit and size + more > READ_BYTES:
            yield unit
            unit, seen, size = [], set(), 0
            more = sum(map(_size, places))
        unit.append(recipe)
        seen |= places
        size += more
    if unit:
        yield unit


def put_together(recipes: list, strip: bool = False) -> Iterator[list[bytes]]:
    """The texts of recipes in their order, in lists of about ``SEND_BYTES``; ``strip``: without white space at their ends.

    A recipe has pieces of text and places by turns, as bytes, and begins and
    ends with a piece. A null place is an empty text.
    """
    codec = pa.Codec("zstd")
    for unit in _units(recipes):
        packed = packed_at(p for recipe in unit for p in recipe[1::2] if p is not None and not p.startswith(HERE))
        out, size = [], 0
        for recipe in unit:
            turns = list(recipe)
            for i in range(1, len(turns), 2):
                place = turns[i]
                turns[i] = b"" if place is None else _unpacked(place, packed, codec)
            text = b"".join(turns)
            out.append(strip_bytes(text) if strip else text)
            size += len(text)
            if size >= SEND_BYTES:
                yield out
                out, size = [], 0
        if out:
            yield out


def recipe_of(pieces: list[Column], places: list[Column]) -> Column:
    """The recipe of a text: ``pieces`` with the texts at ``places`` between them."""
    turns = [c for pair in zip(pieces, places) for c in pair] + [pieces[-1]]
    return F.array(*[c.cast("binary") for c in turns])


def text_of(recipe: Column, strip: bool = False) -> Column:
    """The text of a recipe, read where the row lies: before, a row needs no more room than its recipe."""

    @F.arrow_udf("binary")
    def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for cells in batches:
            for texts in put_together(cells.to_pylist(), strip):
                yield pa.array(texts, pa.binary())

    return whole(recipe).cast("string")


def text_at(place: Column) -> Column:
    """The text at a place, null where there is none."""
    return F.when(place.isNotNull(), text_of(recipe_of([F.lit(""), F.lit("")], [place])))
