"""Removal of byte strings of ``least`` bytes that also start earlier in the table.

Every window of ``least`` bytes belongs to the place of the least hash among
its ``GRAM``-byte grams. Equal windows have equal least hashes, so only the
fragments around one hash value have to meet. Equal fragments are told by a
hash of their bytes: all but the earliest are repeats as a whole, and no text
moves for them. Where different fragments share a gram, one of each goes to a
task that builds a Burrows-Wheeler transform of them. Breadth-first backward
extension finds interval by interval where neighbouring suffixes have 0, 1, 2,
... bytes in common and stops below ``least``: the borders that are left
undefined join equal windows. A gram with more than ``HOT`` different
fragments is dealt by whole windows instead, which is exact and spreads it.

Order of documents is that of their ids, nulls first; rows of one id go by
their text, and equal rows one after the other. A null text is an empty one.
Matches never cross documents. Hashes have 48 bits for grams, which only
decide what meets, and 64 more for equal fragments. Columns other than id and
text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from interviewflow.llm.store import stored
from interviewflow.llm.worker import byte_texts

LEAST = 100
GRAM = 24
# Bytes looked at in one go, so that a place fits into 16 bits.
CHUNK = 1 << 16
HOT = 4096
# Bytes of fragments in one transform.
TRANSFORM = 1 << 18
MULTIPLIER = 0x9E3779B97F4A7C15


def gram_hashes(data, gram: int):
    """A 48-bit hash, in the high bits, of every run of ``gram`` bytes."""
    import numpy as np

    power, width, hashes = MULTIPLIER, 1, data.astype(np.uint64) + np.uint64(1)
    parts, at, left = None, 0, gram
    while left:
        if left & 1:
            moved = hashes[at : at + len(data) - gram + 1]
            parts = moved if parts is None else parts * np.uint64(power) + moved
            at += width
        left >>= 1
        if left:
            hashes = hashes[:-width] * np.uint64(power) + hashes[width:]
            power, width = power * power % (1 << 64), 2 * width
    mixed = (parts ^ (parts >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return mixed & ~np.uint64(0xFFFF)


def sliding_min(values, width: int):
    import numpy as np

    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return values if have == width else np.minimum(values[: len(values) - (width - have)], values[width - have :])


def fragments_of(data: bytes, starts, sizes, least: int, gram: int):
    """Runs of windows with one least gram: start in ``data``, number of windows, and the gram's hash.

    ``data`` is at most ``CHUNK`` bytes of texts one after the other; a window
    lies within one text.
    """
    import numpy as np

    whole = np.frombuffer(data, dtype=np.uint8)
    grams = gram_hashes(whole, gram) | np.arange(len(whole) - gram + 1, dtype=np.uint64)
    least_gram = sliding_min(grams, least - gram + 1)
    valid = np.zeros(len(whole) + 1, dtype=np.int8)
    fits = sizes >= least
    np.add.at(valid, starts[fits], 1)
    np.add.at(valid, starts[fits] + sizes[fits] - least + 1, -1)
    inside = np.cumsum(valid[: len(least_gram)]) > 0
    # A text's first window begins a run, even if the same place is least for the text before.
    first = np.zeros(len(least_gram) + 1, dtype=bool)
    first[starts[fits]] = True
    new = first[:-1].copy()
    new[1:] |= (least_gram[1:] != least_gram[:-1]) | ~inside[:-1]
    begins = np.flatnonzero(new & inside)
    ends = np.flatnonzero(np.append(new[1:] | ~inside[1:], True) & inside)
    return begins, ends - begins + 1, (least_gram[begins] >> np.uint64(16)).astype(np.int64)


def chunks_of(texts: list[bytes], least: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts packed into chunks: row, offset in the row and bytes of each part.

    Parts of a long text overlap so that each window is in one part.
    """
    rows, offsets, parts, size = [], [], [], 0
    for row, text in enumerate(texts):
        if len(text) < least:
            continue
        step = CHUNK - least + 1
        for at in range(0, len(text) - least + 1, step):
            part = text[at : at + CHUNK]
            if size + len(part) > CHUNK and parts:
                yield rows, offsets, parts
                rows, offsets, parts, size = [], [], [], 0
            rows.append(row)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield rows, offsets, parts


def all_fragments(keyed: DataFrame, least: int, gram: int) -> DataFrame:
    """``id, sub, at, n, gram, content, again`` of every fragment; ``content`` is a hash of its bytes.

    ``again``: the same fragment stands earlier in the same batch, so it is
    known to repeat and need not meet the others.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    names = ["id", "sub", "at", "n", "gram", "content", "again"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out = []
            for rows, offsets, parts in chunks_of(byte_texts(batch.column(2)), least):
                data, sizes = b"".join(parts), np.array([len(p) for p in parts])
                starts = np.cumsum(sizes) - sizes
                begins, n, grams = fragments_of(data, starts, sizes, least, gram)
                part = np.searchsorted(starts, begins, side="right") - 1
                ends = begins + n + least - 1
                content = np.array([digest(data[a:b]) for a, b in zip(begins.tolist(), ends.tolist())], dtype=np.uint64)
                places = begins - starts[part] + np.array(offsets)[part]
                out.append((np.array(rows)[part], places, n, grams, content.view(np.int64)))
            if not out:
                continue
            rows, places, n, grams, content = (np.concatenate(x) for x in zip(*out))
            taken = pa.array(rows, pa.int64())
            by_id = pc.sort_indices(
                batch.select(["id", "sub"]), sort_keys=[("id", "ascending"), ("sub", "ascending")], null_placement="at_start"
            )
            turn = np.empty(len(by_id), dtype=np.int64)
            turn[by_id.to_numpy()] = np.arange(len(by_id))
            order = np.lexsort((places, turn[rows], content, grams))
            again = np.zeros(len(order), dtype=bool)
            same = (grams[order][1:] == grams[order][:-1]) & (content[order][1:] == content[order][:-1])
            again[order[1:][same]] = True
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(taken),
                    batch.column(1).take(taken),
                    pa.array(places, pa.int64()),
                    pa.array(n.astype(np.int32)),
                    pa.array(grams),
                    pa.array(content),
                    pa.array(again),
                ],
                names=names,
            )

    types = {"sub": "bigint", "at": "bigint", "n": "int", "gram": "bigint", "content": "bigint", "again": "boolean"}
    schema = keyed.select("id", *[F.lit(0).cast(t).alias(c) for c, t in types.items()]).limit(0).schema
    return keyed.select("id", "sub", "text").mapInArrow(run, schema)


def bounded_suffix_array(data, depth: int):
    """Places sorted by the next bytes, at least ``depth`` of them, by doubling the sorted length."""
    import numpy as np

    n = len(data)
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = data
    words = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(words, kind="stable")
    ranked, have = words, 8
    while True:
        steps = np.concatenate([[0], ranked[order][1:] != ranked[order][:-1]])
        ranks = np.empty(n, dtype=np.int64)
        ranks[order] = np.cumsum(steps)
        if have >= depth:
            return order
        later = np.zeros(n, dtype=np.int64)
        later[: max(0, n - have)] = ranks[have:] + 1
        ranked = ranks * (n + 2) + later
        order = np.argsort(ranked, kind="stable")
        have *= 2


def long_common(data, depth: int):
    """Suffix order, and for each suffix whether it has ``depth`` bytes in common with the one before it.

    An interval of the order holds all suffixes with one prefix. Extending the
    prefixes of ``k`` bytes by the byte before gives intervals whose lower
    neighbour shares ``k`` bytes with their last suffix; the first time that a
    border is met tells its value. Borders not met below ``depth`` share more,
    or have a zero byte before they differ.
    """
    import numpy as np

    n = len(data)
    order = bounded_suffix_array(data, depth)
    before = data[order - 1].astype(np.int64)
    by_byte = np.argsort(before, kind="stable")
    image = np.empty(n, dtype=np.int64)
    image[by_byte] = np.arange(n)
    unknown = np.ones(n + 1, dtype=bool)
    unknown[[0, n]] = False
    low, high = np.array([0]), np.array([n])
    for _ in range(depth):
        sizes = high - low
        flat = np.repeat(high - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
        key = np.repeat(np.arange(len(low)) << 8, sizes) | before[flat]
        sort = np.argsort(key, kind="stable")
        key = key[sort]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.append(heads, len(key)))
        # Prefixes with a zero byte are not extended: it ends a fragment.
        text = key[heads] & 255 > 0
        new_low = image[flat[sort[heads[text]]]]
        new_high = new_low + counts[text]
        fresh = unknown[new_high] | (new_high == n)
        # The last interval of the order has no border after it, but its extensions may.
        ends = new_high[fresh & (new_high < n)]
        low, high = new_low[fresh], new_high[fresh]
        unknown[ends] = False
        if not len(low) or not unknown.any():
            break
    return order, unknown[:n]


def repeated_windows(fragments: list[bytes], least: int):
    """For fragments in the order of their places: fragment and offset of each window that is not the first of its content."""
    import numpy as np

    sizes = np.array([len(f) + 1 for f in fragments])
    data = np.frombuffer(b"\0".join(fragments) + b"\0", dtype=np.uint8)
    starts = np.cumsum(sizes) - sizes
    order, same = long_common(data, least)
    owner = np.repeat(np.arange(len(fragments)), sizes)[order]
    offset = order - starts[owner]
    usable = offset <= sizes[owner] - 1 - least
    group, place = np.cumsum(~same)[usable], order[usable]
    # Zero bytes leave borders open; equal windows stay neighbours, so comparing neighbours settles those.
    windows = np.lib.stride_tricks.sliding_window_view(data, least)
    doubt = np.flatnonzero(group[1:] == group[:-1])
    differ = (windows[place[doubt]] != windows[place[doubt + 1]]).any(axis=1)
    splits = np.zeros(len(group), dtype=np.int64)
    splits[doubt[differ] + 1] = 1
    group = group + np.cumsum(splits)
    sort = np.lexsort((place, group))
    group, place = group[sort], place[sort]
    later = np.flatnonzero(np.concatenate([[False], group[1:] == group[:-1]]))
    place = np.sort(place[later])
    owner = np.searchsorted(starts, place, side="right") - 1
    return owner, place - starts[owner]


def _compare(pieces: DataFrame, least: int) -> DataFrame:
    """Ranges of window starts ``id, sub, low, high`` that repeat an earlier window, for fragments of shared grams."""
    import pyarrow as pa

    dealt = pieces.repartition("gram").sortWithinPartitions("gram", "id", "sub", "at")
    schema = pieces.select("id", "sub", F.col("at").alias("low"), F.col("at").alias("high")).limit(0).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        waiting: list[pa.Table] = []
        size = 0
        for batch in batches:
            waiting.append(pa.Table.from_batches([batch]))
            size += batch.num_rows * (least + 64)
            if size < TRANSFORM:
                continue
            rows = pa.concat_tables(waiting).combine_chunks()
            grams = rows.column("gram").to_numpy()
            cut = int(np.searchsorted(grams, grams[-1]))
            yield from transformed(rows.slice(0, cut))
            waiting, size = [rows.slice(cut)], (len(rows) - cut) * (least + 64)
        if waiting:
            yield from transformed(pa.concat_tables(waiting).combine_chunks())

    def transformed(rows) -> Iterator[pa.RecordBatch]:
        import numpy as np

        grams = rows.column("gram").to_numpy()
        step = TRANSFORM // (least + 64)
        begin = 0
        while begin < len(grams):
            end = min(begin + step, len(grams))
            end = int(np.searchsorted(grams, grams[end - 1], side="right"))
            part = rows.slice(begin, end - begin)
            begin = end
            owner, offset = repeated_windows(part.column("piece").to_pylist(), least)
            if not len(owner):
                continue
            heads = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(offset) != 1)]))
            tails = np.append(heads[1:], len(owner)) - 1
            taken = pa.array(owner[heads], pa.int64())
            at = part.column("at").to_numpy()[owner[heads]]
            columns = [part.column(c).take(taken).combine_chunks() for c in ("id", "sub")]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(at + offset[heads]), pa.array(at + offset[tails])], names=["id", "sub", "low", "high"]
            )

    return dealt.mapInArrow(run, schema)


def _by_window(pieces: DataFrame, least: int) -> DataFrame:
    """The same for grams with very many fragments: whole windows are grouped, the earliest is left out."""
    windows = pieces.select(
        "id", "sub", F.col("at"), "piece", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")
    ).select("id", "sub", (F.col("at") + F.col("i")).alias("low"), F.expr(f"substring(piece, i + 1, {least})").alias("bytes"))
    windows = windows.select("id", "sub", "low", F.sha2("bytes", 256).alias("bytes"))
    place = F.struct("id", "sub", "low")
    first = windows.groupBy("bytes").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = windows.join(first, "bytes").where(~place.eqNullSafe(F.col("first")))
    return met.select("id", "sub", "low", F.col("low").alias("high"))


def keyed_documents(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``id, sub, text``: ``sub`` numbers the rows of an id, by text; 0 where the id has one row."""
    named = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    several = stored(named.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeat-ids")
    zero = F.lit(0).cast("bigint")
    if several.isEmpty():
        return named.select("id", zero.alias("sub"), "text")
    marked = several.select(F.col("id").alias("__id"))
    same = F.col("id").eqNullSafe(F.col("__id"))
    in_turn = Window.partitionBy("id").orderBy("text")
    repeated = named.join(marked, same, "left_semi").withColumn("sub", (F.row_number().over(in_turn) - 1).cast("bigint"))
    return named.join(marked, same, "left_anti").select("id", zero.alias("sub"), "text").unionByName(repeated)


def repeat_ranges(keyed: DataFrame, least: int = LEAST, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``id, sub, low, high``: byte ranges, end exclusive, that hold strings starting earlier; they may overlap."""
    in_content = Window.partitionBy("meet", "content").orderBy("id", "sub", "at")
    # Grams are not negative; fragments known to repeat are spread below zero.
    apart = -1 - F.abs(F.xxhash64("id", "at") % (1 << 62))
    met = (
        all_fragments(keyed, least, gram)
        .withColumn("meet", F.when(F.col("again"), apart).otherwise(F.col("gram")))
        .withColumn("turn", F.row_number().over(in_content))
        .withColumn("kinds", F.sum((F.col("turn") == 1).cast("bigint")).over(Window.partitionBy("meet")))
        .where("again OR turn > 1 OR kinds > 1")
        .withColumn("step", F.when(F.col("again") | (F.col("turn") > 1), 0).when(F.col("kinds") <= hot, 1).otherwise(2))
        .select("id", "sub", "at", "n", "gram", "step")
    )
    met = stored(met, "repeat-fragments", ["step"])
    whole = met.where("step = 0").select("id", "sub", F.col("at").alias("low"), (F.col("at") + F.col("n") - 1).alias("high"))
    places = met.where("step > 0").groupBy("id", "sub").agg(F.collect_list(F.struct("at", "n", "gram", "step")).alias("places"))
    same = [keyed[c].eqNullSafe(places[c]) for c in ("id", "sub")]
    pieces = (
        keyed.join(places, same)
        .select(keyed["id"], keyed["sub"], F.col("text").cast("binary").alias("text"), F.explode("places").alias("p"))
        .select(
            "id", "sub", "p.at", "p.n", "p.gram", "p.step", F.expr(f"substring(text, int(p.at) + 1, p.n + {least - 1})").alias("piece")
        )
    )
    compared = _compare(pieces.where("step = 1").drop("step"), least)
    if met.where("step = 2").isEmpty():
        found = whole.unionByName(compared)
    else:
        found = whole.unionByName(compared).unionByName(_by_window(pieces.where("step = 2"), least))
    return found.select("id", "sub", "low", (F.col("high") + least).alias("high"))


def remove_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM, hot: int = HOT
) -> DataFrame:
    """One row per document: its id, ``n_bytes``, ``removed`` (maximal runs) and ``kept`` (the remaining bytes)."""
    import pyarrow as pa

    if not 1 < gram <= least:
        raise ValueError("gram must be from 2 to least bytes")
    keyed = keyed_documents(docs, id, text)
    ranges = (
        repeat_ranges(keyed, least, gram, hot)
        .groupBy("id", "sub")
        .agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("ranges"))
    )
    same = [keyed[c].eqNullSafe(ranges[c]) for c in ("id", "sub")]
    joined = keyed.join(ranges, same, "left").select(keyed["id"], "text", "ranges")
    run_type = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept, sizes = [], [], []
            for whole, found in zip(byte_texts(batch.column(1)), batch.column(2).to_pylist()):
                runs = merged([(r["low"], r["high"]) for r in found or []])
                removed.append([{"low": a, "high": b} for a, b in runs])
                edges = [0, *[x for r in runs for x in r], len(whole)]
                kept.append(b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2])))
                sizes.append(len(whole))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, run_type), pa.array(kept, pa.binary())],
                names=[id, "n_bytes", "removed", "kept"],
            )

    runs = "array<struct<low:bigint,high:bigint>>"
    schema = keyed.select(
        F.col("id").alias(id),
        F.lit(0).cast("bigint").alias("n_bytes"),
        F.lit(None).cast(runs).alias("removed"),
        F.lit(None).cast("binary").alias("kept"),
    ).limit(0).schema
    return joined.mapInArrow(run, schema)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted ranges."""
    out: list[list[int]] = []
    for low, high in ranges:
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(r) for r in out]


def repeat_digest(docs: DataFrame) -> DataFrame:
    """One row per document: sizes, number of removed runs and a digest of what is left."""
    return remove_repeats(docs).select(
        "doc_id",
        "n_bytes",
        F.coalesce(F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, r: n + r["high"] - r["low"]), F.lit(0)).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
