"""Removal of passages of ``least`` words that also start in a document with a smaller id, by level-wise doubling.

The levels are lengths, each twice the one before: ``least`` is halved (rounded
up) down to ``SEED`` words or fewer, so 13 words give 7, 13. At each length only
what repeated at the length before is looked at, and it goes on only if its
window of this length also starts in another document. Below ``least`` the
window of least hash among those inside a passage speaks for the passage: equal
passages have equal windows of least hash, so nothing is lost, and every fourth
window is a row instead of every one. At ``least`` each remaining window is
compared. ``passage_lengths`` doubles on from there until no window survives.

Rows of one window hash meet in a task. What a task of the scan already sees
in a document with a smaller id is known to repeat and does not meet the
others, so a common line sends a few rows per slice of text, not one per copy.

Words are maximal runs of bytes other than space and 0x09 to 0x0D. A null text
has none. A null id comes before all others; rows of one id never remove from
each other, repeated rows give equal results. An empty table gives an empty
result. Columns other than id and text are not read. Windows of ``least`` words
are told apart by 88 bits of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from interviewflow.llm.store import release, stored
from interviewflow.llm.substrings import sliding_min
from interviewflow.llm.worker import byte_texts, slices

LEAST = 13
SEED = 7
# Text bytes in which repeats are known at once, and words that are hashed in one go.
SLICE = 16 << 20
WORDS_AT_ONCE = 1 << 16
# Odd multipliers of the two window hashes.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
# A place is the number of its first word, then 24 bits for a count or a check.
LOW_BITS = 24
LOW_MASK = (1 << LOW_BITS) - 1


def levels(least: int, seed: int = SEED) -> list[int]:
    """Window lengths up to ``least``, each twice the one before (odd ones a word less)."""
    out = [least]
    while out[0] > seed:
        out.insert(0, (out[0] + 1) // 2)
    return out


def word_hashes(text: bytes):
    import numpy as np
    import xxhash

    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def window_hashes(words, length: int, factor: int):
    """A 64-bit hash of every run of ``length`` word hashes: a polynomial in the inverse of ``factor``, mixed."""
    import numpy as np

    def powers(base: int):
        row = np.full(len(words), base, dtype=np.uint64)
        row[:1] = 1
        return np.multiply.accumulate(row)

    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * powers(pow(factor, -1, 1 << 64)), dtype=np.uint64)])
    mixed = (sums[length:] - sums[:-length]) * powers(factor)[: len(words) - length + 1]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def runs_of(places, shrink: int = 0) -> list[tuple[int, int]]:
    """Maximal runs ``low, high`` of starts out of places with counts, each ``shrink`` shorter."""
    out: list[list[int]] = []
    for place in sorted(places):
        low, high = place >> LOW_BITS, (place >> LOW_BITS) + (place & LOW_MASK)
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(low, high - shrink) for low, high in out if high - shrink > low]


def fragments(words, valid, length: int, among: int):
    """Runs of valid starts that share their window of least hash among ``among`` windows.

    Gives starts, counts, and the place of the window.
    """
    import numpy as np

    grams = window_hashes(words, length, FACTORS[0])
    bits = np.uint64(int(len(words)).bit_length())
    # Of equal hashes the first place is the least.
    keyed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    window = (sliding_min(keyed, among) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    valid = valid[: len(window)]
    head, tail = valid.copy(), valid.copy()
    other = window[1:] != window[:-1]
    head[1:] &= other | ~valid[:-1]
    tail[:-1] &= other | ~valid[1:]
    begins = np.flatnonzero(head)
    return begins, np.flatnonzero(tail) - begins + 1, window[begins], grams


def slice_rows(texts: list[bytes], found: list | None, shrink: int, length: int, among: int, least: int):
    """Row, place and hash of each window of ``length`` words that speaks for starts in ``found`` (None: all)."""
    import numpy as np

    unit = length + among - 1
    most = max(WORDS_AT_ONCE, 4 * unit)
    out: list[tuple] = []
    waiting: list[tuple] = []
    held = 0

    def flush() -> None:
        words = np.concatenate([w for _, _, w, _ in waiting])
        sizes = np.array([len(w) for _, _, w, _ in waiting])
        starts = np.cumsum(sizes) - sizes
        edges = np.zeros(len(words) + 1, dtype=np.int32)
        for start, (_, at, w, runs) in zip(starts.tolist(), waiting):
            last = len(w) - unit + 1
            for low, high in runs:
                low, high = max(low - at, 0), min(high - at, last)
                if low < high:
                    edges[start + low] += 1
                    edges[start + high] -= 1
        begins, counts, window, grams = fragments(words, np.cumsum(edges[:-1]) > 0, length, among)
        if len(begins):
            part = np.searchsorted(starts, begins, side="right") - 1
            rows = np.array([row for row, _, _, _ in waiting])[part]
            low = begins - starts[part] + np.array([at for _, at, _, _ in waiting])[part]
            if length == least:
                counts = (window_hashes(words, length, FACTORS[1])[window] >> np.uint64(64 - LOW_BITS)).astype(np.int64)
            out.append((rows, low << LOW_BITS | counts, grams[window].view(np.int64)))
        waiting.clear()

    for row, text in enumerate(texts):
        runs = None if found is None else runs_of(found[row], shrink)
        words = word_hashes(text) if runs is None or runs else []
        if runs is None:
            runs = [(0, len(words))]
        for at in range(0, len(words) - unit + 1, most - unit + 1):
            part = words[at : at + most]
            if held + len(part) > most and waiting:
                flush()
                held = 0
            waiting.append((row, at, part, runs))
            held += len(part)
    if waiting:
        flush()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def known_repeats(ranks, hashes, checks):
    """Rows that need not meet the others: their window stands in a document with a smaller id of this slice.

    One row of the greatest id still meets them, so that the smallest is known to repeat.
    """
    import numpy as np

    order = np.lexsort((ranks, checks, hashes))
    h, c, r = hashes[order], checks[order], ranks[order]
    head = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.zeros(0, bool)
    first = r[head][np.cumsum(head) - 1] if len(h) else r
    last = np.concatenate([head[1:], [True]]) if len(h) else head
    known = np.zeros(len(h), dtype=bool)
    known[order] = (r > first) & ~last
    return known


def keyed_rows(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, list[str]]:
    """``id, text`` and, where an id has several rows, ``sub``, a hash of the text; and the columns that name a text."""
    named = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if named.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return named, ["id"]
    return named.withColumn("sub", F.xxhash64("text")), ["id", "sub"]


def _met(keyed: DataFrame, places: DataFrame, keys: list[str], how: str) -> DataFrame:
    same = [keyed[k].eqNullSafe(places[k]) for k in keys]
    return keyed.join(places, same, how).select(*[keyed[k] for k in keys], keyed["text"], *[places[c] for c in places.columns if c not in keys])


def survivors(keyed: DataFrame, keys: list[str], places: DataFrame | None, length: int, among: int, least: int, shrink: int = 0) -> DataFrame:
    """One level: ``keys, place, later`` of the windows that stand in another document too; ``later``: in one with a smaller id.

    ``places`` (``keys, places``) holds what survived the level before.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    everything = places is None
    source = keyed.select(*keys, "text") if everything else _met(keyed, places, keys, "inner")
    k = len(keys)
    schema = keyed.select(*keys, F.lit(0).cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("h"), F.lit(True).alias("known")).limit(0).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches, k, SLICE):
            found = None if everything else batch.column(k + 1).to_pylist()
            rows, place, hashes = slice_rows(byte_texts(batch.column(k)), found, shrink, length, among, least)
            if not len(rows):
                continue
            order = pc.rank(batch.column(0), "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
            checks = place & LOW_MASK if length == least else np.zeros(len(place), np.int64)
            known = known_repeats(order[rows], hashes, checks)
            taken = pa.array(rows, pa.int64())
            columns = [*[batch.column(i).take(taken) for i in range(k)], pa.array(place), pa.array(hashes), pa.array(known)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    check = F.col("place").bitwiseAND(F.lit(LOW_MASK)) if length == least else F.lit(0)
    # Known repeats are spread by their place; the others meet by hash.
    together = Window.partitionBy("known", "h", F.when(F.col("known"), F.xxhash64("id", "place")).otherwise(check))
    least_id, most_id = F.min("id").over(together), F.max("id").over(together)
    none = F.max(F.col("id").isNull()).over(together)
    met = source.mapInArrow(run, schema).select(*keys, "place", "known", least_id.alias("lo"), most_id.alias("hi"), none.alias("none"))
    repeated = F.col("known") | (F.col("lo") < F.col("hi")) | (F.col("none") & F.col("lo").isNotNull())
    later = F.col("known") | (F.col("id").isNotNull() & (F.col("none") | (F.col("lo") < F.col("id"))))
    place = F.col("place") if length != least else F.col("place").bitwiseAND(F.lit(~LOW_MASK)).bitwiseOR(F.lit(1).cast("bigint"))
    kept = met.where(repeated).select(*keys, place.alias("place"), F.coalesce(later, F.lit(False)).alias("later"))
    return stored(kept, "passages-level")


def _places(level: DataFrame, keys: list[str]) -> DataFrame:
    return level.groupBy(*keys).agg(F.collect_set("place").alias("places"))


def repeated_passages(keyed: DataFrame, keys: list[str], least: int = LEAST, seed: int = SEED) -> DataFrame:
    """``keys, place, later`` of the windows of ``least`` words that repeat across documents."""
    found = None
    for length in levels(least, seed):
        places = None if found is None else _places(found, keys)
        next_found = survivors(keyed, keys, places, length, least - length + 1, least)
        if found is not None:
            release(found)
        found = next_found
    return found


def remove_passages(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, seed: int = SEED) -> DataFrame:
    """One row per document: its id, ``n_words``, ``removed`` (maximal runs of words, end exclusive) and ``kept``, the rest joined by spaces."""
    import pyarrow as pa

    if not 1 < least or not 1 < seed:
        raise ValueError("least and seed must be at least 2 words")
    keyed, keys = keyed_rows(docs, id, text)
    found = repeated_passages(keyed, keys, least, seed)
    joined = _met(keyed, _places(found.where("later"), keys), keys, "left").select("id", "text", "places")
    run_type = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            counts, removed, kept = [], [], []
            for whole, places in zip(byte_texts(batch.column(1)), batch.column(2).to_pylist()):
                words = whole.split()
                runs: list[list[int]] = []
                for low, high in runs_of(places or []):
                    if runs and low <= runs[-1][1]:
                        runs[-1][1] = high + least - 1
                    else:
                        runs.append([low, high + least - 1])
                edges = [0, *[x for r in runs for x in r], len(words)]
                counts.append(len(words))
                removed.append([{"low": a, "high": b} for a, b in runs])
                kept.append(b" ".join([w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, run_type), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id, "n_words", "removed", "kept"])

    schema = keyed.select(
        F.col("id").alias(id),
        F.lit(0).cast("bigint").alias("n_words"),
        F.lit(None).cast("array<struct<low:bigint,high:bigint>>").alias("removed"),
        F.lit(None).cast("string").alias("kept"),
    ).limit(0).schema
    return joined.mapInArrow(run, schema)


def passage_lengths(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, seed: int = SEED) -> DataFrame:
    """``id, longest``: for documents with a repeated passage, the greatest level that a passage of it reaches.

    Levels go on from ``least`` to twice, four times, ... that length until no
    window survives. Beyond ``least`` one window in each run of half its length
    is compared, so a level is surely reached by passages of 1.5 times its
    length, and never by passages shorter than it.
    """
    keyed, keys = keyed_rows(docs, id, text)
    found = repeated_passages(keyed, keys, least, seed)
    reached, length, unit = found.where("later").select(*keys, F.lit(least).alias("longest")).distinct(), least, least
    reached = stored(reached, "passages-reached")
    while not found.isEmpty():
        length *= 2
        among = length // 2 + 1
        next_found = survivors(keyed, keys, _places(found, keys), length, among, least, length + among - 1 - unit)
        unit = length + among - 1
        release(found)
        found = next_found
        reached = reached.unionByName(found.where("later").select(*keys, F.lit(length).alias("longest")).distinct())
        reached = stored(reached.groupBy(*keys).agg(F.max("longest").alias("longest")), "passages-reached")
    return reached.groupBy("id").agg(F.max("longest").cast("bigint").alias("longest")).withColumnRenamed("id", id)


def passage_digest(docs: DataFrame) -> DataFrame:
    """One row per document: its words, how many are removed, and a digest of the rest."""
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, r: n + r["high"] - r["low"])
    return remove_passages(docs).select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
