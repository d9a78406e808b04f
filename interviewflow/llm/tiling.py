"""Benchmark decontamination by greedy string tiling.

A running Karp-Rabin hash over the words of a document finds the runs of
``least`` words that it shares with an item. Shared runs on one diagonal make
maximal matches; the longest match not yet covered is marked, again and again,
until none of ``least`` words is left. An item of which ``threshold`` of the
words are marked is contained in the document, in whatever order its parts
stand.

Words are lower case, with ASCII punctuation taken for space. A null text is
an empty one. An item without words is contained nowhere; an item of fewer
than ``least`` words must stand in one run. Ties go to the earlier place in
the item, then in the document. Each row, of documents and of items, counts
for itself. Empty tables give empty results; other columns are left alone.

The different item texts go to the workers in blocks of ``BLOCK_BYTES`` by
measured size, a longer one alone; the documents are read once for each block.
Only the starts of maximal matches are kept, so texts of one repeated word
take as many entries as they have diagonals, not the product of their places.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interviewflow.llm.search import blocks_of
from interviewflow.llm.worker import once_per_worker

LEAST = 5
THRESHOLD = 0.5
BLOCK_BYTES = 16 << 20
# Pairs of places that are looked at in one go.
PAIRS = 1 << 20
BASE = 0x9E3779B97F4A7C15
SPACED = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(SPACED).split()


class Items:
    """Word numbers and seeds of the items of one block."""

    def __init__(self, rows: list[tuple[object, str | None]], least: int):
        import numpy as np

        self.least = least
        self.ids = [r[0] for r in rows]
        texts = [words_of(r[1]) for r in rows]
        self.vocabulary = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.words = [np.array([self.vocabulary[w] for w in t], dtype=np.uint64) for t in texts]
        self.seeds = {}
        for width in sorted({min(least, len(w)) for w in self.words} - {0}):
            owners = [k for k, w in enumerate(self.words) if min(least, len(w)) == width]
            hashes = [running_hash(self.words[k], width) for k in owners]
            item = np.repeat(owners, [len(h) for h in hashes])
            at = np.concatenate([np.arange(len(h)) for h in hashes])
            every = np.concatenate(hashes)
            # Whether the run one word before, of the same item, is another one.
            changes = np.concatenate([[True], (every[1:] != every[:-1]) | (item[1:] != item[:-1])])
            order = np.argsort(every, kind="stable")
            self.seeds[width] = (every[order], item[order], at[order], changes[order])

    def contained(self, text: str | None, threshold: float) -> list[tuple[int, int, int]]:
        """Item number, words marked and tiles of each item the text contains."""
        import numpy as np

        words = words_of(text)
        get = self.vocabulary.get
        numbers = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
        known = np.concatenate([[0], np.cumsum(numbers > 0)])
        found = []
        for width, (hashes, item, at, changes) in self.seeds.items():
            if len(numbers) < width:
                continue
            running = running_hash(numbers, width)
            places = np.flatnonzero(known[width:] - known[:-width] == width)
            low, high = (np.searchsorted(hashes, running[places], side=s) for s in ("left", "right"))
            hit = high > low
            if not hit.any():
                continue
            again = places > 0
            again[again] = running[places[again] - 1] == running[places[again]]
            found += self.tiled(numbers, width, places[hit], low[hit], high[hit], again[hit], item, at, changes, threshold)
        return found

    def tiled(self, numbers, width, places, low, high, again, item, at, changes, threshold) -> list[tuple[int, int, int]]:
        """Items of which tiles of shared runs cover enough; ``again``: the place before has the same run."""
        import numpy as np

        first, back = np.unique(low, return_index=True)
        shared = expand(first, high[back])
        # No more of an item can be marked than its shared runs cover.
        candidates = []
        for k in np.unique(item[shared]):
            starts = np.unique(at[shared[item[shared] == k]])
            covered = width + np.minimum(np.diff(starts), width).sum()
            if covered >= threshold * len(self.words[k]):
                candidates.append(k)
        if not candidates:
            return []
        wanted = np.zeros(len(self.words), dtype=bool)
        wanted[candidates] = True
        starts = [[] for _ in self.words]
        # A place whose run is that of the place before begins no match but where the item's run changes too.
        kept = np.flatnonzero(changes)
        few_low, few_high = np.searchsorted(kept, low), np.searchsorted(kept, high)
        for few, own_low, own_high in ((False, low[~again], high[~again]), (True, few_low[again], few_high[again])):
            own_places = places[again] if few else places[~again]
            for a, b in chunks(own_high - own_low, PAIRS):
                pairs = expand(own_low[a:b], own_high[a:b])
                doc_at = np.repeat(own_places[a:b], own_high[a:b] - own_low[a:b])
                pairs = kept[pairs] if few else pairs
                use = wanted[item[pairs]]
                pairs, doc_at = pairs[use], doc_at[use]
                for k in np.unique(item[pairs]).tolist():
                    mine = item[pairs] == k
                    starts[k].append(match_starts(self.words[k], numbers, at[pairs[mine]], doc_at[mine]))
        out = []
        for k in candidates:
            if not starts[k]:
                continue
            item_at, doc_at = (np.concatenate(x) for x in zip(*starts[k]))
            tiles = greedy_tiles(self.words[k], numbers, item_at, doc_at, width)
            marked = sum(n for *_, n in tiles)
            if marked and marked >= threshold * len(self.words[k]):
                out.append((int(k), int(marked), len(tiles)))
        return out


def chunks(sizes, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``sizes`` that add up to about ``most``."""
    import numpy as np

    ends = np.cumsum(sizes)
    low = 0
    while low < len(sizes):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield low, high
        low = high


def match_starts(item, doc, item_at, doc_at):
    """Of places of shared runs those before which the words differ, or one text begins."""
    inner = (item_at > 0) & (doc_at > 0)
    first = ~inner
    first[inner] = item[item_at[inner] - 1] != doc[doc_at[inner] - 1]
    return item_at[first], doc_at[first]


def common_lengths(item, doc, item_at, doc_at):
    """How many words are equal from each pair of places on: powers of two, from the greatest down, compared by their hash."""
    import numpy as np

    widths, hashes = [1], [(item, doc)]
    while 2 * widths[-1] <= min(len(item), len(doc)):
        power = np.uint64(pow(BASE, widths[-1], 1 << 64))
        half = widths[-1]
        hashes.append(tuple(h[:-half] * power + h[half:] for h in hashes[-1]))
        widths.append(2 * half)
    length = np.zeros(len(item_at), dtype=np.int64)
    for width, (own, other) in zip(widths[::-1], hashes[::-1]):
        i, j = item_at + length, doc_at + length
        fits = np.flatnonzero((i + width <= len(item)) & (j + width <= len(doc)))
        fits = fits[own[i[fits]] == other[j[fits]]]
        length[fits] += width
    return length


def expand(low, high):
    """All whole numbers of the ranges, one range after the other."""
    import numpy as np

    sizes = high - low
    return np.repeat(high - np.cumsum(sizes), sizes) + np.arange(sizes.sum())


def running_hash(numbers, width: int):
    """Karp-Rabin hash of every run of ``width`` word numbers, modulo 2**64."""
    import numpy as np

    n = max(len(numbers) - width + 1, 0)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(width if n else 0):
        total = total * np.uint64(BASE) + numbers[i : i + n]
    return total


def greedy_tiles(item, doc, item_at, doc_at, width: int) -> list[tuple[int, int, int]]:
    """Tiles ``(item place, document place, words)`` from the places where maximal matches may begin."""
    import numpy as np

    lengths = common_lengths(item, doc, item_at, doc_at)
    long = lengths >= width
    if not long.any():
        return []
    heap = [(-n, i, j) for n, i, j in zip(lengths[long].tolist(), item_at[long].tolist(), doc_at[long].tolist())]
    heapq.heapify(heap)
    in_item, in_doc, tiles, left = np.zeros(len(item), bool), np.zeros(len(doc), bool), [], len(item)
    while heap and left >= width:
        n, i, j = heapq.heappop(heap)
        n = -n
        taken = in_item[i : i + n] | in_doc[j : j + n]
        if not taken.any():
            in_item[i : i + n] = in_doc[j : j + n] = True
            tiles.append((i, j, n))
            left -= n
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[1], taken, [1]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= width:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return tiles


def blocks(benchmark: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """Digest and text of the different item texts, in blocks of ``block_bytes`` by measured size, one on the driver at a time."""
    named = benchmark.select(F.sha2(F.col(text), 256).alias("query"), F.col(text).alias("text")).where("text IS NOT NULL")
    texts = named.groupBy("query").agg(F.first("text").alias("text"))
    for block in blocks_of(texts, F.octet_length("text") + 16, block_bytes):
        yield [tuple(r) for r in block.collect()]


def _shipped(docs: DataFrame, rows: list[tuple], least: int):
    sent, key = docs.sparkSession.sparkContext.broadcast(rows), f"items-{uuid.uuid4().hex}"
    return lambda: once_per_worker(key, lambda: Items(sent.value, least))


def contained_items(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    least: int = LEAST,
    threshold: float = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each document and item it contains: ids, ``n_words`` marked, ``n_tiles`` and ``coverage`` of the item."""
    import pyarrow as pa

    schema = docs.select(
        F.col(id).alias("id"),
        F.lit("").alias("query"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.lit(0).cast("bigint").alias("n_tiles"),
        F.lit(0.0).alias("coverage"),
    ).limit(0).schema

    def search(rows: list[tuple]) -> DataFrame:
        items_of = _shipped(docs, rows, least)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = items_of()
            for batch in batches:
                found = [
                    (row, k, n, tiles)
                    for row, t in enumerate(batch.column(1).to_pylist())
                    for k, n, tiles in items.contained(t, threshold)
                ]
                rows, numbers, marked, tiles = zip(*found) if found else ([], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int64())),
                        pa.array([items.ids[k] for k in numbers], pa.string()),
                        pa.array(marked, pa.int64()),
                        pa.array(tiles, pa.int64()),
                        pa.array([n / len(items.words[k]) for k, n in zip(numbers, marked)], pa.float64()),
                    ],
                    names=schema.names,
                )

        return docs.select(id, text).mapInArrow(run, schema)

    result = None
    for rows in blocks(benchmark, text, block_bytes):
        result = search(rows) if result is None else result.unionByName(search(rows))
    if result is None:
        result = search([])
    # Items of one text are searched once, and each of their rows gets what was found.
    named = benchmark.select(F.col(item_id).alias("item"), F.sha2(F.col(text), 256).alias("query"))
    met = result.join(named, "query")
    return met.select(F.col("id").alias(id), F.col("item").alias(item_id), "n_words", "n_tiles", "coverage")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    item_id: str = "item_id",
    text: str = "text",
    least: int = LEAST,
    threshold: float = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents that contain no item, with their own columns."""
    import pyarrow as pa

    def clean(kept: DataFrame, rows: list[tuple]) -> DataFrame:
        items_of = _shipped(docs, rows, least)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = items_of()
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                yield batch.filter(pa.array([not items.contained(t, threshold) for t in texts], pa.bool_()))

        return kept.mapInArrow(run, docs.schema)

    kept = docs
    for rows in blocks(benchmark, text, block_bytes):
        kept = clean(kept, rows)
    return kept
