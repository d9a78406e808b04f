"""SimHash near-duplicates: exact comparison of fingerprints tile by tile.

Two fingerprints within ``radius`` bits agree on at least one of ``radius + 1``
bands of bits, so only fingerprints that share a band value meet. They meet in
tiles sorted by their number of set bits: a pair of tiles is compared with
numpy exclusive-or and bit counts, or skipped where the bit counts differ by
more than the radius. Band values with many fingerprints are dealt as pairs of
tiles over many tasks. Links leave a task as a forest, never as all pairs.

A null text is an empty one; texts without words share fingerprint zero. Ids
may repeat: each row gets its own result. A null id never is a component's id
unless all its ids are null. Empty tables give empty results; columns other
than id and text are not read by ``simhash_groups``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from interviewflow.llm.graph import components
from interviewflow.llm.names import free_names
from interviewflow.llm.store import stored
from interviewflow.llm.worker import byte_texts

SHINGLE = 3
SEED = 42
RADIUS = 3
TILE = 256
# Fingerprints of one band value beyond which they are dealt as pairs of tiles of a bit count.
HOT = 8192
HOT_TILE = 2048
SHINGLES_AT_ONCE = 1 << 18


def fingerprint_of(texts: list[bytes], shingle: int = SHINGLE):
    """Fingerprints as unsigned 64-bit integers."""
    import numpy as np
    import xxhash

    digest, seed = xxhash.xxh64_intdigest, SEED
    ones = np.zeros((len(texts), 64), dtype=np.int64)
    total = np.zeros(len(texts), dtype=np.int64)
    hashes: list[int] = []
    owners: list[tuple[int, int]] = []

    def flush() -> None:
        at = 0
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for row, n in owners:
            ones[row] += bits[at : at + n].sum(axis=0, dtype=np.int64)
            at += n
        hashes.clear()
        owners.clear()

    for row, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        if len(words) < shingle:
            own = [digest(b" ".join(words), seed)]
        else:
            own = [digest(b" ".join(w), seed) for w in zip(*[words[i:] for i in range(shingle)])]
        total[row] = len(own)
        for at in range(0, len(own), SHINGLES_AT_ONCE):
            part = own[at : at + SHINGLES_AT_ONCE]
            hashes.extend(part)
            owners.append((row, len(part)))
            if len(hashes) >= SHINGLES_AT_ONCE:
                flush()
    if hashes:
        flush()
    majority = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(majority, axis=1, bitorder="little").view("<u8").reshape(-1)


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with a BIGINT column that holds the 64 bits; a column of that name is replaced."""
    import pyarrow as pa

    kept = docs.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprint_of(byte_texts(batch.column(batch.schema.get_field_index(text))), shingle)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(prints.view("int64"))], names=[*batch.schema.names, into]
            )

    schema = kept.limit(0).withColumn(into, F.lit(0).cast("bigint")).schema
    return kept.mapInArrow(run, schema)


def tile_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` that connect all distinct ``fp`` within ``radius`` bits, as forests of the tasks."""
    import pyarrow as pa

    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    bands = F.array(
        *[
            F.struct(
                F.lit(i).alias("band"),
                F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"),
            )
            for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
        ]
    )
    keyed = prints.select("fp", F.bit_count("fp").alias("ones"), F.explode(bands).alias("k")).select(
        "fp", "ones", "k.band", "k.value"
    )
    sizes = keyed.groupBy("band", "value", "ones").agg(F.count(F.lit(1)).alias("n"))
    tiles = F.struct("ones", F.ceil(F.col("n") / HOT_TILE).cast("int").alias("tiles"))
    hot = (
        sizes.groupBy("band", "value")
        .agg(F.sum("n").alias("n"), F.collect_list(tiles).alias("tiles"))
        .where(F.col("n") > HOT)
        .drop("n")
    )
    mine = F.filter("tiles", lambda t: t["ones"] == F.col("ones"))[0]["tiles"]
    own = F.struct(F.col("ones"), F.pmod(F.xxhash64("fp"), mine).cast("int").alias("tile"))
    near = F.filter("tiles", lambda t: F.abs(t["ones"] - F.col("ones")) <= radius)
    partners = F.flatten(
        F.transform(
            near,
            lambda t: F.transform(
                F.sequence(F.lit(0), t["tiles"] - 1), lambda i: F.struct(t["ones"].alias("ones"), i.alias("tile"))
            ),
        )
    )
    pairs = F.transform(partners, lambda p: F.xxhash64("band", "value", F.least(own, p), F.greatest(own, p)))
    jobs = F.when(F.col("tiles").isNull(), F.array(F.xxhash64("band", "value"))).otherwise(pairs)
    dealt = (
        keyed.join(hot, ["band", "value"], "left")
        .select("fp", "ones", F.explode(jobs).alias("job"))
        .repartition("job")
        .sortWithinPartitions("job", "ones")
        .select("job", "ones", "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        rest = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            rest = [x[cut:] for x in rows]
            if cut:
                yield linked(*[x[:cut] for x in rows])
        if rest is not None and len(rest[0]):
            yield linked(*rest)

    def linked(jobs, ones, fps) -> pa.RecordBatch:
        found = compare_tiles(jobs, ones, fps.view("uint64"), radius)
        return pa.RecordBatch.from_arrays([pa.array(fps[found[:, i]]) for i in range(2)], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def compare_tiles(jobs, ones, fps, radius: int):
    """Row pairs that connect all rows of a job within ``radius`` bits; rows are sorted by job and bit count."""
    import numpy as np

    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i in range(0, len(fps), TILE):
        i_end = min(i + TILE, len(fps))
        for j in range(i, len(fps), TILE):
            if jobs[j] != jobs[i_end - 1]:
                if j > i:
                    break
            elif j > i and jobs[i] == jobs[j] and ones[j] - ones[i_end - 1] > radius:
                break
            j_end = min(j + TILE, len(fps))
            close = np.bitwise_count(fps[i:i_end, None] ^ fps[None, j:j_end]) <= radius
            if i == j:
                close = np.triu(close, 1)
            while True:
                rows = np.flatnonzero(close.any(axis=1))
                if not len(rows):
                    break
                columns = close[rows].argmax(axis=1)
                for a, b in zip((rows + i).tolist(), (columns + j).tolist()):
                    x, y = root(a), root(b)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        links.append((a, b))
                close[rows, columns] = False
                left = np.array([root(k) for k in range(i, i_end)])
                right = np.array([root(k) for k in range(j, j_end)])
                close &= left[:, None] != right[None, :]
    return np.array(links, dtype=np.int64).reshape(-1, 2)


def fingerprint_groups(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per distinct fingerprint of ``id, fp``: ``fp, component_id, chosen``.

    ``component_id`` is the least id that links reach; ``chosen`` marks the one
    fingerprint of the component that this id has.
    """
    first = stored(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-prints")
    roots = components(stored(tile_links(first.select("fp"), radius), "simhash-links"), "simhash-components")
    members = roots.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(
        roots.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct()
    )
    # Struct order puts nulls first; an id that is null comes last here.
    order = F.struct(F.col("first").isNull().alias("none"), "first", "fp")
    least = members.join(first, "fp").groupBy("root").agg(F.min(order).alias("least"))
    linked = members.join(least, "root").select("fp", "least")
    grouped = first.join(linked, "fp", "left")
    alone = F.col("least").isNull()
    return grouped.select(
        "fp",
        F.when(alone, F.col("first")).otherwise(F.col("least.first")).alias("component_id"),
        (alone | (F.col("least.fp") == F.col("fp"))).alias("chosen"),
    )


def simhash_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: its id, ``fingerprint`` in hexadecimal and ``component_id``."""
    named = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    rows = stored(with_fingerprint(named, "text", "fp").select("id", "fp"), "simhash-rows")
    groups = fingerprint_groups(rows, radius)
    return rows.join(groups, "fp").select(
        F.col("id").alias(id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document of each component, that of the least id; of repeated rows with this id the first by text."""
    fp, known, none, n = free_names(docs.columns, "__fp", "__id", "__none", "__n")
    rows = stored(with_fingerprint(docs.select(id, text), text, fp).select(F.col(id).alias("id"), F.col(fp).alias("fp")), "simhash-rows")
    chosen = fingerprint_groups(rows, radius).where("chosen").select(
        F.col("fp").alias(fp),
        F.coalesce(F.col("component_id").cast("string"), F.lit("")).alias(known),
        F.col("component_id").isNull().alias(none),
    )
    marked = with_fingerprint(docs, text, fp).withColumns(
        {known: F.coalesce(F.col(id).cast("string"), F.lit("")), none: F.col(id).isNull()}
    )
    key = [fp, known, none]
    in_turn = Window.partitionBy(*key).orderBy(text)
    kept = marked.join(chosen, key, "left_semi").withColumn(n, F.row_number().over(in_turn)).where(F.col(n) == 1)
    return kept.select(*docs.columns)
