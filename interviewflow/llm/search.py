"""Ranked lexical search: the best documents of each query text, exactly, by bounds from hashed max-sketches.

A document's sketch has ``COORDS`` coordinates. Each of its terms is hashed to
one, which holds the greatest impact of the terms there (the part of a score
that does not depend on the query). The sum of a query's weights times the
coordinates of its terms is thus never less than the document's score. Bounds
of a chunk of documents come from one product of matrices for a batch of
queries. Per query, documents are scored exactly in descending order of their
bounds until the next bound is below the last of the best ``k`` found so far.
Each task keeps the best ``k`` of its own documents, which holds every one of the
best ``k`` of all; those few rows meet per query.

Terms are maximal runs of letters, digits and non-ASCII characters, A-Z in
lower case. Equal query texts are searched once. Queries go to the workers in
blocks of ``BLOCK`` bytes by measured size, a longer one alone; the documents
are read once for each block. A null text has no terms. Rows of one id are
documents of their own. Equal scores go by ascending id, null ids last. Empty
tables, and queries without a known term, give no rows. Columns other than ids
and texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from interviewflow.llm.store import stored
from interviewflow.llm.worker import byte_texts, slices

BEST = 10
COORDS = 2048
# Documents and text bytes of a chunk, queries of a batch, bytes of a block of queries.
CHUNK = 1024
SLICE = 4 << 20
COUNTED = 16 << 20
BATCH = 256
BLOCK = 8 << 20
# Exact scores are computed for so many documents first, then for twice as many.
FIRST = 16
# Single precision sums of COORDS products of non-negative numbers are off by less than this share.
SLACK = 1 + 2.0**-10
# Bytes that are no part of a term become spaces.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def terms_of(texts: list[bytes]):
    """Number of terms of each text, the different terms, and ``text, term, occurrences`` of each pair, by text."""
    import numpy as np
    import pyarrow as pa

    split = [t.translate(TERM_BYTES).split() for t in texts]
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    coded = pa.array(chain.from_iterable(split), pa.binary(), size=int(sizes.sum())).dictionary_encode()
    kinds = max(len(coded.dictionary), 1)
    pairs = np.repeat(np.arange(len(texts)), sizes) * kinds + coded.indices.to_numpy()
    pairs, n = np.unique(pairs, return_counts=True)
    return sizes, coded.dictionary, pairs // kinds, pairs % kinds, n.astype(np.int64)


def coordinates(terms, coords: int):
    import numpy as np
    import xxhash

    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, terms), dtype=np.uint64, count=len(terms))
    return (hashes % np.uint64(coords)).astype(np.int64)


def impacts(occurrences, owner, sizes, documents: int, total: int):
    """Integer impacts of pairs: ``occurrences`` against the length of their text."""
    import numpy as np

    length = np.array([25 + 75 * n * documents // total for n in sizes.tolist()], dtype=np.int64)
    return 1_000_000_000 * occurrences // (1000 * occurrences + 8 * length[owner])


def term_counts(docs: DataFrame, text: str) -> DataFrame:
    """``term, n_docs, n_terms``; the row of the empty term counts documents with a term and all occurrences."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches, 0, COUNTED):
            sizes, terms, _, term, n = terms_of(byte_texts(batch.column(0)))
            n_docs = np.append(np.bincount(term, minlength=len(terms)), (sizes > 0).sum())
            n_terms = np.append(np.bincount(term, n, minlength=len(terms)), sizes.sum()).astype(np.int64)
            names = pa.concat_arrays([terms, pa.array([b""], pa.binary())])
            yield pa.RecordBatch.from_arrays([names, pa.array(n_docs), pa.array(n_terms)], names=["term", "n_docs", "n_terms"])

    parts = docs.select(F.col(text)).mapInArrow(run, "term binary, n_docs bigint, n_terms bigint")
    return parts.groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_terms").alias("n_terms"))


def query_terms(items: DataFrame, text: str) -> DataFrame:
    """``query, term, n`` of the different texts; ``query`` is a digest of the text."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE):
            _, terms, owner, term, n = terms_of(byte_texts(batch.column(1)))
            columns = [batch.column(0).take(pa.array(owner)), terms.take(pa.array(term)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "term", "n"])

    named = items.select(F.sha2(F.col(text), 256).alias("query"), F.col(text).alias("text")).where("text IS NOT NULL")
    texts = named.groupBy("query").agg(F.first("text").alias("text"))
    return texts.mapInArrow(run, "query string, term binary, n bigint")


def blocks_of(rows: DataFrame, size: Column, block: int) -> list[DataFrame]:
    """``rows`` in parts of at most ``block`` bytes: buckets of ``query``, packed by their measured ``size``."""
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    bucket = F.pmod(F.xxhash64("query"), F.lit(8 * total // block + 1))
    sizes = rows.groupBy(bucket.alias("bucket")).agg(F.sum(size).alias("size")).orderBy("bucket").collect()
    packed: list[list[int]] = []
    room = 0
    for row in sizes:
        if not packed or row["size"] > room:
            packed.append([])
            room = block
        packed[-1].append(row["bucket"])
        room -= row["size"]
    return [rows.where(bucket.isin(own)) for own in packed]


class Queries:
    """A block of queries as arrays: their terms, and per query term numbers and weights."""

    def __init__(self, rows, coords: int):
        import numpy as np

        self.terms = sorted({bytes(r["term"]) for r in rows})
        number = {t: i for i, t in enumerate(self.terms)}
        own: dict[str, list] = {}
        for r in rows:
            own.setdefault(r["query"], []).append((number[bytes(r["term"])], r["n"] * r["weight"]))
        self.names = sorted(own)
        self.of = [tuple(np.array(x, dtype=np.int64) for x in zip(*own[q])) for q in self.names]
        self.place = coordinates(self.terms, coords)
        self.coords = coords

    def lookup(self, low: int, high: int):
        """Weights by coordinate, a column for each query from ``low`` to ``high``."""
        import numpy as np

        out = np.zeros((self.coords, high - low), dtype=np.float64)
        for column, (term, weight) in enumerate(self.of[low:high]):
            np.add.at(out[:, column], self.place[term], weight)
        return out.astype(np.float32)


class Best:
    """The best ``k`` documents of each query so far."""

    def __init__(self, queries: int, k: int):
        import numpy as np

        self.k = k
        self.rows: list[list[tuple]] = [[] for _ in range(queries)]
        # Scores that still count.
        self.least = np.ones(queries, dtype=np.int64)

    def add(self, query: int, found: list[tuple]) -> None:
        """``found``: scores and ids."""
        rows = sorted([*self.rows[query], *found], key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))
        self.rows[query] = rows[: self.k]
        if len(rows) >= self.k:
            self.least[query] = max(1, self.rows[query][-1][0])


def search_chunk(texts: list[bytes], name, queries: Queries, best: Best, documents: int, total: int) -> int:
    """Brings the documents of a chunk into ``best``; ``name`` gives the id of a row. Returns the number of exact scores."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes, terms, owner, term, n = terms_of(texts)
    if not len(terms):
        return 0
    impact = impacts(n, owner, sizes, documents, total)
    sketch = np.zeros((len(texts), queries.coords), dtype=np.float32)
    np.maximum.at(sketch, (owner, coordinates(terms.to_pylist(), queries.coords)[term]), impact.astype(np.float32))
    number = pc.fill_null(pc.index_in(terms, value_set=pa.array(queries.terms, pa.binary())), -1).to_numpy().astype(np.int64)[term]
    asked = number >= 0
    owner, number, impact = owner[asked], number[asked], impact[asked]
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    weights = np.zeros(len(queries.terms), dtype=np.int64)
    scored = 0
    for low in range(0, len(queries.of), BATCH):
        high = min(low + BATCH, len(queries.of))
        bounds = (sketch @ queries.lookup(low, high)) * np.float32(SLACK)
        for column in np.flatnonzero((bounds >= best.least[low:high]).any(axis=0)).tolist():
            query = low + column
            bound = bounds[:, column]
            order = np.flatnonzero(bound >= best.least[query])
            order = order[np.argsort(-bound[order], kind="stable")]
            own, weight = queries.of[query]
            weights[own] = weight
            at, step = 0, FIRST
            while at < len(order) and bound[order[at]] >= best.least[query]:
                rows = order[at : at + step]
                counts = starts[rows + 1] - starts[rows]
                flat = np.repeat(starts[rows + 1] - np.cumsum(counts), counts) + np.arange(counts.sum())
                parts = np.concatenate([[0], np.cumsum(weights[number[flat]] * impact[flat])])
                ends = np.cumsum(counts)
                scores = parts[ends] - parts[ends - counts]
                best.add(query, [(int(s), name(int(r))) for s, r in zip(scores, rows) if s >= best.least[query]])
                scored += len(rows)
                at, step = at + step, 2 * step
            weights[own] = 0
    return scored


def best_of_block(docs: DataFrame, rows, id: str, text: str, documents: int, total: int, k: int, coords: int) -> DataFrame:
    """``query, id, score``: the best ``k`` of each task for the queries of a block."""
    import pyarrow as pa

    block = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries(block.value, coords)
        best = Best(len(queries.names), k)
        kind = None
        for batch in slices(batches, 1, SLICE):
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                ids = part.column(0)
                kind = ids.type
                search_chunk(byte_texts(part.column(1)), lambda r: ids[r].as_py(), queries, best, documents, total)
        found = [(q, i, s) for q, own in zip(queries.names, best.rows) for s, i in own]
        if found:
            names, ids, scores = zip(*found)
            columns = [pa.array(names, pa.string()), pa.array(ids, kind), pa.array(scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "id", "score"])

    named = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    schema = named.select(F.lit("").alias("query"), "id", F.lit(0).cast("bigint").alias("score")).limit(0).schema
    return named.mapInArrow(run, schema)


def search(
    docs: DataFrame,
    items: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    k: int = BEST,
    coords: int = COORDS,
    block: int = BLOCK,
) -> DataFrame:
    """``item, rank, id, score`` of the ``k`` highest-scoring documents of each item, scores above 0 only.

    Counts of terms and the queries with their weights are written once to the
    shared folder; two numbers and the blocks of queries come to the driver.
    """
    asked = stored(query_terms(items, item_text), "search-queries")
    totals = F.lit(b"").alias("term")
    wanted = asked.select("term").distinct().unionByName(items.sparkSession.range(1).select(totals))
    counts = stored(term_counts(docs, text).join(wanted, "term"), "search-counts")
    whole = counts.where(F.length("term") == 0).first()
    documents, total = (whole["n_docs"], whole["n_terms"]) if whole else (0, 0)
    weight = F.floor(1000 * F.log(F.lit(float(2 * documents + 2)) / (2 * F.col("n_docs") + 1)))
    weighted = asked.join(counts.where(F.length("term") > 0), "term").select("query", "term", "n", weight.alias("weight"))
    weighted = stored(weighted, "search-weights")
    found = None
    for part in blocks_of(weighted, F.length("term") + 24, block):
        own = best_of_block(docs, part.collect(), id, text, documents, total, k, coords)
        found = own if found is None else found.unionByName(own)
    if found is None:
        named = docs.select(F.col(id).alias("id"))
        found = named.select(F.lit("").alias("query"), "id", F.lit(0).cast("bigint").alias("score")).where("false")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    kept = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    named = items.select(F.col(item).alias("item"), F.sha2(F.col(item_text), 256).alias("query"))
    return named.join(kept, "query").select(F.col("item").alias(item), "rank", F.col("id").alias(id), "score")
