"""Scores of documents under a bigram model with Katz backoff.

``P(w | v)`` is the discounted share of ``v w`` among what follows ``v`` if the
pair was seen, and the backoff weight of ``v`` times ``P(w)`` otherwise;
``P(w)`` in turn is discounted, and unknown words share what is left. Counts up
to ``K`` have Good-Turing discounts; greater ones lose ``DELTA``, so that every
word seen leaves some probability for others. The weight of ``v`` is exactly
what its pairs leave, over what ``P`` gives to the words not seen after it.

Documents are written once as batches of word numbers. Each batch counts its
own words and pairs, and two tables are made of these counts: of words, dealt by
word, and of pairs, dealt by context. Their tasks add up what all batches have,
and give each batch the counts of its own words and pairs, and what the pairs
of each of its contexts add up to. With both tables a batch evaluates each of
its tokens from the highest order down. What moves is one entry per different
word or pair of a batch, however many partitions there are. The pairs of a hot
context are dealt by pair, and the sums of their parts meet once per context.

Words are told apart by 64-bit hashes when they are counted. From there on a
word is known by its count and its number among the words of this count, which
is exact and takes little room: frequent words have small numbers, others small
counts.
Null text: empty, so one end token. Null id: in training. Repeated rows count
and are scored each. Without training tokens every word has probability 1.
Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interviewflow.llm.store import release, rows_at_once, shuffles_end_with_jobs, stored
from interviewflow.llm.worker import byte_texts, slices
from interviewflow.session import bucketed

K = 5
DELTA = 0.05
FOLDS, HELD_OUT = 5, 1
# White space cannot be in a word, so these two texts are none; they are the first two words of each batch.
END, START = b"\n", b" "
# Entries (words or pairs of batches) of a partition; a context with a quarter as many tokens is hot.
PART_TOKENS = 1_000_000
# Bytes of text of a batch.
BATCH_BYTES = 8 << 20
# Documents that a worker gets at once.
TEXTS_AT_ONCE = 1000
# What is added up for each context: how many words follow it once, ..., K times and more often, and what P gives to all of them.
SUMS = K + 2
# The words of a row that are hot, each known by its count and its number among the words of this count.
HOT_WORDS = "array<struct<count:bigint,number:bigint>>"


def discounts(counts_of_counts: list[int], k: int = K) -> list[float]:
    """Katz's Good-Turing factors for counts 1 to ``k``, from how many things have each count 1 to ``k + 1``.

    Where they are no proper discounts, half a count is taken instead.
    """
    n = [0, *counts_of_counts]
    half = [1 - 0.5 / r for r in range(1, k + 1)]
    if min(n[1 : k + 2]) < 1:
        return half
    tail = (k + 1) * n[k + 1] / n[1]
    if tail >= 1:
        return half
    found = [((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) for r in range(1, k + 1)]
    return found if all(0 < d < 1 for d in found) else half


@dataclass
class Unigrams:
    """What the lowest order needs: sizes, discounts, and the share of unknown words."""

    tokens: int = 0
    words: int = 0
    factors: list[float] = field(default_factory=list)
    unknown: float = 1.0

    def mass(self, counts):
        """Discounted counts; divided by ``tokens`` they are probabilities."""
        return discounted(counts, self.factors)

    def log_probability(self, counts):
        import numpy as np

        known = self.mass(np.maximum(counts, 1)) / max(self.tokens, 1)
        return np.log10(np.where(counts > 0, known, self.unknown))


def discounted(counts, factors: list[float]):
    import numpy as np

    table = np.array([0.0, *[d * r for r, d in enumerate(factors, 1)]])
    return np.where(counts > K, counts - DELTA, table[np.minimum(counts, K)])


def word_hash(word: bytes) -> int:
    import xxhash

    value = xxhash.xxh64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


def in_training(id: str) -> Column:
    fold = F.crc32(F.col(id).cast("string")) % FOLDS
    return F.coalesce(fold != HELD_OUT, F.lit(True))


def packed(array, dtype: str) -> bytes:
    """Bytes of equal weight together, compressed: small numbers take little room."""
    import numpy as np
    import zstandard

    cells = np.ascontiguousarray(array.astype(dtype))
    return zstandard.ZstdCompressor(level=1).compress(cells.view(np.uint8).reshape(-1, cells.itemsize).T.tobytes())


def unpacked(data: bytes, dtype: str):
    import numpy as np
    import zstandard

    kind = np.dtype(dtype)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def batches_of(docs: DataFrame) -> DataFrame:
    """From ``id, text, train``: one row per batch of documents.

    ``batch`` is a number of its own; ``ids, training`` and ``sizes`` (tokens) tell
    of its documents, ``tokens`` holds their words by number, ``words`` the hash
    of each number and ``counts`` how often training has it here.
    """
    import pyarrow as pa

    names = ["batch", "ids", "training", "n_tokens", "n_words", "sizes", "tokens", "words", "counts"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        local: dict[bytes, int] = {END: 0, START: 1}
        cells: list = []
        sizes: list[int] = []
        about: list = []
        held = 0

        def made() -> pa.RecordBatch:
            ids, training = (pa.concat_arrays([b.column(i) for b in about]) for i in (0, 1))
            tokens, lengths = np.concatenate(cells), np.array(sizes)
            train = training.to_numpy(zero_copy_only=False)
            counts = np.bincount(tokens, np.repeat(train, lengths), len(local)).astype(np.int64)
            # A training document begins once.
            counts[1] = train.sum()
            hashes = np.array([word_hash(w) for w in local], dtype=np.int64)
            one = pa.array([0, len(lengths)], pa.int32())
            binaries = (packed(lengths, "<u4"), packed(tokens, "<u4"), hashes.tobytes(), packed(counts, "<u4"))
            columns = [
                pa.array([int.from_bytes(os.urandom(8), "little") >> 1], pa.int64()),
                *[pa.ListArray.from_arrays(one, c) for c in (ids, training)],
                pa.array([len(tokens)], pa.int64()),
                pa.array([len(local)], pa.int64()),
                *[pa.array([x], pa.binary()) for x in binaries],
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in slices(rows, 1, BATCH_BYTES // 4):
            number = local.setdefault
            for whole in byte_texts(batch.column(1)):
                own = [number(w, len(local)) for w in whole.lower().split()]
                cells += [np.array(own, dtype=np.uint32), np.zeros(1, dtype=np.uint32)]
                sizes.append(len(own) + 1)
                held += len(whole)
            about.append(batch.select(["id", "train"]))
            if held >= BATCH_BYTES:
                yield made()
                local, held = {END: 0, START: 1}, 0
                for x in (cells, sizes, about):
                    x.clear()
        if sizes:
            yield made()

    wide = docs.select(F.lit(0).cast("bigint").alias("batch"), F.array("id").alias("ids"), F.array("train").alias("training"))
    more = {c: F.lit(0).cast("bigint") for c in ("n_tokens", "n_words")} | {c: F.lit(b"") for c in names[5:]}
    return docs.select("id", "text", "train").mapInArrow(run, wide.withColumns(more).select(*names).limit(0).schema)


def parts_of(hashes, parts: int):
    import numpy as np

    return ((hashes.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def cut_by(part) -> Iterator[tuple[int, int, int]]:
    """Part, begin and end of the runs of a sorted array."""
    import numpy as np

    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    return zip(part[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist())


def single_rows(batches) -> Iterator[dict]:
    """Rows of Arrow batches, one at a time: each holds megabytes."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def hot_words(counts, numbers) -> list[dict]:
    return [{"count": c, "number": m} for c, m in zip(counts.tolist(), numbers.tolist())]


def word_table(batches: DataFrame, parts: int, hot: int) -> DataFrame:
    """Counts of words over all batches, dealt by word.

    One row for each batch and part: ``counts`` of its words there and their
    ``numbers`` among the words of equal count, in their order, and both of those
    that are ``hot``. Rows without a batch have ``stats``: tokens, words, and how
    many words have each count from 1 to ``K + 1``.
    """
    import pyarrow as pa

    word_list = pa.list_(pa.struct([("count", pa.int64()), ("number", pa.int64())]))

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for row in single_rows(rows):
            hashes, counts = np.frombuffer(row["words"], "<i8"), unpacked(row["counts"], "<u4")
            part = parts_of(hashes, parts)
            order = np.argsort(part, kind="stable")
            cells = [(p, row["batch"], hashes[order[a:b]].tobytes(), packed(counts[order[a:b]], "<u4")) for p, a, b in cut_by(part[order])]
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), types)], names=["part", "batch", "words", "counts"])

    def answer(key, group):
        import numpy as np

        hashes = [np.frombuffer(x.as_py(), "<i8") for x in group.column("words")]
        sizes = [len(h) for h in hashes]
        words, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(at, np.concatenate([unpacked(x.as_py(), "<u4") for x in group.column("counts")])).astype(np.int64)
        by_count = np.argsort(total, kind="stable")
        ranked = total[by_count]
        number = np.empty(len(total), dtype=np.int64)
        # No two parts give the same number.
        number[by_count] = (np.arange(len(total)) - np.searchsorted(ranked, ranked)) * parts + key[0].as_py()
        ends = np.cumsum(sizes)
        own = [(total[i], number[i]) for i in (at[e - n : e] for e, n in zip(ends, sizes))]
        real = total[words != word_hash(START)]
        stats = [int(real.sum()), int((real > 0).sum()), *[int((real == r).sum()) for r in range(1, K + 2)]]
        n = len(own)
        return pa.table(
            [
                pa.array([*group.column("batch").to_pylist(), None], pa.int64()),
                pa.array([key[0].as_py()] * (n + 1), pa.int64()),
                pa.array([*[packed(c, "<i8") for c, _ in own], None], pa.binary()),
                pa.array([*[packed(m, "<i8") for _, m in own], None], pa.binary()),
                pa.array([*[hot_words(c[c > hot], m[c > hot]) for c, m in own], None], word_list),
                pa.array([*[None] * n, stats], pa.list_(pa.int64())),
            ],
            names=["batch", "part", "counts", "numbers", "hot", "stats"],
        )

    asked = batches.select("batch", "words", "counts").mapInArrow(ask, "part bigint, batch bigint, words binary, counts binary")
    dealt = asked.repartition(parts, "part").groupBy("part")
    kinds = f"batch bigint, part bigint, counts binary, numbers binary, hot {HOT_WORDS}, stats array<bigint>"
    return dealt.applyInArrow(answer, kinds)


def unigrams_of(words: DataFrame) -> Unigrams:
    """Sizes and counts of counts; as many numbers come to the driver."""
    sums = words.where("stats IS NOT NULL").agg(*[F.sum(F.get("stats", F.lit(i))) for i in range(K + 3)]).first()
    tokens, n, *by_count = (x or 0 for x in sums)
    found = Unigrams(tokens, n, discounts(by_count))
    if tokens:
        kept = sum(d * r * m for r, (d, m) in enumerate(zip(found.factors, by_count), 1))
        low = sum(r * m for r, m in enumerate(by_count[:K], 1))
        many = n - sum(by_count[:K])
        found.unknown = (low - kept + DELTA * many) / tokens
    return found


class Batch:
    """The words of a batch with their counts, and its different pairs in the order of their parts, contexts and words."""

    def __init__(self, row: dict, word_parts: int, parts: int, hot: int):
        import numpy as np

        self.hashes = np.frombuffer(row["words"], "<i8")
        order = np.argsort(parts_of(self.hashes, word_parts), kind="stable")
        answers = sorted(row["word_counts"], key=lambda a: a["part"])
        self.counts, self.numbers = (np.empty(len(self.hashes), dtype=np.int64) for _ in range(2))
        self.counts[order] = np.concatenate([unpacked(a["counts"], "<i8") for a in answers])
        self.numbers[order] = np.concatenate([unpacked(a["numbers"], "<i8") for a in answers])
        self.sizes, self.tokens = unpacked(row["sizes"], "<u4").astype(np.int64), unpacked(row["tokens"], "<u4").view(np.int32)
        n = len(self.hashes)
        # Pairs are numbered by context and word; ``pair_of`` tells which each token is.
        key = np.roll(self.tokens, 1).astype(np.int64)
        key[np.cumsum(self.sizes) - self.sizes] = 1
        key *= n
        key += self.tokens
        by_key = np.argsort(key, kind="stable")
        key = key[by_key]
        fresh = np.diff(key, prepend=-1) != 0
        self.pair_of = np.empty(len(key), dtype=np.int32)
        self.pair_of[by_key] = np.cumsum(fresh, dtype=np.int32) - 1
        pairs = key[fresh]
        del key, by_key, fresh
        context, word = (x.astype(np.int32) for x in np.divmod(pairs, n))
        del pairs
        self.is_hot = self.counts > hot
        part = parts_of(self.hashes, parts)[context]
        apart = self.is_hot[context]
        mixed = self.hashes.view(np.uint64)[context[apart]] * np.uint64(31) + self.hashes.view(np.uint64)[word[apart]]
        part[apart] = parts_of(mixed, parts)
        self.order = np.argsort(part, kind="stable").astype(np.int32)
        self.part, self.context, self.word = part[self.order], context[self.order], word[self.order]
        # In each part every context is one run of pairs.
        self.heads = np.flatnonzero((np.diff(self.part, prepend=-1) != 0) | (np.diff(self.context, prepend=-1) != 0))


def changed(cells):
    """Where a cell of an array differs from the one before."""
    import numpy as np

    return np.append(True, cells[1:] != cells[:-1])[: len(cells)]


def distinct_words(counts, numbers):
    """Counts and numbers of the different words, and which of them each entry is."""
    import numpy as np

    order = np.lexsort((numbers, counts))
    fresh = changed(counts[order]) | changed(numbers[order])
    at = np.empty(len(order), dtype=np.int64)
    at[order] = np.cumsum(fresh) - 1
    first = order[fresh]
    return counts[first], numbers[first], at


def pair_table(batches: DataFrame, unigrams: Unigrams, word_parts: int, parts: int, hot: int) -> DataFrame:
    """Counts of pairs over all batches, dealt by context (pairs of a hot one by both words).

    One row for each batch and part: ``counts`` of its pairs there, in their
    order, and ``sums`` of its contexts. Rows without a batch have ``stats``, how
    many pairs have each count from 1 to ``K + 1``, and the ``hot_sums`` of the hot
    contexts ``hot`` over the pairs of this part.
    """
    import pyarrow as pa

    asked_names = ["part", "batch", "context_counts", "contexts", "runs", "below", "words", "mine"]
    word_list = pa.list_(pa.struct([("count", pa.int64()), ("number", pa.int64())]))

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for row in single_rows(rows):
            b = Batch(row, word_parts, parts, hot)
            train = np.repeat(np.array(row["training"]), b.sizes)
            mine = np.bincount(b.pair_of, train, len(b.order)).astype(np.int64)[b.order]
            runs = np.diff(np.append(b.heads, len(b.order)))
            for part, low, high in cut_by(b.part):
                first, last = np.searchsorted(b.heads, [low, high])
                context = b.context[b.heads[first:last]]
                word = b.word[low:high]
                cells = [
                    packed(b.counts[context], "<i8"),
                    packed(b.numbers[context], "<i8"),
                    packed(runs[first:last], "<u4"),
                    packed(b.counts[word], "<i8"),
                    packed(b.numbers[word], "<i8"),
                    packed(mine[low:high], "<u4"),
                ]
                columns = [pa.array([part], pa.int64()), pa.array([row["batch"]], pa.int64()), *[pa.array([c], pa.binary()) for c in cells]]
                yield pa.RecordBatch.from_arrays(columns, names=asked_names)

    def answer(key, group):
        import numpy as np

        def column(name, dtype):
            return [unpacked(x.as_py(), dtype) for x in group.column(name)]

        contexts, runs, words = column("contexts", "<i8"), column("runs", "<u4"), column("words", "<i8")
        n_contexts, n_pairs = [len(c) for c in contexts], [len(w) for w in words]
        known_count, known, context_at = distinct_words(np.concatenate(column("context_counts", "<i8")), np.concatenate(contexts))
        context = np.repeat(context_at, np.concatenate(runs))
        word, below = np.concatenate(words), np.concatenate(column("below", "<i8"))
        del words, runs, contexts
        order = np.lexsort((word, below, context))
        context, word, below = context[order], word[order], below[order]
        heads = np.flatnonzero(changed(context) | changed(word) | changed(below))
        context, below = context[heads], unigrams.mass(below[heads]) / max(unigrams.tokens, 1)
        del word
        total = np.add.reduceat(np.concatenate(column("mine", "<u4")).astype(np.int64)[order], heads)
        counts = np.empty(len(order), dtype=np.int64)
        counts[order] = np.repeat(total, np.diff(np.append(heads, len(order))))
        del order
        kinds = [np.bincount(context, total == r, len(known)) for r in range(1, K + 1)]
        kinds += [np.bincount(context, total > K, len(known)), np.bincount(context, np.where(total > 0, below, 0.0), len(known))]
        sums = np.stack(kinds, axis=1)
        is_hot = known_count > hot
        stats = [int((total == r).sum()) for r in range(1, K + 2)]
        n, pair_ends, context_ends = len(n_pairs), np.cumsum(n_pairs), np.cumsum(n_contexts)
        own = [packed(counts[e - m : e], "<u4") for e, m in zip(pair_ends, n_pairs)]
        of_contexts = [packed(sums[context_at[e - m : e]].reshape(-1), "<f8") for e, m in zip(context_ends, n_contexts)]
        return pa.table(
            [
                pa.array([*group.column("batch").to_pylist(), None], pa.int64()),
                pa.array([key[0].as_py()] * (n + 1), pa.int64()),
                pa.array([*own, None], pa.binary()),
                pa.array([*of_contexts, None], pa.binary()),
                pa.array([*[None] * n, stats], pa.list_(pa.int64())),
                pa.array([*[None] * n, hot_words(known_count[is_hot], known[is_hot])], word_list),
                pa.array([*[None] * n, sums[is_hot].tolist()], pa.list_(pa.list_(pa.float64()))),
            ],
            names=["batch", "part", "counts", "sums", "stats", "hot", "hot_sums"],
        )

    binaries = ", ".join(f"{n} binary" for n in asked_names[2:])
    asked = batches.mapInArrow(ask, f"part bigint, batch bigint, {binaries}")
    kinds = "batch bigint, part bigint, counts binary, sums binary, stats array<bigint>"
    kinds += f", hot {HOT_WORDS}, hot_sums array<array<double>>"
    return asked.repartition(parts, "part").groupBy("part").applyInArrow(answer, kinds)


def hot_sums(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """``batch, hot_contexts``: for each batch its hot contexts with the sums over all parts."""
    parts = pairs.where("batch IS NULL").select(F.explode(F.arrays_zip("hot", "hot_sums")).alias("h"))
    totals = parts.groupBy(F.col("h.hot").alias("v")).agg(*[F.sum(F.get("h.hot_sums", F.lit(i))).alias(f"s{i}") for i in range(SUMS)])
    wanted = words.where("batch IS NOT NULL").select("batch", F.explode("hot").alias("v"))
    cells = F.struct("v", F.array(*[f"s{i}" for i in range(SUMS)]).alias("sums"))
    return wanted.join(totals, "v").groupBy("batch").agg(F.collect_list(cells).alias("hot_contexts"))


def token_scores(b: Batch, row: dict, unigrams: Unigrams, factors: list[float]):
    """log10 of the probability of each token after the one before: of the pair if it was seen, else of the word and a backoff weight."""
    import numpy as np

    answers = sorted(row["pair_counts"], key=lambda a: a["part"])
    counts = np.concatenate([unpacked(a["counts"], "<u4") for a in answers]).view(np.int32)
    sums = np.concatenate([unpacked(a["sums"], "<f8") for a in answers]).reshape(-1, SUMS)
    context = b.context[b.heads]
    of_context = np.zeros((len(b.hashes), SUMS))
    of_context[context] = sums
    hot = {(h["v"]["count"], h["v"]["number"]): h["sums"] for h in row["hot_contexts"] or []}
    for v in np.unique(context[b.is_hot[context]]).tolist():
        of_context[v] = hot[int(b.counts[v]), int(b.numbers[v])]
    left = of_context[:, :K] @ np.array([(1 - d) * r for r, d in enumerate(factors, 1)]) + DELTA * of_context[:, K]
    free = 1 - of_context[:, K + 1]
    followed = of_context[:, : K + 1].sum(axis=1) > 0
    # A context that training has not leaves all to the lower order.
    weight = np.zeros(len(b.hashes))
    weight[followed] = np.log10(left[followed] / b.counts[followed] / free[followed])
    seen = counts > 0
    pair = weight[b.context] + unigrams.log_probability(b.counts)[b.word]
    pair[seen] = np.log10(discounted(counts[seen], factors) / b.counts[b.context[seen]])
    in_order = np.empty(len(pair))
    in_order[b.order] = pair
    return in_order[b.pair_of]


def katz_scores(docs: DataFrame, id: str = "doc_id", text: str = "text", part_tokens: int = PART_TOKENS) -> DataFrame:
    """One row per document: ``held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Batches, counts and scores are written to the shared folder by jobs that run
    at once; the counts go when the scores are there.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    named = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), in_training(id).alias("train"))
    with rows_at_once(spark, TEXTS_AT_ONCE):
        batches = bucketed(batches_of(named), "batch", "katz_batches", dealt=False)
    tokens, n_words = (x or 0 for x in batches.agg(F.sum("n_tokens"), F.sum("n_words")).first())
    hot = part_tokens // 4
    word_parts, parts = (max(1, math.ceil(n / part_tokens)) for n in (n_words, tokens))
    with shuffles_end_with_jobs(spark):
        words = stored(word_table(batches, word_parts, hot), "katz-words")
    unigrams = unigrams_of(words)
    answered = F.collect_list(F.struct("part", "counts", "numbers")).alias("word_counts")
    known = batches.drop("counts").join(words.where("batch IS NOT NULL").groupBy("batch").agg(answered), "batch")
    with rows_at_once(spark, 1), shuffles_end_with_jobs(spark):
        pairs = stored(pair_table(known, unigrams, word_parts, parts, hot), "katz-pairs")
    by_count = pairs.where("batch IS NULL").agg(*[F.sum(F.get("stats", F.lit(i))) for i in range(K + 1)]).first()
    factors = discounts([x or 0 for x in by_count])
    counted = pairs.where("batch IS NOT NULL").groupBy("batch").agg(F.collect_list(F.struct("part", "counts", "sums")).alias("pair_counts"))
    whole = known.join(counted, "batch").join(hot_sums(words, pairs), "batch", "left")
    names = [id, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in rows:
            for i, row in enumerate(single_rows([batch.drop_columns(["ids"])])):
                b = Batch(row, word_parts, parts, hot)
                starts = np.cumsum(b.sizes) - b.sizes
                base = np.log10((b.counts + 0.5) / (unigrams.tokens + 0.5 * (unigrams.words + 1)))
                n = len(b.sizes)
                ids = batch.column("ids").slice(i, 1).flatten()
                columns = [
                    ids,
                    pa.array([not t for t in row["training"]], pa.bool_()),
                    pa.array(b.sizes),
                    pa.array(np.add.reduceat((b.counts > 0)[b.tokens].astype(np.int64), starts)),
                    pa.array(np.full(n, unigrams.tokens)),
                    pa.array(np.add.reduceat(base[b.tokens], starts)),
                    pa.array(np.add.reduceat(token_scores(b, row, unigrams, factors), starts)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = ["boolean", "bigint", "bigint", "bigint", "double", "double"]
    schema = named.select(F.col("id").alias(id), *[F.lit(None).cast(k).alias(n) for n, k in zip(names[1:], kinds)]).limit(0).schema
    with rows_at_once(spark, 1), shuffles_end_with_jobs(spark):
        scores = stored(whole.mapInArrow(run, schema), "katz-scores")
    release(words, pairs)
    return scores
