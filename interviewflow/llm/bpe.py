"""BPE encoding and decoding: long texts are encoded in parts that are joined pairwise.

A text longer than ``leaf`` characters is cut, where it can be at a space
between two ASCII letters or digits, which is a border of words for any
left and right context. Where there is no such space the cut falls anywhere,
and two neighbours are joined by encoding a window around the cut anew; it
grows until its first tokens are those of the left part and its last tokens
those of the right part. Token sequences whose neighbours all agree are the
encoding of the whole, so the result equals encoding at once.

A null text is an empty one and has no tokens. Repeated rows each get their
result. Ids of documents are not used. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interviewflow.llm.names import free_names
from interviewflow.llm.worker import once_per_worker, slices

# Fixed value: the word pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 1 << 16
# Runs without a border of words from this length on are encoded as a tree.
RUN = 2048
BORDER = re.compile(r"[0-9A-Za-z](?= [0-9A-Za-z])")
UNSPLIT = re.compile(r"\S{%d,}|\s{%d,}" % (RUN, RUN))
SEARCH = 4096
FIRST_WINDOW = 16
AGREE = 2


def byte_of_letter() -> dict[str, int]:
    """The letters in which a byte-level vocabulary writes bytes: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        data = json.loads(vocabulary)
        letters = byte_of_letter()
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        model = data["model"]
        ranks = {
            bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special
        }
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        if [model["vocab"][a + b] for a, b in pairs] != list(range(256, 256 + len(pairs))):
            raise ValueError("the vocabulary must number its tokens in the order of its merges")
        self.engine = tiktoken.Encoding(
            "vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
        self.special = set(special)
        # A window of this many tokens holds any special token that the cut fell into.
        self.first = max([FIRST_WINDOW, *[len(t.encode()) for t in special]])
        self.sizes = {i: len(b) for b, i in ranks.items()} | {i: len(t.encode()) for t, i in special.items()}

    def at_once(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.engine.encode(text, allowed_special=self.special, disallowed_special=())
        return self.engine.encode_ordinary(text)

    def encode(self, text: str) -> list[int]:
        """Long runs without a border go through the tree, so time stays in proportion to the length."""
        if len(text) < RUN or not UNSPLIT.search(text):
            return self.at_once(text)
        return self.tree([(text[a:b], free) for a, b, free in cuts(text, RUN)])

    def tree(self, parts: list[tuple[str, bool]]) -> list[int]:
        """Parts with their ``free`` marks, joined pairwise level by level."""
        return self.join_all([(p.encode(), self.at_once(p), free) for p, free in parts])

    def join_all(self, nodes: list[tuple[bytes, Sequence[int], bool]]) -> list[int]:
        """``(text, ids, free)`` of neighbours; ``free``: the cut before the part is a border of words."""
        level = [(t, list(ids), free) for t, ids, free in nodes]
        while len(level) > 1:
            pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
            level = [p[0] if len(p) == 1 else self.joined(*p) for p in pairs]
        return level[0][1] if level else []

    def joined(self, left, right):
        text = left[0] + right[0]
        if right[2]:
            return text, left[1] + right[1], left[2]
        return text, self.spliced(left[0], left[1], right[0], right[1]), left[2]

    def spliced(self, left: bytes, left_ids: list[int], right: bytes, right_ids: list[int]) -> list[int]:
        """The encoding of ``left + right``."""
        n = self.first
        while True:
            i, begin = self.back(left, left_ids, n)
            j, end = self.forth(right, right_ids, n)
            window = self.at_once((left[begin:] + right[:end]).decode())
            open_left, open_right = i > 0, j < len(right_ids)
            if len(window) >= 2 * AGREE:
                same_left = not open_left or window[:AGREE] == left_ids[i : i + AGREE]
                same_right = not open_right or window[-AGREE:] == right_ids[j - AGREE : j]
                if same_left and same_right:
                    return left_ids[:i] + window + right_ids[j:]
            if not open_left and not open_right:
                return window
            n *= 2

    def back(self, text: bytes, ids: list[int], n: int) -> tuple[int, int]:
        """Token and byte ``n`` tokens before the end, moved on to the start of a character."""
        i = max(0, len(ids) - n)
        at = len(text) - sum(self.sizes[t] for t in ids[i:])
        while i > 0 and text[at] & 0xC0 == 0x80:
            i -= 1
            at -= self.sizes[ids[i]]
        return i, at

    def forth(self, text: bytes, ids: list[int], n: int) -> tuple[int, int]:
        j = min(n, len(ids))
        at = sum(self.sizes[t] for t in ids[:j])
        while j < len(ids) and text[at] & 0xC0 == 0x80:
            at += self.sizes[ids[j]]
            j += 1
        return j, at

    def decode(self, ids: Sequence[int]) -> str:
        return self.engine.decode_bytes(ids).decode("utf-8", errors="replace")


def cuts(text: str, leaf: int) -> list[tuple[int, int, bool]]:
    """Parts of at most about ``leaf`` characters: begin, end, and whether the part begins at a border of words."""
    parts, at, free = [], 0, True
    while len(text) - at > leaf:
        low = max(at + 1, at + leaf - min(SEARCH, leaf // 2))
        last = None
        for last in BORDER.finditer(text, low, at + leaf + 2):
            pass
        end = last.end() if last else at + leaf
        parts.append((at, end, free))
        at, free = end, last is not None
    return [*parts, (at, len(text), free)]


def codec_of(vocabulary) -> Codec:
    data = vocabulary.value
    return once_per_worker("codec-" + hashlib.sha256(data).hexdigest(), lambda: Codec(data))


def vocabulary_of(docs: DataFrame, path: str):
    """The file at ``path``, read on the driver and sent to the workers; a vocabulary has a fixed size."""
    with open(path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


OUTPUTS = {
    "n_tokens": "bigint",
    "ids": "array<int>",
    "decoded": "string",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}


def outputs_of(codec: Codec, ids: list[int], wanted: Sequence[str]) -> list:
    """The wanted columns of one text, from its token ids."""
    import numpy as np

    found = {}
    if "decoded" in wanted or "decoded_sha256" in wanted:
        found["decoded"] = codec.decode(ids)
        if "decoded_sha256" in wanted:
            found["decoded_sha256"] = hashlib.sha256(found["decoded"].encode()).hexdigest()
    if "ids_sha256" in wanted:
        found["ids_sha256"] = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
    found |= {"n_tokens": len(ids)}
    if "ids" in wanted:
        found["ids"] = np.array(ids, dtype=np.int32)
    return [found[c] for c in wanted]


def encode_texts(
    docs: DataFrame, path: str, text: str = "text", outputs: Sequence[str] = ("n_tokens", "ids"), leaf: int = LEAF
) -> DataFrame:
    """``docs`` with the columns ``outputs`` of its texts; columns of these names are replaced.

    Texts up to ``leaf`` characters are encoded where they are. The parts of a
    longer one are encoded as rows of their own in any task, and only they and
    their ids meet again. Equal long texts are encoded once.
    """
    import pyarrow as pa

    vocabulary = vocabulary_of(docs, path)
    kept = docs.drop(*outputs)
    key, *made = free_names(kept.columns, "__key", *[f"__{c}" for c in outputs])
    wanted = ", ".join(f"{c} {OUTPUTS[c]}" for c in outputs)
    empty = kept.limit(0).select("*", *[F.lit(None).cast(OUTPUTS[c]).alias(c) for c in outputs])
    arrow = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary)
        for batch in slices(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            rows = [outputs_of(codec, codec.encode(t) if t else [], outputs) for t in texts]
            columns = [
                pa.array([r[i] for r in rows], type=arrow[OUTPUTS[c]]) for i, c in enumerate(outputs)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *outputs])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for digest, whole in zip(*[c.to_pylist() for c in batch.columns]):
                parts = cuts(whole, leaf)
                for at in range(0, len(parts), 64):
                    some = parts[at : at + 64]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([digest] * len(some), pa.string()),
                            pa.array(range(at, at + len(some)), pa.int32()),
                            pa.array([whole[a:b] for a, b, _ in some], pa.string()),
                            pa.array([free for *_, free in some], pa.bool_()),
                        ],
                        names=["key", "part", "piece", "free"],
                    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        codec = codec_of(vocabulary)
        for batch in slices(batches, "piece"):
            found = [np.array(codec.encode(t), dtype=np.int32) for t in batch.column("piece").to_pylist()]
            ids = pa.array(found, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "part_ids"])

    def join(digest, group):
        codec = codec_of(vocabulary)
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        ids = codec.join_all([(r["piece"].encode(), r["part_ids"], r["free"]) for r in rows])
        cells = [digest[0].as_py(), *outputs_of(codec, ids, outputs)]
        types = [pa.string(), *[arrow[OUTPUTS[c]] for c in outputs]]
        return pa.table(
            [pa.array([x], type=t) for x, t in zip(cells, types)], names=[key, *made]
        )

    is_long = F.coalesce(F.length(text) > leaf, F.lit(False))
    done = kept.where(~is_long).mapInArrow(short, empty.schema)
    long = kept.where(is_long).withColumn(key, F.sha2(text, 256))
    parts = (
        long.select(F.col(key).alias("key"), F.col(text).alias("piece"))
        .mapInArrow(cut, "key string, part int, piece string, free boolean")
        .dropDuplicates(["key", "part"])
    )
    joined = (
        parts.mapInArrow(encode, "key string, part int, piece string, free boolean, part_ids array<int>")
        .groupBy("key")
        .applyInArrow(join, f"{key} string, " + ", ".join(f"{m} {OUTPUTS[c]}" for m, c in zip(made, outputs)))
    )
    whole = long.join(joined, key).select(*kept.columns, *[F.col(m).alias(c) for m, c in zip(made, outputs)])
    return done.unionByName(whole)


def decode_ids(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text of an array of token ids; null gives null."""
    import pyarrow as pa

    vocabulary = vocabulary_of(rows, path)
    kept = rows.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary)
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            cells = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = pa.array([None if x is None else codec.decode(x) for x in cells], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, into])

    return kept.mapInArrow(run, kept.limit(0).withColumn(into, F.lit(None).cast("string")).schema)
