"""Ranked search against plain scoring of every pair."""

import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import LOWER, documents  # noqa: E402

from interviewflow.llm import search  # noqa: E402


def terms(text):
    lowered = (text or "").encode().translate(LOWER).decode()
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, k):
    """Sorted (item, rank, doc, score) by the formula of the contract."""
    own = [(i, Counter(terms(t))) for i, t in docs]
    total = sum(sum(c.values()) for _, c in own)
    some = sum(bool(c) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for at, (i, counts) in enumerate(own):
            n, score = sum(counts.values()), 0
            for t in terms(text):
                if counts[t]:
                    m = 100 - 75 + 75 * n * some // total
                    w = math.floor(1000 * math.log((2 * some + 2) / (2 * df[t] + 1)))
                    score += w * (1000000000 * counts[t] // (1000 * counts[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i if i is not None else 0, at))
        for rank, (score, none, i, _) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if none else i, -score))
    return sorted(out, key=repr)


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß9") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    text = lambda k: rng.choice([" ", ", ", "-\n"]).join(rng.choice(vocabulary).title() for _ in range(k))
    docs = [text(rng.choice([0, 1, 5, 30, 200])) for _ in range(n)]
    items = [text(rng.choice([1, 3, 10, 40])) for _ in range(30)]
    docs += [f"{text(5)} {i} {text(5)}" for i in items[:10]] + [items[0]] * 15
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("coords,block,chunk", [(2048, 8 << 20, 1024), (16, 400, 7), (1, 1 << 20, 1000)])
def test_search_equals_brute_force(spark, monkeypatch, coords, block, chunk):
    monkeypatch.setattr(search, "CHUNK", chunk)
    monkeypatch.setattr(search, "FIRST", 2)
    monkeypatch.setattr(search, "BATCH", 8)
    texts, asked = corpus(coords)
    docs = [*enumerate(texts), (900, None), (901, "?!"), (None, texts[0]), (None, None), (3, texts[3]), (3, texts[5])]
    items = [*enumerate(asked), (0, asked[0]), (5, asked[0]), (None, asked[1]), (70, None), (71, ""), (72, "zzzz unseen")]
    wanted = spark.createDataFrame(items, "item_id bigint, text string").repartition(3)
    got = search.search(documents(spark, docs).repartition(4), wanted, coords=coords, block=block)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, 10)


def test_search_of_empty_tables(spark):
    docs, items = documents(spark, [(1, "a b")]), spark.createDataFrame([(1, "a c")], "item_id bigint, text string")
    for d, i in [(docs.limit(0), items), (docs, items.limit(0)), (documents(spark, [(1, None), (2, " . ")]), items)]:
        result = search.search(d, i)
        assert result.collect() == [] and result.columns == ["item_id", "rank", "doc_id", "score"]
    assert [tuple(r) for r in search.search(docs, items, k=1).collect()] == brute([(1, "a b")], [(1, "a c")], 1)


def test_bounds_hold_and_spare_exact_scores():
    """With few coordinates all is scored; with many, little beyond the best is."""
    texts, asked = corpus(9, 2000)
    own = [Counter(terms(t)) for t in texts]
    df = Counter(t for c in own for t in c)
    total, some = sum(sum(c.values()) for c in own), sum(bool(c) for c in own)
    rows = [
        {"query": str(q), "term": t.encode(), "n": n, "weight": math.floor(1000 * math.log((2 * some + 2) / (2 * df[t] + 1)))}
        for q, text in enumerate(asked)
        for t, n in Counter(terms(text)).items()
        if df[t]
    ]
    scored, best = {}, {}
    for coords in (4, 4096):
        queries, kept = search.Queries(rows, coords), search.Best(len({r["query"] for r in rows}), 10)
        encoded = [t.encode() for t in texts]
        scored[coords] = sum(
            search.search_chunk(encoded[i : i + 256], lambda r, i=i: i + r, queries, kept, some, total) for i in range(0, len(texts), 256)
        )
        best[coords] = kept.rows
    assert best[4] == best[4096] and scored[4096] < scored[4] / 2


def test_long_text_and_many_copies(spark):
    text = "one two three " * 100_000
    docs = [(1, text), *[(i, "one two") for i in range(2, 400)]]
    items = [(1, "one three")]
    got = search.search(documents(spark, docs).repartition(5), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, 10)
