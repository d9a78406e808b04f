"""Passages of words against brute force."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import by_id, documents, sha  # noqa: E402

from interviewflow.llm import passages  # noqa: E402


def brute(rows, least):
    """Per row: number of words, removed words, digest of the rest."""
    order = {None: -(10**9)}
    ids = [order.get(i, i) for i, _ in rows]
    texts = [[w for w in (t or "").encode().split()] for _, t in rows]
    first = {}
    for i, words in zip(ids, texts):
        for p in range(len(words) - least + 1):
            window = tuple(words[p : p + least])
            first[window] = min(first.get(window, i), i)
    out = []
    for i, words in zip(ids, texts):
        gone = [False] * len(words)
        for p in range(len(words) - least + 1):
            if first[tuple(words[p : p + least])] < i:
                gone[p : p + least] = [True] * least
        out.append((len(words), sum(gone), sha(b" ".join(w for w, g in zip(words, gone) if not g))))
    return out


def made(seed, n=60, sizes=(0, 3, 12, 13, 14, 60, 300)):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    shared = [[word() for _ in range(k)] for k in (7, 12, 13, 14, 40, 200)]
    rows = []
    for _ in range(n):
        words = [word() for _ in range(rng.choice(sizes))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(shared)
        rows.append(rng.choice([" ", "\n", "\t  "]).join(words))
    rows += rng.sample(rows, n // 5)
    rows += ["x " * 100, "x " * 40, None, "", " \x0b ", "y\x0c" * 13]
    rng.shuffle(rows)
    return rows


def digest(docs, least):
    df = passages.remove_passages(docs, least=least)
    return sorted(
        (r.doc_id is not None, r.doc_id, r.n_words, sum(x.high - x.low for x in r.removed), sha(r.kept)) for r in df.collect()
    )


@pytest.mark.parametrize("least", [4, 13, 14, 30])
def test_passages_equal_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(passages, "WORDS_AT_ONCE", 64)
    monkeypatch.setattr(passages, "SLICE", 2000)
    rows = list(enumerate(made(least)))
    want = sorted((True, i, *w) for (i, _), w in zip(rows, brute(rows, least)))
    assert digest(documents(spark, rows), least) == want


def test_passages_of_repeated_and_null_ids(spark):
    rows = [(random.Random(i).choice([None, 1, 2, 3]), t) for i, t in enumerate(made(5, 30))]
    rows += rows[:7]
    want = sorted(((i is not None, i, *w) for (i, _), w in zip(rows, brute(rows, 13))), key=repr)
    got = digest(spark.createDataFrame([(*r, "h", 1) for r in rows], "doc_id bigint, text string, h string, place int"), 13)
    assert sorted(got, key=repr) == want


def test_passages_of_empty_and_long_tables(spark):
    assert passages.remove_passages(documents(spark, [])).collect() == []
    assert passages.passage_lengths(documents(spark, [])).collect() == []
    rng = random.Random(1)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(150_000))
    rows = [(1, long), (2, f"own {long} words"), (3, "same " * 200_000), (4, "same " * 30)]
    want = sorted((True, i, *w) for (i, _), w in zip(rows, brute(rows, 13)))
    assert digest(documents(spark, rows), 13) == want


def test_levels_double():
    assert passages.levels(13) == [7, 13] and passages.levels(100) == [7, 13, 25, 50, 100] and passages.levels(5) == [5]


def test_lengths_go_on_until_no_window_survives(spark):
    rng = random.Random(3)
    text = [str(rng.randrange(10**6)) for _ in range(400)]
    own = [str(rng.randrange(10**6, 10**7)) for _ in range(400)]
    # Passages of 12, 13, 39, 80 and 400 words behind words of their own.
    rows = [(0, " ".join(text))] + [(n, " ".join([*own[n : n + 5], *text[:n]])) for n in (12, 13, 39, 80, 400)]
    rows.append((7, " ".join(own[:50])))
    got = {i: r[0]["longest"] for i, r in by_id(passages.passage_lengths(documents(spark, rows))).items()}
    assert got == {13: 13, 39: 26, 80: 52, 400: 208}
    level = passages.LEAST
    while level < 400:
        level *= 2
        for n in (39, 80, 400):
            assert (got[n] >= level) or n < 1.5 * level
            assert got[n] <= n


def test_common_line_sends_few_rows():
    """Rows that meet per window are bounded by slices, not by copies."""
    import numpy as np

    ranks = np.repeat(np.arange(1000), 1)
    known = passages.known_repeats(ranks, np.zeros(1000, np.int64), np.zeros(1000, np.int64))
    assert (~known).sum() == 2 and not known[0] and not known[999]
