"""SimHash groups, components, tiles, repeats and benchmark passages against brute force."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import by_id, documents, fingerprint, groups, repeats, sha  # noqa: E402

from interviewflow.llm import simhash, substrings, tiling  # noqa: E402
from interviewflow.llm.graph import components  # noqa: E402

EDGES = [(7, None), (8, ""), (9, " \t"), (None, "only null"), (None, None)]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


def changed(rng, text, n=1):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "CHANGED"
    return " ".join(w)


def near_copies(seed, n=20):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rng, rng.choice([1, 2, 30, 300]))
        rows += [text, *[changed(rng, text, rng.choice([0, 1, 3])) for _ in range(rng.randrange(4))]]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_simhash_equals_brute_force(spark):
    rows = [*near_copies(1), (900, None), (901, ""), (902, "É Z"), (903, "É z"), (904, "a\x0bb c")]
    got = by_id(simhash.simhash_groups(documents(spark, rows)))
    prints = [fingerprint(t) for _, t in rows]
    component = groups(prints)
    for (i, _), p, c in zip(rows, prints, component):
        assert [(r["fingerprint"], r["component_id"]) for r in got[i]] == [(f"{p:016x}", min(rows[j][0] for j in range(len(rows)) if component[j] == c))]


def test_simhash_edges(spark):
    docs = documents(spark, [(*r, 1, 2) for r in [*EDGES, (3, "a b c d"), (3, "a b c d"), (3, "x")]], ", fp int, fingerprint int")
    got = by_id(simhash.simhash_groups(docs))
    assert {r["component_id"] for i in (7, 8, 9) for r in got[i]} == {7} and len(got[3]) == 3
    assert {(r["fingerprint"] == "0" * 16, r["component_id"]) for r in got[None]} == {(True, 7), (False, None)}
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(3, "a b c d"), (3, "x"), (7, None), (None, "only null")], key=repr)
    assert simhash.simhash_groups(docs.limit(0)).collect() == [] and simhash.keep_one_of_each(docs.limit(0)).collect() == []


def test_pipeline_keeps_one_of_each_group(spark):
    """The stage keeps the document of the least id of each component of fingerprints, and all others."""
    import corpus_pipeline

    rows = near_copies(7, 40)
    component = groups([fingerprint(t) for _, t in rows])
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()}
    assert kept == {min(i for (i, _), c in zip(rows, component) if c == own) for own in set(component)}


@pytest.mark.parametrize("shared", [0, 40])
def test_tile_links_connect_what_brute_force_connects(spark, monkeypatch, shared):
    """Also where a band value is dealt as pairs of tiles."""
    monkeypatch.setattr(simhash, "HOT", 50)
    monkeypatch.setattr(simhash, "HOT_TILE", 16)
    rng = random.Random(shared)
    base = [rng.getrandbits(64 - shared) for _ in range(60)]
    flips = [[sum(1 << k for k in rng.sample(range(64), rng.randrange(5))) for _ in range(6)] for _ in base]
    prints = sorted({b ^ f for b, own in zip(base, flips) for f in own})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    links = [(signed.index(a), signed.index(b)) for a, b in simhash.tile_links(df).collect()]
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        assert (prints[a] ^ prints[b]).bit_count() <= 3
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(prints))] == groups(prints)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(500, 500), (601, 600), (600, 601)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)} | {601: 600}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def overlapping(seed, alphabet):
    rng = random.Random(seed)
    rows, kept = [], []
    for i in range(12):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice(kept) if kept and rng.random() < 0.5 else "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))))
        text = "".join(parts)
        kept += [p for p in parts if p]
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "aé\0"])
@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats_equal_brute_force(spark, alphabet, hot):
    rows = overlapping(3, alphabet)
    docs = documents(spark, rows)
    got = by_id(substrings.remove_repeats(docs, least=20, gram=5, hot=hot))
    for (i, _), want in zip(rows, repeats([t for _, t in rows], 20)):
        r = got[i][0]
        assert (r["n_bytes"], sum(x["high"] - x["low"] for x in r["removed"]), len(r["removed"]), sha(bytes(r["kept"]))) == want


def test_repeats_over_chunks_and_edges(spark, monkeypatch):
    rng = random.Random(5)
    long = prose(rng, 40_000)
    rows = [(1, long), (2, "y" + long[70_000:150_000]), (3, None), (3, "z" * 150), (4, long[:99]), (None, long[:100]), (6, "z" * 300)]
    docs = documents(spark, [(*r, "clash", 1) for r in rows], ", sub string, n int")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = by_id(substrings.repeat_digest(docs))
    want = repeats([t for _, t in order], 100)
    assert len(got[3]) == 2
    for (i, _), w in zip(order, want):
        assert w in [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got[i]]
    assert substrings.repeat_digest(docs.limit(0)).collect() == []
    same = documents(spark, [(1, "q" * 50 + prose(rng, 40)), ] * 3)
    totals = sorted(r["n_removed"] for r in by_id(substrings.repeat_digest(same))[1])
    assert totals[0] == 0 and totals[1] == totals[2] > 100


def test_transform_groups_equal_windows():
    rng = random.Random(9)
    for _ in range(60):
        least, alphabet = rng.choice([5, 9, 20]), rng.choice(["ab", "a", "abcdefgh", "ab\0"])
        fragments = []
        for _ in range(rng.randint(1, 8)):
            f = "".join(rng.choice(alphabet) for _ in range(least + rng.randint(0, 20)))
            if fragments and rng.random() < 0.6:
                f = rng.choice(fragments).decode()[rng.randint(0, 4) :] + f
            fragments.append(f.encode())
        owner, offset = substrings.repeated_windows(fragments, least)
        seen, want = set(), []
        for i, f in enumerate(fragments):
            for j in range(len(f) - least + 1):
                if f[j : j + least] in seen:
                    want.append((i, j))
                seen.add(f[j : j + least])
        assert list(zip(owner.tolist(), offset.tolist())) == want


def tiles_by_hand(item, doc, least):
    """Greedy string tiling as in the books: the longest match of unmarked words, again and again."""
    a, b, total = [False] * len(item), [False] * len(doc), 0
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            return total
        n, i, j = best
        a[i : i + n], b[j : j + n] = [True] * n, [True] * n
        total += n


def test_tiles_equal_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        item = [rng.choice("abcd") for _ in range(rng.randint(1, 25))]
        doc = [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(item))
            doc[rng.randint(0, len(doc)) : 0] = item[at : at + rng.randint(1, 15)]
        items = tiling.Items([(1, " ".join(item))], 3)
        got = items.contained(" ".join(doc), 1e-9)
        least = min(3, len(item))
        assert [n for _, n, _ in got] == [x for x in [tiles_by_hand(item, doc, least)] if x]


def test_decontamination_catches_reordered_passages(spark):
    rng = random.Random(4)
    a, b = prose(rng, 40), prose(rng, 30)
    half = a.split()
    moved = " ".join(half[20:]) + " between them " + " ".join(half[:20])
    rows = [(1, "start " + a.upper() + "!! end"), (2, "x " + moved), (3, prose(rng, 200)), (4, " ".join(half[:10])), (5, None), (6, ""), (6, a.replace(" ", ",  "))]
    docs = documents(spark, [(*r, 1) for r in rows], ", item_id int")
    bench = spark.createDataFrame([(1, a), (2, b), (3, None), (4, ""), (None, "one two")], "item_id bigint, text string")
    found = tiling.contained_items(docs, bench)
    assert sorted((r.doc_id, r.coverage, r.n_tiles) for r in found.select("doc_id", "coverage", "n_tiles").collect()) == [(1, 1.0, 1), (2, 1.0, 2), (6, 1.0, 1)]
    clean = tiling.decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6]
    blocks = tiling.contained_items(docs.drop("item_id"), bench, block_bytes=100)
    assert sorted(r.doc_id for r in blocks.collect()) == [1, 2, 6]
    assert tiling.decontaminate(docs, bench.limit(0)).count() == len(rows)
    assert tiling.contained_items(docs.drop("item_id").limit(0), bench).collect() == []


def test_running_hash_is_karp_rabin():
    numbers = np.array([3, 1, 4, 1, 5, 9], dtype=np.uint64)
    got = tiling.running_hash(numbers, 3)
    want = [(int(a) * tiling.BASE**2 + int(b) * tiling.BASE + int(c)) % (1 << 64) for a, b, c in zip(numbers, numbers[1:], numbers[2:])]
    assert got.tolist() == want
    assert len(tiling.running_hash(numbers, 9)) == 0


def test_columns_are_left_alone(spark):
    docs = documents(spark, [(1, "a b c", "p")], ", source string")
    assert simhash.with_fingerprint(docs, into="source").columns == ["doc_id", "text", "source"]
    assert simhash.with_fingerprint(docs).select(F.col("fingerprint")).first()[0] is not None
