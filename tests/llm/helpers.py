"""Brute-force versions that the operators are held against."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACE = rb"[\x20\x09-\x0D]+"


def documents(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id bigint, text string{extra}")


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r.asDict())
    return out


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words(text):
    return [w for w in re.split(SPACE, (text or "").encode().translate(LOWER)) if w]


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text):
    import xxhash

    w = words(text)
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=3):
    """Component of each index: its least member."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def repeats(rows, least):
    """For rows in order: bytes, removed bytes, runs, digest of the rest."""
    seen, out = set(), []
    for text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - least + 1):
            window = data[p : p + least]
            if window in seen:
                gone[p : p + least] = [True] * least
            seen.add(window)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(data), sum(gone), runs, sha(bytes(b for b, g in zip(data, gone) if not g))))
    return out


def katz(rows, k, delta, discounts):
    """(id, held out, tokens, known, training tokens, base, score) by plain recursion over dictionaries."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    tokens = [[*words(t), b"\n"] for _, t in rows]
    uni, pairs, contexts = Counter(), Counter(), Counter()
    for h, t in zip(held, tokens):
        if not h:
            uni.update(t)
            for pair in zip([b" ", *t], t):
                pairs[pair] += 1
                contexts[pair[0]] += 1
    total, types = sum(uni.values()), len(uni)

    def factors(counts):
        kinds = Counter(counts.values())
        return discounts([kinds[r] for r in range(1, k + 2)])

    d1, d2 = factors(uni), factors(pairs)

    def mass(c, d):
        return c - delta if c > k else d[c - 1] * c

    unknown = 1 - sum(mass(c, d1) for c in uni.values()) / total if total else 1.0
    follow = defaultdict(list)
    for (v, w), c in pairs.items():
        follow[v].append((w, c))

    def low(w):
        return mass(uni[w], d1) / total if uni[w] else unknown

    weight = {
        v: (1 - sum(mass(c, d2) for _, c in f) / contexts[v]) / (1 - sum(low(w) for w, _ in f)) for v, f in follow.items()
    }

    def probability(w, v):
        return mass(pairs[v, w], d2) / contexts[v] if pairs[v, w] else weight.get(v, 1.0) * low(w)

    # Each context's probabilities add up to 1.
    for v in list(follow)[:20]:
        assert abs(sum(probability(w, v) for w in uni) + weight[v] * unknown - 1) < 1e-9
    out = []
    for (i, _), h, t in zip(rows, held, tokens):
        base = sum(math.log10((uni[w] + 0.5) / (total + 0.5 * (types + 1))) for w in t)
        score = sum(math.log10(probability(w, v)) for v, w in zip([b" ", *t], t))
        out.append((i, h, len(t), sum(uni[w] > 0 for w in t), total, base, score))
    return out
