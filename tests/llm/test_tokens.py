"""BPE, length tables, language model and the pipeline."""

import random
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import by_id, documents, katz, sha  # noqa: E402

from interviewflow.llm import bpe, katz as model, lengths, store  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", "l", "s", "'", " ", "  ", "\n", "1", "é", "中", "😀", "!", "'s", "'ll", "<|endoftext|>", "<|end", "the", "\t", "A", "ing"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(Path(PATH).read_bytes())


def test_tree_equals_the_library(library, codec):
    rng = random.Random(1)
    for _ in range(1500):
        alphabet = rng.sample(PIECES, rng.randint(1, 6))
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(2, 120)))
        at = sorted(rng.sample(range(1, len(text)), min(rng.randint(1, 7), len(text) - 1)))
        parts = [(text[a:b], False) for a, b in zip([0, *at], [*at, len(text)])]
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.at_once(text) == want and codec.tree(parts) == want
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_long_unsplit_runs(library, codec):
    rng = random.Random(2)
    for text in ("ab" * 5000, " " * 9000, "xyz1" * 3000, "é" * 6000, "!?" * 4000, "".join(rng.choice("abcde") for _ in range(9000)), "中文" * 3000):
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_cuts_cover_the_text_and_prefer_borders():
    text = "word and more " * 3000 + "x" * 9000
    parts = bpe.cuts(text, 1000)
    assert "".join(text[a:b] for a, b, _ in parts) == text
    assert all(text[a] == " " for a, _, free in parts[1:] if free) and not all(free for *_, free in parts)


@pytest.mark.parametrize("leaf", [50, 1 << 16])
def test_encode_and_decode_documents(spark, library, leaf):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 300))) for _ in range(40)]
    rows = [*enumerate(texts), (90, None), (91, ""), (None, texts[3] + texts[4]), (3, texts[3])]
    docs = documents(spark, [(*r, "clash") for r in rows], ", n_tokens string")
    outputs = ["n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"]
    encoded = bpe.encode_texts(docs, PATH, outputs=outputs, leaf=leaf)
    got = by_id(encoded)
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), ids, t or "", sha(np.array(ids, "<u4").tobytes()), sha(t or ""))
        assert want in [tuple(r[c] for c in outputs) for r in got[i]]
    again = bpe.decode_ids(encoded.select("doc_id", "text", "ids"), PATH)
    assert again.where("decoded <> coalesce(text, '')").count() == 0
    assert bpe.encode_texts(docs.limit(0), PATH).collect() == []


def test_length_table_answers_every_limit(spark, library):
    rng = random.Random(4)
    rows = [(i, "ab c " * rng.randint(0, 900)) for i in range(60)] + [(60, None), (60, None)]
    n = np.array([len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows])
    table = lengths.token_counts(documents(spark, rows), PATH)
    got = table.collect()
    assert sorted(r.length for r in got) == sorted(set(n.tolist()))
    for r in got:
        assert (r.n_docs, r.n_within, r.n_longer) == ((n == r.length).sum(), (n <= r.length).sum(), (n > r.length).sum())
        assert (r.total_tokens, r.truncated_tokens) == (n.sum(), np.minimum(n, r.length).sum())
        assert r.lost_tokens == r.total_tokens - r.truncated_tokens
    limits = [0, 1, 7, 100, 1025, 10**6]
    assert {r.limit: r.truncated_tokens for r in lengths.answer_limits(table, limits).collect()} == {
        x: int(np.minimum(n, x).sum()) for x in limits
    }
    quantiles = {r.quantile: r.length for r in lengths.length_quantiles(table).collect()}
    assert quantiles == {q: int(np.quantile(n, q, method="inverted_cdf")) for q in (0.5, 0.9, 0.99)}
    assert lengths.token_counts(documents(spark, []), PATH).collect() == []


def same_scores(got, want):
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=repr), sorted(want, key=repr)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("part_tokens", [4_000_000, 200])
def test_katz_equals_plain_recursion(spark, part_tokens):
    """Also with hot words, which are dealt by pair."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["The", "É"]
    rows = [(i, " ".join(rng.choice(vocabulary[: rng.choice([5, 20, 62])]) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    rows += [(None, "the new one"), (200, None), (201, ""), (3, rows[3][1]), (3, "other text")]
    docs = documents(spark, [(*r, 1) for r in rows], ", key int")
    got = [tuple(r) for r in model.katz_scores(docs, part_tokens=part_tokens).collect()]
    same_scores(got, katz(rows, model.K, model.DELTA, model.discounts))


def test_katz_without_training_documents(spark):
    held = [i for i in range(60) if katz([(i, "a")], model.K, model.DELTA, model.discounts)[0][1]][:3]
    rows = [(i, "a b") for i in held]
    got = [tuple(r) for r in model.katz_scores(documents(spark, rows)).collect()]
    assert all(r[1:] == (True, 3, 0, 0, 0.0, 0.0) for r in got) and len(got) == 3
    assert model.katz_scores(documents(spark, [])).collect() == []


def test_scores_are_read_again_and_leave_settings_as_they_were(spark):
    """Shuffles and counts are gone by then; the scores are a table of their own."""
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"]
    before = [spark.conf.get(k) for k in keys]
    scores = model.katz_scores(documents(spark, [(i, f"a b{i % 7} c") for i in range(200)]))
    assert sorted(scores.collect()) == sorted(scores.collect()) and scores.count() == 200
    assert [spark.conf.get(k) for k in keys] == before


def test_settings_come_back_after_an_error(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), store.rows_at_once(spark, 3), store.shuffles_end_with_jobs(spark):
        assert spark.conf.get(key) == "3"
        raise ValueError
    assert spark.conf.get(key) == before


def test_discounts():
    assert model.discounts([100, 40, 20, 12, 8, 5]) == pytest.approx(
        [((r + 1) * n[r] / (r * n[r - 1]) - 0.3) / 0.7 for n in [[100, 40, 20, 12, 8, 5]] for r in range(1, 6)]
    )
    assert model.discounts([3, 0, 1, 0, 0, 0]) == [0.5, 0.75, 1 - 0.5 / 3, 0.875, 0.9]


def test_pipeline_stages_do_what_they_say(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)

    def prose():
        return "the man and the house of " + " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(80))

    clean, leak, item = [prose() for _ in range(4)], prose(), " ".join(prose().split()[6:40])
    secret = prose() + " token = 9f8b2c4d6e1a3b5c7d9e0f1a end"
    rows = [(i, t) for i, t in enumerate([*clean, clean[0], leak + " " + item, secret, "too short", None])]
    docs = documents(spark, rows).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(kept) == [0, 1, 2, 3, 6]
    assert all(kept[i].text == clean[i] for i in range(4))
    assert kept[6].text.endswith(" [SECRET] end") and kept[6].n_chars == len(kept[6].text)
    assert all(r.n_tokens == len(r.ids) for r in kept.values())
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
