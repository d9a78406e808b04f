"""Extra columns with the names of helper columns keep their values."""

import pytest

from interviewflow.llm import bpe, lengths, passages, pii, quality, search, secrets, simhash, substrings, tiling, whitening
from interviewflow.llm.names import free_names
from interviewflow.llm.queries import vocabulary_path

HELPERS = ["__id", "__n", "__none", "__fp", "__key", "__secrets", "__pii", "__spans", "__m", "__N_tokens", "h", "known", "query", "place", "x"]
TEXT = "token = 'abcdef123456' and mail a.b@example.org "


@pytest.fixture
def docs(spark):
    rows = [(i, text, *[f"{c}{i}" for c in HELPERS]) for i, text in [(1, TEXT), (2, TEXT * 60), (3, None), (4, "other words")]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in HELPERS))


def test_free_names():
    assert free_names(["A", "__b", "___b"], "a", "__B", "c") == ["_a", "____B", "c"]
    assert free_names([], "a", "a") == ["a", "_a"]


def test_row_operators_keep_clashing_columns(spark, docs):
    made = [
        simhash.keep_one_of_each(docs),
        secrets.redact_secrets(docs),
        pii.redact_pii(docs),
        quality.keep_quality(docs),
        tiling.decontaminate(docs, spark.createDataFrame([(1, "some other passage of seven words here")], "item_id int, text string")),
        bpe.encode_texts(docs, vocabulary_path(), leaf=64),
    ]
    for df in made:
        assert df.columns[: len(docs.columns)] == docs.columns
        for row in df.collect():
            assert [row[c] for c in HELPERS] == [f"{c}{row.doc_id}" for c in HELPERS]


def test_digests_take_tables_with_clashing_columns(spark, docs):
    vectors = docs.selectExpr("doc_id AS vec_id", "array(1f * doc_id, 2f) AS embedding", *HELPERS)
    items = docs.selectExpr("doc_id AS item_id", "text", *HELPERS)
    for df, n in [
        (passages.passage_digest(docs), 4),
        (substrings.repeat_digest(docs), 4),
        (simhash.simhash_groups(docs), 4),
        (whitening.whitening_digest(vectors), 4),
        (search.search(docs, items), 5),
    ]:
        assert df.count() == n
    assert lengths.token_counts(docs, vocabulary_path()).count()
