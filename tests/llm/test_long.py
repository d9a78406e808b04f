"""Very long texts, planted secrets against the SQL twin, account numbers, and answers for any context limit."""

import random
import string
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from interviewflow.llm import lengths, pii, queries, secrets, spans, tiling
from interviewflow.llm.queries import ORACLES, vocabulary_path


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id bigint, text string")


def test_running_sums(spark):
    for n in (0, 1, 2, 3, 10, 50):
        cells = [random.Random(n + i).randrange(9) for i in range(n)]
        array = F.array(*[F.lit(c) for c in cells]).cast("array<int>")
        row = spark.range(1).select(spans.running(array, 0, lambda x, y: x + y).alias("s"), spans.running(array, 0, F.greatest).alias("m")).first()
        assert row.s == [sum(cells[: i + 1]) for i in range(n)] and row.m == [max(cells[: i + 1]) for i in range(n)]


def test_a_megabyte_of_addresses(spark):
    text = " ".join(f"ü{i}@ex.org" for i in range(60_000))
    start = time.time()
    found = pii.pii_digest(one(spark, text)).first()
    masked = pii.redact_pii(one(spark, text)).first().text
    # Growing arrays took time with the square: 44 s for a third of it.
    assert time.time() - start < 60
    assert found.n_email == 60_000 and found.spans.startswith("email:1:9,") and masked == " ".join(["ü[EMAIL]"] * 60_000)


def test_a_long_random_run(spark):
    rng = random.Random(2)
    text = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(100_000))
    start = time.time()
    found = secrets.secret_digest(one(spark, f"x {text} y")).first().spans
    assert found.startswith("entropy_base64:") and time.time() - start < 60


def test_repeated_words_take_no_product_of_places():
    items = tiling.Items([("a", "the " * 2000), ("b", "the cat " * 300)], 5)
    start = time.time()
    assert items.contained("the " * 330_000, 0.5) == [(0, 2000, 1)]
    assert items.contained("the cat " * 5000, 0.5) == [(1, 600, 1)] and time.time() - start < 20


@pytest.mark.parametrize(
    "text,n",
    [
        ("IBAN DE89370400440532013000 ABC", 1),
        ("account GB82WEST12345698765432 7 times", 1),
        ("iban DE89 3704 0044 0532 0130 00 AB", 1),
        ("iban DE88370400440532013000", 0),
        ("iban NO9386011117947.", 1),
        ("iban DE893704004405320130001", 0),
        ("iban ZZ8937040044053201300", 0),
    ],
)
def test_account_numbers_end_with_their_country(spark, text, n):
    assert pii.pii_digest(one(spark, text)).first().spans.count("iban:") == n


def test_secrets_and_pii_equal_their_sql_on_planted_texts(spark, tmp_path):
    rng = random.Random(7)
    key = lambda n=40: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    texts = [
        f"sample_key={key()}", f"build/example/{key()}", "example-" + "ab-" * 30, f"{key(20)}xxxx{key(60)}", f"{key(10)}sample{key(10)}",
        f"password: {key(8)} token={key(5)}", "0123456789abcdef" * 3, f"AKIA{'A1' * 9}", "a" * 60, "00000000" + key(30), key(300),
        "IBAN DE89370400440532013000 ABC, mail a.b@c.de, 10.0.0.1 and 4111 1111 1111 1111", "ssn 123-45-6789", None, "",
        "version 3 DE89370400440532013000 serial", f"{key(24)}/changeme/{key(24)}", "f47ac10b-58cc-4372-a567-0e02b2c3d479",
    ]
    rows = [(i, t) for i, t in enumerate(texts * 3)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op1_secrets", "op8_pii"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        want = db.execute(ORACLES[name])
        assert got.columns == [c[0] for c in want.description]
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    found = {r.doc_id: r.spans for r in queries.QUERIES["op1_secrets"](spark, str(tmp_path)).collect()}
    assert "entropy" in found[0] and "entropy" in found[1] and found[2] == ""


def test_answers_for_limits_and_quantiles(spark):
    sizes = [0, 1, 1, 3, 7, 7, 7, 600, 2000]
    docs = spark.createDataFrame([(" a" * n,) for n in sizes] + [(None,)], "text string")
    table = lengths.token_counts(docs, vocabulary_path())
    own = sorted([0, *sizes])
    got = lengths.token_answers(table, limits=[2, 7, 512, 4096], quantiles=[0.5, 1.0]).collect()
    for r in got:
        within = [n for n in own if n <= r.length]
        kept = sum(min(n, r.length) for n in own)
        assert (r.n_docs, r.n_within, r.n_longer) == (own.count(r.length), len(within), len(own) - len(within))
        assert (r.total_tokens, r.truncated_tokens, r.lost_tokens) == (sum(own), kept, sum(own) - kept)
    assert sorted(r.length for r in got if r.kind == "length") == sorted(set(own))
    assert sorted(r.length for r in got if r.kind == "limit") == [2, 7, 512, 4096]
    assert {r.quantile: r.length for r in got if r.kind == "quantile"} == {0.5: 3, 1.0: 2000}
    empty = lengths.token_answers(lengths.token_counts(docs.limit(0), vocabulary_path()), limits=[4]).collect()
    assert [(r.kind, r.n_within, r.truncated_tokens) for r in empty] == [("limit", 0, 0)]
