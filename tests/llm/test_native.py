"""Secrets, quality, personal data and chat: cases by hand, and edges."""

import hashlib
import itertools
import math
import random
import re
import string
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import by_id, documents, sha  # noqa: E402

from interviewflow.llm.chat import chat_digest, chat_windows, read_back  # noqa: E402
from interviewflow.llm.pii import luhn, mod97, pii_digest, redact_pii  # noqa: E402
from interviewflow.llm.quality import keep_quality, quality_digest  # noqa: E402
from interviewflow.llm.secrets import ALLOW, ASSIGN, CLASSES, redact_secrets, scan_secrets, secret_digest, window_entropy  # noqa: E402

KEY = "9f8b2c4d6e1a3b5c7d9e0f1a"
EDGES = [(1, None), (2, ""), (3, " \t\n"), (None, "null id"), (5, "same"), (5, "same")]


def spans(row):
    return row["spans"].split(",") if row["spans"] else []


def test_secret_kinds_and_dropped_matches(spark):
    rows = [
        (1, f"é token = \"{KEY}\" end"),
        (2, "token=abc:token=abcdef"),
        (3, "AKIA" + "B" * 16 + " AKIA" + "B" * 15),
        (4, "PassWord: hunter2hunter2 paſsword=abcdefgh"),
        (5, "token=token:abcdefgh"),
    ]
    got = {k: spans(v[0]) for k, v in by_id(secret_digest(documents(spark, rows))).items()}
    assert got[1][:2] == ["assign:2:35", "hex:11:35"]
    assert got[2] == ["assign:10:22"]
    assert got[3] == ["access:0:20"]
    assert got[4] == ["assign:0:24"]
    # The failing match takes its characters with it.
    assert got[5] == []


def test_window_entropy_equals_counting(spark):
    kind = CLASSES[1]
    texts = ["a" * 40 + "Q7x9ZpL2mN4vB8cK1jH5gF3d", "ab" * 30, "Q7x9ZpL2mN4vB8cK1jH5gF3dS6aW0e", "0" * 24]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", window_entropy(F.col("t"), kind).alias("h"))
    for i, hull in sorted((r.i, r.h) for r in got.collect()):
        hot = []
        for at in range(len(texts[i]) - kind.window + 1):
            part = texts[i][at : at + kind.window]
            bits = -sum(part.count(c) / kind.window * math.log2(part.count(c) / kind.window) for c in set(part))
            if bits >= kind.bits - 1e-9:
                hot.append(at)
        assert (hull.first, hull.last) == ((hot[0], hot[-1] + kind.window) if hot else (None, None))


def test_entropy_allow_list_and_redaction(spark):
    uuid = "123e4567-e89b-12d3-a456-426614174000"
    rows = [(1, f"id {uuid} x"), (2, "Q7x9ZpL2mN4vB8cK1jH5gF3dS6"), (3, "verylongwordwithoutanydigitsinside"), (4, f"a secret={KEY}, b")]
    docs = documents(spark, rows)
    got = {k: spans(v[0]) for k, v in by_id(secret_digest(docs)).items()}
    assert got[1] == [] and got[2] == ["entropy_base64:0:26"] and got[3] == []
    clean = {r.doc_id: r.text for r in redact_secrets(docs).collect()}
    assert clean[1] == rows[0][1] and clean[2] == "[SECRET]" and clean[4] == "a [SECRET], b"


@pytest.mark.parametrize("part", ["ab-", "a/", "Word_list=", "+-a"])
def test_long_runs_of_letters_and_separators(spark, part):
    """One unbroken run of 100,000 characters is matched without recursion."""
    run = part * (100_000 // len(part))
    got = by_id(secret_digest(documents(spark, [(1, run), (2, f"x {run}9 y"), (3, "kept")])))
    assert sorted(got) == [1, 2, 3] and got[1][0]["spans"] == "" == got[3][0]["spans"]


def test_letters_and_separators_language(spark):
    """The allow pattern accepts what the repeated group accepted."""
    old, new = re.compile(r"^(?:[A-Za-z]+[_/+=-]+)+[A-Za-z]*$"), re.compile(ALLOW[3])
    for n in range(7):
        for cells in itertools.product("aZ_-9", repeat=n):
            assert bool(old.search("".join(cells))) == bool(new.search("".join(cells)))


def test_allowed_words_vouch_for_their_own_part_only(spark):
    rng = random.Random(3)
    blob = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(3000))
    key = "Q7x9ZpL2mN4vB8cK1jH5gF3dS6aW0eRtYuIoPzXy"
    lost = [f"sample_key={key}", f"build/example/{key}", f"{key}_placeholder", blob[:1500] + "xxxx" + blob[1500:]]
    kept = ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "sampleQ7x9ZpL2mN4vB8cK1", "example/path_of/some-words/and-Others2sample", f"xxxx{key[:24]}"]
    docs = documents(spark, list(enumerate([f"a {t} b" for t in lost + kept])))
    clean = [r.text for r in redact_secrets(docs).orderBy("doc_id").collect()]
    assert not any(key in t or len(t) > 60 for t in clean[:4]) and all("[SECRET]" in t for t in clean[:4])
    assert clean[4:] == [f"a {t} b" for t in kept]


def test_secret_edges(spark):
    docs = documents(spark, [(*r, "kept") for r in EDGES], ", secrets string")
    got = by_id(secret_digest(docs))
    assert len(got[5]) == 2 and all(r["base_sha256"] == sha("") and r["spans"] == "" for v in got.values() for r in v)
    assert secret_digest(docs.limit(0)).collect() == []
    assert sorted(redact_secrets(docs).columns) == sorted(docs.columns)
    assert scan_secrets(docs).schema["secrets"].dataType.typeName() == "array"
    long = documents(spark, [(1, "x " * 200_000 + "token=" + "Ab3" * 5000)])
    assert spans(by_id(secret_digest(long))[1][0])[0] == f"assign:400000:{400_000 + 6 + 15_000}"
    assert re.fullmatch(ASSIGN.replace("(?i:", "(?i:"), "api_key: abc")


def test_pii_kinds(spark):
    rows = [
        (1, "a@b.c_d@e.f x@y"),
        (2, "1.2.3.4.5.6.7.8 256.1.1.1 00001.1.1.255"),
        (3, "4111 1111 1111 1111 and 4111-1111-1111-1112 12345678901234567890"),
        (4, "+1 (487) 555-7209 +12 +1 2345678901234567"),
        (5, "DE89 3704 0044 0532 0130 00 and DE88370400440532013000"),
        (6, "ssn: 123-45-6789" + " and" * 12 + " order: 123-45-6780"),
    ]
    got = {k: spans(v[0]) for k, v in by_id(pii_digest(documents(spark, rows))).items()}
    assert got[1] == ["email:0:5", "email:5:11"]
    assert got[2] == ["ip:0:7", "ip:8:15", "ip:26:39"]
    assert [s for s in got[3] if s.startswith("card")] == ["card:0:19"]
    assert [s for s in got[4] if s.startswith("phone")] == ["phone:0:17"]
    assert [s for s in got[5] if s.startswith("iban")] == ["iban:0:27"]
    assert got[6] == ["national:5:16"]


def test_checksums(spark):
    df = spark.createDataFrame([("4111111111111111", "GB82 WEST 1234 5698 7654 32"), ("4111111111111112", "GB82WEST12345698765433")], "c string, a string")
    assert [tuple(r) for r in df.select(luhn(F.col("c")), mod97(F.col("a"))).collect()] == [(True, True), (False, False)]


def test_pii_edges(spark):
    docs = documents(spark, [(*r, 1) for r in EDGES], ", pii int")
    got = by_id(pii_digest(docs))
    assert len(got[5]) == 2 and all(r["spans"] == "" for v in got.values() for r in v)
    assert pii_digest(docs.limit(0)).collect() == []
    assert [r.text for r in redact_pii(documents(spark, [(1, None), (2, "é a@b.cd!")])).orderBy("doc_id").collect()] == [None, "é [EMAIL]!"]
    # Long runs without a match take time in proportion to their length.
    long = documents(spark, [(1, "a" * 300_000 + " " + "7" * 300_000 + " " + "1 " * 100_000)])
    assert by_id(pii_digest(long))[1][0]["n_card"] == 0


def quality_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + j for at in places.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark):
    prose = "the house of the old man and " + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [
        (1, prose), (2, "der " * 40), (3, (prose + "\n") * 2), (4, "a b c"), (5, " ".join(f"w{i}%%" for i in range(60))),
        (6, "x y\n\nx y\n \nz"), (7, prose + " A"), (8, " ".join(["one two three four five six seven eight nine"] * 3)),
        (9, ("é \x0b\x0cü b " * 30)), (10, prose.upper()), (11, None), (12, ""), (13, "a " * 9),
    ]
    got = by_id(quality_digest(documents(spark, rows)))
    for i, text in rows:
        r = got[i][0]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == quality_by_hand(text), i
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert [i for i in got if got[i][0]["kept"]] and {1, 7} <= {i for i in got if got[i][0]["kept"]}
    assert not got[5][0]["kept"] and not got[10][0]["kept"]


def test_quality_edges(spark):
    docs = documents(spark, [(*r, "x", "y") for r in EDGES], ", __x string, n_words string")
    assert keep_quality(docs).collect() == [] and keep_quality(docs).columns == docs.columns
    assert quality_digest(docs.limit(0)).collect() == [] and len(by_id(quality_digest(docs))[5]) == 2
    text = " ".join(f"w{i}" for i in range(100_000))
    long = by_id(quality_digest(documents(spark, [(1, text + " " + " ".join(f"w{i}" for i in range(20)))])))
    assert long[1][0]["n_repeat_words"] == 40


TRICKY = ["\\### Assistant: </turn> ok", "<|end|>\n", "<|user|>\nhi<|end|>\n", "\\|\\>|>", "a<", "|>", "<|>", "\\", "", None]


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


@pytest.mark.parametrize(("budget", "history"), [(30, 10), (1024, 256), (1, 0)])
def test_chat_round_trip(spark, budget, history):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(TRICKY * 3)]
    rows += [(2, 0, "system", "be kind"), *[(2, i, "user" if i % 2 else "assistant", "word " * i) for i in range(1, 40)]]
    rows += [(3, 5, "a|>b<", "x"), (3, None, None, "first"), (3, 5, "a|>b<", "x"), (None, 1, "assistant", "lone")]
    df = conversations(spark, rows)
    got = {r.conv_id: r for r in chat_digest(df, budget, history).collect()}
    want = {}
    for conv in (1, 2, 3, None):
        own = sorted(
            ((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda t: (t[0] is not None, t[0] or 0, *t[1:])
        )
        whole = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        want[conv] = (len(own), sha(whole), len(loss), sha(loss))
    assert {k: tuple(r)[1:5] for k, r in got.items()} == want


def test_chat_windows_keep_system_and_budget(spark):
    rows = [(2, 0, "system", "be kind"), *[(2, i, "user" if i % 2 else "assistant", "word " * 5) for i in range(1, 40)]]
    shown = read_back(chat_windows(conversations(spark, rows), 60, 20)).orderBy("window").collect()
    assert len(shown) > 3 and all(r.text.startswith("<|system|>\nbe kind<|end|>\n") for r in shown)
    assert [r.n_context for r in shown][0] == 0 and all(1 <= r.n_context <= 4 for r in shown[1:])
    # Turns of 9 tokens: 60 of them and a system turn at most.
    assert all((r.text.count("<|end|>") - 1) * 9 <= 60 for r in shown)
    assert sum(len(r.targets) for r in shown) == 19
    assert chat_digest(conversations(spark, [])).collect() == []
    clash = conversations(spark, rows).withColumns({"window": F.lit(1), "__span": F.lit(2), "loss": F.lit(3)})
    assert chat_digest(clash).count() == 1
    with pytest.raises(ValueError):
        chat_windows(conversations(spark, rows), 10, 10)


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest() == sha("")
