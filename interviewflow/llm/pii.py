"""Personal data: patterns propose spans, checksums confirm them, words nearby move their score.

Everything is a Column expression. A null text counts as empty; an empty text
or table has no spans; repeated rows are scanned each for itself; other
columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interviewflow.llm.names import free_names
from interviewflow.llm.spans import find_spans, in_order, listed, masked, no_spans, of_kind, with_parts

# The base kinds. A run is entered at its first character or where
# the last match ended, and taken without giving back, so long runs cost one pass.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
BASE = ("email", "ip", "card", "phone")

# Kinds of the method: country-prefixed account numbers with a mod-97 check, and national numbers by context.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 "
    "FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 "
    "LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 "
    "ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)


def iban_pattern(lengths: str = IBAN_LENGTHS) -> str:
    """Account numbers of the length of their country, so that capitals and digits behind one are no part of it."""
    by_length: dict[int, list[str]] = {}
    for cell in lengths.split():
        by_length.setdefault(int(cell[2:]), []).append(cell[:2])
    kinds = [f"(?:{'|'.join(c)})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items())]
    return rf"\b(?:{'|'.join(kinds)})\b"


IBAN = iban_pattern()
# How all of them begin: few texts have it, and only those are searched.
IBAN_START = r"\b[A-Z]{2}[0-9]{2}[\x20A-Z0-9]"
NATIONAL = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
# Start score, the words nearby that raise it and those that lower it.
SCORES = {
    "iban": (0.6, r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b", r"(?i)\b(?:serial|version|part no|sku)\b"),
    "national": (0.4, r"(?i)\b(?:ssn|social security|tax id|national id)\b", r"(?i)\b(?:serial|version|order|sku)\b"),
}
LEAST_SCORE = 0.5
STEP = 0.3
NEAR = 40


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes Luhn's check."""
    cells = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(cells, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + d) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether a country-prefixed account number leaves 1 on division by 97."""
    plain = F.regexp_replace(account, r"\x20", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    values = F.transform(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1,
    )
    rest = F.aggregate(values, F.lit(0), lambda r, v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97)
    return rest == 1


def scored(text: Column, spans: Column, kind: str) -> Column:
    """Spans whose start score, moved by the words within ``NEAR`` characters, reaches ``LEAST_SCORE``."""
    base, raises, lowers = SCORES[kind]

    def score(part, s: Column) -> Column:
        begin = F.greatest(s["start"] - NEAR, F.lit(0))
        around = F.concat_ws(" ", part(begin, s["start"] - begin), part(s["end"], F.lit(NEAR)))
        up = F.when(around.rlike(raises), STEP).otherwise(0.0)
        return F.lit(base) + up - F.when(around.rlike(lowers), STEP).otherwise(0.0)

    return with_parts(text, lambda part: F.filter(spans, lambda s: score(part, s) >= LEAST_SCORE))


def pii_spans(text: Column) -> Column:
    """All spans of a text in order, base kinds and the method's."""
    whole = F.coalesce(text, F.lit(""))
    card = lambda hit: F.length(digits(hit)).between(12, 19) & luhn(digits(hit))
    phone = lambda hit: F.length(digits(hit)).between(9, 15)
    iban = find_spans(whole, IBAN, "iban", 4, mod97)
    national = find_spans(whole, NATIONAL, "national", 5)
    return in_order(
        F.when(whole.contains("@"), find_spans(whole, EMAIL, "email", 0)).otherwise(no_spans()),
        find_spans(whole, IP, "ip", 1, lambda hit: hit.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")),
        find_spans(whole, CARD, "card", 2, card),
        F.when(whole.contains("+"), find_spans(whole, PHONE, "phone", 3, phone)).otherwise(no_spans()),
        F.when(whole.rlike(IBAN_START), scored(whole, iban, "iban")).otherwise(no_spans()),
        F.when(whole.rlike(NATIONAL), scored(whole, national, "national")).otherwise(no_spans()),
    )


def scan_pii(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with a column of spans; a column of that name is replaced."""
    return docs.withColumn(into, pii_spans(F.col(text)))


def redact_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each span replaced by its kind in brackets; texts without spans, nulls too, stay as they are."""
    (spans,) = free_names(docs.columns, "__pii")
    found = scan_pii(docs, text, spans)
    clean = masked(F.col(text), F.col(spans), lambda kind: F.concat(F.lit("["), F.upper(kind), F.lit("]")))
    return found.withColumn(text, clean).drop(spans)


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts and places of what was found."""
    found = scan_pii(docs.select("doc_id", "text"), into="__spans").select("doc_id", "__spans")
    counts = [F.size(of_kind(F.col("__spans"), [k])).cast("bigint").alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(listed(of_kind(F.col("__spans"), BASE)), 256).alias("base_sha256"),
        listed(F.col("__spans")).alias("spans"),
    )
