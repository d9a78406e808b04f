"""Secret scans: fixed key patterns, and sliding-window Shannon entropy over long unbroken strings.

Everything is a Column expression. A null text counts as empty; an empty text
or table has no spans; repeated rows are scanned each for itself; other
columns are left alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interviewflow.llm.names import free_names
from interviewflow.llm.spans import find_spans, in_order, let, listed, masked, no_spans, of_kind, span

# Key words, alphabets and least lengths of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
BASE = ("assign", "access", "hex")


@dataclass(frozen=True)
class CharClass:
    """Strings of one alphabet: an entropy of ``bits`` or more in some window of ``window`` characters is a secret."""

    kind: str
    alphabet: str
    window: int
    bits: float

    @property
    def pattern(self) -> str:
        return f"[{self.alphabet.replace('-', '')}{'-' * ('-' in self.alphabet)}]{{{self.window},}}"


LETTERS = "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharClass("entropy_hex", "0123456789abcdefABCDEF", 20, 3.0),
    CharClass("entropy_base64", "0123456789" + LETTERS + LETTERS.upper() + "+/_=-", 24, 4.0),
)
# Strings that look random to the entropy but are known not to be secrets. A pattern that begins with ^ is the
# shape of a whole string; the others are words, which vouch for the characters around them only.
ALLOW = (
    r"^[A-Za-z]+$",
    r"^[0-9]+$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    # No repeated group: Java matches one by recursion, and a long run would end the task.
    r"^[A-Za-z]+[_/+=-][A-Za-z_/+=-]*$",
    r"(?i)example|sample|placeholder|changeme|xxxx|0{8}|1234567",
)


def window_entropy(candidate: Column, kind: CharClass) -> Column:
    """The hull of the windows with enough entropy: a struct of first and last end, nulls where there is none.

    Counts of the characters in the window change by one entering and one
    leaving character per step, and with them the sum of ``c * log2(c)``.
    """
    size, width = len(kind.alphabet), kind.window
    weight = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(width + 2)])
    letters = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.instr(F.lit(kind.alphabet), c))
    leaving = F.concat(F.array_repeat(F.lit(0), width), letters)
    steps = F.slice(
        F.zip_with(letters, leaving, lambda a, b: F.struct(a.alias("enter"), b.alias("leave"))), F.lit(1), F.size(letters)
    )
    start = F.struct(
        F.array_repeat(F.lit(0), size).alias("counts"),
        F.lit(0.0).alias("total"),
        F.lit(0).alias("at"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )

    def count(counts: Column, place: Column) -> Column:
        return F.when(place > 0, F.get(counts, place - 1)).otherwise(F.lit(0))

    def change(before: Column, by: int) -> Column:
        return F.get(weight, before + by) - F.get(weight, before)

    def moved(counts: Column, place: Column, by: int) -> Column:
        cell = F.array(F.get(counts, place - 1) + by)
        own = F.concat(F.slice(counts, F.lit(1), place - 1), cell, F.slice(counts, place + 1, F.lit(size)))
        return F.when(place > 0, own).otherwise(counts)

    def step(acc: Column, x: Column) -> Column:
        def changed(more: Column) -> Column:
            entered = acc["total"] + change(count(more, x["enter"]) - (x["enter"] > 0).cast("int"), 1)
            left = F.when(x["leave"] > 0, change(count(more, x["leave"]), -1)).otherwise(F.lit(0.0))
            return F.struct(moved(more, x["leave"], -1).alias("counts"), (entered + left).alias("total"))

        def judged(now: Column) -> Column:
            at = acc["at"] + 1
            hot = (at >= width) & (F.lit(math.log2(width)) - now["total"] / width >= kind.bits - 1e-9)
            return F.struct(
                now["counts"].alias("counts"),
                now["total"].alias("total"),
                at.alias("at"),
                F.when(hot, F.coalesce(acc["first"], at - width)).otherwise(acc["first"]).alias("first"),
                F.when(hot, at).otherwise(acc["last"]).alias("last"),
            )

        return let(let(moved(acc["counts"], x["enter"], 1), changed), judged)

    return F.aggregate(steps, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def entropy_spans(text: Column, kind: CharClass, rank: int, allow: tuple[str, ...] = ALLOW) -> Column:
    """Random-looking parts of the long strings of one character class, without allowed ones.

    An allowed word takes out itself and the letters and digits on both sides,
    up to a separator or a window; if another part still is random, the whole
    random part of the string is a secret.
    """

    shapes = [p for p in allow if p.startswith("^")]
    words = [p for p in allow if not p.startswith("^")]

    def unshaped(hit: Column) -> Column:
        known = F.lit(False)
        for pattern in shapes:
            known = known | hit.rlike(pattern)
        return ~known

    def random(piece: Column) -> Column:
        bare = F.regexp_replace(piece, "^[+/_=-]+|[+/_=-]+$", "")
        return unshaped(bare) & window_entropy(piece, kind)["first"].isNotNull()

    def secret(hit: Column) -> Column:
        if not words:
            return F.lit(True)
        # Of a string with allowed words, what stands further from them than a window or a separator must be random.
        near = f"[A-Za-z0-9]{{0,{kind.window}}}"
        vouched = f"{near}(?:{'|'.join(f'(?:{w})' for w in words)}){near}"
        return F.when(hit.rlike("|".join(f"(?:{w})" for w in words)), F.exists(F.split(hit, vouched, -1), random)).otherwise(True)

    found = find_spans(text, kind.pattern, kind.kind, rank, unshaped)
    hulls = F.transform(
        found, lambda s: F.struct(s["start"].alias("at"), s["hit"].alias("hit"), window_entropy(s["hit"], kind).alias("hull"))
    )
    hot = F.filter(hulls, lambda s: s["hull"]["first"].isNotNull() & secret(s["hit"]))
    placed = F.transform(
        hot,
        lambda s: span(
            s["at"] + s["hull"]["first"],
            s["at"] + s["hull"]["last"],
            kind.kind,
            rank,
            F.substring(s["hit"], s["hull"]["first"] + 1, s["hull"]["last"] - s["hull"]["first"]),
        ),
    )
    return F.when(text.rlike(kind.pattern), placed).otherwise(no_spans())


def secret_spans(text: Column, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> Column:
    """All spans of a text in order, base kinds and entropy kinds."""
    whole = F.coalesce(text, F.lit(""))
    lists = [
        find_spans(whole, ASSIGN, "assign", 0, lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_LEAST),
        find_spans(whole, ACCESS, "access", 1),
        find_spans(whole, HEX, "hex", 2),
    ]
    return in_order(*lists, *[entropy_spans(whole, c, 3 + i, allow) for i, c in enumerate(classes)])


def scan_secrets(docs: DataFrame, text: str = "text", into: str = "secrets", **options) -> DataFrame:
    """``docs`` with a column of spans; a column of that name is replaced."""
    return docs.withColumn(into, secret_spans(F.col(text), **options))


def redact_secrets(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """Each secret replaced by ``[SECRET]``; texts without secrets, nulls too, stay as they are."""
    (spans,) = free_names(docs.columns, "__secrets")
    found = scan_secrets(docs, text, spans, **options)
    clean = masked(F.col(text), F.col(spans), lambda kind: F.lit("[SECRET]"))
    return found.withColumn(text, clean).drop(spans)


def secret_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts and places of what was found."""
    found = scan_secrets(docs.select("doc_id", "text"), into="__spans").select("doc_id", "__spans")
    counts = [F.size(of_kind(F.col("__spans"), [k])).cast("bigint").alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(listed(of_kind(F.col("__spans"), BASE)), 256).alias("base_sha256"),
        listed(F.col("__spans")).alias("spans"),
    )
