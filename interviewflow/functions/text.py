"""Text expressions. All of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from interviewflow.defaults import NULL_TOKENS, PREVIEW_MARK, PREVIEW_SIZES, WHITESPACE, WHITESPACE_CLASS

# A token is a run of these, or one other character that is no plain white space.
WORD_PATTERN = r"[\p{L}\p{N}_]+"
_SPACES = tuple(c.encode() for c in WHITESPACE)


def null_tokens(col: Column, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    """Null where the whole cell is one of the missing-value tokens."""
    return F.when(~col.isin(*tokens), col)


def strip_ws(col: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def strip_bytes(text: bytes) -> bytes:
    """``strip_ws`` of a text in UTF-8, in a worker."""
    start, end = 0, len(text)
    while text.startswith(_SPACES, start, end):
        start += next(len(s) for s in _SPACES if text.startswith(s, start, end))
    while text.endswith(_SPACES, start, end):
        end -= next(len(s) for s in _SPACES if text.endswith(s, start, end))
    return text[start:end]


def collapse_ws(col: Column) -> Column:
    """Stripped, and each inner run of white space made one space."""
    return F.regexp_replace(strip_ws(col), WHITESPACE_CLASS + "+", " ")


def clean_rationale(col: Column, all_lines: bool = False) -> Column:
    """Text without bold marks and without the stated diagnosis.

    The label is removed from the last line only, or from every line with
    ``all_lines``. A missing text becomes the empty text.
    """
    flags = "(?iudm)" if all_lines else "(?iud)"
    plain = F.replace(F.coalesce(col, F.lit("")), F.lit("**"), F.lit(""))
    return strip_ws(F.regexp_replace(plain, flags + r"Diagnosis:[^\n]*$", ""))


def inject_after(col: Column, marker: str, text: str) -> Column:
    """``text`` on a new line behind the first ``marker``; unchanged without one."""
    at = F.locate(marker, col)
    end = at + F.lit(len(marker))
    return F.when(
        at > 0,
        F.concat(F.substring(col, F.lit(1), end - 1), F.lit("\n" + text), F.substring(col, end, F.length(col))),
    ).otherwise(col)


def prompt_preview(
    col: Column,
    limit: int = PREVIEW_SIZES[0],
    head: int = PREVIEW_SIZES[1],
    tail: int = PREVIEW_SIZES[2],
    mark: str = PREVIEW_MARK,
) -> Column:
    """Short texts whole; longer ones as head, mark and tail (which may overlap)."""
    return F.when(F.length(col) <= limit, col).otherwise(
        F.concat(F.left(col, F.lit(head)), F.lit(mark), F.right(col, F.lit(tail)))
    )


def token_count(col: Column, tokenizer: Callable[[], Callable[[str], list]] | None = None) -> Column:
    """Tokens per text, 0 for null.

    Without a tokenizer, words and single punctuation marks are counted in the
    JVM. ``tokenizer`` is a factory of an ``encode(text)`` function; it is
    called once per Python worker and batch stream, not once per row.
    """
    if tokenizer is None:
        # Each word shrunk to one letter, white space dropped: what is left has
        # one character per token. Cheaper than listing all matches.
        left = F.translate(F.regexp_replace(col, WORD_PATTERN, "w"), " \t\n\r\f", "")
        return F.coalesce(F.length(left), F.lit(0))

    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tokenizer()
        for batch in batches:
            yield batch.map(lambda s: 0 if s is None else len(encode(s))).astype("int32")

    return count(col)
