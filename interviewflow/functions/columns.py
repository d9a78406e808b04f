"""Choosing columns by name. Only schemas are read; no job runs."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from interviewflow.defaults import CANDIDATE_PREFIXES, ID_NAME_PARTS, ID_NAMES, SELECTION_PATTERNS


def require_columns(df: DataFrame, names: Iterable[str], source: str = "table") -> DataFrame:
    """``df`` itself, or a ``ValueError`` that lists the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{source} lacks {missing}; it has {df.columns}")
    return df


def resolve_column(
    columns: Sequence[str],
    candidates: Sequence[str] = ID_NAMES,
    parts: Sequence[Sequence[str]] = ID_NAME_PARTS,
    chosen: str | None = None,
) -> str:
    """The user's choice, else the first known name, else the first name holding all parts."""
    if chosen is not None:
        if chosen not in columns:
            raise ValueError(f"no column {chosen!r} among {list(columns)}")
        return chosen
    known = next((c for c in candidates if c in columns), None)
    if known is not None:
        return known
    for column in columns:
        if any(all(p in column.lower() for p in group) for group in parts):
            return column
    raise ValueError(f"none of {list(candidates)} among {list(columns)}")


def find_columns(columns: Sequence[str], patterns: Sequence[str] = SELECTION_PATTERNS, mode: str = "first") -> list[str]:
    """Columns matching a pattern from their start, ignoring case.

    ``first`` stops at the first pattern with a match; ``all`` keeps the union.
    """
    found: list[str] = []
    for pattern in patterns:
        hits = [c for c in columns if re.match(pattern, c, re.IGNORECASE) and c not in found]
        found += hits
        if hits and mode == "first":
            break
    if not found:
        raise ValueError(f"no column of {list(columns)} matches {list(patterns)}")
    return found


def candidate_columns(columns: Sequence[str], prefixes: Sequence[str] = CANDIDATE_PREFIXES) -> dict[int, str]:
    """Number -> column for the numbered candidate columns, by rising number.

    When two spellings carry one number, the earlier prefix wins. A number
    written with leading zeros is no candidate, as no pick can name it.
    """
    named: dict[int, str] = {}
    for prefix in prefixes:
        shape = re.compile(re.escape(prefix) + r"(0|[1-9][0-9]*)", re.IGNORECASE)
        for column in columns:
            hit = shape.fullmatch(column)
            if hit:
                named.setdefault(int(hit.group(1)), column)
    if not named:
        raise ValueError(f"no numbered candidate column among {list(columns)}")
    return dict(sorted(named.items()))
