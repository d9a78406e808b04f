"""Prompts from templates whose placeholders are written ``{{name}}``."""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from interviewflow.defaults import BLOCK_MARKS, NO_PROMPT_COLUMN, NO_PROMPT_VALUE, USER_TURN

_PLACEHOLDER = re.compile(r"\{\{\s*(\w+)\s*\}\}")


def placeholders(body: str) -> list[str]:
    """Names a template needs, each once, in order of appearance."""
    return list(dict.fromkeys(_PLACEHOLDER.findall(body)))


def choose_template(templates: Mapping[str, str], name: str, default: str = "main") -> tuple[str, str]:
    """(name, body) of the named template, or of the default for an unknown name."""
    chosen = name if name in templates else default
    return chosen, templates[chosen]


def _require(body: str, values, template: str) -> None:
    absent = [n for n in placeholders(body) if n not in values]
    if absent:
        raise ValueError(f"template {template!r} needs {absent}")


def render(
    body: str,
    values: Mapping[str, Column],
    template: str = "template",
    non_empty: Sequence[str] = ("gender",),
) -> Column:
    """One concatenation of literals and columns, so inserted text is never expanded again.

    A null value (or an empty one, for names in ``non_empty``) is an error
    that names the placeholder and the template.
    """
    _require(body, values, template)
    pieces: list[Column] = []
    for i, piece in enumerate(_PLACEHOLDER.split(body)):
        if i % 2 == 0:
            if piece:
                pieces.append(F.lit(piece))
            continue
        value = values[piece].cast("string")
        if piece in non_empty:
            value = F.nullif(value, F.lit(""))
        problem = F.raise_error(F.lit(f"template '{template}' got no value for '{piece}'")).cast("string")
        pieces.append(F.coalesce(value, problem))
    return F.concat(*pieces) if pieces else F.lit("")


def render_around(
    body: str,
    left_out: Collection[str],
    values: Mapping[str, Column],
    template: str = "template",
    non_empty: Sequence[str] = ("gender",),
) -> tuple[list[Column], list[str]]:
    """``render`` cut at the placeholders ``left_out``: the texts around them, one more than they are, and their names in order."""
    _require(body, {*values, *left_out}, template)
    parts, names = [""], []
    for i, piece in enumerate(_PLACEHOLDER.split(body)):
        if i % 2 and piece in left_out:
            names.append(piece)
            parts.append("")
        else:
            parts[-1] += "{{" + piece + "}}" if i % 2 else piece
    return [render(part, values, template, non_empty) for part in parts], names


def messages(prompt: Column, system_role: str = "developer", user_text: str = USER_TURN) -> Column:
    """Chat turns: the prompt under the system role, then the fixed user turn."""
    turn = [
        F.struct(F.lit(system_role).alias("role"), prompt.alias("content")),
        F.struct(F.lit("user").alias("role"), F.lit(user_text).alias("content")),
    ]
    return F.array(*turn)


def numbered_blocks(texts: Sequence[Column]) -> Column:
    """All texts as blocks headed 1..n; a missing text leaves an empty block."""
    before, behind = BLOCK_MARKS.split("{text}")
    blocks = [
        F.concat(F.lit(before.replace("{number}", str(i))), F.coalesce(text, F.lit("")), F.lit(behind))
        for i, text in enumerate(texts, start=1)
    ]
    return F.concat_ws("\n", *blocks)


def selection_prompt(texts: Sequence[Column], prompt: Column | None, k: int, body: str) -> Column:
    """Request to pick ``k`` of the texts; ``body`` takes prompt, candidates, n and k."""
    asked = F.lit(NO_PROMPT_COLUMN) if prompt is None else F.coalesce(prompt, F.lit(NO_PROMPT_VALUE))
    values = {"prompt": asked, "candidates": numbered_blocks(texts), "n": F.lit(len(texts)), "k": F.lit(k)}
    return render(body, values, template="selection", non_empty=())
