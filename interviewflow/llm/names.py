"""Names for helper columns that no column of the user has."""

from __future__ import annotations

from collections.abc import Iterable


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with underscores in front until no taken column and no other of them has it, in any case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out
