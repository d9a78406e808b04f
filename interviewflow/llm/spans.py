"""Spans of regular expressions as Column expressions: every match with its place in code points."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points beyond which a text is cut into blocks before pieces of it are taken.
LONG = 1 << 16
BLOCK = 1 << 12
SPAN = "struct<start:int,rank:int,end:int,kind:string,hit:string>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def span(start: Column, end: Column, kind: str, rank: int, hit: Column) -> Column:
    cells = (start.cast("int"), F.lit(rank), end.cast("int"), F.lit(kind), hit)
    return F.struct(*[c.alias(n) for c, n in zip(cells, ("start", "rank", "end", "kind", "hit"), strict=True)])


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, also where ``then`` uses it inside functions of its own."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(cells: Column, first: int, add: Callable[[Column, Column], Column]) -> Column:
    """Sums (or what ``add`` makes) of all cells up to each, for an array of whole numbers.

    An array that grows by one cell is copied at each step, so cells are summed
    in blocks of about the square root of their number, then the blocks.
    """

    def within(block: Column, start: Column) -> Column:
        begin = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))

        def step(acc: Column, cell: Column) -> Column:
            now = add(acc["at"], cell).cast("int")
            return F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out"))

        return F.aggregate(block, begin, step, lambda acc: acc["out"])

    def by_block(own: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(own))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / width).cast("int")), lambda k: F.slice(own, k * width + 1, width))
        return let(parts, joined)

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(first), lambda x, y: add(x, y).cast("int")))
        upto = let(totals, lambda t: within(t, F.lit(first)))
        starts = F.concat(F.array(F.lit(first)), F.slice(upto, 1, F.size(blocks) - 1))
        return F.flatten(F.zip_with(blocks, starts, within))

    return let(cells, lambda own: F.when(F.size(own) == 0, F.array().cast("array<int>")).otherwise(by_block(own)))


def find_spans(
    text: Column, pattern: str, kind: str, rank: int, keep: Callable[[Column], Column] | None = None
) -> Column:
    """Leftmost non-overlapping matches of ``pattern``, then those whose text passes ``keep``.

    The text between the matches and the matches themselves alternate, so a
    match ends where the lengths up to it do. The pattern must not match
    the empty text. Texts without a match are scanned once only.
    """

    def placed(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        ends = running(F.zip_with(gaps, matches, lambda gap, hit: F.length(gap) + F.length(hit)), 0, lambda x, y: x + y)
        return F.zip_with(ends, matches, lambda end, hit: span(end - F.length(hit), end, kind, rank, hit))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    if keep is not None:
        found = F.filter(found, lambda s: keep(s["hit"]))
    return F.when(text.rlike(pattern), found).otherwise(no_spans())


def with_parts(text: Column, then: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """``then(part)`` where ``part(start, length)`` is a piece of ``text``.

    A substring is found by walking from the start, so a long text is cut into
    blocks once and a piece is taken from its own.
    """
    long = F.length(text) > LONG
    blocks = F.when(long, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).otherwise(F.array(text))
    width = F.when(long, BLOCK).otherwise(2**31 - 1)

    def made(cut: Column) -> Column:
        def part(start: Column, length: Column) -> Column:
            first = F.floor(start / cut["width"]).cast("int")
            last = F.floor((start + F.greatest(length, F.lit(1)) - 1) / cut["width"]).cast("int")
            own = F.array_join(F.slice(cut["blocks"], first + 1, last - first + 1), "")
            return F.substring(own, start - first * cut["width"] + 1, length)

        return then(part)

    return let(F.struct(blocks.alias("blocks"), width.alias("width")), made)


def in_order(*lists: Column) -> Column:
    """All spans by start, then by the order of their kinds."""
    return F.array_sort(F.concat(*lists))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    cells = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(cells, ",")


def of_kind(spans: Column, kinds: Sequence[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def masked(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """``text`` with each maximal run of overlapping spans replaced by ``mark`` of its first span's kind.

    ``spans`` is in the order of ``in_order``.
    """

    def cleaned(part: Callable[[Column, Column], Column], own: Column, ends: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(own) - 1))
        met = F.zip_with(own, before, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), s["kind"].alias("kind")))
        fresh = F.filter(met, lambda m: m["start"] >= m["at"])
        pieces = F.transform(fresh, lambda m: F.concat(part(m["at"], m["start"] - m["at"]), mark(m["kind"])))
        last = F.element_at(ends, -1)
        return F.concat(F.array_join(pieces, ""), part(last, F.length(text) - last))

    def replaced(own: Column) -> Column:
        ends = running(F.transform(own, lambda s: s["end"]), 0, F.greatest)
        return let(ends, lambda e: with_parts(text, lambda part: cleaned(part, own, e)))

    return let(spans, lambda own: F.when(F.size(own) == 0, text).otherwise(replaced(own)))
