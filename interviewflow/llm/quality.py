"""Quality rules: a table of thresholds compiled into one projection over the words and lines of a text.

Everything is a Column expression; no row leaves its task. A null or empty
text has no words and fails. Repeated rows are judged each for itself; other
columns are left alone.

The rule on stop words knows English, French, German and Spanish and ignores a
language column: a clean text of 50 words or more in another language fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 8

# Frequent function words of the languages served.
STOP_WORDS = (
    "the be to of and that have with a in is it for was on as at by this from or an not are "
    "de la le et que en un une les des est du dans pour qui sur au "
    "der die das und zu den mit von ist im ein eine nicht auf dem sich "
    "el los y se del las por con una para como su al lo"
)
SYMBOLS = "#*$%&|<>"

# (measure, least, most, words a text must have for the rule to apply). None: no bound on that side.
RULES = (
    ("n_words", 20, None, 0),
    ("mean_word_chars", 2.5, 14.0, 20),
    ("symbols_per_word", None, 0.1, 20),
    ("stop_word_share", 0.02, None, 50),
    ("letter_share", 0.6, None, 20),
    ("capitals_share", None, 0.6, 20),
    ("repeat_word_share", None, 0.3, 0),
    ("doubled_word_share", None, 0.3, 20),
    ("dup_line_share", None, 0.5, 20),
    ("bullet_line_share", None, 0.9, 20),
    ("ellipsis_line_share", None, 0.5, 20),
)


def text_words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Number of words in windows of ``width`` words that occur twice or more.

    A window's hash is built by doubling: of one word, two, four and so on,
    with 64 bits, so two windows of one text are taken for equal by chance
    about once in 10**9 texts of 100,000 words. ``width`` is a power of two.
    Only texts that repeat a hash are sorted.
    """

    def doubled(step: int):
        return lambda h: F.zip_with(h, F.slice(h, F.lit(step + 1), F.size(h)), lambda a, b: F.xxhash64(a, b))

    def marked(keys: Column) -> Column:
        return bound(F.array_sort(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)

    def covered(ranked: Column) -> Column:
        none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
        after = F.concat(F.slice(ranked, F.lit(2), F.size(ranked)), none)
        before = F.concat(none, F.slice(ranked, F.lit(1), F.size(ranked) - 1))
        beside = F.zip_with(before, after, lambda a, b: F.struct(a["h"].alias("a"), b["h"].alias("b")))
        both = F.zip_with(
            ranked,
            beside,
            lambda x, y: F.when(x["h"].eqNullSafe(y["a"]) | x["h"].eqNullSafe(y["b"]), x["i"]),
        )
        return bound(F.array_sort(F.filter(both, lambda i: i.isNotNull())), length)

    def length(places: Column) -> Column:
        later = F.slice(places, F.lit(2), F.size(places))
        gaps = F.zip_with(places, later, lambda a, b: F.coalesce(b - a, F.lit(width)))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + F.least(gap, F.lit(width)))

    hashes, step = F.transform(words, lambda w: F.xxhash64(w)), 1
    while step < width:
        hashes, step = bound(hashes, doubled(step)), 2 * step
    windows = F.slice(hashes, F.lit(1), F.size(words) - (width - 1))
    counted = bound(
        windows, lambda keys: F.when(F.size(F.array_distinct(keys)) < F.size(keys), marked(keys)).otherwise(F.lit(0))
    )
    return F.when(F.size(words) > width, counted).otherwise(F.lit(0)).cast("bigint")


def measured(text: Column) -> Column:
    """A struct of counts of one text. Words and lines are split once, wherever the struct ends up in a plan."""
    whole = F.coalesce(text, F.lit(""))
    stop = sorted(set(STOP_WORDS.split()))
    filled = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(words: Column, lines: Column) -> Column:
        n, n_lines = F.size(words), F.size(lines)
        later = F.slice(words, F.lit(2), n)
        return F.struct(
            n.cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace(whole, rf"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
            (n_lines - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            n_lines.alias("n_lines"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(stop))).alias("n_stop"),
            F.size(F.filter(F.zip_with(words, later, lambda a, b: a == b), lambda same: same)).alias("n_doubled"),
            F.length(F.regexp_replace(whole, r"[^\p{L}]+", "")).alias("n_letters"),
            F.length(F.regexp_replace(whole, r"[^\p{Lu}]+", "")).alias("n_capitals"),
            F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]"))).alias("n_bullets"),
            F.size(F.filter(lines, lambda x: x.rlike(r"(?:\.\.\.|…)\s*$"))).alias("n_ellipses"),
        )

    return bound(text_words(whole), lambda words: bound(filled, lambda lines: counts(words, lines)))


def verdict(m: Column, rules=RULES) -> Column:
    """True where every rule of the table holds."""
    words, lines = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["n_lines"], F.lit(1))
    values = {
        "n_words": m["n_words"],
        "mean_word_chars": m["word_chars"] / words,
        "symbols_per_word": m["n_symbols"] / words,
        "stop_word_share": m["n_stop"] / words,
        "letter_share": m["n_letters"] / F.greatest(m["word_chars"], F.lit(1)),
        "capitals_share": m["n_capitals"] / F.greatest(m["n_letters"], F.lit(1)),
        "repeat_word_share": m["n_repeat_words"] / words,
        "doubled_word_share": m["n_doubled"] / words,
        "dup_line_share": m["n_dup_lines"] / lines,
        "bullet_line_share": m["n_bullets"] / lines,
        "ellipsis_line_share": m["n_ellipses"] / lines,
    }
    holds = F.lit(True)
    for name, least, most, from_words in rules:
        good = F.lit(True)
        if least is not None:
            good = good & (values[name] >= least)
        if most is not None:
            good = good & (values[name] <= most)
        holds = holds & ((m["n_words"] < from_words) | good)
    return holds


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def kept(m: Column, rules=RULES) -> Column:
    return ~base_failed(m) & verdict(m, rules)


def keep_quality(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The documents that pass all rules."""
    return docs.where(bound(measured(F.col(text)), lambda m: kept(m, rules)))


def quality_digest(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per document: its counts and whether it stays."""
    m = F.col("__m")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = docs.select("doc_id", measured(F.col("text")).alias("__m"))
    return judged.select(
        "doc_id", *[m[c].alias(c) for c in names], base_failed(m).alias("base_failed"), kept(m, rules).alias("kept")
    )
