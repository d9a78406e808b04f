"""Chat formatting: turn-aligned windows of a token budget, with the loss on each assistant text once.

Prefix sums of turn tokens place every turn in the window its first token falls
into; windows begin at multiples of half of what the history leaves of the
budget. A window shows the conversation's first system turn, the last turns
before it as limited history, and its own turns; only assistant turns of its
own are under the loss mask. The system turn comes on top of the budget. A turn
is never cut: history and own turns go over the budget only where an own turn
alone is longer than half of what the history leaves.

Nulls: a null text or role is empty, null turns come first, null ``conv_id``
is one conversation. Ties of a turn go by role and text; repeated rows are
turns of their own. Empty tables give no windows. Columns other than the four
named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Control strings of the template.
OPEN, SHUT, END = "<|", "|>", "<|end|>\n"
TOKEN = r"[0-9A-Za-z_]+|[^0-9A-Za-z_\x20\x09-\x0D]"
TURN_TOKENS = 4
BUDGET = 1024
HISTORY = 256
BLOCK_BITS = 6


def escaped(text: Column) -> Column:
    """No control string is left in the result; ``unescaped`` gives the text back."""
    plain = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(plain, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|>])", "$1")


def formatted(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(role), F.lit(SHUT + "\n"), escaped(text), F.lit(END))


def placed_turns(conversations: DataFrame, stride: int) -> DataFrame:
    """Each turn with the tokens before it in its conversation and its window.

    Sums run inside blocks of turns and over the blocks of a conversation, so
    a conversation with a large share of all turns is spread over many tasks.
    """
    conv, turn = F.col("conv_id"), F.col("turn").cast("bigint")
    turns = conversations.select(
        conv,
        conv.isNull().alias("__none"),
        F.coalesce(conv, F.lit(0).cast(conversations.schema["conv_id"].dataType)).alias("__conv"),
        F.coalesce(F.shiftright(turn, BLOCK_BITS), F.lit(-(2**62))).alias("__block"),
        turn.alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).withColumn("__tokens", F.regexp_count(F.col("text"), F.lit(TOKEN)).cast("bigint") + TURN_TOKENS)
    key = ["__none", "__conv"]
    sums = turns.groupBy(*key, "__block").agg(F.sum("__tokens").alias("__n"))
    earlier = Window.partitionBy(*key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*key, "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    inside = (
        Window.partitionBy(*key, "__block")
        .orderBy(F.col("turn").asc_nulls_first(), "role", "text")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = turns.withColumn("__inside", F.coalesce(F.sum("__tokens").over(inside), F.lit(0)))
    before = F.col("__base") + F.col("__inside")
    return (
        summed.join(starts, [*key, "__block"])
        .select("conv_id", *key, "turn", "role", "text", before.alias("__before"))
        .withColumn("__span", F.floor(F.col("__before") / F.lit(stride)))
    )


def stride_of(budget: int = BUDGET, history: int = HISTORY) -> int:
    """Tokens from one window's begin to the next: so many, and a last turn of no more, are within the budget."""
    return max(1, (budget - history) // 2)


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: ``conv_id, window, text, loss, n_context``.

    ``loss`` has the code points of ``text`` under the mask, ends exclusive;
    the first ``n_context`` turns are repeated ones.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be smaller than budget")
    turns = placed_turns(conversations, stride_of(budget, history))
    key = ["__none", "__conv"]
    windows = turns.groupBy(*key, "__span").agg(F.min("__before").alias("__from"))
    following = Window.partitionBy(*key).orderBy("__span")
    windows = windows.withColumns(
        {"__next": F.lead("__span").over(following), "__next_from": F.lead("__from").over(following)}
    )
    first_system = F.min(F.when(F.col("role") == "system", F.struct("__before", "conv_id", "role", "text")))
    system = turns.where(F.col("role") == "system").groupBy(*key).agg(first_system.alias("__system"))
    parted = turns.join(windows.drop("__from"), [*key, "__span"]).join(
        system.select(*key, F.col("__system.__before").alias("__system_at")), key, "left"
    )
    own = F.struct(F.col("__span").alias("window"), F.lit(2).alias("part"))
    again = F.struct(F.col("__next").alias("window"), F.lit(1).alias("part"))
    repeats = (F.col("__next_from") - F.col("__before") <= history) & ~F.col("__before").eqNullSafe(F.col("__system_at"))
    copies = F.when(F.coalesce(repeats, F.lit(False)), F.array(own, again)).otherwise(F.array(own))
    shown = parted.select("conv_id", *key, "__before", "role", "text", F.explode(copies).alias("__to"))
    retained = (
        windows.join(system, key)
        .where(F.col("__from") > F.col("__system.__before"))
        .select(
            F.col("__system.conv_id").alias("conv_id"),
            *key,
            F.col("__system.__before").alias("__before"),
            F.col("__system.role").alias("role"),
            F.col("__system.text").alias("text"),
            F.struct(F.col("__span").alias("window"), F.lit(0).alias("part")).alias("__to"),
        )
    )
    cells = F.struct(
        F.col("__to.part").alias("part"),
        F.col("__before").alias("before"),
        (F.col("role") == "assistant").alias("target"),
        F.length(formatted(F.col("role"), F.lit(""))).alias("frame"),
        formatted(F.col("role"), F.col("text")).alias("shown"),
    )
    grouped = shown.unionByName(retained).groupBy("conv_id", *key, F.col("__to.window").alias("window")).agg(
        F.array_sort(F.collect_list(cells)).alias("__turns")
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        end = acc["at"] + F.length(t["shown"])
        begin = acc["at"] + t["frame"] - len(END)
        found = F.array(F.struct(begin.alias("start"), (end - len(END)).alias("end")))
        out = F.when((t["part"] == 2) & t["target"], F.concat(acc["out"], found)).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    return grouped.select(
        "conv_id",
        *key,
        "window",
        F.array_join(F.transform("__turns", lambda t: t["shown"]), "").alias("text"),
        F.aggregate("__turns", start, step, lambda acc: acc["out"]).alias("loss"),
        F.size(F.filter("__turns", lambda t: t["part"] < 2)).alias("n_context"),
    ).drop(*key)


def read_back(windows: DataFrame) -> DataFrame:
    """``windows`` with ``turns`` (role and text of each turn of its own) and ``targets`` (texts under the mask)."""
    pieces = F.split("text", r"<\|end\|>\n", -1)
    own = F.slice(pieces, F.col("n_context") + 1, F.size(pieces) - 1 - F.col("n_context"))
    parts = r"(?s)^<\|(.*?)\|>\n(.*)$"
    turns = F.transform(
        own,
        lambda p: F.struct(
            unescaped(F.regexp_extract(p, parts, 1)).alias("role"), unescaped(F.regexp_extract(p, parts, 2)).alias("text")
        ),
    )
    targets = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    return windows.withColumns({"turns": turns, "targets": targets})


def chat_digest(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per conversation, all of it read back from the windows."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read_back(chat_windows(conversations, budget, history)).select(
        "conv_id",
        "window",
        F.size("turns").alias("__n"),
        whole.alias("__whole"),
        F.array_join("targets", "").alias("__loss"),
        F.length("text").alias("__chars"),
    )
    in_turn = "listagg({}, '') WITHIN GROUP (ORDER BY window)"
    digests = read.groupBy("conv_id").agg(
        F.sum("__n").alias("n_turns"),
        F.expr(in_turn.format("__whole")).alias("__whole"),
        F.expr(in_turn.format("__loss")).alias("__loss"),
        F.sum("__chars").alias("formatted_chars"),
    )
    return digests.select(
        "conv_id",
        F.col("n_turns").cast("bigint").alias("n_turns"),
        F.sha2("__whole", 256).alias("turns_sha256"),
        F.length("__loss").cast("bigint").alias("loss_chars"),
        F.sha2("__loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
    )
