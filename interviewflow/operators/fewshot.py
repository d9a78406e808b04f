"""Seeded exemplars and the prompts built from them.

Draws act through ``md5(seed:class:key)``, so they depend on the data and the
seed only, never on partitioning. Only keys are numbered and drawn; texts are
joined to the finished draw.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from interviewflow.defaults import SEED_NO_REUSE, SEED_WITH_REUSE
from interviewflow.functions.columns import require_columns
from interviewflow.functions.ids import int_id
from interviewflow.functions.labels import label_of, status_text
from interviewflow.functions.templates import render, render_around
from interviewflow.functions.text import strip_ws
from interviewflow.operators.spread import number_rows, spread_join
from interviewflow.operators.tables import require_unique
from interviewflow.session import cut, shared_path
from interviewflow.sources.files import qualified
from interviewflow.sources.texts import put_texts, recipe_of, text_at, text_of

SHOT_NAMES = ("zero_shot_name", "one_shot_name")
# Hex digits of a hash that make a bucket: 65,536 for keys of a class or
# people, 4,096 for the keys of one person.
KEY_DIGITS = 4
OWN_DIGITS = 3
SLOTS = ("zero", "one")
# Rows that share a transcript, gathered: their key, their other columns, and where the transcript lies.
TALK, PICKS, PLACE = "__talk", "__picks", "__place"
# What a prompt is put together from.
RECIPE = "__recipe"
# Bits of the numbers of picks that one row gathers.
TALK_BITS = 6


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))


def _number(hashed: Column) -> Column:
    # 15 hex digits fit a BIGINT.
    return F.conv(F.left(hashed, F.lit(15)), 16, 10).cast("bigint")


def _once(count: Column, key: Column, what: str) -> Column:
    return F.when(count == 1, key).otherwise(F.raise_error(F.concat(F.lit(f"{what} is not unique: "), key.cast("string"))).cast("string"))


def _pool_index(keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbers the pool of each class so that one person's entries are adjacent.

    ``keys`` has cls, id, key. Returns the entries (cls, idx, shot), the
    people (cls, id, lo, own) and the class sizes (cls, size).
    """
    pool = keys.where(F.col("cls").isin(0, 1)).select(
        "cls", "id", "key", _hash(F.col("id")).alias("hp"), _hash(F.col("key")).alias("hk")
    )
    pool = pool.withColumn("cell", F.left("hk", F.lit(OWN_DIGITS)))
    # Entries are counted per cell, a small part of one person's entries, so
    # the people below have at most 4,096 rows each however many entries.
    cells = pool.groupBy("cls", "id", "hp", "cell").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("bucket", F.left("hp", F.lit(KEY_DIGITS)))
    totals = cells.groupBy("cls", "bucket").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("cls").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    starts = totals.select("cls", "bucket", (F.sum("n").over(earlier) - F.col("n")).alias("start"))
    sizes = totals.groupBy("cls").agg(F.sum("n").alias("size"))

    inside = Window.partitionBy("cls", "bucket").orderBy("hp", "id", "cell").rowsBetween(Window.unboundedPreceding, 0)
    # At most 65,536 bucket starts per class.
    placed = (
        cells.withColumn("at", F.sum("n").over(inside) - F.col("n"))
        .join(F.broadcast(starts), ["cls", "bucket"])
        .select("cls", "id", "cell", "n", (F.col("at") + F.col("start")).alias("at"))
    )
    people = placed.groupBy("cls", "id").agg(F.min("at").alias("lo"), F.sum("n").alias("own"))
    rank = F.row_number().over(Window.partitionBy("cls", "id", "cell").orderBy("hk", "key")) - 1
    entries = (
        pool.withColumn("rank", rank)
        .join(placed, ["cls", "id", "cell"])
        .select("cls", (F.col("at") + F.col("rank")).alias("idx"), F.col("key").alias("shot"))
    )
    return entries, people, sizes


def shots_with_reuse(
    df: DataFrame,
    label_col: str = "PHQ_Binary",
    id_col: str = "Participant_ID",
    key_col: str = "name",
    seed: int = SEED_WITH_REUSE,
    names: Sequence[str] = SHOT_NAMES,
) -> DataFrame:
    """Each row gets one exemplar of class 0 and one of class 1, both of other people.

    Of a pool of N with c entries of the row's own person, numbered together
    from ``lo`` on, the draw is ``j = hash mod (N - c)``, moved up by c when
    ``j >= lo``. So the draw is an equi-join on a number: no pair of rows is
    ever compared. Where nobody else is in the pool the name is ``''``.
    Keys must be unique. The keys are kept in the shared folder by a job that
    runs at once; texts are joined to the result only.
    """
    require_columns(df, [label_col, id_col, key_col])
    counted = df.groupBy(
        F.col(key_col).alias("key"), F.col(id_col).alias("id"), label_of(df, label_col).cast("int").alias("cls")
    ).agg(F.count(F.lit(1)).alias("n"))
    keys = cut(counted.select(_once(F.col("n"), F.col("key"), key_col).alias("key"), "id", "cls"))
    entries, people, sizes = _pool_index(keys)

    targets = keys.select("key", "id", F.explode(F.array(F.lit(0), F.lit(1))).alias("cls"))
    placed = spread_join(targets, people, ["cls", "id"], "left")
    placed = placed.join(F.broadcast(sizes), "cls", "left")
    lo, own = F.coalesce("lo", F.lit(0)), F.coalesce("own", F.lit(0))
    others = F.coalesce(F.col("size"), F.lit(0)) - own
    draw = F.when(others > 0, F.pmod(_number(_hash(F.lit(seed), F.col("cls"), F.col("key"))), others))
    shifted = placed.select("key", "cls", draw.alias("j"), lo.alias("lo"), own.alias("own"))
    wanted = shifted.select("key", "cls", F.when(F.col("j") >= F.col("lo"), F.col("j") + F.col("own")).otherwise(F.col("j")).alias("idx"))
    # Draws are uniform over the pool of their class: beside a huge class the few
    # numbers of a rare one are hot here, and are split as skewed.
    drawn = spread_join(wanted, entries, ["cls", "idx"], "left")
    picks = drawn.groupBy("key").agg(
        *[F.coalesce(F.max(F.when(F.col("cls") == c, F.col("shot"))), F.lit("")).alias(name) for c, name in enumerate(names)]
    )
    return df.join(picks.withColumnRenamed("key", key_col), key_col)


def shots_no_reuse(
    train: DataFrame,
    test: DataFrame,
    label_col: str = "PHQ_Binary",
    key_col: str = "name",
    test_key: str = "Participant_ID",
    seed: int = SEED_NO_REUSE,
    names: Sequence[str] = SHOT_NAMES,
) -> DataFrame:
    """Each test row gets its own exemplar of class 0 and of class 1.

    Both pools are put in seeded order and numbered, the test rows as well;
    equal numbers meet. A pool smaller than the test table is a ``ValueError``
    with both sizes. Keys of both tables must be unique. Jobs over the keys
    run at once.
    """
    require_columns(train, [label_col, key_col], "pool")
    require_columns(test, [test_key], "test table")
    pool = train.select(label_of(train, label_col).cast("int").alias("cls"), F.col(key_col).alias("key")).where(F.col("cls").isin(0, 1))
    pool = pool.groupBy("cls", "key").agg(F.count(F.lit(1)).alias("n"))
    pool = pool.select("cls", _once(F.col("n"), F.col("key"), key_col).alias("shot"))
    pool = cut(pool.withColumn("h", _hash(F.lit(seed), F.col("cls"), F.col("shot"))))
    rows = test.groupBy(test_key).agg(F.count(F.lit(1)).alias("n"))
    same = F.col(test_key).cast("string")
    rows = cut(rows.select(F.col(test_key).alias("__key"), _hash(_once(F.col("n"), same, test_key)).alias("h")))
    need = _check_sizes(pool, rows)

    # As many of each class as there are test rows: later buckets are not sorted.
    pool = number_rows(pool, ["cls"], [F.col("h"), F.col("shot")], F.left("h", F.lit(KEY_DIGITS)), "idx", below=need)
    rows = number_rows(rows, [], [F.col("h"), F.col("__key")], F.left("h", F.lit(KEY_DIGITS)), "idx")
    rows = rows.select(F.col("__key").alias(test_key), "idx")

    pairs = pool.groupBy("idx").agg(
        *[F.max(F.when(F.col("cls") == c, F.col("shot"))).alias(name) for c, name in enumerate(names)]
    )
    return test.join(rows.join(pairs, "idx").drop("idx"), test_key)


def _check_sizes(pool: DataFrame, rows: DataFrame) -> int:
    """One job over the kept keys; three numbers come back. The number of rows is returned."""
    cls = F.col("cls")
    sizes = pool.select("cls").unionAll(rows.select(F.lit(-1).alias("cls")))
    zeros, ones, need = sizes.agg(F.count_if(cls == 0), F.count_if(cls == 1), F.count_if(cls == -1)).first()
    if min(zeros, ones) < need:
        raise ValueError(f"need {need} exemplars of each class, but the pools hold {zeros} zeros and {ones} ones")
    return need


def attach_shots(
    df: DataFrame,
    pool: DataFrame,
    fields: Mapping[str, str],
    own: Mapping[str, str] | None = None,
    shots: Mapping[str, str] = {"zero": SHOT_NAMES[0], "one": SHOT_NAMES[1]},
    key: str = "name",
    row_key: str = "name",
    strict: bool = True,
    unique: bool = False,
) -> DataFrame:
    """Exemplar fields beside every row as ``<shot>_<field>``.

    ``fields`` maps field names to pool columns. ``strict``: an unknown name
    raises. Otherwise the row's own columns (``own``, default the same names)
    stand in when there is no match; a column the table lacks gives null.
    Pool keys must be unique; ``unique`` says the caller knows they are, else
    a job looks at them. Row keys must be unique too.

    Pool texts are shuffled to the names of their rows, and from there to the
    rows; the row's own texts move once, to meet them.
    """
    require_columns(pool, [key, *fields.values()], "pool")
    if not unique:
        require_unique(pool, key)
    own = dict(own or fields)
    # Names of all slots in one narrow table; the texts of the pool are joined to it once.
    slots = F.array(*[F.struct(F.lit(shot).alias("slot"), F.col(c).cast("string").alias("shot")) for shot, c in shots.items()])
    asked = df.select(F.col(row_key).alias("__row"), F.explode(slots).alias("s")).select("__row", "s.slot", "s.shot")
    texts = pool.select(
        F.col(key).cast("string").alias("shot"), F.struct(*[F.col(c).alias(f) for f, c in fields.items()]).alias("__shot")
    )
    met = spread_join(asked, texts, "shot", "inner").groupBy("__row").agg(
        *[F.first(F.when(F.col("slot") == shot, F.col("__shot")), True).alias(f"__{shot}") for shot in shots]
    )
    joined = df.join(met, df[row_key] == met["__row"], "left")
    columns = []
    for shot, name_col in shots.items():
        found = F.col(f"__{shot}").isNotNull()
        for field in fields:
            if strict:
                text = F.concat(F.lit("no exemplar named "), F.coalesce(F.col(name_col).cast("string"), F.lit("null")))
                other = F.raise_error(text).cast("string")
            else:
                other = F.col(own[field]) if own[field] in df.columns else F.lit(None)
            columns.append(F.when(found, F.col(f"__{shot}.{field}")).otherwise(other).alias(f"{shot}_{field}"))
    return joined.select(*[df[c] for c in df.columns], *columns)


def fewshot_prompt(
    df: DataFrame,
    pool: DataFrame,
    body: str,
    mode: str,
    text_col: str,
    values: Mapping[str, Column] | None = None,
    label_col: str = "PHQ_Binary",
    gender_col: str = "Gender",
    transcript_col: str = "Transcript",
    key: str = "name",
    row_key: str = "name",
    out: str = "prompt",
    unique: bool = False,
) -> DataFrame:
    """``df`` with a prompt of two exemplars and the row itself.

    ``body`` takes ``zero_gender``, ``zero_transcript``, ``zero_text``, the
    same for ``one``, ``gender``, ``transcript``, and in mode ``train``
    ``status``. ``train`` wants every exemplar to exist and strips the
    prompt; ``test`` falls back to the row's own fields and keeps the ends.
    Missing fields are inserted as empty text.
    """
    if mode not in ("train", "test"):
        raise ValueError(f"mode is 'train' or 'test', not {mode!r}")
    fields = {"gender": gender_col, "transcript": transcript_col, "text": text_col}
    joined = attach_shots(df, pool, fields, key=key, row_key=row_key, strict=mode == "train", unique=unique)
    return _with_prompt(joined, body, mode, values, label_col, gender_col, transcript_col, out)


INSERTED = [f"{shot}_{field}" for shot in SLOTS for field in ("gender", "transcript", "text")]


def _filled(joined: DataFrame, mode: str, values, label_col: str, gender_col: str, transcript_col: str) -> dict[str, Column]:
    """What the placeholders of a prompt stand for, in rows with their exemplar fields."""
    filled = {name: F.coalesce(F.col(name).cast("string"), F.lit("")) for name in INSERTED}
    filled["gender"] = F.coalesce(F.col(gender_col), F.lit(""))
    filled["transcript"] = F.coalesce(F.col(transcript_col), F.lit(""))
    if mode == "train":
        filled["status"] = status_text(label_of(joined, label_col))
    return {**filled, **(values or {})}


def _with_prompt(joined: DataFrame, body: str, mode: str, values, label_col: str, gender_col: str, transcript_col: str, out: str) -> DataFrame:
    """The prompt of rows with their exemplar fields, in place of these fields."""
    filled = _filled(joined, mode, values, label_col, gender_col, transcript_col)
    prompt = render(body, filled, template=mode, non_empty=())
    return joined.withColumn(out, strip_ws(prompt) if mode == "train" else prompt).drop(*INSERTED)


def gather_talks(
    rows: DataFrame, number: str, id_col: str = "Participant_ID", transcript_col: str = "Transcript"
) -> DataFrame:
    """One row per person and transcript: its key ``TALK``, the place of the transcript, and ``PICKS``, the other columns of its rows.

    ``number`` tells the picks of a person apart; a row holds those of a block
    of 64 numbers at most. Transcripts are written where their rows are read,
    to the shared folder, and do not move: ``PLACE`` tells where a transcript
    lies (``sources.texts``).
    """
    digest = F.coalesce(F.md5(F.col(transcript_col).cast("string").cast("binary")), F.lit("-"))
    block = F.shiftright(int_id(F.col(number)), TALK_BITS).cast("string")
    # The digest tells transcripts apart; person and block only spread those that many people share.
    parts = [digest, F.coalesce(block, F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit(""))]
    rest = [F.col(c) for c in rows.columns if c != transcript_col]
    folder = qualified(rows.sparkSession, shared_path(rows.sparkSession, "transcripts"))
    place = put_texts(F.col(transcript_col).cast("string").cast("binary"), folder)
    placed = rows.withColumn(TALK, F.concat_ws(":", *parts)).withColumn(PLACE, place)
    return placed.groupBy(TALK).agg(F.first(PLACE).alias(PLACE), F.collect_list(F.struct(*rest)).alias(PICKS))


def reuse_recipes(
    talks: DataFrame,
    body: str,
    text_col: str,
    values: Mapping[str, Column] | None = None,
    seed: int = SEED_WITH_REUSE,
    label_col: str = "PHQ_Binary",
    gender_col: str = "Gender",
    transcript_col: str = "Transcript",
    id_col: str = "Participant_ID",
    key: str = "name",
) -> DataFrame:
    """Training prompts of all picks of ``talks`` (``gather_talks``, in buckets of ``TALK``): ``shots_with_reuse``, then ``fewshot_prompt``.

    Transcripts stay where they lie: rows have their places, ``PLACE`` for
    their own, and ``RECIPE``, what the prompt is put together from
    (``with_prompts``). An exemplar is looked up in the row of its talk, and
    goes from there to the talk of the prompt. Rows come dealt by ``TALK``.
    """
    columns = talks.schema[PICKS].dataType.elementType.names
    keys = talks.select(TALK, F.explode(PICKS).alias("p")).select(TALK, *[f"p.{c}" for c in (label_col, id_col, key)])
    drawn = shots_with_reuse(keys, label_col, id_col, key, seed)
    slots = F.array(*[F.struct(F.lit(slot).alias("slot"), F.col(c).alias("shot")) for slot, c in zip(SLOTS, SHOT_NAMES)])
    asked = drawn.select(F.col(TALK).alias("__to"), F.col(key).alias("__row"), F.explode(slots).alias("s"))
    # The draw has refused repeated names.
    named = keys.select(F.col(key).alias("shot"), TALK)
    placed = spread_join(asked.select("__to", "__row", "s.slot", "s.shot"), named, "shot", "left")

    def pick_of(name: str) -> Column:
        return F.get(F.filter(PICKS, lambda p: p[key] == F.col(name)), F.lit(0))

    met = spread_join(placed, talks, TALK, "left").withColumn("__pick", pick_of("shot"))
    fields = {"gender": F.col(f"__pick.{gender_col}"), "transcript": F.col(PLACE), "text": F.col(f"__pick.{text_col}")}
    shot = F.when(F.col("__pick").isNotNull(), F.struct(*[c.alias(f) for f, c in fields.items()]))
    # As many parts as the talks have buckets, so that these are read in place.
    parts = int(talks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved = met.select("__to", "__row", "slot", "shot", shot.alias("__shot")).repartition(parts, "__to")
    mine = lambda slot, c: F.first(F.when(F.col("slot") == slot, F.col(c)), True)
    shots = moved.groupBy("__to", "__row").agg(
        *[mine(slot, c).alias(a) for slot, n in zip(SLOTS, SHOT_NAMES) for c, a in (("shot", n), ("__shot", f"__{slot}"))]
    )
    joined = spread_join(shots.withColumnRenamed("__to", TALK), talks, TALK).withColumn("__pick", pick_of("__row"))
    # Whole transcripts are there for ``values`` that look at them; no others are read.
    own = {c: F.col(f"__pick.`{c}`") for c in columns} | {transcript_col: text_at(F.col(PLACE))}
    places = {"transcript": F.col(PLACE)}
    shown = []
    for slot, name in zip(SLOTS, SHOT_NAMES):
        missing = F.raise_error(F.concat(F.lit("no exemplar named "), F.coalesce(name, F.lit("null")))).cast("string")
        found = F.col(f"__{slot}").isNotNull()
        here = {f: F.when(found, F.col(f"__{slot}.{f}")).otherwise(missing.cast("binary") if f == "transcript" else missing) for f in fields}
        places[f"{slot}_transcript"] = F.col(f"__{slot}_place")
        shown += [here["transcript"].alias(f"__{slot}_place"), *[here[f].alias(f"{slot}_{f}") for f in ("gender", "text")]]
    rows = joined.select(TALK, PLACE, *[c.alias(n) for n, c in own.items()], *SHOT_NAMES, *shown)
    rows = rows.withColumns({f"{slot}_transcript": text_at(F.col(f"__{slot}_place")) for slot in SLOTS})
    filled = _filled(rows, "train", values, label_col, gender_col, transcript_col)
    left_out = [n for n in places if n not in (values or {})]
    pieces, names = render_around(body, left_out, filled, template="train", non_empty=())
    recipe = recipe_of(pieces, [places[n] for n in names])
    return rows.withColumn(RECIPE, recipe).select(TALK, *columns, *SHOT_NAMES, PLACE, RECIPE)


def with_prompts(recipes: DataFrame, transcript_col: str = "Transcript", out: str = "prompt") -> DataFrame:
    """Rows of ``reuse_recipes`` with their transcript and prompt in place of where these lie; texts that are not asked for are not read."""
    whole = recipes.withColumn(transcript_col, text_at(F.col(PLACE))).withColumn(out, text_of(F.col(RECIPE), strip=True))
    return whole.drop(PLACE, RECIPE)


def reuse_prompts(
    talks: DataFrame,
    body: str,
    text_col: str,
    values: Mapping[str, Column] | None = None,
    seed: int = SEED_WITH_REUSE,
    label_col: str = "PHQ_Binary",
    gender_col: str = "Gender",
    transcript_col: str = "Transcript",
    id_col: str = "Participant_ID",
    key: str = "name",
    out: str = "prompt",
) -> DataFrame:
    """``reuse_recipes`` with their transcripts and prompts; ``recipes`` of the returned frame has the rows before that."""
    recipes = reuse_recipes(talks, body, text_col, values, seed, label_col, gender_col, transcript_col, id_col, key)
    prompts = with_prompts(recipes, transcript_col, out)
    prompts.recipes = recipes
    return prompts
