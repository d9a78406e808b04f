"""Few-shot training and test sets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from interviewflow.defaults import SEED_NO_REUSE, SEED_WITH_REUSE
from interviewflow.functions.ids import exemplar_key
from interviewflow.functions.text import token_count
from interviewflow.operators.fewshot import (
    RECIPE,
    SHOT_NAMES,
    TALK,
    fewshot_prompt,
    gather_talks,
    reuse_prompts,
    shots_no_reuse,
    with_prompts,
)
from interviewflow.operators.generate import Generator, generate_repeats, merge_dealt, merge_results, of_recipes, run_resumable
from interviewflow.session import bucketed, kept

NUMBER, TEXT = "Exp_5_Selected_Rationale_Number", "Exp_5_Selected_Rationale"


def training_prompts(
    expanded: DataFrame,
    body: str,
    values: Mapping[str, Column] | None = None,
    seed: int = SEED_WITH_REUSE,
    number: str = NUMBER,
    text: str = TEXT,
) -> DataFrame:
    """Expanded picks with ``name``, two exemplar names, ``prompt``, ``Token_Count``, and ``__talk``, by which rows are dealt.

    Each transcript is written once; rows move with the places of the three
    that their prompt needs, and transcript and prompt are put together where
    they are read. ``recipes`` of the returned frame has the rows before that.
    """
    named = expanded.withColumn("name", exemplar_key(F.col("Participant_ID"), F.col(number)))
    talks = bucketed(gather_talks(named, number), TALK, "talks", dealt=False, codec="zstd")
    made = reuse_prompts(talks, body, text, values, seed)
    rest = [c for c in expanded.columns if c not in ("name", *SHOT_NAMES)]
    columns = ["name", *rest, *SHOT_NAMES, "prompt", "Token_Count", TALK]
    prompts = _shown(made, columns, expanded.schema["Transcript"].dataType)
    prompts.recipes = made.recipes
    return prompts


def _shown(prompts: DataFrame, columns: list[str], kind: T.DataType) -> DataFrame:
    """``columns`` of prompts, the transcript in the type in which it was given."""
    counted = prompts.withColumn("Token_Count", token_count(F.col("prompt")))
    return counted.withColumn("Transcript", F.col("Transcript").cast(kind)).select(*columns)


def training_set(prompts: DataFrame, generator: Generator, store: str, run_id: str, batches: int = 1) -> DataFrame:
    """Training prompts with Generated_Rationale and Generated_Token_Count, resumable; what is drawn and inserted is computed once.

    Prompts as ``training_prompts`` gives them are never written: their recipes
    are, and a prompt is put together where it is asked, and again where it is
    read. Others, as changed ones, are written whole; those that are dealt by
    talk stay so, and the answers of a talk come to its prompts.
    """
    # Not by getattr, which would find a column of this name.
    recipes = vars(prompts).get("recipes")
    dealt = TALK in prompts.columns
    if recipes is not None:
        rows = bucketed(recipes, TALK, "recipes", dealt=False, codec="zstd")
        generator = of_recipes(generator)
    else:
        rows = bucketed(prompts, TALK, "prompts", dealt=False, codec="zstd") if dealt else kept(prompts, "prompts")
    asked = rows.select("name", F.col("prompt" if recipes is None else RECIPE).alias("prompt"))
    results = run_resumable(asked, 1, generator, store, run_id, key="name", batches=batches, partitions=0 if dealt else None)
    made = results.select(
        "name",
        F.col("text").alias("Generated_Rationale"),
        token_count(F.col("text")).alias("Generated_Token_Count"),
    )
    if not dealt:
        return merge_results(rows, made, ["name"])
    merged = merge_dealt(rows, made, "name", TALK)
    if recipes is None:
        return merged.drop(TALK)
    columns = dict.fromkeys([*prompts.columns, *made.columns])
    return _shown(with_prompts(merged), [c for c in columns if c != TALK], prompts.schema["Transcript"].dataType)


def evaluation_prompts(
    train: DataFrame,
    test: DataFrame,
    body: str,
    values: Mapping[str, Column] | None = None,
    seed: int = SEED_NO_REUSE,
    text: str = "Generated_Rationale",
    unique: bool = False,
) -> DataFrame:
    """Test rows with two exemplars no other row has, ``prompt`` and ``Token_Count``.

    Both tables are computed once, and dealt by what they are joined on.
    """
    used = [c for c in dict.fromkeys(["name", "PHQ_Binary", "Gender", "Transcript", text]) if c in train.columns]
    train = bucketed(train.select(*used), "name", "exemplars")
    test = bucketed(test, "Participant_ID", "tests")
    drawn = shots_no_reuse(train, test, seed=seed)
    prompts = fewshot_prompt(drawn, train, body, "test", text, values, row_key="Participant_ID", unique=unique)
    return prompts.withColumn("Token_Count", token_count(F.col("prompt")))


def evaluation_set(
    prompts: DataFrame,
    generator: Generator,
    marker: str,
    extra: str,
    repeats: int = 5,
    store: str | None = None,
    run_id: str = "run",
    batches: int = 1,
) -> DataFrame:
    """Test rows with ``repeats`` responses, their token counts and a prompt preview; resumable with ``store``."""
    prompts = kept(prompts, "prompts")
    keyed = prompts.select("Participant_ID", "prompt")
    rows = prompts.drop("prompt")
    return generate_repeats(keyed, rows, repeats, generator, marker, extra, store=store, run_id=run_id, batches=batches)
