"""Candidates for an id range, and from candidates to cleaned selections."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interviewflow.defaults import DEFAULT_PICKS, PROMPT_FALLBACKS
from interviewflow.functions.columns import candidate_columns, require_columns
from interviewflow.functions.labels import label_of, status_text
from interviewflow.functions.picks import picks_for, picks_from_cells
from interviewflow.functions.templates import choose_template, placeholders, render
from interviewflow.functions.text import clean_rationale
from interviewflow.operators.candidates import default_picks, default_picks_from_table, expand_picks
from interviewflow.operators.generate import Generator, merge_results, run_resumable, select_best
from interviewflow.operators.reshape import to_long, to_wide
from interviewflow.operators.spread import spread_join
from interviewflow.operators.tables import id_range, require_rows, require_unique
from interviewflow.session import kept


def with_template(
    df: DataFrame,
    templates: Mapping[str, str],
    template: str = "main",
    criteria: Mapping[str, str] | None = None,
    out: str = "Prompt",
) -> DataFrame:
    """``df`` with the prompt of the named template (of ``main`` for an unknown name).

    Templates take ``transcript``, ``gender``, ``depression_status`` and the
    names in ``criteria``; a missing value is an error.
    """
    name, body = choose_template(templates, template)
    needed = placeholders(body)
    sources = {"transcript": "Transcript", "gender": "Gender", "depression_status": "PHQ_Binary"}
    values: dict[str, Column] = {n: F.lit(text) for n, text in (criteria or {}).items()}
    for placeholder, column in sources.items():
        if placeholder in needed:
            require_columns(df, [column])
            values[placeholder] = F.col(column)
    if "depression_status" in values:
        values["depression_status"] = F.when(F.col("PHQ_Binary").isNotNull(), status_text(label_of(df, "PHQ_Binary")))
    return df.withColumn(out, render(body, values, template=name))


def with_prompt(
    df: DataFrame,
    body: str,
    defaults: Mapping[str, str] = PROMPT_FALLBACKS,
    values: Mapping[str, Column] | None = None,
    out: str = "Prompt",
) -> DataFrame:
    """``df`` with a prompt in which missing fields have stand-ins.

    ``body`` takes ``gender``, ``transcript``, ``depression_status`` and the names in ``values``.
    """
    require_columns(df, ["Gender", "PHQ_Binary", "Transcript"])
    filled = {
        "gender": F.coalesce("Gender", F.lit(defaults["gender"])),
        "transcript": F.coalesce("Transcript", F.lit(defaults["transcript"])),
        "depression_status": status_text(label_of(df, "PHQ_Binary"), null_status=defaults["status"]),
    }
    return df.withColumn(out, render(body, {**filled, **(values or {})}, template=out, non_empty=()))


def candidates_for_range(
    df: DataFrame,
    lo: int,
    hi: int,
    n: int,
    generator: Generator,
    templates: Mapping[str, str],
    template: str,
    store: str,
    run_id: str,
    criteria: Mapping[str, str] | None = None,
    id_col: str = "Participant_ID",
    batches: int = 1,
) -> DataFrame:
    """``df`` with Prompt and Rational_1..n for the ids in range; other rows stay as they are.

    Candidates the table already has are not asked for, and results are kept
    in ``store``, so a second run asks only for what is missing. Ids must be
    unique: a repeated one is an error before the first call. A range without
    rows gives the table as it is, with a warning. The job runs at once.
    """
    require_unique(df, id_col)
    chosen = id_range(df, id_col, lo, hi)
    if chosen.isEmpty():
        warnings.warn(f"no id from {lo} to {hi}", stacklevel=2)
        return df
    present = {i: f"Rational_{i}" for i in range(1, n + 1) if f"Rational_{i}" in df.columns}
    known = to_long(chosen, [id_col], present) if present else None
    prompts = kept(with_template(chosen, templates, template, criteria).select(id_col, "Prompt"), "prompts")
    results = run_resumable(prompts, n, generator, store, run_id, key=id_col, prompt="Prompt", batches=batches, known=known)
    wide = to_wide(results, [id_col], "candidate_no", "text", n)
    # The prompts of the range and the results meet on the id, then once with the table.
    return merge_results(df, prompts.join(wide, id_col, "left"), [id_col])


def select_and_expand(
    df: DataFrame,
    generator: Generator,
    body: str,
    store: str | None = None,
    id_col: str = "Participant_ID",
    carry: Sequence[str] | None = None,
    run_id: str = "run",
    batches: int = 1,
) -> DataFrame:
    """From a table of candidates to one cleaned text per pick (``modified_rationale``).

    The number of picks follows from the number of candidates. Ids must be
    unique. With ``store`` the answers are kept there, and another run asks
    only for those that are missing.
    """
    columns = candidate_columns(df.columns)
    answers = select_best(
        df, picks_for(len(columns)), generator, body, key=id_col, store=store, run_id=run_id, batches=batches
    )
    return clean_selection(expand_picks(spread_join(df, answers, id_col), candidates=columns, carry=carry, id_col=id_col))


def clean_selection(expanded: DataFrame, text: str = "Selected_Rationale", out: str = "modified_rationale") -> DataFrame:
    """Expanded picks with the cleaned text beside the chosen one."""
    return expanded.withColumn(out, clean_rationale(F.col(text)))


def expand_selection(df: DataFrame, id_col: str = "Participant_ID") -> DataFrame:
    """One row per pick of a table with selection columns; an error when none leads to a text (one job tells)."""
    return require_rows(expand_picks(df, id_col=id_col), "no selection leads to a text")


def expand_selection_with_defaults(
    df: DataFrame,
    id_col: str = "Participant_ID",
    defaults: Mapping[int, Sequence[int]] | DataFrame = DEFAULT_PICKS,
) -> DataFrame:
    """Variant for whole-number cells, with listed picks for listed ids that have none.

    ``defaults`` maps ids to picks, or is a table of ``id_col`` and ``numbers``.
    """
    require_columns(df, [id_col, "Gender", "PHQ_Binary", "Transcript"])
    cells = [c for c in df.columns if "Selected_Rational_Number" in c]
    picks = picks_from_cells(df, cells, strict=True) if cells else F.array().cast("array<bigint>")
    if isinstance(defaults, DataFrame):
        df = default_picks_from_table(df.withColumn("__picks", picks), "__picks", defaults, id_col, "numbers")
        picks = F.col("__picks")
    else:
        picks = default_picks(picks, F.col(id_col), defaults)
    if "PHQ_Score" not in df.columns:
        df = df.withColumn("PHQ_Score", F.lit(None).cast("int"))
    return expand_picks(
        df,
        picks,
        candidate_columns(df.columns),
        carry=["Gender", "PHQ_Binary", "PHQ_Score"],
        id_col=id_col,
        names=("Exp_5_Selected_Rationale_Number", "Exp_5_Selected_Rationale"),
    )
