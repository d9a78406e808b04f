"""Queries over the given tables, one per operator or composed job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interviewflow.functions.columns import candidate_columns
from interviewflow.functions.ids import id_from_filename, int_id, normalize_id, padded_id, text_id
from interviewflow.functions.picks import pad_picks, parse_picks, picks_from_cells
from interviewflow.functions.templates import messages, selection_prompt
from interviewflow.functions.text import clean_rationale, inject_after, prompt_preview
from interviewflow.operators.candidates import dropped_picks, expand_picks
from interviewflow.operators.fewshot import fewshot_prompt, shots_no_reuse, shots_with_reuse
from interviewflow.operators.generate import (
    generate,
    generate_repeats,
    merge_results,
    pending,
    per_request,
    progress,
    requests,
    select_best,
)
from interviewflow.operators.reshape import to_long, to_wide
from interviewflow.operators.scoring import confusion_rows
from interviewflow.operators.tables import (
    change_counts,
    correct_labels,
    correction_report,
    distinct_keys,
    id_overlap,
    keep_first,
    keep_ids,
    preview,
    profile,
    union_tables,
    unmatched,
)
from interviewflow.operators.tokens import token_stats, with_tokens
from interviewflow.operators.transcripts import (
    build_transcripts,
    count_updated,
    join_transcripts,
    update_transcripts,
)
from interviewflow.plans.candidates import (
    candidates_for_range,
    expand_selection_with_defaults,
    select_and_expand,
    with_prompt,
    with_template,
)
from interviewflow.plans.fewshot import exemplar_key, training_prompts
from interviewflow.plans.scoring import CORPORA, score_corpus
from interviewflow.plans.transcripts import transcripts_by_id
from interviewflow.session import bucketed, shared_path
from interviewflow.sources.sinks import short_cell
from workload.adapters import (
    CRITERIA,
    EXTRA,
    MAIN_BODY,
    MARKER,
    N_CANDIDATES,
    SELECT_BODY,
    TEMPLATES,
    TEST_BODY,
    TRAIN_BODY,
    candidates,
    keyed,
    pick_call,
    predictions,
    responses,
    roster,
    selections,
    slice_call,
    table,
    utterances,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    """Registers a query under the name of its function, without a closing underscore."""
    QUERIES[run.__name__.rstrip("_")] = run
    return run


def digest(df: DataFrame, text: str, name: str) -> list:
    return [F.md5(F.col(text).cast("binary")).alias(f"{name}_md5"), F.length(text).alias(f"{name}_chars")]


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


# Transcripts


@query
def transcript_inner(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("Participant_ID", F.col("conv_id").cast("string"))
    built = build_transcripts(turns, "Participant_ID", ["turn"])
    joined = join_transcripts(roster(spark, sf_dir).drop("Transcript"), built)
    return lower_names(joined.select("Participant_ID", "Gender", "PHQ_Binary", "transcript"))


def _update(spark, sf_dir, mode):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known"))
    old = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("Participant_ID"), F.when(F.col("known"), F.col("text")).alias("Transcript")
    )
    return update_transcripts(old, transcripts_by_id(utterances(spark, sf_dir)), mode)


@query
def transcript_update_overwrite(spark, sf_dir):
    return lower_names(_update(spark, sf_dir, "overwrite"))


@query
def transcript_update_fillna(spark, sf_dir):
    return lower_names(_update(spark, sf_dir, "fillna"))


@query
def transcript_update_counts(spark, sf_dir):
    return count_updated(_update(spark, sf_dir, "fillna"))


@query
def transcript_unmatched(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("participant_id"), F.length("text").alias("n_chars"))
    return unmatched(docs, table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("participant_id")), "participant_id")


@query
def id_overlap_(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("participant_id"))
    b = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 2).alias("participant_id"))
    return id_overlap(a, b, "participant_id")


# Ids and tables


@query
def normalize_ids(spark, sf_dir):
    cust, shape = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 7
    x = (
        F.when(shape == 0, F.concat(F.lit(" 0"), cust, F.lit(" ")))
        .when(shape == 1, F.concat(F.lit("P_"), cust))
        .when(shape == 2, F.concat(cust, F.lit(".0")))
        .when(shape == 3, F.concat(F.lit("-"), cust))
        .when(shape == 4, "abc ")
        .when(shape == 5, F.concat(cust, F.lit(".5")))
    )
    f = F.format_string("%05d_%s_Transcript.csv", F.col("o_custkey"), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        normalize_id(x).alias("normalized"),
        int_id(x).alias("int_id"),
        text_id(x).alias("text_id"),
        id_from_filename(f).alias("file_prefix"),
        id_from_filename(f, strict=True).alias("file_digits"),
    )


def _first_events(spark, sf_dir):
    return keep_first(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])


@query
def dedupe_keep_first(spark, sf_dir):
    return _first_events(spark, sf_dir).select("event_id", "user_id", "event_type", "value")


@query
def dedupe_counts(spark, sf_dir):
    return change_counts(table(spark, sf_dir, "events"), _first_events(spark, sf_dir))


@query
def filter_ids_int(spark, sf_dir):
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("o_custkey"))
    return keep_ids(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ids, "o_custkey", "int")


@query
def filter_ids_str(spark, sf_dir):
    name = F.concat(F.lit(" Customer#"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(" "))
    kept = keep_ids(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(name.alias("c_name")), "c_name", "string")
    return kept.select("c_custkey", "c_name", padded_id(F.col("c_name"), 24).alias("sort_key"))


@query
def distinct_ids(spark, sf_dir):
    return distinct_keys(table(spark, sf_dir, "orders"), "o_custkey")


@query
def union_by_name(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    return union_tables(
        s.selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance"),
        c.selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment"),
    )


def _labels(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id AS participant_id", "quality", "toxic AS phq_binary")
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("participant_id"))
    return labels, ids, "participant_id", "phq_binary"


@query
def label_correction(spark, sf_dir):
    return correct_labels(*_labels(spark, sf_dir))


@query
def label_correction_report(spark, sf_dir):
    return correction_report(*_labels(spark, sf_dir))


@query
def profile_(spark, sf_dir):
    return profile(candidates(spark, sf_dir))


@query
def head_preview(spark, sf_dir):
    return preview(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], 5, "text")


# Tokens and prompts


def _counted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return with_tokens(docs.select("doc_id", F.col("text").alias("Prompt"), F.expr("n_chars div 5").alias("Token_Length")))


@query
def token_counts(spark, sf_dir):
    return _counted(spark, sf_dir).select("doc_id", "token_count", "token_difference")


@query
def token_stats_(spark, sf_dir):
    stats = token_stats(_counted(spark, sf_dir))
    return stats.select(*[F.round(c, 6).alias(c) if c.startswith("mean") else F.col(c) for c in stats.columns])


@query
def prompt_render(spark, sf_dir):
    shown = with_template(roster(spark, sf_dir), TEMPLATES, "summary")
    return shown.select(F.col("Participant_ID").alias("participant_id"), *digest(shown, "Prompt", "prompt"))


def _main_prompts(spark, sf_dir):
    return with_prompt(roster(spark, sf_dir), MAIN_BODY, values={"criteria": F.lit(CRITERIA)})


@query
def prompt_defaults(spark, sf_dir):
    shown = _main_prompts(spark, sf_dir)
    return shown.select(F.col("Participant_ID").alias("participant_id"), *digest(shown, "Prompt", "prompt"))


@query
def messages_(spark, sf_dir):
    shown = with_template(roster(spark, sf_dir), TEMPLATES, "summary")
    turns = shown.select(F.col("Participant_ID").alias("participant_id"), F.posexplode(messages(F.col("Prompt"))).alias("turn", "m"))
    return turns.select("participant_id", "turn", "m.role", F.md5(F.col("m.content").cast("binary")).alias("content"))


@query
def prompt_inject_preview(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    x = inject_after(F.concat(F.lit(MARKER), F.col("text"), F.lit(MARKER)), MARKER, EXTRA)
    return docs.select("doc_id", x.alias("x")).select(
        "doc_id",
        F.md5(F.col("x").cast("binary")).alias("injected_md5"),
        prompt_preview(F.col("x")).alias("preview"),
        short_cell(F.col("x"), 3000).alias("summary"),
    )


# Candidates and generation


@query
def candidate_long(spark, sf_dir):
    wide = candidates(spark, sf_dir)
    return to_long(wide, ["Participant_ID"], candidate_columns(wide.columns)).withColumnRenamed("Participant_ID", "participant_id")


@query
def candidate_wide(spark, sf_dir):
    return to_wide(candidate_long(spark, sf_dir), ["participant_id"], "candidate_no", "text", N_CANDIDATES)


def _done(spark, sf_dir):
    text = F.when(F.col("quality") == 1, F.concat_ws(" ", F.lit("kept"), "doc_id", "k")).otherwise("")
    made = table(spark, sf_dir, "labels").select("doc_id", "quality", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    return made.select(F.col("doc_id").alias("participant_id"), F.col("k").alias("candidate_no"), text.alias("text"))


def _prompt_table(spark, sf_dir):
    return _main_prompts(spark, sf_dir).select(F.col("Participant_ID").alias("participant_id"), F.col("Prompt").alias("prompt"))


@query
def generate_resume(spark, sf_dir):
    done = _done(spark, sf_dir)
    new = generate(_prompt_table(spark, sf_dir), 5, per_request(keyed("participant_id", slice_call)), done, "participant_id")
    return merge_results(done, new.select(*done.columns), ["participant_id", "candidate_no"], "full")


@query
def generate_pending(spark, sf_dir):
    return requests(_prompt_table(spark, sf_dir), 5, _done(spark, sf_dir), "participant_id").drop("prompt")


@query
def pending_cells(spark, sf_dir):
    return pending(_done(spark, sf_dir)).select("participant_id", "candidate_no")


@query
def generate_progress(spark, sf_dir):
    return progress(_prompt_table(spark, sf_dir), _done(spark, sf_dir), 5, "participant_id")


@query
def generate_range_merge(spark, sf_dir):
    everyone = roster(spark, sf_dir)
    call = per_request(keyed("Participant_ID", slice_call))
    store = shared_path(spark, "range")
    merged = candidates_for_range(everyone, 302, 1_000_000_000, 3, call, TEMPLATES, "summary", store, "r1")
    if "Prompt" not in merged.columns:  # a table too small to have an id in range
        merged = merged.withColumns({c: F.lit(None).cast("string") for c in ("Prompt", "Rational_1", "Rational_2", "Rational_3")})
    cells = [f"Rational_{i}" for i in (1, 2, 3)]
    return merged.select(F.col("Participant_ID").alias("participant_id"), F.md5(F.col("Prompt").cast("binary")).alias("prompt_md5"), *cells)


@query
def repeats_wide(spark, sf_dir):
    prompts = _main_prompts(spark, sf_dir).select("Participant_ID", F.concat("Prompt", F.lit(MARKER)).alias("prompt"))
    # Ids in both tables are on two rows, and so get no response.
    rows = union_tables(
        table(spark, sf_dir, "labels").selectExpr("doc_id AS Participant_ID", "cast(quality AS bigint) AS note"),
        table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("Participant_ID")).agg(F.max("turn").alias("note")),
    )
    call = per_request(keyed("Participant_ID", slice_call))
    wide = generate_repeats(prompts, rows, 3, call, MARKER, EXTRA)
    return wide.withColumn("preview_md5", F.md5(F.col("Prompt_preview").cast("binary"))).drop("Prompt_preview").withColumnRenamed("Participant_ID", "participant_id")


# Selection


def _with_prompts(spark, sf_dir, step=1):
    return with_prompt(candidates(spark, sf_dir, step), MAIN_BODY, values={"criteria": F.lit(CRITERIA)})


@query
def selection_prompt_(spark, sf_dir):
    wide = _with_prompts(spark, sf_dir)
    texts = [F.col(c) for c in candidate_columns(wide.columns).values()]
    shown = wide.select(F.col("Participant_ID").alias("participant_id"), selection_prompt(texts, F.col("Prompt"), 5, SELECT_BODY).alias("p"))
    return shown.select("participant_id", *digest(shown, "p", "prompt"))


@query
def selection_job(spark, sf_dir):
    picked = select_best(_with_prompts(spark, sf_dir, step=2), 5, per_request(pick_call), SELECT_BODY)
    return picked.drop("response").withColumnRenamed("Participant_ID", "participant_id")


@query
def selection_parse(spark, sf_dir):
    picks = parse_picks(F.col("response"))
    return responses(spark, sf_dir).select(
        F.col("Participant_ID").alias("participant_id"), F.size(picks).alias("n_picks"), *pad_picks(picks, 5)
    )


@query
def selection_expand(spark, sf_dir):
    rows = expand_picks(selections(spark, sf_dir))
    return lower_names(rows.withColumn("transcript_md5", F.md5(F.col("Transcript").cast("binary"))).drop("Transcript"))


@query
def selection_expand_defaults(spark, sf_dir):
    listed = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("Participant_ID"), F.array(F.col("quality") + 1, F.col("toxic") + 5, F.col("doc_id") % 30 + 1).alias("numbers")
    )
    rows = expand_selection_with_defaults(selections(spark, sf_dir), defaults=listed)
    return rows.selectExpr("Participant_ID AS participant_id", "Exp_5_Selected_Rationale_Number AS number", "Exp_5_Selected_Rationale AS text")


@query
def selection_drops(spark, sf_dir):
    wide = selections(spark, sf_dir)
    return dropped_picks(wide, picks_from_cells(wide, [c for c in wide.columns if c.startswith("Selected_")]))


@query
def rationale_clean(spark, sf_dir):
    text, shape = F.col("text"), F.col("doc_id") % 4
    marked = (
        F.when(shape == 0, F.concat(text, F.lit("\n**Diagnosis:** depressed")))
        .when(shape == 1, F.concat(F.lit("**"), text, F.lit("** DIAGNOSIS: x\n")))
        .when(shape == 2, F.concat(text, F.lit("\nDiagnosis: d\nmore")))
        .otherwise(F.concat(F.lit("\u00a0"), text, F.lit(" ")))
    )
    cleaned = table(spark, sf_dir, "documents").select("doc_id", clean_rationale(marked).alias("c"))
    return cleaned.select("doc_id", *digest(cleaned, "c", "cleaned"))


@query
def select_expand_clean(spark, sf_dir):
    rows = select_and_expand(_with_prompts(spark, sf_dir), per_request(pick_call), SELECT_BODY)
    return lower_names(rows.select("Participant_ID", "Selected_Rationale_Number", "modified_rationale"))


# Few-shot


def _named(spark, sf_dir, *columns):
    """Expanded picks under their names."""
    rows = expand_picks(selections(spark, sf_dir))
    named = rows.withColumn("name", exemplar_key(F.col("Participant_ID"), F.col("Selected_Rationale_Number")))
    return named.select(*columns) if columns else named


def _tests(spark, sf_dir):
    built = build_transcripts(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], out="Transcript")
    gender = F.when(F.col("conv_id") % 2 == 0, "female").otherwise("male")
    return built.select(F.col("conv_id").alias("Participant_ID"), gender.alias("Gender"), "Transcript")


@query
def shots_with_reuse_(spark, sf_dir):
    drawn = shots_with_reuse(_named(spark, sf_dir, "Participant_ID", "name", "PHQ_Binary"))
    return lower_names(drawn.select("name", "Participant_ID", "zero_shot_name", "one_shot_name"))


@query
def shots_no_reuse_(spark, sf_dir):
    drawn = shots_no_reuse(_named(spark, sf_dir, "name", "PHQ_Binary"), _tests(spark, sf_dir))
    return lower_names(drawn.select("Participant_ID", "zero_shot_name", "one_shot_name"))


@query
def fewshot_train_prompt(spark, sf_dir):
    expanded = expand_picks(selections(spark, sf_dir))
    shown = training_prompts(expanded, TRAIN_BODY, number="Selected_Rationale_Number", text="Selected_Rationale")
    return shown.select("name", *digest(shown, "prompt", "prompt"))


@query
def fewshot_test_prompt(spark, sf_dir):
    named = bucketed(_named(spark, sf_dir, "name", "PHQ_Binary", "Gender", "Transcript", "Selected_Rationale"), "name", "exemplars")
    drawn = shots_no_reuse(named, _tests(spark, sf_dir))
    pid = F.col("Participant_ID")
    gaps = drawn.withColumn("zero_shot_name", F.when(pid % 3 != 0, F.col("zero_shot_name"))).withColumn(
        "one_shot_name", F.when(pid % 3 == 1, "nobody").otherwise(F.col("one_shot_name"))
    )
    shown = fewshot_prompt(gaps, named, TEST_BODY, "test", "Selected_Rationale", row_key="Participant_ID", unique=True)
    return shown.select(pid.alias("participant_id"), *digest(shown, "prompt", "prompt"))


# Scores


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def metrics_depression(spark, sf_dir):
    return _rounded(score_corpus(predictions(spark, sf_dir, "depressed", "non-depressed", "non-depressed"), "depression"))


@query
def metrics_accuracy(spark, sf_dir):
    return _rounded(score_corpus(predictions(spark, sf_dir, "Depressed", "non-depressed", "Non-depressed."), "depression_spoken"))


@query
def metrics_full(spark, sf_dir):
    return _rounded(score_corpus(predictions(spark, sf_dir, "PTSD", "non-PTSD", "Non-PTSD"), "ptsd"))


@query
def confusion_rows_(spark, sf_dir):
    return confusion_rows(predictions(spark, sf_dir, "PTSD", "non-PTSD", "Non-PTSD"), mapping=CORPORA["ptsd"][0])
