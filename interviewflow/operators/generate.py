"""Batch jobs around a text generator the user plugs in.

The generator is the only place where rows leave the JVM. Its calls are paid
and need not be repeatable, so write the result (``run_resumable``) before
using it twice: a lazy plan would call again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from interviewflow.defaults import PREVIEW_MARK, PREVIEW_SIZES
from interviewflow.functions.columns import candidate_columns, require_columns
from interviewflow.functions.picks import pad_picks, parse_picks
from interviewflow.functions.templates import selection_prompt
from interviewflow.functions.text import inject_after, prompt_preview, token_count
from interviewflow.operators.candidates import positions_to_numbers
from interviewflow.operators.reshape import to_wide
from interviewflow.operators.spread import spread_join
from interviewflow.operators.store import (
    COLUMNS,
    PACK_AT,
    append_results,
    attempt_ledger,
    committed,
    key_text,
    live_batches,
    pack,
    read_results,
)
from interviewflow.operators.tables import keep_first, require_unique
from interviewflow.session import kept
from interviewflow.sources.files import delete
from interviewflow.sources.texts import put_together


class Generator(Protocol):
    """Maps frames of (key, candidate_no, prompt) to frames of the result columns.

    Result columns: key, candidate_no, text, status, error, attempts.
    """

    def __call__(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


class Reply(NamedTuple):
    """What one request came to."""

    text: str | None
    status: str = "ok"
    error: str | None = None
    attempts: int = 1


Call = Callable[[dict], "str | Reply"]


def per_request(call: Call) -> Generator:
    """Generator out of a function of one request ``{key, candidate_no, prompt}``.

    A request that raises gives a null text with its error; the others go on.
    """

    def answer(request: dict) -> Reply:
        try:
            reply = call(request)
        except Exception as problem:
            return Reply(None, "failed", str(problem))
        return reply if isinstance(reply, Reply) else Reply(reply)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies = [answer(request) for request in frame.to_dict("records")]
            out = frame[[c for c in frame.columns if c != "prompt"]].reset_index(drop=True)
            answers = pd.DataFrame(replies, columns=list(Reply._fields), dtype=object)
            yield pd.concat([out, answers.astype({"attempts": "int32"})], axis=1)

    return run


def of_recipes(generator: Generator) -> Generator:
    """``generator`` for requests whose prompt is a recipe (``sources.texts``): prompts are put together in the worker that asks.

    They are handed on in frames of few megabytes, without white space at their ends.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def whole() -> Iterator[pd.DataFrame]:
            for frame in frames:
                at = 0
                for texts in put_together(list(frame["prompt"]), strip=True):
                    part = frame.iloc[at : at + len(texts)]
                    yield part.assign(prompt=[t.decode() for t in texts])
                    at += len(texts)

        return generator(whole())

    return run


def with_retry(
    call: Call,
    retries: int = 3,
    base_delay: float = 1.0,
    retry_on: type[Exception] | tuple[type[Exception], ...] = Exception,
    sleep: Callable[[float], None] = time.sleep,
) -> Call:
    """``call`` tried up to ``retries`` times, the delay doubling; then an empty text."""

    def tried(request: dict) -> Reply:
        problem: Exception | None = None
        for attempt in range(1, retries + 1):
            try:
                reply = call(request)
            except retry_on as raised:
                problem = raised
                if attempt < retries:
                    sleep(base_delay * 2 ** (attempt - 1))
                continue
            return reply if isinstance(reply, Reply) else Reply(reply, attempts=attempt)
        return Reply("", "failed", str(problem), retries)

    return tried


def _result_schema(df: DataFrame, key: str) -> T.StructType:
    fields = [T.StructField(key, df.schema[key].dataType), T.StructField("candidate_no", T.IntegerType())]
    fields += [T.StructField(c, T.StringType()) for c in ("text", "status", "error")]
    return T.StructType([*fields, T.StructField("attempts", T.IntegerType())])


def finished(text: str = "text") -> Column:
    """Whether a result holds a text."""
    return F.coalesce(F.col(text), F.lit("")) != ""


def pending(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows without a text yet: null or empty."""
    return df.where(~finished(text))


def missing_numbers(prompts: DataFrame, n: int, done: DataFrame | None = None, key: str = "key", prompt: str = "prompt") -> DataFrame:
    """``key, prompt, numbers``: which of the ``n`` candidates of each key are still to be made.

    ``done`` holds results, or with no ``text`` the finished requests. The
    finished numbers of a key (at most ``n``) meet its prompt once.
    """
    require_columns(prompts, [key, prompt])
    base = prompts.select(key, F.col(prompt).alias("prompt"))
    numbers = F.sequence(F.lit(1), F.lit(n))
    if done is not None:
        given = done.where(finished()) if "text" in done.columns else done
        made = given.where(F.col("candidate_no").between(1, n)).select(key, "candidate_no").distinct()
        made = made.groupBy(key).agg(F.collect_set(F.col("candidate_no").cast("int")).alias("__made"))
        base = spread_join(base, made, key, "left")
        numbers = F.array_except(numbers, F.coalesce(F.col("__made"), F.array().cast("array<int>")))
    return base.select(key, "prompt", numbers.alias("numbers"))


def requests(prompts: DataFrame, n: int, done: DataFrame | None = None, key: str = "key", prompt: str = "prompt") -> DataFrame:
    """One row (key, candidate_no, prompt) for each of ``n`` candidates still to be made.

    Only then is a prompt repeated: long texts are not shuffled n times.
    """
    return missing_numbers(prompts, n, done, key, prompt).select(key, F.explode("numbers").alias("candidate_no"), "prompt")


def generate(
    prompts: DataFrame,
    n: int,
    generator: Generator,
    done: DataFrame | None = None,
    key: str = "key",
    prompt: str = "prompt",
    partitions: int | None = None,
) -> DataFrame:
    """Results for every request not in ``done``, one row each, failures included.

    A call takes much longer than moving its prompt, so requests are dealt
    evenly over ``partitions`` tasks, by default the session's number of
    shuffle partitions; 0 leaves them where their rows were read.
    """
    return asked(requests(prompts, n, done, key, prompt), generator, key, partitions)


def asked(todo: DataFrame, generator: Generator, key: str = "key", partitions: int | None = None) -> DataFrame:
    """Results of the requests (key, candidate_no, prompt), dealt like those of ``generate``."""
    if partitions is None:
        partitions = int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if partitions:
        todo = todo.repartition(partitions, key, "candidate_no")
    return todo.mapInPandas(generator, _result_schema(todo, key))


def latest_results(store: DataFrame, key: str = "key", run: str = "run_id") -> DataFrame:
    """One row per request of an append-only store: a finished one before others, then the first run."""
    ranked = store.withColumn("__open", ~finished())
    kept = keep_first(ranked, [key, "candidate_no"], ["__open", run], id_type=None)
    return kept.drop("__open")


def run_resumable(
    prompts: DataFrame,
    n: int,
    generator: Generator,
    store: str,
    run_id: str,
    key: str = "key",
    prompt: str = "prompt",
    batches: int = 1,
    partitions: int | None = None,
    known: DataFrame | None = None,
    max_attempts: int | None = None,
    retry_after: float = 0.0,
) -> DataFrame:
    """Adds the missing results to the store (see ``operators.store``) and returns all of them.

    ``known`` holds results made elsewhere (key, candidate_no, text); they are
    not asked for again and not copied to the store.

    ``batches`` splits the keys by hash and commits after each part, so a run
    that is stopped loses one part at most. The next run, with any ``run_id``
    and any type of the same keys, asks only for what is missing. A lost task
    repeats its calls; each request still counts once in the result. Keys must
    be unique; a repeated one is an error before the first call.

    Failures count over runs: a request with ``max_attempts`` failed attempts is
    not asked for again, and one that failed waits ``retry_after`` seconds,
    doubled with each attempt (``store.attempt_ledger`` shows both).

    What is missing is planned once, from keys, numbers and flags of the store
    and no texts. With several batches it is written beside the store, read per
    batch, and removed after the last. A batch writes no more files than it has
    tasks, and many small batches are packed into one.
    """
    spark = prompts.sparkSession
    require_unique(prompts, key)
    done = _settled(spark, store, prompts.schema[key].dataType, key, max_attempts, retry_after)
    if known is not None:
        done = done.unionByName(known.where(finished()).select(key, "candidate_no"))
    if batches == 1:
        answer_requests(requests(prompts, n, done, key, prompt), generator, store, run_id, key, partitions)
    else:
        pending_path = f"{store}/pending"
        part = F.pmod(F.xxhash64(key_text(key, prompts.schema[key].dataType)), F.lit(batches)).cast("int")
        tasks = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // batches)
        missing = missing_numbers(prompts, n, done, key, prompt).where(F.size("numbers") > 0).withColumn("part", part)
        spread = missing.repartition(tasks * batches, "part", F.pmod(F.xxhash64(key), F.lit(tasks)))
        spread.write.mode("overwrite").partitionBy("part").parquet(pending_path)
        kept = spark.read.schema(missing.schema).parquet(pending_path)
        for i in range(batches):
            todo = kept.where(F.col("part") == i).select(key, F.explode("numbers").alias("candidate_no"), "prompt")
            answer_requests(todo, generator, store, run_id, key, partitions)
        delete(spark, pending_path)
    if len(live_batches(spark, store)) > PACK_AT:
        pack(spark, store)
    return stored_results(spark, store, prompts.schema[key].dataType, key)


def _settled(spark, store: str, kind: T.DataType, key: str, max_attempts: int | None, retry_after: float) -> DataFrame:
    """Requests (key, candidate_no) of a store that are not to be asked now: finished, given up, or not yet due."""
    if max_attempts is None and not retry_after:
        rows = read_results(spark, store).where("finished")
    else:
        ledger = attempt_ledger(spark, store, max_attempts, retry_after)
        rows = ledger.where((F.col("state") != "open") | (F.col("due") > F.current_timestamp()))
    return rows.select(F.col("key").try_cast(kind).alias(key), "candidate_no")


def answer_requests(
    todo: DataFrame,
    generator: Generator,
    store: str,
    run_id: str,
    key: str = "key",
    partitions: int | None = None,
    name: str | None = None,
    **about,
) -> None:
    """Answers of the requests (key, candidate_no, prompt), as a committed batch of the store.

    ``name`` makes it the commit of that name: if it exists nothing is asked.
    """
    if name is not None and committed(todo.sparkSession, store, name):
        return
    text = key_text(key, todo.schema[key].dataType)
    fresh = asked(todo, generator, key, partitions)
    columns = {"key": text, "finished": finished(), "run_id": F.lit(run_id), "asked_at": F.current_timestamp()}
    rows = fresh.select(*[columns.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(COLUMNS)])
    append_results(rows, store, name, run_id=run_id, **about)


def stored_results(spark, store: str, kind: T.DataType | str = "string", key: str = "key") -> DataFrame:
    """One row per request of a store, keys as ``kind``; keys that are none are left out."""
    latest = latest_results(read_results(spark, store), "key").drop("finished", "asked_at")
    typed = latest.withColumn("key", F.col("key").try_cast(kind)).where("key IS NOT NULL")
    return typed.withColumnRenamed("key", key)


def merge_results(base: DataFrame, new: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``base`` with new values put in; a null never replaces a value.

    ``new`` has one row per key. ``full`` also appends keys only ``new`` has.
    """
    values = [c for c in new.columns if c not in keys]
    renamed = new.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in values])
    joined = base.join(renamed, keys, "full") if how == "full" else spread_join(base, renamed, keys, "left")
    return _merged(joined, base.columns, values)


def _merged(joined: DataFrame, columns: list[str], values: list[str]) -> DataFrame:
    merged = [F.coalesce(f"__new_{c}", F.col(c)).alias(c) if c in values else F.col(c) for c in columns]
    return joined.select(*merged, *[F.col(f"__new_{c}").alias(c) for c in values if c not in columns])


def merge_dealt(base: DataFrame, new: DataFrame, key: str, deal: str) -> DataFrame:
    """Like ``merge_results`` with a ``base`` in buckets of ``deal``, a column of few rows per value: its texts stay where they lie.

    Only keys and new values move: they are gathered per value of ``deal``.
    """
    values = [c for c in new.columns if c != key]
    placed = spread_join(new, base.select(key, deal), key)
    gathered = placed.groupBy(deal).agg(F.collect_list(F.struct(key, *values)).alias("__new"))
    own = F.get(F.filter("__new", lambda n: n[key] == F.col(key)), F.lit(0))
    joined = spread_join(base, gathered, deal, "left").withColumn("__own", own)
    for c in values:
        joined = joined.withColumn(f"__new_{c}", F.col(f"__own.{c}"))
    return _merged(joined, base.columns, values)


def progress(prompts: DataFrame, results: DataFrame, n: int, key: str = "key") -> DataFrame:
    """One row: responses expected, present and pending, and keys with at least one response.

    Results of keys without a prompt do not count.
    """
    made = results.where(finished() & F.col("candidate_no").between(1, n)).select(key, "candidate_no").distinct()
    made = made.join(prompts.select(key).distinct(), key, "left_semi")
    per_key = made.groupBy(key).agg(F.count(F.lit(1)).alias("made"))
    counted = prompts.select(F.lit(n).cast("bigint").alias("expected"), F.lit(0).cast("bigint").alias("made")).unionAll(
        per_key.select(F.lit(0).cast("bigint"), F.col("made"))
    )
    return counted.agg(
        F.coalesce(F.sum("expected"), F.lit(0)).alias("n_expected"),
        F.coalesce(F.sum("made"), F.lit(0)).alias("n_present"),
        F.coalesce(F.sum(F.col("expected") - F.col("made")), F.lit(0)).alias("n_pending"),
        F.count_if(F.col("made") > 0).alias("n_keys_started"),
    )


def select_best(
    df: DataFrame,
    k: int,
    generator: Generator,
    body: str,
    key: str = "Participant_ID",
    prompt_col: str | None = "Prompt",
    partitions: int | None = None,
    store: str | None = None,
    run_id: str = "run",
    batches: int = 1,
) -> DataFrame:
    """Picks of one request per row: key, response and ``k`` pick columns.

    The request shows the candidates by position; picks are given back as the
    numbers in the candidate column names. Keys must be unique; a job over the
    key column says so before the first call. With ``store`` the answers are
    kept there like those of ``run_resumable``; without, the result is lazy.
    """
    columns = candidate_columns(df.columns)
    asked = F.col(prompt_col) if prompt_col in df.columns else None
    texts = [F.col(f"`{c}`") for c in columns.values()]
    prompts = df.select(key, selection_prompt(texts, asked, k, body).alias("prompt"))
    if store is None:
        require_unique(df, key)
        answers = generate(prompts, 1, generator, key=key, partitions=partitions)
    else:
        answers = run_resumable(prompts, 1, generator, store, run_id, key, batches=batches, partitions=partitions)
        # The store may hold answers of rows that are not asked about here.
        answers = spread_join(answers, df.select(key), key, "left_semi")
    picks = positions_to_numbers(parse_picks(F.col("text")), columns)
    return answers.select(key, F.col("text").alias("response"), *pad_picks(picks, k))


def join_unique(prompts: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Prompts with the one table row of their key; keys with no row or several are left out."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    once = counts.where(F.col("__n") == 1).select(key)
    return spread_join(df, prompts.join(once, key, "left_semi"), key, "inner")


def generate_repeats(
    prompts: DataFrame,
    df: DataFrame,
    repeats: int,
    generator: Generator,
    marker: str,
    extra: str,
    key: str = "Participant_ID",
    done: DataFrame | None = None,
    tokenizer: Callable[[], Callable[[str], list]] | None = None,
    preview: tuple[int, int, int] = PREVIEW_SIZES,
    mark: str = PREVIEW_MARK,
    partitions: int | None = None,
    store: str | None = None,
    run_id: str = "run",
    batches: int = 1,
) -> DataFrame:
    """``df`` with ``repeats`` responses per prompt, their token counts and a prompt preview.

    ``extra`` is put behind the first ``marker`` of each prompt. Rows whose
    key has no prompt, or is not unique, keep null responses. ``done`` holds
    responses (key, candidate_no, text) made elsewhere. With ``store`` the job
    is resumable like ``run_resumable``; without, the result is lazy, and each
    use of it calls the generator again.
    """
    read = [c for c in df.columns if c != key]
    asked = join_unique(prompts.select(key, "prompt"), df.select(key), key)
    final = asked.select(key, inject_after(F.col("prompt"), marker, extra).alias("prompt"))
    if store is not None:
        # Read for the calls and for the preview.
        final = kept(final, "prompts")
    if store is None:
        made = generate(final, repeats, generator, done, key, partitions=partitions)
    else:
        made = run_resumable(final, repeats, generator, store, run_id, key, batches=batches, partitions=partitions, known=done)
    made = made.select(key, "candidate_no", "text")
    if done is not None:
        given = done.where(finished()).select(*made.columns)
        made = made.join(given.select(key, "candidate_no").distinct(), [key, "candidate_no"], "left_anti").unionByName(given)
    counted = made.select(key, "candidate_no", "text", token_count(F.col("text"), tokenizer).alias("tokens"))
    wide = to_wide(counted, [key], "candidate_no", {"text": "Generated_rationale_", "tokens": "Generated_token_"}, repeats)
    shown = final.select(key, prompt_preview(F.col("prompt"), *preview, mark=mark).alias("Prompt_preview"))
    added = wide.join(shown, key)
    new = [c for c in added.columns if c != key]
    return spread_join(df, added, key, "left").select(key, *read, *new)
