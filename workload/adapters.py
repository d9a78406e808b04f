"""The given tables in the shapes the library works on.

Each function has a twin in ``sql.py`` under the same name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_CANDIDATES = 30

# Short neutral templates; real ones are the caller's.
MAIN_BODY = (
    "Explain the finding ({{depression_status}}).\n"
    "Words of the {{gender}} speaker:\n{{transcript}}\n"
    "Criteria:\n{{criteria}}\nFinding: {{depression_status}}\n"
)
SUMMARY_BODY = "Sum up.\n{{transcript}}\n"
TEMPLATES = {"main": MAIN_BODY, "summary": SUMMARY_BODY}
CRITERIA = "A. low mood; B. loss of interest"
SELECT_BODY = "Prompt:\n{{prompt}}\nTexts:\n{{candidates}}\nPick the best {{k}} of {{n}}.\n"
TRAIN_BODY = (
    "\n Explain ({{status}}).\n1: {{zero_gender}}\n{{zero_transcript}}\nnon-depressed\n{{zero_text}}\n"
    "2: {{one_gender}}\n{{one_transcript}}\ndepressed\n{{one_text}}\n"
    "3: {{gender}}\n{{transcript}}\n{{status}} \n"
)
TEST_BODY = (
    "Judge.\n1: {{zero_gender}}\n{{zero_transcript}}\n{{zero_text}}\nnon-depressed\n"
    "2: {{one_gender}}\n{{one_transcript}}\n{{one_text}}\ndepressed\n"
    "3: {{gender}}\n{{transcript}}\nEnd with the finding.\n"
)
MARKER = "End with the finding."
EXTRA = "Do as in 1 and 2."


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_number(hashed: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(hashed, start, digits), 16, 10).cast("bigint")


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as interviews; those with labels have a class."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("Participant_ID"),
        F.when(F.col("doc_id") % 2 == 0, "female").otherwise("male").alias("Gender"),
        F.col("toxic").alias("PHQ_Binary"),
        F.col("quality").alias("PHQ_Score"),
        F.col("text").alias("Transcript"),
    )


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns, named as if each role of a conversation had its own file."""
    turns = table(spark, sf_dir, "conversations")
    name = F.format_string("%04d_%s_Transcript.csv", F.col("conv_id"), F.col("role"))
    return turns.select("conv_id", "turn", F.col("text"), name.alias("file_name"), F.lit(0).alias("block"), F.col("turn").alias("line"))


def candidates(spark: SparkSession, sf_dir: str, step: int = 1) -> DataFrame:
    """Roster with the whole text cut into 30 equal candidates, numbered in steps of ``step``.

    Null where a short text has nothing left.
    """
    base = roster(spark, sf_dir)
    measured = base.withColumn("__n", F.length("Transcript")).withColumn("__w", F.expr(f"cast(ceil(__n / {N_CANDIDATES}) as int)"))
    # A substring is found by walking from the start, so cut blocks of five first.
    blocks = [f"substring(Transcript, {i} * __w + 1, 5 * __w) AS __b{i}" for i in range(0, N_CANDIDATES, 5)]
    cells = [
        f"CASE WHEN {i} * __w < __n THEN substring(__b{i - i % 5}, {i % 5} * __w + 1, __w) END AS Rational_{(i + 1) * step}"
        for i in range(N_CANDIDATES)
    ]
    return measured.selectExpr("*", *blocks).selectExpr(*base.columns, *cells)


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with five selection cells: numbers as text, notes, junk and nulls."""
    hashed = candidates(spark, sf_dir).withColumn("__h", F.expr("md5(concat_ws(':', Participant_ID, Transcript))"))
    numbers = [f"cast(conv(substring(__h, {2 * i - 1}, 2), 16, 10) as bigint) % 33 AS __n{i}" for i in range(1, 6)]
    cells = [
        f"CASE WHEN __n{i} % 8 = 0 THEN NULL WHEN __n{i} % 8 = 1 THEN 'x' WHEN __n{i} % 8 = 2 THEN concat('No. ', __n{i}) "
        f"ELSE cast(__n{i} as string) END AS Selected_Rational_Number_{i}"
        for i in range(1, 6)
    ]
    names = [c for c in hashed.columns if c != "__h"]
    return hashed.selectExpr(*names, *numbers).selectExpr(*names, *cells)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One free-text answer per document, in six shapes."""
    h = F.md5(F.col("text").cast("binary"))
    a, b, c = [(hex_number(h, 1 + 4 * i, 4) % 30 + 1).cast("string") for i in range(3)]
    shape = F.col("doc_id") % 6
    answer = (
        F.when(shape == 0, F.concat(F.lit("["), a, F.lit(", "), b, F.lit(", "), c, F.lit("]")))
        .when(shape == 1, F.concat(F.lit("Best: ["), a, F.lit(","), b, F.lit("] before 2")))
        .when(shape == 2, F.concat(a, F.lit(" and "), b, F.lit(", then "), c))
        .when(shape == 3, F.concat(F.lit("["), a, F.lit(",,"), b, F.lit("] or "), c))
        .when(shape == 4, F.concat(F.lit("[0"), a, F.lit("]")))
        .otherwise("none of them")
    )
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("Participant_ID"), answer.alias("response"))


def predictions(spark: SparkSession, sf_dir: str, positive: str, negative: str, other: str) -> DataFrame:
    """Labels with three models that err on different rows; the third answers in numbers."""
    labels = table(spark, sf_dir, "labels")

    def guess(m: int) -> Column:
        wrong = (F.col("doc_id") * m) % 7 == 0
        return F.when(wrong, 1 - F.col("toxic")).otherwise(F.col("toxic"))

    spelled = F.when(guess(3) == 1, positive).otherwise(F.when(F.col("doc_id") % 2 == 0, other).otherwise(negative))
    return labels.select(
        F.col("toxic").alias("label"),
        F.when(guess(1) == 1, positive).otherwise(negative).alias("predict1"),
        spelled.alias("predict2"),
        guess(5).cast("string").alias("predict3"),
    )


def slice_call(request: dict) -> str:
    """Stand-in for a model: 60 characters of the prompt from a hashed place on, and a digest of all of it."""
    h = hashlib.md5(f"{request['key']}:{request['candidate_no']}".encode()).hexdigest()
    prompt = request["prompt"]
    start = int(h[:8], 16) % len(prompt)
    return prompt[start : start + 60] + ":" + hashlib.md5(prompt.encode()).hexdigest()


def keyed(key: str, call):
    """``call`` for requests whose key column is named ``key``."""
    return lambda request: call({**request, "key": request[key]})


def pick_call(request: dict) -> str:
    """Stand-in for a judge: five hashed positions, some out of range, as a list or as prose."""
    h = hashlib.md5(request["prompt"].encode()).hexdigest()
    a = [int(h[4 * i : 4 * i + 4], 16) % 33 + 1 for i in range(5)]
    if h[0] < "8":
        return str(a)
    return f"Best: {a[0]} and {a[1]}, then {a[2]}."
