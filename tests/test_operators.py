import random

import pytest
from pyspark.sql import functions as F

from interviewflow.operators.candidates import (
    default_picks,
    default_picks_from_table,
    dropped_picks,
    expand_picks,
    positions_to_numbers,
)
from interviewflow.operators.reshape import renumber, to_long, to_wide
from interviewflow.operators.scoring import confusion_counts, confusion_rows, prediction_columns, report, score
from interviewflow.operators.spread import concat_ordered, concat_pieces, number_rows, spread_join
from interviewflow.operators.tables import (
    change_counts,
    class_pool,
    correct_labels,
    correction_report,
    distinct_keys,
    id_overlap,
    id_range,
    keep_first,
    keep_ids,
    preview,
    profile,
    require_rows,
    require_values,
    sort_ids,
    union_tables,
    unmatched,
)
from interviewflow.operators.tokens import token_stats, with_tokens
from interviewflow.operators.transcripts import (
    build_transcripts,
    count_updated,
    drop_blank,
    join_transcripts,
    update_transcripts,
)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Skewed joins, concatenation, numbering


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows: a third on key 1, a third on null, the rest spread."""
    n = F.col("id")
    key = F.when(n % 3 == 0, F.lit(1)).when(n % 3 == 1, F.lit(None)).otherwise(n)
    return spark.range(3000).select(key.cast("bigint").alias("k"), n.alias("v"))


def test_spread_join_refuses_other_kinds(skewed):
    with pytest.raises(ValueError):
        spread_join(skewed, skewed, "k", "full")


def test_number_rows_below_keeps_the_first_positions(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.md5(F.col("id").cast("string")).alias("h"), "id")
    order, bucket = [F.col("h"), F.col("id")], F.left("h", F.lit(2))
    every = number_rows(df, ["g"], order, bucket, "idx")
    assert bag(number_rows(df, ["g"], order, bucket, "idx", below=37)) == bag(every.where("idx < 37"))


def test_concat_ordered_equals_python(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), f"f{rng.randint(0, 2)}", i, rng.choice(["x", "y", None])) for i in range(500)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, file string, line int, t string").repartition(7)
    got = dict(rows(concat_ordered(df, ["k"], "t", ["file", "line"], bits=4)))
    for key in "ab":
        mine = sorted((f, i, t) for k, f, i, t in data if k == key)
        assert got[key] == " ".join(t for _, _, t in mine if t is not None)
    pieces, by = concat_pieces(df, ["k"], "t", ["file", "line"], bits=4)
    assert by == ["file", "__piece"] and pieces.count() > 20


def test_number_rows_equals_row_number(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("g"), F.md5(F.col("id").cast("string")).alias("h"), "id")
    numbered = number_rows(df, ["g"], [F.col("h"), F.col("id")], F.left("h", F.lit(2)), "idx")
    for g in (0, 1):
        mine = sorted((r.h, r.id, r.idx) for r in numbered.where(F.col("g") == g).collect())
        assert [i for _, _, i in mine] == list(range(1000))
    alone = number_rows(df, [], [F.col("h"), F.col("id")], F.left("h", F.lit(2)), "idx")
    assert [r.idx for r in sorted(alone.collect(), key=lambda r: (r.h, r.id))] == list(range(2000))


# Tables


def test_keep_first(spark):
    df = spark.createDataFrame([("1", 0), (None, 1), (None, 2), ("1.0", 3), ("x", 4)], "k string, ord int")
    assert rows(keep_first(df, "k", ["ord"]), "ord") == [("1", 0), (None, 1)]
    assert rows(keep_first(df, "k", ["ord"], "string"), "ord") == [("1", 0), (None, 1), ("1.0", 3), ("x", 4)]


def test_keep_first_limits_rows_before_the_shuffle(spark):
    df = spark.createDataFrame([("1", 0)], "k string, ord int").repartition(3)
    plan = keep_first(df, "k", ["ord"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_keep_ids(spark):
    df = spark.createDataFrame([("7",), ("10",), ("x",), (None,), (" 07",)], "i string")
    ids = spark.createDataFrame([("7",), ("10",), ("99",), (None,)], "i string")
    assert bag(keep_ids(df, ids, "i")) == [(" 07",), ("10",), ("7",)]
    assert bag(keep_ids(df, ids, "i", "string")) == [("10",), ("7",)]
    with pytest.raises(ValueError):
        keep_ids(df, ids, "i", "float")


def test_sort_ids(spark):
    df = spark.createDataFrame([("10", 0), ("7", 1), (None, 2), ("12345678901234567890", 3), ("7", 0)], "i string, ord int")
    assert [r[0] for r in rows(sort_ids(df, "i", "string", ["ord"]))] == ["7", "7", "10", "12345678901234567890", None]
    assert rows(sort_ids(df.where("ord < 3"), "i", "int", ["ord"])) == [("7", 0), ("7", 1), ("10", 0), (None, 2)]


def test_union_tables(spark):
    a, b = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(2, 3), (2, 3)], "b int, c int")
    both = union_tables(a, b)
    assert both.columns == ["a", "b", "c"]
    assert bag(both) == [(1, 2, None), (None, 2, 3), (None, 2, 3)]


def test_unmatched_and_overlap(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,), (None,)], "i int"), spark.createDataFrame([(2,), (3,)], "i int")
    assert bag(unmatched(a, b, "i")) == [(1,), (None,)]
    assert bag(id_overlap(a, b, "i")) == [(1, "left"), (2, "both"), (3, "right")]
    assert bag(distinct_keys(a, "i")) == [(1,), (2,)]


def test_label_correction(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (3, None)], "Participant_ID int, PHQ_Binary int")
    listed = spark.createDataFrame([(3,), (2,), (9,)], "Participant_ID int")
    for ids in ([3, 2, 9], listed):
        assert bag(correct_labels(df, ids)) == [(1, 0), (2, 1), (3, 1), (3, 1)]
        assert bag(correction_report(df, ids)) == [(2, 1, 0, False), (3, 2, 2, False), (9, 0, 0, True)]
    assert correct_labels(df.select("Participant_ID"), [1]).columns == ["Participant_ID"]
    assert bag(correct_labels(df)) == bag(df)


def test_counts_profile_preview(spark):
    df = spark.createDataFrame([(1, "a" * 300, None), (5, "b", "y")], "Participant_ID int, Rational_1 string, Rational_2 string")
    assert bag(change_counts(df, df.limit(1))) == [(2, 1, 1)]
    assert bag(change_counts(df.limit(0), df.limit(0))) == [(0, 0, 0)]
    assert bag(profile(df)) == [(2, 3, 2, 1, 5)]
    assert preview(df, ["Participant_ID"], 1, "Rational_1").first()["Rational_1"] == "a" * 200 + "..."


def test_checks(spark):
    df = spark.range(3)
    assert require_rows(df, "none") is df
    with pytest.raises(ValueError, match="none"):
        require_rows(df.limit(0), "none")
    assert require_values(df, F.col("id") >= 0, "low").count() == 3
    with pytest.raises(Exception, match="low"):
        require_values(df, F.col("id") > 0, "low").collect()


def test_id_range_and_pool(spark):
    df = spark.createDataFrame([("301", 0), ("302", 1), ("718", 0), ("x", 1)], "i string, c int")
    assert bag(id_range(df, "i", 302, 718)) == [("302", 1), ("718", 0)]
    assert bag(class_pool(df, "c", 1)) == [("302", 1), ("x", 1)]
    for lo, hi in ((-1, 5), (5, 4)):
        with pytest.raises(ValueError):
            id_range(df, "i", lo, hi)


# Transcripts


def test_build_transcripts(spark):
    data = [("p", 0, " a  b "), ("p", 1, " "), ("p", 2, "NA"), ("p", 3, "c"), ("q", 0, "None")]
    df = spark.createDataFrame(data, "id string, ord int, text string").repartition(3)
    assert bag(build_transcripts(df, "id", ["ord"], collapse=True)) == [("p", "a b c"), ("q", "")]
    assert bag(build_transcripts(df, "id", ["ord"])) == [("p", " a  b    c"), ("q", "")]


def test_files_of_one_id_are_joined_in_file_order(spark):
    from interviewflow.plans.transcripts import transcripts_by_id

    cells = [("302_b_T.csv", 0, "y"), ("0302_T.csv", 0, " x "), ("0302_T.csv", 1, "NA"), ("7_T.csv", 0, " "), ("x_T.csv", 0, "z")]
    df = spark.createDataFrame([(f, 0, i, t) for f, i, t in cells], "file_name string, block bigint, line bigint, text string")
    assert bag(transcripts_by_id(df)) == [("302", "x y")]


def test_drop_blank(spark):
    df = spark.createDataFrame([("a",), ("  \n",), (None,), ("",)], "t string")
    assert bag(drop_blank(df, "t")) == [("a",)]


def test_join_transcripts(spark):
    roster = spark.createDataFrame([(1, "f"), (2, "m"), (2, "n")], "Participant_ID int, g string")
    texts = spark.createDataFrame([("2", "t"), ("3", "u")], "Participant_ID string, transcript string")
    assert bag(join_transcripts(roster, texts)) == [("2", "m", "t"), ("2", "n", "t")]


@pytest.mark.parametrize("mode,want,n", [("overwrite", ["n1", "n2", "old"], 2), ("fillna", ["n1", "old", "old"], 1)])
def test_update_transcripts(spark, mode, want, n):
    roster = spark.createDataFrame([("01", None), ("2.0", "old"), ("3", "old")], "Participant_ID string, Transcript string")
    texts = spark.createDataFrame([("1", "n1"), ("2", "n2"), ("9", "n9")], "Participant_ID string, transcript string")
    new = update_transcripts(roster, texts, mode)
    assert [r[1] for r in rows(new, "Participant_ID")] == want
    assert bag(count_updated(new)) == [(n, 3)]


def test_update_adds_the_column_and_checks_the_mode(spark):
    roster = spark.createDataFrame([(1,)], "Participant_ID int")
    texts = spark.createDataFrame([("1", "n1"), (None, "x")], "Participant_ID string, transcript string")
    assert bag(update_transcripts(roster, texts)) == [(1, "n1", True)]
    with pytest.raises(ValueError):
        update_transcripts(roster, texts, "append")


# Reshaping, picks


def test_reshape_round_trip(spark):
    wide = spark.createDataFrame([(1, "a", None, "c")], "i int, Rational_1 string, Rational_2 string, Rational_3 string")
    long = to_long(wide, ["i"], {1: "Rational_1", 2: "Rational_2", 3: "Rational_3"})
    assert rows(long, "candidate_no") == [(1, 1, "a"), (1, 2, None), (1, 3, "c")]
    assert bag(to_wide(long, ["i"], "candidate_no", "text", 4)) == [(1, "a", None, "c", None)]
    named = to_long(wide, ["i"], ["Rational_1", "Rational_3"])
    assert bag(named) == [(1, "Rational_1", "a"), (1, "Rational_3", "c")]


def test_renumber_and_positions(spark):
    columns = {2: "Rational_2", 10: "Rational_10", 1: "Rational_1"}
    assert renumber(columns) == {1: 1, 2: 2, 3: 10}
    df = spark.createDataFrame([([1, 3, 4, 0],)], "p array<bigint>")
    ordered = dict(sorted(columns.items()))
    assert df.select(positions_to_numbers(F.col("p"), ordered)).first()[0] == [1, 10, None, None]
    assert df.select(positions_to_numbers(F.col("p"), {1: "a", 2: "b"})).first()[0] == [1, 3, 4, 0]


@pytest.fixture
def selected(spark):
    schema = "Participant_ID int, PHQ_Binary int, Gender string, Transcript string, Rational_1 string, Rationale_2 string, "
    schema += "Rational_3 string, Selected_Rational_Number_1 double, Selected_Rational_Number_2 string"
    data = [(1, 1, "f", "t1", "a", None, "c", 3.0, "No. 1"), (2, 0, "m", "t2", "a", None, "c", 2.0, "9"), (3, 0, "m", "t3", "a", "b", "c", None, "x")]
    return spark.createDataFrame(data, schema)


def test_expand_picks(selected):
    out = expand_picks(selected)
    assert out.columns == ["Participant_ID", "Gender", "PHQ_Binary", "Transcript", "Selected_Rationale_Number", "Selected_Rationale"]
    assert bag(out) == [(1, "f", 1, "t1", 1, "a"), (1, "f", 1, "t1", 3, "c")]


def test_expand_picks_needs_no_shuffle(selected):
    assert "Exchange" not in expand_picks(selected)._jdf.queryExecution().executedPlan().toString()


def test_dropped_picks(spark, selected):
    picks = F.array(F.lit(1), F.lit(2), F.lit(9)).cast("array<bigint>")
    assert bag(dropped_picks(selected, picks)) == [(9, 5)]


def test_default_picks(spark):
    df = spark.createDataFrame([(302, []), (302, [1]), (9, [])], "i int, p array<bigint>")
    listed = sorted({5, 10, 14, 21, 26, 1, 4, 7, 11, 17})
    assert [r[0] for r in df.select(default_picks(F.col("p"), F.col("i"))).collect()] == [listed, [1], []]
    table = spark.createDataFrame([("302", [7, 2, 7])], "i string, numbers array<int>")
    assert bag(default_picks_from_table(df, "p", table, "i", "numbers")) == [(302, [1]), (302, [2, 7]), (9, [])]


# Scores, tokens


def test_scores(spark):
    df = spark.createDataFrame([(1, "depressed"), (1, "non-depressed"), (0, "0"), (0, "1")], "label int, predict1 string")
    got = score(df, mapping={"non-depressed": 0, "depressed": 1})
    assert bag(got) == [("predict1", 1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5)]
    assert report(got, "depression").columns == ["model", "tp", "fp", "fn", "tn", "mean_f1"]
    with pytest.raises(ValueError):
        report(got, "other")
    assert bag(confusion_rows(df, mapping={"non-depressed": 0, "depressed": 1})) == [
        ("predict1", 0, 0, 1), ("predict1", 0, 1, 1), ("predict1", 1, 0, 1), ("predict1", 1, 1, 1)
    ]


def test_scores_of_one_class(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.9)], "label int, predict1 double")
    assert bag(score(df)) == [("predict1", 0, 0, 0, 2, 1.0, 0.0, 1.0, 0.0, 1.0, 0.5)]


def test_scores_refuse_unknown_labels(spark):
    for cell in ("maybe", "2", None):
        df = spark.createDataFrame([(0, cell)], "label int, predict1 string")
        with pytest.raises(Exception, match="label is not known|is not 0 or 1"):
            score(df).collect()
    loose = spark.createDataFrame([(0, "maybe"), (1, "1")], "label int, predict1 string")
    assert bag(confusion_counts(loose, strict=False)) == [("predict1", 1, 0, 0, 0)]
    assert prediction_columns(["label", "predict1", "predict12", "id", "predictx"]) == ["predict1", "predict12"]


def test_token_tables(spark):
    df = spark.createDataFrame([("a b", 3), (None, 0)], "Prompt string, Token_Length int")
    counted = with_tokens(df)
    assert bag(counted.select("token_count", "token_difference")) == [(0, 0), (2, -1)]
    assert bag(token_stats(counted)) == [(2, 1.0, 2, 0, -0.5, 0, -1)]
    assert token_stats(with_tokens(df.drop("Token_Length"))).columns == ["n_prompts", "mean_token_count", "max_token_count", "min_token_count"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_adaptive_plan_splits_the_hot_key(spark, how):
    """The kinds of join used for lookups are the kinds Spark splits."""
    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {name: spark.conf.get(name, None) for name in low}
    try:
        for name, value in low.items():
            spark.conf.set(name, value)
        n = F.col("id")
        left = spark.range(0, 60_000, 1, 8).select(F.when(n % 3 == 0, F.lit(1)).otherwise(n).alias("k"), F.md5(n.cast("string")).alias("v"))
        right = spark.range(500).select(n.alias("k"), F.lit("w").alias("w"))
        joined = spread_join(left, right, "k", how)
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
