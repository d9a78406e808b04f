import json
import random
import re

import pytest
from pyspark.sql import functions as F

from interviewflow import defaults
from interviewflow.functions.columns import candidate_columns, find_columns, require_columns, resolve_column
from interviewflow.functions.ids import (
    exemplar_key,
    id_from_filename,
    int_id,
    normalize_id,
    padded_id,
    text_id,
)
from interviewflow.functions.labels import decode_labels, status_text
from interviewflow.functions.picks import pad_picks, parse_picks, picks_for, picks_from_cells
from interviewflow.functions.templates import (
    choose_template,
    messages,
    numbered_blocks,
    placeholders,
    render,
    selection_prompt,
)
from interviewflow.functions.text import (
    clean_rationale,
    collapse_ws,
    inject_after,
    null_tokens,
    prompt_preview,
    strip_ws,
    token_count,
)

SPACES = [chr(i) for i in range(0x3100) if chr(i).isspace()]


def random_texts(parts, n=300, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_whitespace_is_what_python_calls_space():
    assert set(defaults.WHITESPACE) == set(SPACES)


def test_null_tokens(apply):
    cells = ["NA", "None", "", "12", "two\nlines", " hi  \"there\" ", "na", None]
    assert apply(null_tokens, cells) == [None, None, None, "12", "two\nlines", " hi  \"there\" ", "na", None]


def test_strip_and_collapse_match_python(apply):
    texts = random_texts([*SPACES, "a", "b", "é", "中"])
    assert apply(strip_ws, texts) == [t.strip() for t in texts]
    assert apply(collapse_ws, texts) == [re.sub(r"\s+", " ", t.strip()) for t in texts]


def test_normalize_id(apply):
    cells = [" 0302 ", "P_302", "302.0", "-5", "abc ", None, "000", "12345678901234567890123"]
    assert apply(normalize_id, cells) == ["302", "302", "302", "5", "abc", None, "0", "12345678901234567890123"]


def test_id_from_filename(apply):
    names = ["0302_Transcript.csv", "x302_Transcript.csv", " 12_a.csv", "plain"]
    assert apply(id_from_filename, names) == ["0302", "x302", " 12", "plain"]
    assert apply(lambda c: id_from_filename(c, strict=True), names) == ["0302", None, "12", None]


def test_int_id(apply):
    cells = ["302", " 302 ", "302.0", "3.02e2", "302.5", "x", "", None, "9007199254740993", "12d", "NaN", "Infinity"]
    assert apply(int_id, cells) == [302, 302, 302, 302, None, None, None, None, 9007199254740993, None, None, None]
    assert apply(int_id, [302.0, 1.5, float("nan"), None], "double") == [302, None, None, None]


def test_text_id_keeps_zeros(apply):
    assert apply(text_id, [" 007 ", "7", None]) == ["007", "7", None]


def test_padded_id_sorts_like_zfill(apply):
    cells = ["7", "10", "12345678901234567890", "-5", "+5", "", None]
    assert apply(padded_id, cells) == [None if c is None else c.zfill(16) for c in cells]


def test_exemplar_key(spark):
    df = spark.createDataFrame([(302, 5.0)], "i int, n double")
    assert df.select(exemplar_key(F.col("i"), F.col("n"))).first()[0] == "302_5"


def test_status_text(apply):
    assert apply(status_text, [1, 0, None], "int") == ["depressed", "non-depressed", "non-depressed"]
    assert apply(lambda c: status_text(c, null_status="unknown"), [1, 0, None], "int")[2] == "unknown"


def test_decode_labels(apply):
    spoken = defaults.LABELS_DEPRESSION_SPOKEN
    assert apply(lambda c: decode_labels(c, spoken), ["Non-depressed.", "Depressed", "1", None]) == [0, 1, 1, None]
    assert apply(lambda c: decode_labels(c, spoken, strict=False), ["maybe"]) == [None]
    assert apply(lambda c: decode_labels(c, {}, "double"), [1.0, 0.0], "double") == [1, 0]
    with pytest.raises(Exception, match="maybe"):
        apply(lambda c: decode_labels(c, spoken), ["maybe"])


def test_clean_rationale_known_cases(apply):
    cells = [
        "a **b** Diagnosis: depressed",
        "x\nDiagnosis: depressed\n",
        "x\nDiagnosis: d\nmore",
        "DIAGNOSIS: a\r\nmore",
        "  lead Diagnosis: q  ",
        "a\x1cb \x1c",
        "\u3000x\u3000",
        None,
    ]
    expected = ["a b", "x", "x\nDiagnosis: d\nmore", "DIAGNOSIS: a\r\nmore", "lead", "a\x1cb", "x", ""]
    assert apply(clean_rationale, cells) == expected


def test_clean_rationale_matches_python(apply):
    texts = random_texts(["Diagnosis:", "diagnosis:", "DIAGNOSIS:", "Diagnoſis:", "**", "*", "\n", "\r", " ", "\x85", "\u00a0", "x"], 500)
    expected = [re.sub(r"Diagnosis:.*$", "", t.replace("**", ""), flags=re.IGNORECASE).strip() for t in texts]
    assert apply(clean_rationale, texts) == expected


def test_clean_rationale_all_lines(apply):
    assert apply(lambda c: clean_rationale(c, all_lines=True), ["x\nDiagnosis: d\nmore"]) == ["x\n\nmore"]


def test_inject_after(apply):
    cells = ["a END b END c", "none", "END", None]
    assert apply(lambda c: inject_after(c, "END", "more"), cells) == ["a END\nmore b END c", "none", "END\nmore", None]


def test_prompt_preview(apply):
    mark = defaults.PREVIEW_MARK
    texts = ["é" * 1000, "ab" * 500 + "c", "xyz" * 6667]
    expected = [t if len(t) <= 1000 else t[:500] + mark + t[-10000:] for t in texts]
    assert apply(prompt_preview, texts) == expected


def test_token_count(apply):
    assert apply(token_count, ["Hi, you!", "", None, "über_9 中文."]) == [4, 0, 0, 3]


def test_token_count_with_tokenizer(apply):
    built = lambda: lambda text: text.split("-")
    assert apply(lambda c: token_count(c, built), ["a-b-c", "a", None]) == [3, 1, 0]


def test_render_inserts_verbatim(spark):
    row = spark.createDataFrame([("{{gender}} $x \\1", "f")], "transcript string, gender string")
    values = {"transcript": F.col("transcript"), "gender": F.col("gender")}
    assert row.select(render("<{{ gender }}|{{transcript}}>", values)).first()[0] == "<f|{{gender}} $x \\1>"


@pytest.mark.parametrize("gender", [None, ""])
def test_render_names_the_missing_value(spark, gender):
    row = spark.createDataFrame([("t", gender)], "transcript string, gender string")
    prompt = render("{{gender}} {{transcript}}", {"transcript": F.col("transcript"), "gender": F.col("gender")}, "main")
    with pytest.raises(Exception, match="'main' got no value for 'gender'"):
        row.select(prompt).collect()


def test_render_needs_every_placeholder():
    with pytest.raises(ValueError, match="criteria"):
        render("{{criteria}}", {})
    assert placeholders("{{a}} {{b}} {{a}}") == ["a", "b"]


def test_choose_template():
    assert choose_template({"main": "m", "x": "y"}, "x") == ("x", "y")
    assert choose_template({"main": "m"}, "other") == ("main", "m")


def test_messages(spark):
    turns = spark.range(1).select(messages(F.lit("p"), "system")).first()[0]
    assert [(t.role, t.content) for t in turns] == [("system", "p"), ("user", "Medical Rationale: ")]


def test_selection_prompt(spark):
    row = spark.createDataFrame([("a", None, None)], "c1 string, c2 string, p string")
    texts = [F.col("c1"), F.col("c2")]
    blocks = row.select(numbered_blocks(texts)).first()[0]
    assert blocks == "\n".join(f"\n--- RATIONALE {i + 1} ---\n{t}\n" for i, t in enumerate(["a", ""]))
    body = "{{prompt}}|{{candidates}}|{{k}} of {{n}}"
    assert row.select(selection_prompt(texts, F.col("p"), 1, body)).first()[0] == f"No specific prompt provided.|{blocks}|1 of 2"
    assert row.select(selection_prompt(texts, None, 1, body)).first()[0].startswith("No prompt column found in the data.|")


def test_picks_for():
    assert [picks_for(n) for n in (30, 15, 5, 7)] == [5, 5, 1, 1]


ANSWERS = {
    "[5, 10, 14]": [5, 10, 14],
    "Best: [3,7] because 2": [3, 7],
    "3 and 8": [3, 8],
    "[1,,2] x 9": [1, 2, 9],
    "[01]": [1],
    "[1 2]": [1, 2],
    "[]": [],
    "[ ]": [],
    "none": [],
    "[2,\n4]": [2, 4],
    "see [a] then [6]": [6],
    "[ 1] 7": [1, 7],
}


def test_parse_picks(apply):
    assert apply(parse_picks, list(ANSWERS)) == list(ANSWERS.values())


def test_parse_picks_matches_python(apply):
    def reading(text):
        hit = re.search(r"\[[\d,\s]+\]", text)
        if hit:
            try:
                return json.loads(hit.group())
            except ValueError:
                pass
        return [int(n) for n in re.findall(r"\d+", text)]

    texts = random_texts(["[", "]", ",", " ", "0", "7", "12", "x", "\n", "\t", "\x0b"], 800)
    assert apply(parse_picks, texts) == [reading(t) for t in texts]


def test_parse_picks_too_long_number_keeps_its_place(apply):
    assert apply(parse_picks, ["[1, 99999999999999999999, 2]"]) == [[1, None, 2]]


def test_pad_picks(spark):
    df = spark.createDataFrame([([1, 2, 3],), (list(range(7)),)], "p array<bigint>")
    rows = df.select(*pad_picks(F.col("p"), 5)).collect()
    assert list(rows[0]) == [1, 2, 3, None, None] and list(rows[1]) == [0, 1, 2, 3, 4]
    assert df.select(*pad_picks(F.col("p"), 2)).columns == ["Selected_Rational_Number_1", "Selected_Rational_Number_2"]


def test_picks_from_cells(spark):
    df = spark.createDataFrame([(7.0, "No. 7", "x", None, 5, "2")], "a double, b string, c string, d string, e int, f string")
    assert df.select(picks_from_cells(df, df.columns)).first()[0] == [2, 5, 7]
    assert df.select(picks_from_cells(df, ["b", "f"], strict=True)).first()[0] == [2]


def test_resolve_column():
    assert resolve_column(["x", "ID"]) == "ID"
    assert resolve_column(["id", "Participant_ID"]) == "Participant_ID"
    assert resolve_column(["my_participant_identity"]) == "my_participant_identity"
    assert resolve_column(["a", "b"], chosen="b") == "b"
    for columns, chosen in ((["a"], None), (["a"], "z")):
        with pytest.raises(ValueError):
            resolve_column(columns, chosen=chosen)


def test_find_columns():
    names = ["Selected_Rational_Number_1", "selected_rationale_number_2", "Selection", "Other"]
    assert find_columns(names) == names[:2]
    assert find_columns(["My_Selection"]) == ["My_Selection"]
    assert find_columns(["a1", "b1"], ["a", "b"], "all") == ["a1", "b1"]
    with pytest.raises(ValueError):
        find_columns(["x"])


def test_candidate_columns():
    names = ["Rational_10", "rational_2", "Rationale_2", "Rationale3", "Rational_04", "Rational_", "Selected_Rational_1"]
    assert candidate_columns(names) == {2: "rational_2", 3: "Rationale3", 10: "Rational_10"}
    with pytest.raises(ValueError):
        candidate_columns(["x"])


def test_require_columns(spark):
    with pytest.raises(ValueError, match="absent"):
        require_columns(spark.range(1), ["id", "absent"])


def test_text_cells_of_a_table_read_from_csv(spark):
    from interviewflow.functions.ids import exemplar_key
    from interviewflow.functions.labels import label_of
    from interviewflow.operators.candidates import expand_picks
    from interviewflow.operators.fewshot import shots_no_reuse, shots_with_reuse
    from interviewflow.operators.tables import profile
    from interviewflow.plans.candidates import with_prompt, with_template

    df = spark.createDataFrame(
        [("302", "1.0", "f", "t", "5.0", "3000000000", "c"), ("1000", "0.0", "m", "u", None, "1", "d"), ("7", None, "m", "v", "2", "x", "e")],
        "Participant_ID string, PHQ_Binary string, Gender string, Transcript string, no string, Selected_Rational_Number_1 string, Rational_1 string",
    )
    assert [r[0] for r in df.select(label_of(df, "PHQ_Binary")).collect()] == [1, 0, None]
    assert [r.Prompt for r in with_prompt(df, "{{depression_status}}").collect()] == ["depressed", "non-depressed", "unknown"]
    labelled = df.where("PHQ_Binary IS NOT NULL")
    shown = with_template(labelled, {"main": "{{depression_status}}"})
    assert [r.Prompt for r in shown.collect()] == ["depressed", "non-depressed"]
    assert [r[0] for r in df.select(exemplar_key(F.col("Participant_ID"), F.col("no"))).collect()] == ["302_5", None, "7_2"]
    assert profile(df).select("min_id", "max_id").first() == (7, 1000)
    assert [tuple(r) for r in expand_picks(df, id_col="Participant_ID").select("Participant_ID", "Selected_Rationale").collect()] == [("1000", "d")]
    named = labelled.withColumn("name", F.col("Participant_ID"))
    drawn = {r.name: (r.zero_shot_name, r.one_shot_name) for r in shots_with_reuse(named).collect()}
    assert drawn == {"302": ("1000", ""), "1000": ("", "302")}
    one = spark.createDataFrame([(1,)], "Participant_ID int")
    assert shots_no_reuse(named, one).select("zero_shot_name", "one_shot_name").first() == ("1000", "302")


def test_long_whole_numbers_keep_their_digits(apply):
    from interviewflow.functions.ids import int_id

    cells = ["9007199254740993.0", "9007199254740993", "1e3", "1.5", "+7.", "99999999999999999999.0", ".0"]
    assert apply(int_id, cells) == [9007199254740993, 9007199254740993, 1000, None, 7, None, 0]
