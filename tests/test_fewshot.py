import re

import random
from collections import Counter
from pathlib import Path

import pytest
from pyarrow.fs import LocalFileSystem
from pyspark.sql import functions as F

from interviewflow.operators.fewshot import PICKS, attach_shots, fewshot_prompt, gather_talks, require_unique, shots_no_reuse, shots_with_reuse
from interviewflow.operators.generate import per_request, requests
from interviewflow.operators.store import read_results
from interviewflow.plans.fewshot import evaluation_prompts, evaluation_set, training_prompts, training_set
from interviewflow.session import shared_dir
from interviewflow.sources import texts
from interviewflow.sources.prompts import RemoteFolder
from workload.adapters import keyed, slice_call

SCHEMA = "Participant_ID int, PHQ_Binary int, name string"


def entries(people=20, hot=60):
    """One person has most entries; some people have no class."""
    data = []
    for p in range(people):
        for k in range(hot if p == 3 else 1 + p % 4):
            data.append((p, None if p % 7 == 6 else p % 2, f"{p}_{k}"))
    return data


def test_reuse_draws_right_class_and_other_people(spark):
    data = entries()
    random.Random(1).shuffle(data)
    drawn = shots_with_reuse(spark.createDataFrame(data, SCHEMA)).collect()
    label = {n: c for _, c, n in data}
    person = {n: p for p, _, n in data}
    assert sorted(r["name"] for r in drawn) == sorted(n for _, _, n in data)
    for r in drawn:
        for cls, shot in enumerate((r.zero_shot_name, r.one_shot_name)):
            assert label[shot] == cls and person[shot] != r.Participant_ID
    assert len({r.zero_shot_name for r in drawn}) > 10


def test_reuse_reaches_every_entry(spark):
    data = [(p, p % 2, f"{p}_{k}") for p in range(200) for k in range(2)]
    drawn = shots_with_reuse(spark.createDataFrame(data[:8] + [(500 + i, None, f"x{i}") for i in range(400)], SCHEMA))
    zeros = Counter(r.zero_shot_name for r in drawn.collect())
    assert set(zeros) == {"0_0", "0_1", "2_0", "2_1"} and min(zeros.values()) > 50


def test_reuse_does_not_depend_on_partitioning(spark):
    df = spark.createDataFrame(entries(), SCHEMA)
    names = [*df.columns, "zero_shot_name", "one_shot_name"]
    first = sorted(map(tuple, shots_with_reuse(df.repartition(1)).select(*names).collect()), key=repr)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 13):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            again = shots_with_reuse(df.orderBy(F.rand(n)).repartition(n + 4))
            assert sorted(map(tuple, again.select(*names).collect()), key=repr) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(first) == df.count()
    other = shots_with_reuse(df, seed=7).select("name", "zero_shot_name", "one_shot_name")
    assert sorted(map(tuple, other.collect())) != sorted((r['name'], r.zero_shot_name, r.one_shot_name) for r in shots_with_reuse(df).collect())


def test_reuse_without_anyone_else(spark):
    df = spark.createDataFrame([(1, 0, "1_1"), (1, 0, "1_2"), (2, None, "2_1")], SCHEMA)
    got = {r["name"]: (r.zero_shot_name, r.one_shot_name) for r in shots_with_reuse(df).collect()}
    assert got["1_1"] == got["1_2"] == ("", "")
    assert got["2_1"][0] in ("1_1", "1_2") and got["2_1"][1] == ""


def test_repeated_names_are_refused(spark):
    df = spark.createDataFrame([(1, 0, "1_1"), (1, 0, "1_1")], SCHEMA)
    with pytest.raises(Exception, match="name is not unique: 1_1"):
        shots_with_reuse(df)
    with pytest.raises(ValueError, match="1_1"):
        require_unique(df, "name")


def test_no_reuse_uses_each_once(spark):
    train = spark.createDataFrame([(i, i % 2, f"n{i}") for i in range(600)], SCHEMA)
    test = spark.createDataFrame([(1000 + i,) for i in range(300)], "Participant_ID int")
    drawn = shots_no_reuse(train, test).collect()
    assert len(drawn) == 300
    assert {r.zero_shot_name for r in drawn} == {f"n{i}" for i in range(0, 600, 2)}
    assert {r.one_shot_name for r in drawn} == {f"n{i}" for i in range(1, 600, 2)}
    again = shots_no_reuse(train.repartition(5), test.repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, drawn))
    assert sorted(map(tuple, shots_no_reuse(train, test, seed=1).collect())) != sorted(map(tuple, drawn))


def test_no_reuse_names_both_sizes(spark):
    train = spark.createDataFrame([(i, i % 2, f"n{i}") for i in range(5)], SCHEMA)
    test = spark.createDataFrame([(i,) for i in range(3)], "Participant_ID int")
    with pytest.raises(ValueError, match="need 3 .* 3 zeros and 2 ones"):
        shots_no_reuse(train, test)


@pytest.fixture
def pool(spark):
    return spark.createDataFrame([("a", "f", "ta", "ra"), ("b", None, "tb", None)], "name string, Gender string, Transcript string, text string")


FIELDS = {"gender": "Gender", "transcript": "Transcript", "text": "text"}


def test_lookup_falls_back_to_own_fields(spark, pool):
    schema = "name string, Gender string, Transcript string, zero_shot_name string, one_shot_name string"
    df = spark.createDataFrame([("r1", "m", "own", None, "b"), ("r2", "m", "own", "zzz", "a")], schema)
    got = {r["name"]: r for r in attach_shots(df, pool, FIELDS, strict=False).collect()}
    assert (got["r1"].zero_gender, got["r1"].zero_transcript, got["r1"].zero_text) == ("m", "own", None)
    assert (got["r1"].one_gender, got["r1"].one_transcript, got["r1"].one_text) == (None, "tb", None)
    assert got["r2"].zero_transcript == "own" and got["r2"].one_text == "ra"


def test_strict_lookup_names_the_missing_exemplar(spark, pool):
    df = spark.createDataFrame([("r", "a", "zzz")], "name string, zero_shot_name string, one_shot_name string")
    with pytest.raises(Exception, match="no exemplar named zzz"):
        attach_shots(df, pool, FIELDS).collect()
    with pytest.raises(ValueError, match="not unique"):
        attach_shots(df, pool.union(pool), FIELDS)


BODY = "  1 {{zero_gender}}/{{zero_transcript}}/{{zero_text}} 2 {{one_gender}}/{{one_transcript}}/{{one_text}} 3 {{gender}}/{{transcript}} "


def test_prompts(spark, pool):
    schema = "name string, Gender string, Transcript string, PHQ_Binary int, zero_shot_name string, one_shot_name string"
    df = spark.createDataFrame([("r", "m", "own {{gender}}", 1, "a", "b")], schema)
    train = fewshot_prompt(df, pool, BODY + "{{status}} ", "train", "text")
    assert train.columns == [*df.columns, "prompt"]
    assert train.first().prompt == "1 f/ta/ra 2 /tb/ 3 m/own {{gender}} depressed"
    test = fewshot_prompt(df, pool, BODY, "test", "text")
    assert test.first().prompt == "  1 f/ta/ra 2 /tb/ 3 m/own {{gender}} "
    with pytest.raises(ValueError):
        fewshot_prompt(df, pool, BODY, "other", "text")


def test_both_sets_end_to_end(spark, tmp_path):
    data = [(p, p % 2, "f", f"talk {p}", k, f"reason {p} {k}") for p in range(12) for k in (1, 2)]
    schema = "Participant_ID int, PHQ_Binary int, Gender string, Transcript string, "
    schema += "Exp_5_Selected_Rationale_Number int, Exp_5_Selected_Rationale string"
    prompts = training_prompts(spark.createDataFrame(data, schema), BODY + "{{status}}")
    assert prompts.where("Token_Count > 0").count() == 24
    train = training_set(prompts, per_request(keyed("name", slice_call)), str(tmp_path / "train"), "r1")
    assert train.where("Generated_Rationale <> '' AND Generated_Token_Count > 0").count() == 24

    test = spark.createDataFrame([(100 + i, "m", f"test talk {i}") for i in range(5)], "Participant_ID int, Gender string, Transcript string")
    shown = evaluation_prompts(train, test, BODY + "END.")
    done = evaluation_set(shown, per_request(keyed("Participant_ID", slice_call)), "END.", "More.", repeats=2)
    rows = done.collect()
    assert len(rows) == 5 and all(r.Prompt_preview.endswith("END.\nMore.") for r in rows)
    assert all(r.Generated_rationale_1 and r.Generated_rationale_2 and r.Generated_token_2 for r in rows)


def moved(df, *texts):
    """Exchanges of the plan that carry one of the columns ``texts``."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    blocks = [b.split("\n") for b in plan.split("\n\n") if re.match(r"\(\d+\) (Broadcast)?Exchange", b.strip())]
    return [b for b in blocks if any(re.search(rf"\b{t}#", line) for t in texts for line in b if line.startswith("Input"))]


def test_exemplar_texts_move_once_to_their_prompt(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(40).selectExpr(
            "id AS Participant_ID", "id % 3 AS Exp_5_Selected_Rationale_Number", "repeat('t', 9) AS Transcript",
            "repeat('r', 9) AS Exp_5_Selected_Rationale", "repeat('r', 9) AS Generated_Rationale", "cast(id % 2 AS int) AS PHQ_Binary", "'f' AS Gender",
        )
        prompts = training_prompts(rows, BODY).select("name", "prompt")
        texts = ["Transcript", "Exp_5_Selected_Rationale", "__shot", "__zero", "__one", "first"]
        assert len(moved(prompts, *texts)) == 1 and prompts.count() == 40
        # Test rows are dealt by their own id: their texts stay, and only those of the exemplars move.
        named = rows.withColumn("name", F.concat("Participant_ID", F.lit("_x")))
        tests = rows.select("Participant_ID", "Gender", "Transcript").where("Participant_ID < 9")
        shown = evaluation_prompts(named, tests, BODY.replace("{{status}}", "")).select("Participant_ID", "prompt")
        assert len(moved(shown, *texts, "Generated_Rationale")) == 1 and shown.count() == 9
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


SELECTED = "Participant_ID int, PHQ_Binary int, Gender string, Transcript string, Exp_5_Selected_Rationale_Number int, Exp_5_Selected_Rationale string"


def test_a_transcript_is_written_once_for_all_picks(spark):
    talk = lambda p: "".join(random.Random(p).choices("0123456789abcdef", k=20_000))
    data = [(p, p % 2, "f", talk(p), k, f"reason {p} {k}") for p in range(20) for k in range(1, 9)]
    folder = Path(shared_dir(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    before = size()
    prompts = training_prompts(spark.createDataFrame(data, SELECTED), BODY + "{{status}}")
    # The text and its packed form, both compressed; eight copies of each were 3.2 MB.
    assert size() - before < 2 * 20 * 20_000
    assert prompts.where(F.length("prompt") > 60_000).count() == 160


def test_talks_give_the_prompts_of_single_rows(spark):
    data = [(p, p % 3 if p % 3 < 2 else None, "f" if p % 2 else None, None if p == 4 else f"talk {p // 2}", k, f"reason {p} {k}") for p in range(12) for k in (1, 2, 70)]
    data += [(50, 0, "m", f"talk of its own {k}", k, "é \x00") for k in range(3)]
    rows = spark.createDataFrame(data, SELECTED)
    talks = gather_talks(rows, "Exp_5_Selected_Rationale_Number")
    assert sorted(len(r[PICKS]) for r in talks.collect()) == [1] * 15 + [2] * 12
    named = rows.withColumn("name", F.concat_ws("_", "Participant_ID", "Exp_5_Selected_Rationale_Number"))
    want = fewshot_prompt(shots_with_reuse(named), named, BODY + "{{status}}", "train", "Exp_5_Selected_Rationale")
    got = training_prompts(rows, BODY + "{{status}}")
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    alone = training_prompts(rows.where("PHQ_Binary = 0"), BODY)
    with pytest.raises(Exception, match="no exemplar named"):
        alone.collect()


def test_prompts_stay_where_they_lie_while_they_are_answered(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        data = [(p, p % 2, "f", f"talk {p}", k, f"reason {p} {k}") for p in range(12) for k in (1, 2)]
        prompts = training_prompts(spark.createDataFrame(data, SELECTED), BODY + "{{status}}")
        plain = spark.range(3).selectExpr("cast(id AS string) AS name", "'p' AS prompt")
        first = requests(plain, 1, read_results(spark, str(tmp_path / "none")).select(F.col("key").alias("name"), "candidate_no"), "name")
        assert "Join" not in first._jdf.queryExecution().executedPlan().toString()
        calls = spark.sparkContext.accumulator(0)

        def call(request):
            calls.add(1)
            return slice_call({**request, "key": request["name"]})

        for run in ("r1", "r2"):
            made = training_set(prompts, per_request(call), str(tmp_path / "train"), run)
            assert moved(made.select("name", "prompt", "Generated_Rationale"), "prompt", "Transcript") == []
            rows = made.collect()
            assert len(rows) == 24 and calls.value == 24 and "__talk" not in made.columns
            assert all(r.Generated_Rationale == slice_call({"key": r["name"], "candidate_no": 1, "prompt": r.prompt}) for r in rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_answered_prompts_take_the_room_of_their_recipes(spark, tmp_path):
    talk = lambda p: "".join(random.Random(p).choices("0123456789abcdef", k=20_000))
    data = [(p, p % 2, "f", talk(p), k, f"reason {p} {k}") for p in range(20) for k in range(1, 9)]
    folders = [Path(shared_dir(spark).removeprefix("file:")), tmp_path]
    size = lambda: sum(f.stat().st_size for folder in folders for f in folder.rglob("*") if f.is_file())
    before = size()
    prompts = training_prompts(spark.createDataFrame(data, SELECTED), BODY + "{{status}}")
    made = training_set(prompts, per_request(keyed("name", slice_call)), str(tmp_path / "train"), "r1")
    # One packed copy of each transcript, 0.2 MB, and tables of names and places; 160 prompts with three of them took 6 MB.
    assert size() - before < 800_000
    rows = made.collect()
    assert len(rows) == 160 and all(r.Transcript == talk(r.Participant_ID) and len(r.prompt) > 60_000 for r in rows)
    assert all(r.Generated_Rationale == slice_call({"key": r["name"], "candidate_no": 1, "prompt": r.prompt}) for r in rows)


def test_recipes_wait_for_a_later_run(spark, tmp_path):
    data = [(p, p % 2, "f", None if p == 3 else f"\u2003talk {p} ", k, f"reason {p} {k}") for p in range(10) for k in (1, 2)]
    prompts = training_prompts(spark.createDataFrame(data, SELECTED), "\u3000 {{transcript}}{{zero_transcript}}{{ one_transcript }}\u00a0")
    want = {r["name"]: r.prompt for r in prompts.collect()}
    assert all(p == p.strip() and p.count("talk") in (2, 3) for p in want.values())
    calls = spark.sparkContext.accumulator(0)

    def call(request):
        calls.add(1)
        return request["prompt"]

    def half(request):
        if request["name"] < "5":
            raise ValueError("down")
        return call(request)

    store = str(tmp_path / "train")
    first = training_set(prompts, per_request(half), store, "r1")
    assert first.where("Generated_Rationale IS NOT NULL").count() == calls.value == 10
    rows = training_set(prompts, per_request(call), store, "r2", batches=3).collect()
    assert calls.value == 20 and {r["name"]: r.Generated_Rationale for r in rows} == {r["name"]: r.prompt for r in rows} == want


def test_changed_prompts_are_asked_as_they_are(spark, tmp_path):
    data = [(p, p % 2, "f", f"talk {p}", k, f"reason {p} {k}") for p in range(6) for k in (1, 2)]
    prompts = training_prompts(spark.createDataFrame(data, SELECTED), BODY).where("Participant_ID > 1").withColumn("prompt", F.upper("prompt"))
    prompts = prompts.withColumn("recipes", F.lit(1))
    rows = training_set(prompts, per_request(lambda request: request["prompt"]), str(tmp_path / "train"), "r1").collect()
    assert len(rows) == 8 and all(r.Generated_Rationale == r.prompt == r.prompt.upper() for r in rows)


def test_transcripts_go_with_rows_where_workers_cannot_open_the_folder(spark, tmp_path, monkeypatch):
    data = [(p, p % 2, "f", None if p == 3 else f"talk {p} é" * 50, k, f"reason {p} {k}") for p in range(10) for k in (1, 2)]
    rows = spark.createDataFrame(data, SELECTED)
    want = sorted((r["name"], r.prompt, r.Transcript) for r in training_prompts(rows, BODY).collect())
    for folder in ("viewfs://store/x", "dbfs:/x"):
        monkeypatch.setattr("interviewflow.operators.fewshot.qualified", lambda session, path, folder=folder: folder)
        made = training_set(training_prompts(rows, BODY), per_request(lambda r: r["prompt"]), str(tmp_path / folder[:4]), "r1")
        assert sorted((r["name"], r.Generated_Rationale, r.Transcript) for r in made.collect()) == want


def test_texts_at_their_places(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(texts, "SEND_BYTES", 3000)
    monkeypatch.setattr(texts, "READ_BYTES", 2000)
    monkeypatch.setattr(texts, "GAP_BYTES", 300)
    cells = [None if i % 7 == 0 else "".join(random.Random(i % 30).choices("0123456789abcdef", k=i % 30 * 50)) for i in range(90)]
    rows = spark.createDataFrame(list(enumerate(cells)), "i int, t string").repartition(3)
    at = rows.select("i", texts.put_texts(F.col("t").cast("binary"), f"file:{tmp_path}/a:b").alias("p")).localCheckpoint()
    assert len(list((tmp_path / "a:b").iterdir())) == 3
    assert [r.t for r in at.select("i", texts.text_at(F.col("p")).alias("t")).orderBy("i").collect()] == cells
    recipes = [[b" <", None if r.p is None else bytes(r.p), b"> "] for r in at.orderBy("i").collect()]
    sent = list(texts.put_together(recipes, strip=True))
    assert [t.decode() for some in sent for t in some] == [f"<{c or ''}>" for c in cells]
    assert len(sent) > 10 and all(sum(map(len, some[:-1])) < 3000 for some in sent)
    # The same files by Arrow, as those of an object store.
    monkeypatch.setattr(texts, "system_of", lambda folder: (RemoteFolder(LocalFileSystem()), folder.removeprefix("file:")))
    assert [t for some in texts.put_together(recipes, strip=True) for t in some] == [t for some in sent for t in some]


def test_values_may_look_at_transcripts(spark):
    data = [(p, p % 2, "f", f"talk {p}", 1, "reason") for p in range(4)]
    values = {"own": F.upper("Transcript"), "zero_transcript": F.concat(F.lit("<"), "zero_transcript", F.lit(">"))}
    prompts = training_prompts(spark.createDataFrame(data, SELECTED), "{{own}} {{zero_transcript}} {{transcript}}", values)
    rows = prompts.collect()
    assert len(rows) == 4 and prompts.columns[-3:] == ["prompt", "Token_Count", "__talk"]
    for r in rows:
        zero = r.zero_shot_name.split("_")[0]
        assert r.prompt == f"TALK {r.Participant_ID} <talk {zero}> talk {r.Participant_ID}"
    with pytest.raises(ValueError, match="needs .'other'"):
        training_prompts(spark.createDataFrame(data, SELECTED), "{{other}} {{transcript}}")
