import pytest
from pyspark.sql import functions as F

from interviewflow.plans.candidates import (
    candidates_for_range,
    clean_selection,
    expand_selection,
    expand_selection_with_defaults,
    select_and_expand,
    with_prompt,
    with_template,
)
from interviewflow.operators.generate import per_request
from interviewflow.plans.scoring import score_corpus
from interviewflow.plans.tables import correct_table, dedupe_table, filter_table, stack_tables
from interviewflow.plans.transcripts import ledger_transcripts, refresh_ledger, roster_refresh, roster_update, transcript_splits
from interviewflow.session import cut, shared_dir
from interviewflow.sources.prompts import read_prompts, write_prompts
from interviewflow.sources.ordered import read_ordered, read_places, with_row_number, write_ordered
from interviewflow.sources.sinks import current_version, read_versioned, with_preview, write_formats, write_versioned
from interviewflow.sources.records import has_open_cells, lines_of, split_states
from interviewflow.sources.tables import ORDER, find_separator, read_table
from interviewflow.sources.transcripts import list_files, read_utterances


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_separator(spark, tmp_path):
    tabs, commas = tmp_path / "a.txt", tmp_path / "b.txt"
    tabs.write_text("a\tb\tc,d\n")
    commas.write_text("a,b\n")
    assert find_separator(spark, str(tabs)) == "\t" and find_separator(spark, str(commas)) == ","
    assert find_separator(spark, "x.tsv") == "\t" and find_separator(spark, "x.CSV") == ","
    assert find_separator(spark, str(tabs), ";") == ";"


def any_open(spark, path, sep):
    return has_open_cells(split_states(lines_of(spark, path), sep))


def test_read_table(spark, tmp_path):
    file = tmp_path / "t.csv"
    file.write_text('id,t\n01,"two\nlines"\n2," say ""hi"" "\nNA,5\n')
    assert any_open(spark, str(file), ",")
    assert bag(read_table(spark, str(file))) == [("01", "two\nlines"), ("2", ' say "hi" '), (None, "5")]
    assert bag(read_table(spark, str(file), nulls=()))[-1] == ("NA", "5")
    file.write_text('id\tt\n1\t"a ""b"""\n')
    assert not any_open(spark, str(file), "\t")
    assert bag(read_table(spark, str(file), "\t")) == [("1", 'a "b"')]


@pytest.fixture
def folder(tmp_path):
    """Utterance files with differing headers, an empty one and one without a text column."""
    place = tmp_path / "talks"
    place.mkdir()
    (place / "0302_Transcript.csv").write_text('Start,Text\n1,x\n2,NA\n3,None\n4,\n5,"two\nlines"\n6," hi  ""there"" "\n')
    (place / "302_b_Transcript.csv").write_text("Text,Start\ny,1\n")
    (place / "x303_Transcript.csv").write_text("text\nno digits first\n")
    (place / "304_Transcript.csv").write_text("Other\n1\n")
    (place / "305_Transcript.csv").write_text("Text\n")
    (place / "306_Transcript.csv").write_text("Text\n")
    (place / "306 + ä%20_Transcript.csv").write_text("Text\nodd name\n", encoding="utf-8")
    (place / "ignored.csv").write_text("Text\nz\n")
    return place


def test_list_files(spark, folder):
    assert {r[0] for r in list_files(spark, str(folder)).collect()} == {p.name for p in folder.glob("*_Transcript.csv")}


def test_read_utterances(spark, folder):
    found = read_utterances(spark, str(folder))
    assert found.columns == [*ORDER, "text"]
    texts = {}
    for r in found.orderBy(*ORDER).collect():
        texts.setdefault(r.file_name, []).append(r.text)
    assert set(texts) == {p.name for p in folder.glob("*_Transcript.csv")}
    assert texts["0302_Transcript.csv"][1:] == ["x", "NA", "None", None, "two\nlines", ' hi  "there" ']
    assert texts["302_b_Transcript.csv"][1:] == ["y"] and texts["x303_Transcript.csv"][1:] == ["no digits first"]
    assert texts["304_Transcript.csv"] == texts["305_Transcript.csv"] == texts["306_Transcript.csv"] == [None]
    assert texts["306 + ä%20_Transcript.csv"][1:] == ["odd name"]


def test_read_utterances_without_text_column_or_with_named_columns(spark, tmp_path, folder):
    names = {r.file_name for r in read_utterances(spark, str(folder), need_text=True).collect()}
    assert "304_Transcript.csv" not in names and "306_Transcript.csv" in names
    same = tmp_path / "same"
    same.mkdir()
    (same / "1_Transcript.csv").write_text("a,Text\n1,x\n2,y\n")
    found = read_utterances(spark, str(same), columns=["a", "Text"]).orderBy(*ORDER)
    assert [r.text for r in found.collect()] == [None, "x", "y"]


def test_line_order_survives_many_splits(spark, tmp_path):
    place = tmp_path / "long"
    place.mkdir()
    (place / "1_Transcript.csv").write_text("Text\n" + "".join(f"w{i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096b")
        found = read_utterances(spark, str(place))
        assert found.rdd.getNumPartitions() > 4
        ordered = [r.text for r in found.orderBy(*ORDER).collect() if r.text]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert ordered == [f"w{i}" for i in range(5000)]


def test_transcript_splits(spark, tmp_path, folder):
    meta = tmp_path / "test.csv"
    meta.write_text("Participant_ID,Gender\n0302,f\n304,m\n305,m\n999,f\n")
    got = transcript_splits(spark, str(folder), {"test": str(meta), "train": str(meta)}, "both")
    assert set(got) == {"test", "train"}
    assert bag(got["test"]) == [("0302", "f", 'x two\nlines  hi  "there" '), ("304", "m", ""), ("305", "m", "")]
    with pytest.raises(ValueError):
        transcript_splits(spark, str(folder), {}, "dev")


def test_roster_update(spark, tmp_path, folder):
    roster = spark.createDataFrame([("302", "old"), ("306.0", None), ("7", "stay")], "pariticipant_id_x string, Transcript string")
    out = roster_update(spark, roster, str(folder))
    assert bag(out) == [("302", 'x two lines hi "there" y', True), ("306.0", None, False), ("7", "stay", False)]
    assert bag(roster_update(spark, roster, str(folder), mode="fillna").select("Transcript"))[1:] == [("stay",), (None,)]
    named = roster.withColumnRenamed("pariticipant_id_x", "nr")
    assert roster_update(spark, named, str(folder), id_col="nr").where("updated").count() == 1


def test_prompt_files(spark, tmp_path):
    place = tmp_path / "prompts"
    place.mkdir()
    (place / "302.txt").write_text('a\n"b"\n')
    (place / "303_4.txt").write_text("c")
    (place / "n.csv").write_text("c")
    assert bag(read_prompts(spark, str(place))) == [("302", 'a\n"b"\n'), ("303_4", "c")]


def test_written_prompts_come_back_equal(spark, tmp_path):
    data = [("302", 'a\n"b"\n'), ("0303", "c"), ("x y/z", ""), ("4_5", "\n")]
    write_prompts(spark.createDataFrame(data, "key string, prompt string"), str(tmp_path / "out"))
    assert bag(read_prompts(spark, str(tmp_path / "out"))) == sorted(data, key=repr)
    with pytest.raises(Exception, match="no key"):
        write_prompts(spark.createDataFrame([(None, "x")], "key string, prompt string"), str(tmp_path / "bad"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc')], "i int, t string")
    base = str(tmp_path / "res")
    copy = write_versioned(df, base, "r1")
    write_versioned(read_versioned(spark, base).union(df), base, "r2")
    assert spark.read.parquet(copy).count() == 1 and read_versioned(spark, base).count() == 2
    paths = write_formats(df, str(tmp_path / "f"), "both")
    assert [p.rsplit(".", 1)[1] for p in paths] == ["csv", "parquet"]
    assert bag(read_table(spark, paths[0])) == [("1", 'a "b"\nc')] and bag(spark.read.parquet(paths[1])) == bag(df)
    assert write_formats(df, str(tmp_path / "g"), "CSV") == [str(tmp_path / "g") + ".csv"]
    with pytest.raises(ValueError):
        write_formats(df, base, "excel")


def test_cell_preview(spark):
    def table(n):
        return spark.createDataFrame([("é" * n,), ("b",), (None,)], "Transcript string")

    assert with_preview(table(30000)).columns == ["Transcript"]
    longer = with_preview(table(30001))
    assert longer.columns == ["Transcript", "Transcript_Summary"]
    assert [r[1] for r in longer.collect()] == ["é" * 30000 + "... (총 30001 자)", "b", None]
    assert with_preview(spark.range(1)).columns == ["id"]


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(spark) == shared_dir(spark)
    kept = cut(spark.range(5))
    assert kept.count() == 5 and "Scan ExistingRDD" in kept._jdf.queryExecution().toString()


# Composed jobs


@pytest.fixture
def people(spark):
    data = [(301, "f", 1, 9, "t1"), (302, "m", 0, 2, "t2"), (303, "f", None, 3, "t3")]
    return spark.createDataFrame(data, "Participant_ID int, Gender string, PHQ_Binary int, PHQ_Score int, Transcript string")


TEMPLATES = {"main": "{{gender}} {{transcript}} {{criteria}}", "short": "{{transcript}}"}


def test_templates_by_name(people):
    texts = lambda df: [r.Prompt for r in df.orderBy("Participant_ID").collect()]
    assert texts(with_template(people, TEMPLATES, "short")) == ["t1", "t2", "t3"]
    assert texts(with_template(people, TEMPLATES, "unknown", {"criteria": "c"}))[0] == "f t1 c"
    with pytest.raises(Exception, match="depression_status"):
        with_template(people, {"main": "{{depression_status}}"}).collect()


def test_prompt_stand_ins(spark):
    df = spark.createDataFrame([(None, None, None), ("f", 1, "t")], "Gender string, PHQ_Binary int, Transcript string")
    got = with_prompt(df, "{{gender}}|{{depression_status}}|{{transcript}}")
    assert bag(got.select("Prompt")) == [("f|depressed|t",), ("patient|unknown|",)]
    with pytest.raises(ValueError, match="Gender"):
        with_prompt(df.drop("Gender"), "x")


def test_candidates_for_range(spark, people, tmp_path):
    call = per_request(lambda r: f"{r['prompt']}#{r['candidate_no']}")
    held = people.withColumn("Rational_1", F.when(F.col("Participant_ID") == 302, "held"))
    out = candidates_for_range(held, 302, 400, 2, call, TEMPLATES, "short", str(tmp_path / "s"), "r1")
    got = {r.Participant_ID: (r.Prompt, r.Rational_1, r.Rational_2) for r in out.collect()}
    assert got == {301: (None, None, None), 302: ("t2", "held", "t2#2"), 303: ("t3", "t3#1", "t3#2")}
    with pytest.warns(UserWarning, match="no id"):
        assert candidates_for_range(people, 900, 901, 2, call, TEMPLATES, "short", str(tmp_path / "n"), "r1") is people


def test_select_expand_clean(spark, people, tmp_path):
    wide = people.withColumns({f"Rational_{i}": F.concat(F.lit(f"**c{i}** "), "Transcript", F.lit(" Diagnosis: x")) for i in range(1, 6)})
    out = select_and_expand(wide, per_request(lambda r: "[2, 9]"), "{{candidates}}", store=str(tmp_path / "answers"))
    assert [r.modified_rationale for r in out.orderBy("Participant_ID").collect()] == ["c2 t1", "c2 t2", "c2 t3"]
    assert [c for c in out.columns if c.startswith("PHQ")] == ["PHQ_Binary", "PHQ_Score"]


def test_expand_selection(people):
    wide = people.withColumns({"Rational_1": F.lit("a"), "Selected_Rational_Number_1": F.lit("2")})
    with pytest.raises(ValueError, match="no selection"):
        expand_selection(wide)
    found = expand_selection(wide.withColumn("Selected_Rational_Number_1", F.lit(1)))
    assert clean_selection(found).count() == 3


def test_expand_selection_with_defaults(people):
    wide = people.drop("PHQ_Score").withColumns({f"Rational_{i}": F.lit(f"c{i}") for i in (1, 5, 8)})
    out = expand_selection_with_defaults(wide.withColumn("Selected_Rational_Number_1", F.when(F.col("Participant_ID") == 301, "8.0")))
    assert out.columns[-2:] == ["Exp_5_Selected_Rationale_Number", "Exp_5_Selected_Rationale"]
    assert bag(out.select("Participant_ID", out.columns[-2])) == [(302, 1), (302, 5), (303, 5)]


def test_score_corpus(spark):
    df = spark.createDataFrame([(1, "PTSD"), (0, "Non-PTSD"), (0, "PTSD")], "label int, predict1 string")
    assert score_corpus(df, "ptsd").select("tp", "fp", "fn", "tn").first() == (1, 1, 0, 1)
    spoken = spark.createDataFrame([(1, "Depressed"), (0, "Non-depressed.")], "label int, predict1 string")
    assert score_corpus(spoken, "depression_spoken").first().accuracy == 1.0
    with pytest.raises(Exception, match="label is not known"):
        score_corpus(spoken, "depression").collect()


def test_table_utilities(spark, tmp_path):
    table, ids = tmp_path / "t.tsv", tmp_path / "ids.csv"
    table.write_text("Participant_ID\tPHQ_Binary\tt\n10\t0\ta\n7\t0\tb\n10\t1\tc\n\t0\td\n335\t0\te\n")
    ids.write_text("Participant_ID,x\n10,1\n7,2\n,3\n99,4\n")
    out = str(tmp_path / "o")
    assert bag(dedupe_table(spark, str(table), out + "1")) == [("10", "0", "a"), ("335", "0", "e"), ("7", "0", "b"), (None, "0", "d")]
    assert read_table(spark, out + "1.csv", "\t").count() == 4
    kept = filter_table(spark, str(table), str(ids), out + "2", out_sep=";")
    assert [tuple(r) for r in kept.collect()] == [("7", "0", "b"), ("10", "0", "a"), ("10", "1", "c")]
    assert bag(read_table(spark, out + "2.csv", ";")) == bag(kept)
    unsorted = filter_table(spark, str(table), str(ids), out + "3", id_type="string", sort=False)
    assert [r.t for r in unsorted.collect()] == ["a", "b", "c"]
    paths = correct_table(spark, str(table), out + "4")
    assert [p[-3:] for p in paths] == ["csv", "uet"]
    assert spark.read.parquet(paths[1]).where("PHQ_Binary = 1").count() == 2
    assert stack_tables(spark, [str(table), str(ids)], out + "5").columns == ["Participant_ID", "PHQ_Binary", "t", "x"]
    with pytest.raises(ValueError):
        dedupe_table(spark, str(table), out + "6", id_col="nope")


def test_first_in_file_order_over_many_splits(spark, tmp_path):
    file = tmp_path / "big.csv"
    file.write_text("Participant_ID,n\n" + "".join(f"{i % 50},{i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096b")
        kept = dedupe_table(spark, str(file), str(tmp_path / "o")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((int(i), int(n)) for i, n in kept) == [(i, i) for i in range(50)]


def test_many_layouts_an_empty_file_and_stray_quotes(spark, tmp_path):
    place = tmp_path / "talks"
    place.mkdir()
    for i in range(150):
        before = ",".join(f"h{i}_{k}" for k in range(i % 7))
        header, row = (before + ",Text", "1," * (i % 7)) if before else ("Text", "")
        (place / f"{i}_Transcript.csv").write_text(f'{header},note{i}\n{row}word {i} 5" tall,"a ""b"""\n')
    (place / "900_Transcript.csv").write_text("")
    (place / "901_Transcript.csv").write_text('n,Text\n1,"two\nlines"\n')
    found = read_utterances(spark, str(place))
    texts = {}
    for r in found.orderBy(*ORDER).collect():
        texts.setdefault(r.file_name, []).append(r.text)
    assert len(texts) == 152 and texts["900_Transcript.csv"] == [None]
    assert texts["901_Transcript.csv"] == [None, "two\nlines"]
    assert all(texts[f"{i}_Transcript.csv"] == [None, f'word {i} 5" tall'] for i in range(150))
    # One scan, however many layouts there are and whether cells span lines or not.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [value") == 1
    (place / "901_Transcript.csv").write_text("Text\nplain\n")
    assert read_utterances(spark, str(place))._jdf.queryExecution().optimizedPlan().toString().count("Relation [c0") == 1


@pytest.mark.parametrize("encoding", ["utf-16", "iso-8859-1"])
def test_encoding_holds_in_every_pass(spark, tmp_path, encoding):
    place = tmp_path / "talks"
    place.mkdir()
    (place / "1_Transcript.csv").write_text("No,Text\n1,größe\n", encoding=encoding)
    (place / "2_Transcript.csv").write_text("Text,No\nété,1\n", encoding=encoding)
    found = read_utterances(spark, str(place), encoding=encoding, need_text=True)
    assert bag(found.where("text IS NOT NULL").select("file_name", "text")) == [("1_Transcript.csv", "größe"), ("2_Transcript.csv", "été")]
    file = tmp_path / "t.csv"
    file.write_text("id,t\n1,ü\n", encoding=encoding)
    assert bag(read_table(spark, str(file), encoding=encoding)) == [("1", "ü")]


def test_files_with_and_without_open_cells(spark, tmp_path):
    place = tmp_path / "rows"
    place.mkdir()
    (place / "a.csv").write_text('id,t\n1,"two\nlines"\n')
    (place / "b.csv").write_text('id,t\n2,5" tall\n')
    got = read_table(spark, str(place), sep=",", order=True)
    assert bag(got.select("id", "t")) == [("1", "two\nlines"), ("2", '5" tall')]
    assert any_open(spark, str(place / "a.csv"), ",") and not any_open(spark, str(place / "b.csv"), ",")


def test_prompt_files_meet(spark, tmp_path):
    keys = ["302_1", "a b", "x=1/2", "100%", "q+r", "ä"]
    df = spark.createDataFrame([(k, f"p {k}\nend\n") for k in keys], "key string, prompt string")
    out = str(tmp_path / "prompts")
    write_prompts(df, out)
    assert bag(read_prompts(spark, out)) == bag(df)
    with pytest.raises(Exception, match="has no key"):
        write_prompts(spark.createDataFrame([("", "p")], "key string, prompt string"), str(tmp_path / "none"))


def test_both_formats_run_the_plan_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            calls.add(len(frame))
            yield frame

    df = spark.range(2).mapInPandas(count, "id bigint")
    paths = write_formats(df, str(tmp_path / "t"), "both")
    assert calls.value == 2 and [p[-3:] for p in paths] == ["csv", "uet"]
    assert bag(spark.read.csv(paths[0], header=True)) == [("0",), ("1",)]


def test_a_stopped_run_leaves_the_version_before(spark, tmp_path):
    base = str(tmp_path / "res")
    with pytest.raises(Exception):
        read_versioned(spark, base)
    first = write_versioned(spark.range(3), base, "r1")
    held = read_versioned(spark, base)
    stops = spark.range(3).select(F.when(F.col("id") < 2, F.col("id")).otherwise(F.raise_error(F.lit("stopped")).cast("bigint")).alias("id"))
    with pytest.raises(Exception, match="stopped"):
        write_versioned(stops, base, "r2")
    assert current_version(spark, base) == first and read_versioned(spark, base).count() == 3
    again = write_versioned(spark.range(5), base, "r1")
    assert again != first and read_versioned(spark, base).count() == 5 and held.count() == 3


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_order_is_kept_through_files(spark, tmp_path, adaptive):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = spark.range(40_000).select(((F.col("id") * 7919) % 40_000).cast("string").alias("Participant_ID"), F.when(F.col("id") % 1000 == 0, "two\nlines").otherwise("x").alias("t"))
        rows.write.csv(str(tmp_path / "in"), header=True, quote='"', escape='"')
        spark.range(0, 40_000, 2).select(F.col("id").alias("Participant_ID")).write.csv(str(tmp_path / "ids"), header=True)
        got = filter_table(spark, str(tmp_path / "in"), str(tmp_path / "ids"), str(tmp_path / "out"), in_sep=",")
        assert [int(r[0]) for r in got.collect()] == list(range(0, 40_000, 2))
        assert adaptive == "true" or len(list((tmp_path / "out.csv").glob("part*"))) > 1
        numbered = with_row_number(read_places(spark, str(tmp_path / "out.csv")))
        assert numbered.columns == ["Participant_ID", "t", "row_no"]
        assert numbered.where("2 * row_no <> Participant_ID").isEmpty() and numbered.count() == 20_000
        whole = filter_table(spark, str(tmp_path / "in"), str(tmp_path / "ids"), str(tmp_path / "as_is"), in_sep=",", sort=False)
        want = [r[0] for r in read_table(spark, str(tmp_path / "in"), ",", order=True).orderBy(*ORDER).collect() if int(r[0]) % 2 == 0]
        assert [r[0] for r in whole.collect()] == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_first_rows_keep_the_order_of_the_file(spark, tmp_path):
    ids = [5, 3, 5, 9, 3, 1, 9, 7]
    (tmp_path / "t.csv").write_text("Participant_ID,n\n" + "".join(f"{i},{n}\n" for n, i in enumerate(ids)))
    got = dedupe_table(spark, str(tmp_path / "t.csv"), str(tmp_path / "out"))
    assert [tuple(r) for r in got.collect()] == [("5", "0"), ("3", "1"), ("9", "3"), ("1", "5"), ("7", "7")]
    stacked = stack_tables(spark, [str(tmp_path / "t.csv"), str(tmp_path / "t.csv")], str(tmp_path / "both"))
    assert [int(r.n) for r in stacked.collect()] == [*range(8), *range(8)]


def test_empty_ordered_table(spark, tmp_path):
    write_ordered(spark.range(0).selectExpr("cast(id as string) a"), str(tmp_path / "e"), [F.col("a")])
    assert read_ordered(spark, str(tmp_path / "e")).count() == 0


def test_two_files_of_one_key(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "302.txt").write_text("p")
    with pytest.raises(Exception, match="two files of one key"):
        read_prompts(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="not unique"):
        write_prompts(spark.createDataFrame([("1", "x"), ("1", "y")], "key string, prompt string"), str(tmp_path / "c"))


def test_prompt_files_are_byte_equal_and_change_at_once(spark, tmp_path):
    data = {"302": 'a\n"b"\r\n', "x/y": "c", "_h": "", ".d": "é", "50%25": " ", "c 1+%": "\n"}
    out = tmp_path / "out"
    write_prompts(spark.createDataFrame(list(data.items()), "key string, prompt string").repartition(3), str(out))
    files = {p.name: p.read_bytes().decode() for p in out.iterdir()}
    assert files == {"302.txt": data["302"], "x%2Fy.txt": "c", "%5Fh.txt": "", "%2Ed.txt": "é", "50%2525.txt": " ", "c 1+%.txt": "\n"}
    assert {r.key: r.prompt for r in read_prompts(spark, str(out)).collect()} == data
    with pytest.raises(Exception, match="no key"):
        write_prompts(spark.createDataFrame([("9", "p"), (None, "q")], "key string, prompt string"), str(out))
    assert {p.name for p in out.iterdir()} == set(files) and len(list(tmp_path.iterdir())) == 1
    # What a stream of plain text files makes of the names is the same.
    from interviewflow.sources.prompts import named_prompts

    plain = named_prompts(spark.read.schema("value string").text(str(out), wholetext=True))
    assert {r.key: r.prompt for r in plain.collect()} == {k: v for k, v in data.items() if v and k != "_h"}


def test_a_second_run_opens_changed_files_only(spark, tmp_path, monkeypatch):
    import os

    place, state = tmp_path / "talks", str(tmp_path / "state")
    place.mkdir()

    def put(name, text, age):
        (place / name).write_text(text)
        os.utime(place / name, (1_700_000_000 - age, 1_700_000_000 - age))

    put("302_a_Transcript.csv", "Text\nold a\n", 500)
    put("302_b_Transcript.csv", "Text\nold  b\n", 400)
    put("303_Transcript.csv", 'Text\n"two\nlines"\n', 400)
    put("304_Transcript.csv", "Text\nstays\n", 500)
    put("305_Transcript.csv", "", 500)
    roster = spark.createDataFrame([(i, "was") for i in (302, 303, 304, 305, 306, 307)], "Participant_ID bigint, Transcript string")
    first = roster_refresh(spark, roster, str(place), state, "r1")
    assert bag(first) == [(302, "old a old b", True), (303, "two lines", True), (304, "stays", True), (305, "was", False), (306, "was", False), (307, "was", False)]
    # Nothing happened: nothing is touched, and no file opened.
    from interviewflow.plans import transcripts

    opened = []
    read = transcripts.read_utterances
    monkeypatch.setattr(transcripts, "read_utterances", lambda *a, **k: opened.append(k["modifiedAfter"]) or read(*a, **k))
    assert roster_refresh(spark, first.drop("updated"), str(place), state, "r2").where("updated").isEmpty() and opened == []
    put("302_b_Transcript.csv", "Text\nnew b\n", 100)
    put("306_Transcript.csv", "Text\ncame\n", 90)
    (place / "303_Transcript.csv").unlink()
    put("307_Transcript.csv", "Other\nno text\n", 80)
    second = roster_refresh(spark, first.drop("updated"), str(place), state, "r3")
    assert bag(second) == [(302, "old a new b", True), (303, "two lines", False), (304, "stays", False), (305, "was", False), (306, "came", True), (307, "was", False)]
    # Files older than the changed ones are not listed for the scan.
    found = read(spark, str(place), modifiedAfter=opened[0])
    assert {r.file_name for r in found.collect()} == {"302_b_Transcript.csv", "306_Transcript.csv", "307_Transcript.csv"}
    assert bag(ledger_transcripts(spark, state)) == [("302", "old a new b"), ("304", "stays"), ("306", "came")]
    assert refresh_ledger(spark, str(place), state, "r4").isEmpty()
    assert bag(second)[0] == (302, "old a new b", True)


def test_small_files_of_a_ledger_share_tasks(spark, tmp_path):
    folder = tmp_path / "talks"
    folder.mkdir()
    for i in range(120):
        (folder / f"{i}_Transcript.csv").write_text(f'n,Text\n1,"a\nb {i}"\n')
    context, before = spark.sparkContext, spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    context.setJobGroup("small files", "")
    try:
        roster = spark.range(120).selectExpr("id AS Participant_ID", "'old' AS Transcript")
        rows = roster_refresh(spark, roster, str(folder), str(tmp_path / "state"), "r1").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        context.setLocalProperty("spark.jobGroup.id", None)
    assert {(r.Participant_ID, r.Transcript) for r in rows} == {(i, f"a b {i}") for i in range(120)}
    jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup("small files")]
    stages = [context.statusTracker().getStageInfo(s) for j in jobs if j for s in j.stageIds]
    assert 0 < max(s.numTasks for s in stages if s) < 60
