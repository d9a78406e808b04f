"""Delimited files with cells over several lines, cut into many splits, against the csv module."""

import csv
import io
import random

import pytest

from interviewflow.sources.records import begin_states, lines_of, split_states
from interviewflow.sources.tables import ORDER, read_table
from interviewflow.sources.transcripts import read_utterances


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def made(rng, n):
    pieces = ['5" tall', 'say "so", then', "a\nb", "\n\n", 'x"\n"y', '","', '"\n', ",", "é ü", "plain", " lead", "z" * 400, '"quoted"']
    return [[str(i), "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 4)))] for i in range(n)]


def text_of(rows, header, end="\n", sep=","):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end, delimiter=sep)
    writer.writerow(header)
    writer.writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("seed,end,sep,encoding", [(1, "\n", ",", "utf-8"), (2, "\r\n", ",", "utf-8"), (3, "\n", "\t", "iso-8859-1")])
def test_split_files_give_the_rows_of_the_csv_module(spark, tmp_path, small_splits, seed, end, sep, encoding):
    rng = random.Random(seed)
    rows = made(rng, 120)
    file = tmp_path / "t.csv"
    file.write_bytes(text_of(rows, ["id", "te xt"], end, sep).encode(encoding))
    got = read_table(spark, str(file), sep, nulls=(), order=True, encoding=encoding)
    assert got.columns == ["id", "te xt", *ORDER] and got.rdd.getNumPartitions() > 5
    # The reader trims nothing but treats an unquoted cell's blanks as the csv module does.
    assert [tuple(r)[:2] for r in got.orderBy(*ORDER).collect()] == [tuple(r) for r in rows]
    assert read_table(spark, str(file), sep, encoding=encoding).columns == ["id", "te xt"]


def test_a_cell_over_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f'line {i} "" , x' for i in range(300))
    file = tmp_path / "t.csv"
    file.write_text(f'id,t,u\n1,"{long}",a\n2,b,c\n3,"{long}","{long}"\n4,"open {long}', newline="")
    got = read_table(spark, str(file), ",", order=True).orderBy(*ORDER).drop(*ORDER).collect()
    plain = long.replace('""', '"')
    assert [tuple(r) for r in got] == [("1", plain, "a"), ("2", "b", "c"), ("3", plain, plain), ("4", f"open {plain}", None)]


def test_states_of_splits(spark, tmp_path, small_splits):
    """The running composition tells where a sequential reader stands at the start of each split."""
    rng = random.Random(9)
    text = text_of(made(rng, 60), ["id", "t"])
    (tmp_path / "a.csv").write_text(text, newline="")
    lines = lines_of(spark, str(tmp_path / "a.csv"))
    begins = {r.block: r.begins for r in begin_states(split_states(lines, ",")).collect()}
    ends, at = set(), 0
    for record in csv.reader(io.StringIO(text, newline="")):
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerow(record)
        ends.add(at)
        at += len(out.getvalue().encode())
    starts = {}
    at = 0
    for line in text.encode().split(b"\n"):
        starts[at] = at not in ends
        at += len(line) + 1
    # A split takes the lines that begin behind its first byte.
    data = text.encode()
    for block, state in begins.items():
        first = 0 if block == 0 else data.index(b"\n", block) + 1
        assert starts.get(first, False) == state or first >= len(data)
    assert any(begins.values()) and not all(begins.values())


def test_folders_of_files(spark, tmp_path, small_splits):
    place = tmp_path / "rows"
    place.mkdir()
    rng = random.Random(4)
    want = []
    for i in range(7):
        rows = made(rng, rng.choice([0, 1, 30])) if i % 2 else [[str(k), "plain"] for k in range(i)]
        (place / f"{i}_Transcript.csv").write_text("\n" * (i % 3) + text_of(rows, ["id", "Text"]), newline="")
        want += [(f"{i}_Transcript.csv", *r) for r in rows]
    got = read_table(spark, str(place), ",", nulls=(), order=True).orderBy(*ORDER)
    assert [(r.file_name, r.id, r.Text) for r in got.collect()] == want
    found = read_utterances(spark, str(place)).where("text IS NOT NULL").orderBy(*ORDER)
    assert [(r.file_name, r.text) for r in found.collect()] == [(f, t) for f, _, t in want]
    shared = read_utterances(spark, str(place), text_names=("Text",), columns=["id", "Text"], multiline=True).where("text IS NOT NULL")
    assert [(r.file_name, r.text) for r in shared.orderBy(*ORDER).collect()] == [(f, t) for f, _, t in want]
