import pytest
from interviewflow.operators.generate import (
    Reply,
    generate,
    generate_repeats,
    join_unique,
    latest_results,
    merge_results,
    pending,
    per_request,
    progress,
    requests,
    run_resumable,
    select_best,
    with_retry,
)
from interviewflow.operators.store import attempt_ledger
from interviewflow.streaming.prompts import open_requests, stream_generate, stream_results


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def prompts(spark):
    return spark.createDataFrame([("a", "pa"), ("b", "pb")], "key string, prompt string")


def echo(request):
    return f"{request['prompt']}{request['candidate_no']}"


def test_generate(prompts):
    out = generate(prompts, 2, per_request(echo), partitions=3)
    assert out.columns == ["key", "candidate_no", "text", "status", "error", "attempts"]
    assert bag(out) == [(k, i, f"p{k}{i}", "ok", None, 1) for k in "ab" for i in (1, 2)]


def test_a_failing_request_leaves_the_others(prompts):
    def call(request):
        if request["candidate_no"] == 1:
            raise RuntimeError("down")
        return "x"

    assert bag(generate(prompts, 2, per_request(call)).drop("key"))[0::2] == [(1, None, "failed", "down", 1), (2, "x", "ok", None, 1)]


def test_retry():
    tries, slept = [], []

    def call(request):
        tries.append(1)
        if len(tries) <= request["fail"]:
            raise OSError("later")
        return "t"

    assert with_retry(call, sleep=slept.append)({"fail": 2}) == Reply("t", "ok", None, 3)
    assert slept == [1.0, 2.0]
    tries.clear(), slept.clear()
    assert with_retry(call, sleep=slept.append)({"fail": 9}) == Reply("", "failed", "later", 3)
    assert slept == [1.0, 2.0]
    with pytest.raises(OSError):
        with_retry(call, retry_on=ValueError)({"fail": 99})


def test_retry_inside_a_job(prompts):
    def call(request):
        raise ValueError("no")

    out = generate(prompts, 1, per_request(with_retry(call, 2, 0.0)))
    assert bag(out) == [("a", 1, "", "failed", "no", 2), ("b", 1, "", "failed", "no", 2)]


def test_done_requests_are_not_made(spark, prompts):
    done = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 2, ""), ("b", 3, None), ("b", 9, "x")], "key string, candidate_no int, text string")
    todo = bag(requests(prompts, 3, done))
    assert [(k, i) for k, i, _ in todo] == [("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 3)]
    plain = requests(prompts, 3).select("key", "candidate_no")
    assert bag(pending(done)) == [("a", 2, ""), ("b", 3, None)]
    assert bag(progress(prompts, done, 3)) == [(6, 1, 5, 1)]


def test_merge_results(spark):
    base = spark.createDataFrame([(1, "t"), (2, None), (3, "z")], "k int, v string")
    new = spark.createDataFrame([(1, None, "w"), (2, "u", None), (9, "q", "q")], "k int, v string, w string")
    assert bag(merge_results(base, new, ["k"])) == [(1, "t", "w"), (2, "u", None), (3, "z", None)]
    assert bag(merge_results(base, new, ["k"], "full"))[-1] == (9, "q", "q")


def counting_call(folder):
    """Leaves one file per call, so calls can be counted over processes."""

    def call(request):
        import uuid

        with open(f"{folder}/{request['key']}-{request['candidate_no']}-{uuid.uuid4().hex}", "w"):
            return echo(request)

    return call


def test_a_stopped_run_is_continued(spark, prompts, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    store = str(tmp_path / "store")
    call = counting_call(str(calls))

    def breaks(frames):
        for frame in frames:
            if "b" in list(frame["key"]):
                raise RuntimeError("stopped")
            yield from per_request(call)(iter([frame]))

    with pytest.raises(Exception, match="stopped"):
        run_resumable(prompts, 2, breaks, store, "r1", batches=64)
    first = run_resumable(prompts, 2, per_request(call), store, "r2", batches=4)
    assert sorted(first.select("key", "candidate_no", "text").collect()) == [(k, i, f"p{k}{i}") for k in "ab" for i in (1, 2)]
    assert len(list(calls.iterdir())) == 4
    again = run_resumable(prompts, 2, per_request(call), store, "r3")
    assert bag(again) == bag(first) and len(list(calls.iterdir())) == 4
    more = run_resumable(prompts, 3, per_request(call), store, "r4", known=spark.createDataFrame([("a", 3, "k")], "key string, candidate_no int, text string"))
    assert more.count() == 5 and len(list(calls.iterdir())) == 5


def test_failed_results_are_filled_by_the_next_run(prompts, tmp_path):
    def down(request):
        raise RuntimeError("down")

    store = str(tmp_path / "store")
    assert run_resumable(prompts, 1, per_request(down), store, "r1").where("text IS NULL").count() == 2
    assert bag(run_resumable(prompts, 1, per_request(echo), store, "r2").select("text")) == [("pa1",), ("pb1",)]


def test_latest_results(spark):
    store = spark.createDataFrame([("a", 1, None, "r1"), ("a", 1, "y", "r3"), ("a", 1, "x", "r2")], "key string, candidate_no int, text string, run_id string")
    assert bag(latest_results(store)) == [("a", 1, "x", "r2")]


def test_select_best(spark):
    df = spark.createDataFrame([(1, "p", "a", "b"), (2, None, "c", None)], "Participant_ID int, Prompt string, Rational_2 string, Rational_7 string")

    def call(request):
        return "[2, 1, 5]" if "p|" in request["prompt"] else "none"

    out = select_best(df, 2, per_request(call), "{{prompt}}|{{candidates}}{{k}}{{n}}")
    assert bag(out) == [(1, "[2, 1, 5]", 7, 2), (2, "none", None, None)]


def test_join_unique(spark, prompts):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "key string, v int")
    assert bag(join_unique(prompts, df, "key")) == [("a", 1, "pa")]


def test_generate_repeats(spark, tmp_path):
    prompts = spark.createDataFrame([("1", "x END y"), ("2", "plain"), ("3", "dup")], "Participant_ID string, prompt string")
    df = spark.createDataFrame([("1", "u"), ("2", "v"), ("3", "w"), ("3", "w2"), ("4", "z")], "Participant_ID string, other string")
    done = spark.createDataFrame([("1", 1, "kept words")], "Participant_ID string, candidate_no int, text string")
    call = lambda r: f"{r['prompt']} {r['candidate_no']}"
    wide = generate_repeats(prompts, df, 2, per_request(call), "END", "more", done=done)
    assert wide.columns == ["Participant_ID", "other", "Generated_rationale_1", "Generated_rationale_2", "Generated_token_1", "Generated_token_2", "Prompt_preview"]
    got = bag(wide)
    assert got[0] == ("1", "u", "kept words", "x END\nmore y 2", 2, 5, "x END\nmore y")
    assert got[1] == ("2", "v", "plain 1", "plain 2", 2, 2, "plain")
    assert [r[2:] for r in got[2:]] == [(None,) * 5] * 3
    store = str(tmp_path / "store")
    for call in (per_request(call), None):
        kept = generate_repeats(prompts, df, 2, call or never, "END", "more", done=done, store=store)
        assert bag(kept) == got


def never(frames):
    """A generator that must not be asked for anything."""
    for frame in frames:
        assert frame.empty
        yield from ()


def test_stream_takes_each_file_once(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    folder.mkdir()
    (folder / "302.txt").write_text("one\ntwo")
    (folder / "skip.csv").write_text("x")
    done = spark.createDataFrame([("303", 1, "x")], "key string, candidate_no int, text string")

    def run():
        stream = stream_generate(spark, str(folder), 2, per_request(echo), out, checkpoint, done, files_per_batch=1)
        assert stream.awaitTermination(120) and stream.exception() is None
        return bag(stream_results(spark, out).select("key", "candidate_no", "text"))

    first = [("302", 1, "one\ntwo1"), ("302", 2, "one\ntwo2")]
    assert run() == first
    (folder / "303.txt").write_text("new")
    assert run() == [*first, ("303", 2, "new2")]
    assert run() == [*first, ("303", 2, "new2")]


def test_streamed_requests_stay_open_until_answered(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    (folder / "sub").mkdir(parents=True)
    for i in range(6):
        (folder / f"{i}.txt").write_text(f"p{i}")
    (folder / "sub" / "3.txt").write_text("another prompt of key 3")
    calls = spark.sparkContext.accumulator(0)

    def run(fail, **options):
        def call(request):
            calls.add(1)
            if fail(request):
                raise ValueError("down")
            return echo(request)

        before = calls.value
        stream = stream_generate(spark, str(folder), 2, per_request(call), out, checkpoint, **options)
        assert stream.awaitTermination(120) and stream.exception() is None
        return calls.value - before

    assert run(lambda r: r["candidate_no"] == 2, files_per_batch=2) >= 12
    assert open_requests(spark, out).count() == 6
    answered = {(r.key, r.candidate_no): r.text for r in stream_results(spark, out).where("text IS NOT NULL").collect()}
    assert len(answered) == 6
    # Nothing new has come, but the open ones are asked again, and only they.
    assert run(lambda r: int(r["key"]) % 2) == 6 and open_requests(spark, out).count() == 3
    (folder / "9.txt").write_text("p9")
    assert run(lambda r: False) == 3 + 2 and open_requests(spark, out).isEmpty()
    assert run(lambda r: False) == 0
    texts = {(r.key, r.candidate_no): r.text for r in stream_results(spark, out).collect()}
    assert len(texts) == 14 and all(texts[k] == t for k, t in answered.items())
    assert all(t == f"p{k}{i}" for (k, i), t in texts.items() if k != "3")


def test_streamed_requests_are_given_up(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    folder.mkdir()
    (folder / "1.txt").write_text("p")
    for _ in range(4):
        down = per_request(lambda request: 1 / 0)
        assert stream_generate(spark, str(folder), 1, down, out, checkpoint, max_attempts=2).awaitTermination(120)
    assert open_requests(spark, out).isEmpty() and attempt_ledger(spark, out, 2).first().attempts == 2


def test_a_repeated_micro_batch_asks_for_nothing(spark, tmp_path):
    """The answers are committed, but the job ends before it keeps what is open."""
    from interviewflow.sources.files import delete
    from interviewflow.streaming.prompts import _round

    out, calls = str(tmp_path / "out"), spark.sparkContext.accumulator(0)

    def call(request):
        calls.add(1)
        return echo(request)

    new = spark.createDataFrame([("a", "p", 1, "f")], "key string, prompt string, file_time int, file_path string")
    for _ in range(2):
        _round(spark, new, 2, per_request(call), out, "stream-q-0", None, None, None)
        delete(spark, f"{out}/open.json")
    assert calls.value == 2 and stream_results(spark, out).count() == 2


def test_no_sleep_after_the_last_try():
    slept = []

    def fail(request):
        raise ValueError("no")

    reply = with_retry(fail, retries=3, sleep=slept.append)({})
    assert slept == [1.0, 2.0] and reply.attempts == 3


def test_progress_leaves_out_unknown_keys(spark):
    from interviewflow.operators.generate import progress

    prompts = spark.createDataFrame([("a", "p")], "key string, prompt string")
    results = spark.createDataFrame([("z", 1, "t"), ("y", 2, "t")], "key string, candidate_no int, text string")
    assert progress(prompts, results, 2).first() == (2, 0, 2, 0)


def test_repeated_ids_are_refused_before_the_first_call(spark, tmp_path):
    from interviewflow.operators.generate import run_resumable, select_best
    from interviewflow.plans.candidates import candidates_for_range, select_and_expand
    from interviewflow.plans.fewshot import training_set

    calls = spark.sparkContext.accumulator(0)

    def call(request):
        calls.add(1)
        return "1"

    gen = per_request(call)
    df = spark.createDataFrame(
        [(1, "f", 1, "t1", "c"), (1, "m", 0, "t2", "d")], "Participant_ID bigint, Gender string, PHQ_Binary int, Transcript string, Rational_1 string"
    )
    jobs = [
        lambda: candidates_for_range(df, 1, 2, 1, gen, {"main": "{{transcript}}"}, "main", str(tmp_path / "a"), "r"),
        lambda: select_and_expand(df, gen, "{{candidates}}", str(tmp_path / "b")),
        lambda: select_best(df, 1, gen, "{{candidates}}"),
        lambda: run_resumable(df.selectExpr("Participant_ID AS key", "Transcript AS prompt"), 1, gen, str(tmp_path / "c"), "r"),
        lambda: training_set(df.selectExpr("cast(Participant_ID AS string) AS name", "Transcript AS prompt"), gen, str(tmp_path / "d"), "r"),
    ]
    for job in jobs:
        with pytest.raises(ValueError, match="not unique: 1"):
            job()
    assert calls.value == 0


def test_selection_goes_on_after_a_stop(spark, tmp_path):
    from interviewflow.plans.candidates import select_and_expand

    calls = spark.sparkContext.accumulator(0)
    failing = spark.sparkContext.broadcast({"b"})

    def first(request):
        if any(x in request["prompt"] for x in failing.value):
            raise ValueError("down")
        return "[1]"

    def second(request):
        calls.add(1)
        return "[1]"

    df = spark.createDataFrame(
        [(i, "f", 1, "t", c) for i, c in enumerate("abc")],
        "Participant_ID bigint, Gender string, PHQ_Binary int, Transcript string, Rational_1 string",
    )
    store = str(tmp_path / "answers")
    body = "{{candidates}}"
    assert select_and_expand(df, per_request(first), body, store, run_id="1").count() == 2
    again = select_and_expand(df, per_request(second), body, store, run_id="2", batches=3)
    assert sorted(r.modified_rationale for r in again.collect()) == ["a", "b", "c"]
    assert calls.value == 1


def test_requests_are_dealt_over_tasks(spark):
    from interviewflow.operators.generate import generate

    prompts = spark.createDataFrame([(str(i), "p") for i in range(64)], "key string, prompt string").coalesce(1)

    def seen(frames):
        import pandas as pd
        from pyspark import TaskContext

        for frame in frames:
            out = frame[["key", "candidate_no"]]
            yield pd.concat([out, pd.DataFrame({"text": [str(TaskContext.get().partitionId())] * len(out), "status": "ok", "error": "", "attempts": 1})], axis=1)

    made = generate(prompts, 1, seen)
    assert made.select("text").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
