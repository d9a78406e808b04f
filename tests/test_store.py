import pytest
from pyspark.sql import functions as F

from interviewflow.operators import store as stores
from interviewflow.operators.generate import per_request, run_resumable
from interviewflow.operators.store import attempt_ledger, commits, live_batches, pack, read_results
from interviewflow.sources.files import delete, exists, names_in, put_text, read_text


def counted(spark):
    return spark.sparkContext.accumulator(0)


def paid(calls, fail=lambda request: False):
    def call(request):
        calls.add(1)
        if fail(request):
            raise ValueError(f"no {request['candidate_no']}")
        return f"{request['prompt']}{request['candidate_no']}"

    return per_request(call)


def table(spark, kind, n=50):
    return spark.range(n).select(F.col("id").cast(kind).alias("key"), F.concat(F.lit("p"), "id").alias("prompt"))


def test_small_files(spark, tmp_path):
    place = str(tmp_path)
    put_text(spark, f"{place}/log/a.json", "é")
    put_text(spark, f"{place}/log/a.json", "two")
    assert read_text(spark, f"{place}/log/a.json") == "two" and names_in(spark, f"{place}/log") == ["a.json"]
    assert names_in(spark, f"{place}/none") == [] and not exists(spark, f"{place}/none")
    delete(spark, f"{place}/log")
    assert not exists(spark, f"{place}/log")


@pytest.mark.parametrize("first,second", [("int", "bigint"), ("bigint", "string"), ("string", "int"), ("double", "bigint"), ("int", "decimal(12,2)")])
def test_a_resumed_run_pays_nothing_for_keys_of_another_type(spark, tmp_path, first, second):
    store, calls = str(tmp_path / "store"), counted(spark)
    run_resumable(table(spark, first), 2, paid(calls), store, "r1")
    again = run_resumable(table(spark, second), 2, paid(calls), store, "r2", batches=3)
    assert calls.value == 100 and again.count() == 100
    assert dict(again.dtypes)["key"] == dict(table(spark, second).dtypes)["key"]
    assert {r.text for r in again.collect()} == {f"p{i}{k}" for i in range(50) for k in (1, 2)}


def test_any_number_of_batches_commits(spark, tmp_path):
    store, calls = str(tmp_path / "store"), counted(spark)

    def stops(frames):
        for frame in frames:
            if "17" in set(frame["key"]):
                raise RuntimeError("stopped")
            yield from paid(calls)(iter([frame]))

    with pytest.raises(Exception, match="stopped"):
        run_resumable(table(spark, "string"), 1, stops, store, "r1", batches=100)
    kept = read_results(spark, store).count()
    done = commits(spark, store)
    assert kept == sum(c["rows"] for c in done.values()) and all(c["rows"] <= 4 for c in done.values())
    before = calls.value
    whole = run_resumable(table(spark, "string"), 1, paid(calls), store, "r2", batches=7)
    assert whole.count() == 50 and calls.value - before == 50 - kept
    assert not exists(spark, f"{store}/pending")


def test_files_are_no_more_than_tasks(spark, tmp_path):
    store, calls = tmp_path / "store", counted(spark)
    run_resumable(table(spark, "bigint"), 4, paid(calls), str(store), "r1", partitions=3)
    assert len(list(store.rglob("*.parquet"))) <= 3
    run_resumable(table(spark, "bigint"), 4, paid(calls), str(store), "r2")
    assert len(list(store.rglob("*.parquet"))) <= 3 and len(live_batches(spark, str(store))) == 1


def test_a_batch_without_commit_is_not_seen(spark, tmp_path):
    store, calls = str(tmp_path / "store"), counted(spark)
    run_resumable(table(spark, "int"), 1, paid(calls), store, "r1")
    rows = read_results(spark, store)
    rows.withColumn("text", F.lit("half")).write.parquet(f"{store}/data/torn")
    assert read_results(spark, store).where("text = 'half'").isEmpty()


def test_packing_keeps_rows_and_open_tables(spark, tmp_path, monkeypatch):
    from interviewflow.operators import generate

    store, calls = str(tmp_path / "store"), counted(spark)
    monkeypatch.setattr(generate, "PACK_AT", 3)
    early = run_resumable(table(spark, "int", 5), 1, paid(calls), store, "r1")
    whole = run_resumable(table(spark, "int"), 1, paid(calls), store, "r2", batches=10)
    assert len(live_batches(spark, store)) == 1 and len(commits(spark, store)) == 1
    assert early.count() == 5 and whole.count() == 50 and calls.value == 50
    more = run_resumable(table(spark, "int"), 2, paid(calls), store, "r3")
    assert more.count() == 100 and calls.value == 100
    pack(spark, store, 2)
    assert read_results(spark, store).count() == 100 and len(names_in(spark, f"{store}/data")) == 3
    # A commit that was lost on the way changes nothing for readers.
    assert run_resumable(table(spark, "int"), 2, paid(calls), store, "r4").count() == 100 and calls.value == 100


def test_attempts_add_up_and_dead_requests_are_not_paid_again(spark, tmp_path):
    store, calls = str(tmp_path / "store"), counted(spark)
    odd = paid(calls, lambda request: request["key"] % 2)
    for run in ("r1", "r2", "r3", "r4"):
        run_resumable(table(spark, "int", 10), 1, odd, store, run, max_attempts=3)
    assert calls.value == 5 + 3 * 5
    ledger = {int(r.key): r for r in attempt_ledger(spark, store, 3).collect()}
    assert all((r.attempts, r.state, r.error) == ((3, "dead", "no 1") if k % 2 else (1, "ok", None)) for k, r in ledger.items())
    # With a higher bound they are asked again.
    run_resumable(table(spark, "int", 10), 1, paid(calls), store, "r5", max_attempts=4)
    assert calls.value == 25 and {r.state for r in attempt_ledger(spark, store, 4).collect()} == {"ok"}


def test_a_failed_request_waits(spark, tmp_path):
    store, calls = str(tmp_path / "store"), counted(spark)
    broken = paid(calls, lambda request: True)
    run_resumable(table(spark, "int", 2), 1, broken, store, "r1", retry_after=3600)
    run_resumable(table(spark, "int", 2), 1, broken, store, "r2", retry_after=3600)
    assert calls.value == 2
    row = attempt_ledger(spark, store, retry_after=3600).first()
    asked = read_results(spark, store).first().asked_at
    assert row.state == "open" and 3500 < (row.due - asked).total_seconds() < 3700
    run_resumable(table(spark, "int", 2), 1, paid(calls), store, "r3")
    assert calls.value == 4 and stores.attempt_ledger(spark, store).where("state <> 'ok'").isEmpty()
