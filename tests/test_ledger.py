import numpy as np
import pytest
from pyspark.sql import functions as F

from featloom.operators import encode
from featloom.sinks import ledger


def model_of(counter, dims=2):
    def make():
        def model(batch):
            counter.add(len(batch))
            if any(m == "bad" for m in batch["message"]):
                raise RuntimeError("cannot read")
            return np.array([[len(m or ""), 3.0] for m in batch["message"]])

        return model

    return make


def table(spark, n=60, start=0):
    rows = [(f"m{i}", None if i % 11 == 0 else "x" * (i % 7)) for i in range(start, n)]
    return spark.createDataFrame(rows, "message_id string, message string").repartition(3)


def resume(df, counter, target, **more):
    return ledger.encode_resumable(
        df, model_of(counter), 2, ["message_id"], ["message"], str(target), batch_size=1, ranges=16, waves=5, **more
    )


def content(df):
    rows = [(r.message_id, None if r.embedding is None else tuple(r.embedding), r.error) for r in df.collect()]
    return sorted(rows, key=repr)


def plain(df, spark):
    return content(encode.encode_rows(df, model_of(spark.sparkContext.accumulator(0)), 2, ["message_id"], ["message"], 1))


def test_a_job_in_parts_gives_the_table_of_one_run_and_sees_each_row_once(spark, tmp_path):
    calls, df = spark.sparkContext.accumulator(0), table(spark)
    assert resume(df, calls, tmp_path, most_waves=2) is False
    part = calls.value
    assert 0 < part < 60
    assert ledger.read_encoded(spark, str(tmp_path)).count() == part
    assert resume(df, calls, tmp_path) is True
    assert calls.value == 60
    assert content(ledger.read_encoded(spark, str(tmp_path))) == plain(df, spark)
    assert resume(df, calls, tmp_path) is True
    assert calls.value == 60


def test_a_wave_without_an_entry_is_not_read_and_done_again(spark, tmp_path, monkeypatch):
    calls, df = spark.sparkContext.accumulator(0), table(spark)
    commit, waves = ledger._commit, []

    def stopped(*args):
        if len(waves) == 2:
            raise KeyboardInterrupt
        waves.append(calls.value)
        commit(*args)

    monkeypatch.setattr(ledger, "_commit", stopped)
    with pytest.raises(KeyboardInterrupt):
        resume(df, calls, tmp_path)
    lost = calls.value - waves[-1]
    assert lost > 0
    assert ledger.read_encoded(spark, str(tmp_path)).count() == waves[-1]
    monkeypatch.setattr(ledger, "_commit", commit)
    assert resume(df, calls, tmp_path) is True
    assert calls.value == 60 + lost
    assert content(ledger.read_encoded(spark, str(tmp_path))) == plain(df, spark)


def test_a_model_that_kills_its_worker_ends_the_job_but_not_what_is_finished(spark, tmp_path):
    calls, df = spark.sparkContext.accumulator(0), table(spark)
    assert resume(df, calls, tmp_path, most_waves=1) is False
    done = calls.value

    def make():
        import os

        return lambda batch: os._exit(1)

    with pytest.raises(Exception, match="(?i)worker|crash|exit"):
        ledger.encode_resumable(df, make, 2, ["message_id"], ["message"], str(tmp_path), ranges=16, waves=5)
    assert ledger.read_encoded(spark, str(tmp_path)).count() == done
    assert resume(df, calls, tmp_path) is True
    assert calls.value == 60
    assert content(ledger.read_encoded(spark, str(tmp_path))) == plain(df, spark)


def test_new_rows_only_are_encoded_later(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    assert resume(table(spark, 40), calls, tmp_path)
    assert resume(table(spark, 60), calls, tmp_path)
    assert calls.value == 60
    assert content(ledger.read_encoded(spark, str(tmp_path))) == plain(table(spark), spark)


def test_failing_repeated_and_null_rows(spark, tmp_path):
    rows = [("a", "bad"), ("b", None), (None, "xy"), (None, None)] + [("hot", "xyz")] * 40
    df = spark.createDataFrame(rows, "message_id string, message string")
    assert resume(df, spark.sparkContext.accumulator(0), tmp_path)
    found = ledger.read_encoded(spark, str(tmp_path))
    assert found.count() == 44
    good, bad = encode.split_encoded(found)
    assert [(r.message_id, r.error) for r in bad.collect()] == [("a", "RuntimeError: cannot read")]
    assert good.where("message_id = 'hot'").count() == 40


def test_empty_table_other_settings_and_a_second_writer(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    assert resume(table(spark).limit(0), calls, tmp_path / "none") is True
    assert ledger.read_encoded(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="nothing finished"):
        ledger.read_encoded(spark, str(tmp_path / "other"))
    assert resume(table(spark, 9), calls, tmp_path / "t") is True
    with pytest.raises(ValueError, match="other settings"):
        resume(table(spark, 9), calls, tmp_path / "t", normalize=True)
    taken = ledger.ledger(spark, str(tmp_path / "t"))[-1]
    with pytest.raises(Exception, match="(?i)exist"):
        ledger._commit(spark, str(tmp_path / "t"), taken["number"], {"number": -1})
    assert ledger.ledger(spark, str(tmp_path / "t"))[-1] == taken


def distinct(df, counter, **more):
    return encode.encode_distinct(df, model_of(counter), 2, ["message_id"], ["message"], batch_size=1, **more)


@pytest.mark.parametrize("hot_share", [1000, 4])
def test_the_model_sees_each_different_input_once(spark, monkeypatch, hot_share):
    monkeypatch.setattr(encode, "HOT_SHARE", hot_share)
    rows = [(f"m{i}", f"text {i % 9}") for i in range(60)] + [(f"h{i}", "hot") for i in range(40)]
    rows += [(f"n{i}", None) for i in range(5)] + [("e", ""), (None, "text 1"), ("b", "bad"), ("b", "bad")]
    df = spark.createDataFrame(rows, "message_id string, message string").repartition(4)
    calls = spark.sparkContext.accumulator(0)
    found = content(distinct(df, calls))
    assert calls.value == 13
    error = "RuntimeError: cannot read"
    want = [(i, None, error) if m == "bad" else (i, (float(len(m or "")), 3.0), None) for i, m in rows]
    assert found == sorted(want, key=repr)


def test_inputs_that_share_a_digest_keep_apart(spark, monkeypatch):
    df = spark.createDataFrame([("a", "x"), ("b", "yy"), ("c", "x"), ("d", None)], "message_id string, message string")
    monkeypatch.setattr(encode.F, "xxhash64", lambda *a: F.lit(7).cast("long"))
    found = distinct(df, spark.sparkContext.accumulator(0))
    monkeypatch.undo()
    assert [(i, v) for i, v, _ in content(found)] == [("a", (1.0, 3.0)), ("b", (2.0, 3.0)), ("c", (1.0, 3.0)), ("d", (0.0, 3.0))]


def test_different_inputs_through_a_resumable_job(spark, tmp_path):
    df = spark.createDataFrame([(f"m{i}", "x" * (i % 5)) for i in range(50)], "message_id string, message string")
    calls = spark.sparkContext.accumulator(0)

    def once(different, names):
        ledger.encode_resumable(different, model_of(calls), 2, names, ["message"], str(tmp_path), 1)
        return ledger.read_encoded(spark, str(tmp_path))

    first = content(distinct(df, calls, encode=once))
    assert content(distinct(df, calls, encode=once)) == first and calls.value == 5
    assert [v for _, v, _ in first] == [(float(int(i[1:]) % 5), 3.0) for i, _, _ in first]


def test_distinct_of_an_empty_table(spark):
    assert distinct(table(spark).limit(0), spark.sparkContext.accumulator(0)).count() == 0
