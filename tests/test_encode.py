import numpy as np
import pytest
from pyspark.sql import functions as F

from featloom import fixed
from featloom.operators import encode
from featloom.plans.corpus_encode import encode_corpora, encode_corpora_in_waves, encode_files


def model_of(counter=None, poison="bad"):
    def make():
        def model(batch):
            if counter is not None:
                counter.add(len(batch))
            if any(poison in m for m in batch["message"]):
                raise RuntimeError("cannot read")
            return np.array([[len(m), 3.0] for m in batch["message"]])

        return model

    return make


def segments(spark, n=23, bad=(7, 15)):
    rows = [
        ("ab"[i % 2], f"m{i}", "bad" if i in bad else "x" * (i + 1), None) for i in range(n)
    ]
    df = spark.createDataFrame(rows, "dataset_name string, message_id string, message string, o int")
    return df.repartition(3)


@pytest.mark.parametrize("batch_size", [1, 4, 64])
def test_only_the_failing_rows_are_quarantined(spark, batch_size):
    rows = encode.encode_rows(segments(spark), model_of(), 2, ["message_id"], ["message"], batch_size)
    good, bad = encode.split_encoded(rows)
    assert {r.message_id: list(r.embedding) for r in good.collect()} == {
        f"m{i}": [i + 1.0, 3.0] for i in range(23) if i not in (7, 15)
    }
    assert {r.message_id: r.error for r in bad.collect()} == {
        "m7": "RuntimeError: cannot read", "m15": "RuntimeError: cannot read"
    }


def test_normalize_and_wrong_shape(spark):
    df = segments(spark, bad=())
    rows = encode.encode_rows(df, model_of(), 2, ["message_id"], ["message"], normalize=True)
    norms = [np.linalg.norm(r.embedding) for r in rows.collect()]
    assert np.allclose(norms, 1, atol=1e-6)
    short = encode.encode_rows(df, lambda: lambda b: np.ones((len(b) + 1, 2)), 2, ["message_id"], ["message"])
    assert short.where("error like 'ValueError%'").count() == 23


def test_the_model_runs_once_for_both_outputs(spark):
    calls = spark.sparkContext.accumulator(0)
    good, bad = encode.batch_encode(
        segments(spark, bad=()), model_of(calls), 2, ["message_id"], ["message"]
    )
    assert (good.count(), bad.count(), good.count()) == (23, 0, 23)
    assert calls.value == 23


def test_the_model_is_built_once_per_worker(spark):
    built = spark.sparkContext.accumulator(0)

    def make():
        built.add(1)
        return lambda batch: np.ones((len(batch), 2))

    df = segments(spark, 200).repartition(40)
    assert encode.encode_rows(df, make, 2, ["message_id"], ["message"], 5).count() == 200
    assert 1 <= built.value <= spark.sparkContext.defaultParallelism


def test_empty_table(spark):
    rows = encode.encode_rows(segments(spark).limit(0), model_of(), 2, ["message_id"], ["message"])
    assert rows.count() == 0 and rows.columns == ["message_id", "embedding", "error"]


def test_corpora_are_written_apart_and_never_over_each_other(spark, tmp_path):
    target, quarantine = str(tmp_path / "emb"), str(tmp_path / "bad")
    encode_corpora(segments(spark), model_of(), 2, ["message"], target, quarantine)
    written = spark.read.parquet(target)
    assert {r.dataset_name: r["count"] for r in written.groupBy("dataset_name").count().collect()} \
        == {"a": 12, "b": 9}
    assert spark.read.parquet(quarantine).count() == 2
    with pytest.raises(Exception, match="output exists"):
        encode_corpora(segments(spark), model_of(), 2, ["message"], target, str(tmp_path / "x"))


def test_corpora_in_waves(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    args = (segments(spark), model_of(calls), 2, ["message"], str(tmp_path / "t"), 1)
    assert encode_corpora_in_waves(*args, most_waves=3) is None
    good, bad = encode_corpora_in_waves(*args)
    assert calls.value == 23 and good.count() == 21
    assert {r.message_id for r in bad.collect()} == {"m7", "m15"}
    encode_corpora(*args[:4], str(tmp_path / "emb"), str(tmp_path / "bad"), 1)
    want = spark.read.parquet(str(tmp_path / "emb")).select(*good.columns)
    assert good.exceptAll(want).count() == 0 and want.count() == 21


def test_files_are_encoded_by_path(spark, tmp_path):
    for name in ("a.wav", "a.mp3", "b.WAV", "c.Wav", "notes.txt"):
        (tmp_path / name).write_bytes(b"12345")

    def make():
        def model(batch):
            return np.array([[float("mp3" in p), 1.0] for p in batch["path"]])

        return model

    out = str(tmp_path / "out")
    encode_files(spark, str(tmp_path), make, 2, out, str(tmp_path / "bad"))
    table = spark.read.parquet(out)
    assert sorted(r.stem for r in table.collect()) == ["a", "a", "b"]
    last = {r.stem: r.path.rsplit("/", 1)[1] for r in encode.last_write_wins(table).collect()}
    assert last == {"a": "a.wav", "b": "b.WAV"}


def test_unknown_encoder_gets_the_default(spark):
    df = spark.createDataFrame(
        [(m,) for m, _, _ in fixed.ENCODERS] + [("other",), (None,)], "model_id string"
    )
    got = {r.model_id: (r.emb_dims, r.text_model) for r in encode.resolve_encoder(df).collect()}
    tiny = (384, "sentence-transformers/all-MiniLM-L12-v2")
    assert got["other"] == got[None] == got["openai/whisper-tiny"] == tiny
    assert got["openai/whisper-medium"] == (1024, "sentence-transformers/all-roberta-large-v1")


def test_distinct_inputs(spark):
    df = spark.createDataFrame([("p",), ("p",), ("q",)], "path string")
    assert sorted(r.path for r in encode.distinct_inputs(df).collect()) == ["p", "q"]


def test_prep_edges(spark):
    from featloom.operators import prep

    df = spark.createDataFrame(
        [("a", 1.0, 5.0), ("a", 3.0, 5.0), ("b", 2.0, 1.0), ("c", None, float("nan"))],
        "dataset_name string, ope double, agr double",
    )
    out = prep.zscore_rescale(df, cols=["ope", "agr"], target=(10.0, 2.0)).orderBy(
        "dataset_name", "ope"
    ).collect()
    half = 2 / np.sqrt(2)
    assert [r.ope for r in out] == [pytest.approx(10 - half), pytest.approx(10 + half), None, None]
    assert [r.agr for r in out] == [None] * 4

    feats = spark.createDataFrame([([1.0, 2.0],), ([3.0, 6.0],)], "embedding array<double>")
    assert tuple(prep.embedding_distribution(feats).first()) == (3.0, 1.5)
    assert prep.embedding_distribution(feats, ddof=1).first().std == pytest.approx(3 / np.sqrt(2))
    scaled = prep.zscore_rescale(
        df, cols=["ope"], target=prep.embedding_distribution(feats)
    ).orderBy("ope").collect()
    assert [r.ope for r in scaled if r.ope is not None][0] == pytest.approx(3 - 1.5 / np.sqrt(2))


def test_padding_and_masks(spark):
    from featloom.operators import prep

    df = spark.createDataFrame(
        [(0, [1.0]), (0, [1.0, 2.0, 3.0]), (1, [4.0, 5.0]), (1, [])],
        "batch_id int, x array<double>",
    )
    got = prep.pad_to_batch(df, "batch_id", "x").collect()
    assert sorted(map(str, (list(r.x) for r in got))) == [
        "[0.0, 0.0]", "[1.0, 0.0, 0.0]", "[1.0, 2.0, 3.0]", "[4.0, 5.0]"
    ]
    text = spark.createDataFrame([(0, "a  b c"), (0, " d"), (1, "")], "batch_id int, m string")
    tokens = text.withColumn("t", prep.words(F.col("m")))
    got = prep.truncate_mask(tokens, "t", 2, batch="batch_id").collect()
    assert {r.m: (list(r.t), list(r.attention_mask)) for r in got} == {
        "a  b c": (["a", "b"], [1, 1]), " d": (["d", ""], [1, 0]), "": ([], [])
    }
    alone = prep.truncate_mask(tokens, "t", 2).collect()
    assert {r.m: list(r.attention_mask) for r in alone} == {"a  b c": [1, 1], " d": [1], "": []}
