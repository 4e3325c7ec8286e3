"""Input that once gave silent wrong answers: ragged, missing, reordered, misspelt or crowded."""

from math import exp, log

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featloom.functions import vectors
from featloom.functions.stats import log_tail, log_two_sided_p
from featloom.operators import encode, groupfeats, index, pooling, prep, reshape, runlog
from featloom.plans import corpus_encode, feature_tables
from featloom.plans.training_prep import prepare_batches
from featloom.sources.csv import read_csv


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


# --- tails ---------------------------------------------------------------------------


@pytest.mark.parametrize(
    "t, nu, p",
    [
        (12, 149, 1.2209073687e-23), (9, 1999, 5.1186138347e-19), (9, 2001, 5.1145353077e-19),
        (12, 20000, 4.6150376584e-33), (2, 1, 0.29516723530086664), (1, 10, 0.34089313230206),
        (1.959963984540054, 1e9, 0.05000000027729522), (0, 7, 1.0),
    ],
)
def test_tail_has_relative_precision(t, nu, p):
    assert exp(log_tail(t, nu)) == pytest.approx(p, rel=1e-9)


def test_rank_by_p_follows_t(spark):
    ts = np.linspace(0.1, 400, 300)
    df = spark.createDataFrame([(float(t), 50.0) for t in ts], "t double, nu double")
    found = df.select("t", log_two_sided_p(F.col("t"), F.col("nu")).alias("p")).orderBy("p").collect()
    assert [r.t for r in found] == sorted(ts.tolist(), reverse=True)
    assert log_tail(None, 3) is None and log_tail(1.0, 0) is None
    assert log_tail(float("inf"), 3) == float("-inf")
    assert found[0].p < log(1e-40)


# --- widths ---------------------------------------------------------------------------


def ragged(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0]), (3, None)]
    return spark.createDataFrame(rows, "message_id int, embedding array<double>")


@pytest.mark.parametrize("dims", [None, 2])
def test_another_width_is_an_error(spark, dims):
    segments = spark.createDataFrame([(7, 1), (7, 2), (8, 9)], "user_id int, message_id int")
    with pytest.raises(Exception, match="width"):
        reshape.vec_to_cols(ragged(spark), ["message_id"], "embedding", dims).collect()
    with pytest.raises(Exception, match="width"):
        groupfeats.group_mean(segments, ragged(spark), dims=dims).collect()


def test_dense_head_keeps_rows_apart(spark):
    w, b = np.eye(4), np.zeros(4)
    rows = [([1.0, 2.0, 3.0, 4.0],), (None,), ([5.0, 6.0, 7.0, 8.0],)]
    df = spark.createDataFrame(rows, "v array<double>").coalesce(1)
    got = [r.h for r in df.select(vectors.dense(F.col("v"), w, b, "identity").alias("h")).collect()]
    assert got == [r[0] for r in rows]
    odd = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0],), ([0.0] * 8,)], "v array<double>")
    with pytest.raises(Exception, match="widths"):
        odd.coalesce(1).select(vectors.dense(F.col("v"), w, b)).collect()


# --- order ------------------------------------------------------------------------------


def test_copies_elsewhere_do_not_change_the_order(spark, monkeypatch):
    df = spark.range(500).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    even = {r.a: r.idx for r in index.dense_index(df, seed=5).collect()}
    monkeypatch.setattr(index, "_is_even", lambda keyed: False)
    crowded = {r.a: r.idx for r in index.dense_index(df, seed=5).collect()}
    assert even == crowded


def test_shuffle_key_out_of_range(spark):
    df = spark.createDataFrame([(2**32,)], "k long")
    with pytest.raises(Exception, match="out of range"):
        index.dense_index(df, shuffle_key=F.col("k")).collect()


def test_ids_above_32_bits(spark):
    from featloom.workload.prep import SPREAD

    df = spark.range(3_500_000_000, 3_500_000_300).withColumnRenamed("id", "message_id")
    split = index.exact_split(df, 0.8, shuffle_key=F.expr(SPREAD))
    assert split.where("split = 'train'").count() == 240


# --- files ------------------------------------------------------------------------------


def test_csv_goes_by_name(spark, tmp_path):
    path = write(tmp_path / "a.csv", "message_id,user_id,x\nm1,u1,1.5\n")
    schema = T.StructType(
        [T.StructField("user_id", T.StringType()), T.StructField("message_id", T.StringType()),
         T.StructField("x", T.DoubleType())]
    )
    assert read_csv(spark, path, schema).collect() == [("u1", "m1", 1.5)]
    only = T.StructType([T.StructField("x", T.DoubleType())])
    assert read_csv(spark, path, only).collect() == [(1.5,)]
    with pytest.raises(ValueError, match="not in the header: y"):
        read_csv(spark, path, T.StructType([T.StructField("y", T.StringType())]))


def test_files_must_have_one_header(spark, tmp_path):
    a = write(tmp_path / "a.csv", "id,x\n1,2\n")
    b = write(tmp_path / "b.csv", "x,id\n2,1\n")
    with pytest.raises(Exception, match="header"):
        read_csv(spark, [a, b]).collect()


def test_text_ids_stay_text(spark, tmp_path):
    path = write(tmp_path / "t.csv", "id,x,y\n3f,1,1e2\n3d,2,inf\n7D,3,.5\n")
    df = read_csv(spark, path)
    assert dict(df.dtypes) == {"id": "string", "x": "bigint", "y": "double"}
    assert [r.id for r in df.orderBy("x").collect()] == ["3f", "3d", "7D"]
    number = T.StructType([T.StructField("id", T.DoubleType())])
    with pytest.raises(Exception, match="not a number: 3"):
        read_csv(spark, path, number).collect()


def test_a_blank_id_does_not_change_the_others(spark, tmp_path):
    write(tmp_path / "hitop_embeddings.csv", "message_id,f0000\n1,1\n,9\n2,2\n")
    write(tmp_path / "wtc_embeddings.csv", "message_id,f0000\n11,3\n")
    ids = write(tmp_path / "ids.csv", "message_id\n2\n1\n\n")
    out = str(tmp_path / "out")
    feature_tables.fill_cohort_features(spark, str(tmp_path), ids, out)
    assert sorted(r.group_id for r in spark.read.parquet(out).collect()) == ["1", "2"]


# --- encoding ---------------------------------------------------------------------------


def constant(width):
    return lambda: lambda batch: np.ones((len(batch), width))


def test_ids_pass_untouched(spark):
    rows = [(9007199254740993, "a"), (None, "b"), (2**62 + 1, "c")]
    df = spark.createDataFrame(rows, "id long, message string").coalesce(1)
    got = encode.encode_rows(df, constant(2), 2, ["id"], ["message"]).collect()
    assert [r.id for r in got] == [r[0] for r in rows]


def test_a_wrong_width_goes_to_quarantine(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, message string")
    good, bad = encode.batch_encode(df, constant(3), 2, ["id"], ["message"])
    assert good.count() == 0
    assert all("2 wanted" in r.error for r in bad.collect())


@pytest.mark.parametrize("taken", ["target", "quarantine"])
def test_outputs_are_checked_before_the_model(spark, tmp_path, taken):
    calls = spark.sparkContext.accumulator(0)

    def make():
        calls.add(1)
        return lambda batch: np.ones((len(batch), 2))

    (tmp_path / taken).mkdir()
    df = spark.createDataFrame([("a", "m", "x")], "dataset_name string, message_id string, message string")
    with pytest.raises(ValueError, match="output exists"):
        corpus_encode.encode_corpora(
            df, make, 2, ["message"], str(tmp_path / "target"), str(tmp_path / "quarantine")
        )
    assert calls.value == 0


# --- rows that once went missing --------------------------------------------------------


def test_rows_without_a_batch_are_padded_too(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0]), (None, [3.0])], "b int, x array<double>")
    got = sorted((r.b or 0, r.x) for r in prep.pad_to_batch(df, "b", "x").collect())
    assert got == [(0, [3.0]), (1, [1.0, 0.0]), (1, [1.0, 2.0])]
    words = spark.createDataFrame([(None, ["a"]), (2, ["a", "b"])], "b int, t array<string>")
    assert prep.truncate_mask(words, "t", batch="b").count() == 2


def test_sequences_of_missing_vectors_stay(spark):
    rows = [("a", 0, 1, [2.0, 4.0]), ("a", 1, 1, None), ("b", 0, 1, None)]
    df = spark.createDataFrame(rows, "seq_id string, pos int, mask int, vec array<double>")
    got = {r.seq_id: r.vec for r in pooling.mean_pool(df).collect()}
    assert got == {"a": [2.0, 4.0], "b": None}


@pytest.mark.parametrize("positions", [(1, 2, 3), (0, 2, 3), (0, 0, 2)])
def test_last_pool_rejects_other_positions(spark, positions):
    rows = [("s", p, 1, [float(i)]) for i, p in enumerate(positions)]
    df = spark.createDataFrame(rows, "seq_id string, pos int, mask int, vec array<double>")
    with pytest.raises(Exception, match="positions are not"):
        pooling.last_pool(df).collect()


def test_rows_without_a_run_are_one_run(spark):
    rows = [(run, e, "val", 5.0) for run in (None, 1) for e in range(6)]
    df = spark.createDataFrame(rows, "run_id int, epoch int, phase string, sum_loss double")
    got = runlog.plateau_lr(df, 1.0, patience=2).collect()
    by_run = {run: [r.lr for r in sorted(got, key=lambda r: r.epoch) if r.run_id == run] for run in (None, 1)}
    assert by_run[None] == by_run[1] == pytest.approx([1.0, 1.0, 1.0, 0.1, 0.1, 0.1])


def test_common_ids_of_many_frames(spark):
    frames = [spark.range(i % 3, 10).withColumnRenamed("id", "user_id") for i in range(70)]
    assert sorted(r.user_id for r in groupfeats.common_ids(frames).collect()) == list(range(2, 10))


def test_training_batches_hold_every_row_once(spark):
    def corpus(n, shift):
        return spark.range(n).select(
            F.col("id").alias("message_id"),
            (F.rand(3) + shift).alias("ope"),
            F.repeat(F.lit("w "), (F.col("id") % 5).cast("int")).alias("message"),
        )

    made = prepare_batches({"a": corpus(90, 0), "b": corpus(60, 5)}, 16, cols=["ope"]).collect()
    assert len({(r.dataset_name, r.message_id) for r in made}) == len(made) == 150
    assert sum(r.split == "train" for r in made) == 120
    batches: dict = {}
    for r in made:
        assert len(r.tokens) == len(r.attention_mask)
        batches.setdefault((r.split, r.batch_id), []).append(r)
    for rows in batches.values():
        assert len(rows) <= 16 and len({len(r.tokens) for r in rows}) == 1
    for name in "ab":
        scores = [r.ope for r in made if r.dataset_name == name]
        assert np.mean(scores) == pytest.approx(0, abs=1e-9)
        assert np.std(scores, ddof=1) == pytest.approx(1)
