"""Multi-line CSV in splits against the reader that takes a file as one task."""

import csv
import random

import pytest

from featloom.sources import records
from featloom.sources.csv import read_csv, read_wide_csv
from featloom.sources.records import csv_records


@pytest.fixture(params=[64, 200, 1 << 20])
def split_bytes(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    kept = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], request.param)
    spark.conf.set(names[1], 1)
    yield request.param
    for n, v in zip(names, kept):
        spark.conf.set(n, v)


def write(path, rows, end="\n"):
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator=end).writerows(rows)
    return str(path)


def table(n, seed=0):
    rng = random.Random(seed)
    bits = ["plain", "a,b", 'say "hi"', "two\nlines", "\n\nblank\n", '"', '""\n"', "é漢😀", "", "x" * 90, "long\n" * 40, "NA"]
    return [["id", "text", "more"]] + [[i, rng.choice(bits), rng.choice(bits)] for i in range(n)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_splits_agree_with_whole_files(spark, tmp_path, split_bytes, end):
    path = write(tmp_path / "t.csv", table(120), end)
    split = read_csv(spark, path, multi_line="split")
    want = [
        (int(i), *(None if v in ("", "NA") else v for v in rest)) for i, *rest in table(120)[1:]
    ]
    assert rows(split) == sorted(want, key=str)
    assert rows(split) == rows(read_csv(spark, path))
    if split_bytes == 64:
        assert csv_records(spark, path).select("path").rdd.getNumPartitions() > 20


def test_many_open_splits(spark, tmp_path, monkeypatch):
    """A join that shuffles the lines keeps the order inside each split."""
    path = write(tmp_path / "t.csv", table(400, 9))
    kept = {n: spark.conf.get(n) for n in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.enabled")}
    monkeypatch.setattr(records, "OPEN_SPLITS", 0)
    for adaptive in ("false", "true"):
        for (n, _), v in zip(kept.items(), ("-1", 300, adaptive)):
            spark.conf.set(n, v)
        try:
            split = read_csv(spark, path, multi_line="split")
            assert "SortMergeJoin" in split._jdf.queryExecution().executedPlan().toString()
            found = rows(split)
        finally:
            for n, v in kept.items():
                spark.conf.set(n, v)
        assert found == rows(read_csv(spark, path))


def test_several_files_and_their_headers(spark, tmp_path, split_bytes):
    paths = [write(tmp_path / f"{k}.csv", table(30 + k, k)) for k in range(4)]
    assert rows(read_csv(spark, paths, multi_line="split")) == rows(read_csv(spark, paths))
    assert rows(read_csv(spark, str(tmp_path), multi_line="split")) == rows(read_csv(spark, str(tmp_path)))
    other = write(tmp_path / "z.csv", [["id", "other", "more"], [1, "a", "b"]])
    with pytest.raises(Exception, match="another header"):
        read_csv(spark, [paths[0], other], multi_line="split").collect()


def test_a_value_over_many_splits_and_no_line_end(spark, tmp_path, split_bytes):
    long = "\n".join(f"line {i}, with a comma" for i in range(300))
    body = f'a,b\n1,"{long}"\n2,"x"\n3,"{long}"'
    path = tmp_path / "t.csv"
    path.write_text(body)
    found = rows(read_csv(spark, str(path), multi_line="split"))
    assert found == [(1, long), (2, "x"), (3, long)]


def test_feature_files_and_empty_ones(spark, tmp_path, split_bytes):
    path = write(tmp_path / "t.csv", [["id", "f0", "f1"], ["a\nb", 1.5, "NaN"], ["c", "", 2]])
    assert rows(read_wide_csv(spark, path, ["id"], multi_line="split")) == [("a\nb", 1.5, None), ("c", None, 2.0)]
    empty = write(tmp_path / "e.csv", [["id", "f0"]])
    assert read_wide_csv(spark, empty, ["id"], multi_line="split").count() == 0
    with pytest.raises(ValueError, match="multi_line"):
        read_csv(spark, path, multi_line="yes")
