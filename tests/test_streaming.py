"""Row-local operators on a streaming DataFrame."""

import numpy as np
from pyspark.sql import functions as F

from featloom.functions import vectors
from featloom.operators import encode, groupfeats, reshape
from featloom.sources import media


def drain(spark, stream, tmp_path, name):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / name)).start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def test_row_local_operators_agree_with_batch(spark, tmp_path):
    batch = spark.createDataFrame(
        [("a", f"m{i}", f"{i}.wav", "x" * (i + 1), [float(i), 1.0, 2.0], float(i)) for i in range(6)],
        "dataset_name string, message_id string, filename string, message string, "
        "embedding array<double>, ope double",
    )
    source = str(tmp_path / "in")
    batch.write.parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(source)
    ids = spark.createDataFrame([("m1",), ("m4",)], "message_id string")

    def model():
        return lambda b: np.array([[len(m), 1.0] for m in b["message"]])

    shapes = {
        "unit": lambda d: d.select("message_id", vectors.l2_normalize(F.col("embedding")).alias("v")),
        "vec_long": lambda d: reshape.vec_to_long(d, ["message_id"], "embedding"),
        "long": lambda d: reshape.to_long(d, ["message_id"], ["ope"]),
        "cohort": lambda d: groupfeats.cohort(d.select("message_id", "ope"), ids),
        "paths": lambda d: media.with_media_path(d, {"a": "/m"}).select("path"),
        "encoded": lambda d: encode.encode_rows(d, model, 2, ["message_id"], ["message"]),
    }
    for name, shape in shapes.items():
        want = sorted(map(tuple, shape(batch).collect()), key=str)
        assert drain(spark, shape(stream), tmp_path, name) == want
