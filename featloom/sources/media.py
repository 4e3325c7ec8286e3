"""Manifest of media files and their corpus."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom import fixed
from featloom.functions import text


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(target):
        raise ValueError(f"path does not exist: {path}")
    return system.getFileStatus(target).isFile()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Media files at ``path``: ``path, stem, suffix, length, modified``, sorted.

    A folder is not searched recursively and keeps all-lower or all-upper
    suffixes. A single file may have any case; another suffix is an error. The
    content is not read.
    """
    reader = spark.read.format("binaryFile")
    if _is_file(spark, path):
        if os.path.splitext(path)[1].lower() not in fixed.MEDIA_SUFFIXES:
            raise ValueError(f"unsupported format: {path}")
    else:
        kinds = [s[1:] for s in fixed.MEDIA_SUFFIXES]
        kinds += [k.upper() for k in kinds]
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(kinds) + "}")
    return listing(reader.load(path))


def listing(files: DataFrame) -> DataFrame:
    """``path, stem, suffix, length, modified`` of file rows, sorted by path."""
    return files.select(
        "path",
        text.stem(F.col("path")).alias("stem"),
        text.suffix(F.col("path")).alias("suffix"),
        "length",
        F.col("modificationTime").alias("modified"),
    ).orderBy("path")


def with_corpus(df: DataFrame, file: str | None = None) -> DataFrame:
    """Tag rows with the corpus their file name starts with and its id type.

    ``file`` is a column of paths; without it, the file each row was read from.
    """
    path = F.input_file_name() if file is None else F.col(file)
    types = F.create_map(
        *[F.lit(x) for pair in fixed.CORPUS_ID_TYPES.items() for x in pair]
    )
    corpus = text.corpus_of(path)
    return df.withColumn("dataset_name", F.nullif(corpus, F.lit(""))).withColumn(
        "id_type", F.try_element_at(types, F.col("dataset_name"))
    )


def with_media_path(segments: DataFrame, folders: dict[str, str]) -> DataFrame:
    """Path of a segment's media file: its corpus' folder and its file name."""
    pairs = F.create_map(*[F.lit(x) for pair in folders.items() for x in pair])
    folder = F.try_element_at(pairs, F.col("dataset_name"))
    return segments.withColumn("path", text.media_path(folder, F.col("filename")))
