"""The corpus pipeline: stages from documents to token ids, each written as Parquet and read again.

Every stage handles nulls, empty and very long texts, repeated rows, empty tables and extra columns as
the docstring of its operator says; extra columns pass unchanged, also those called like results.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm import decontam, langid, lattice, minhash, suffixdedup
from featloom.llm.common import held_out, read
from featloom.session import ensure_checkpoint_dir


def _aside(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The columns under neutral names, so that none is called like a result."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names


def _text(docs: DataFrame, names: list[str], column: str = "text") -> str:
    return names[docs.columns.index(column)]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language cannot be determined: without text or without a letter.

    A low score alone, as of a short text full of numbers, is no reason to lose a document. Learns from the labelled documents outside the held-out fifth; without any, only letters count.
    """
    known = docs.where(~held_out(F.col("doc_id"), 5, 0))
    net = langid.learn(known)
    if net is None:
        return docs.where(F.coalesce(F.regexp(F.col("text"), F.lit(r"\p{L}")), F.lit(False)))
    plain, names = _aside(docs)
    judged = langid.identify(plain, net, _text(docs, names), names)
    good = judged.where(F.col("lang_pred") != langid.UNDETERMINED)
    return good.select(names).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    plain, names = _aside(docs)
    kept = minhash.without_near_duplicates(plain, _text(docs, names, "doc_id"), _text(docs, names))
    return kept.select(names).toDF(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that also start in a document with a smaller id; n_chars follows the text."""
    plain, names = _aside(docs)
    cut = suffixdedup.without_repeats(plain, _text(docs, names, "doc_id"), _text(docs, names))
    cut = cut.toDF(*docs.columns)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))
    return cut


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item, within its edit budget."""
    plain, names = _aside(docs)
    found = decontam.find_leaks(plain, read(spark, sf_dir, "benchmark"), names, _text(docs, names))
    return found.where(F.size("leaks") == 0).select(names).toDF(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with token_ids, a sampled segmentation, and n_tokens (replaced if there)."""
    docs = docs.drop("token_ids", "n_tokens")
    plain, names = _aside(docs)
    path = public_tokenizers.path("piece_bpe_32k.model")
    made = lattice.encode(plain, path, names, _text(docs, names), _text(docs, names, "doc_id"))
    return made.toDF(*docs.columns, "token_ids").withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: Trained networks, byte-exact suffix matches and sampled segmentations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents, each result written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
