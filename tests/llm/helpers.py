"""Odd documents and small tables shared by the tests of this folder."""

from __future__ import annotations

import duckdb

import __spark_entry__ as entry
from tests.oracle import DATA

SF = f"{DATA}/sf0.001"

#: Null id and text, empty, blank, one word, ties, repeats, controls, long text without blanks.
ODD = [
    (None, "a row without an id and a few words more"),
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r "),
    (4, "word"),
    (5, "x" * 70_000),
    (6, "the same line\nthe same line\n\nother line"),
    (6, "the same line\nthe same line\n\nother line"),
    (7, "12345 --- !!! ###"),
    (8, "naïve Ünïcode 漢字 😀 a b c a b c a b c"),
    (9, "one two three four five six seven eight nine ten " * 3),
    (10, "\x00 zero \ud7ff byte"),
]


def odd_docs(spark):
    """Documents with odd rows and columns whose names clash with results."""
    rows = [(i, t, "en", "s", 1, 0.5, "x", 3, True, "r") for i, t in ODD]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, score double, "
        "host string, n_tokens int, kept boolean, rule string",
    )


def empty_docs(spark):
    return odd_docs(spark).limit(0)


def run(spark, name: str, folder: str = SF):
    return entry.queries()[name](spark, folder)


def table(name: str, folder: str = SF) -> list[tuple]:
    return duckdb.sql(f"SELECT * FROM '{folder}/{name}.parquet'").fetchall()


def documents(folder: str = SF) -> list[tuple[int, str]]:
    return [(r[0], r[1]) for r in table("documents", folder)]


def write_tables(spark, folder: str, docs, labels=None, benchmark=None) -> str:
    """A data folder with these tables."""
    docs.write.parquet(f"{folder}/documents.parquet")
    if labels is not None:
        labels.write.parquet(f"{folder}/labels.parquet")
    if benchmark is not None:
        benchmark.write.parquet(f"{folder}/benchmark.parquet")
    return folder
