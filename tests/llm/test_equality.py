"""Texts made to share a polynomial hash, and tasks on workers that do not have the package."""

import os
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest

from featloom.llm import lattice, minhash, shingles, suffixdedup
from tests.llm.helpers import SF

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def thue_morse(n, a="a", b="b"):
    """The word and its complement: they agree in every polynomial modulo 2**64 from 1,024 letters on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(a if x else b for x in bits), "".join(b if x else a for x in bits)


WORDS = [thue_morse(n, *ab) for n in (1024, 2048, 4096) for ab in ("ab", "xé")]


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_the_words_agree_in_a_polynomial():
    """So the tests below mean something."""
    codes = np.array([[ord(c) for c in w] for w in WORDS[0]])
    hashes = [lattice._part(lattice._prefix(c), np.array([0]), np.array([len(c)]))[0] for c in codes]
    assert hashes[0] == hashes[1]


def test_word_hashes_differ():
    for pair in WORDS:
        found, _ = shingles.words(*flat(pair))
        assert len(found) == 2 and found[0] != found[1]


def test_stretches_of_all_sizes():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 3, 30_000).astype(np.uint8)
    start = rng.integers(0, 20_000, 4000)
    size = np.concatenate([rng.integers(0, 30, 3990), rng.integers(4000, 9000, 10)])
    hashes = shingles.stretch_hashes(data, start, size)
    strings = [data[s : s + n].tobytes() for s, n in zip(start, size, strict=True)]
    assert len(set(zip(strings, hashes.tolist(), strict=True))) == len(set(strings)) == len(set(hashes.tolist()))
    alone = [shingles.stretch_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0] for x in strings[:200]]
    assert alone == hashes[:200].tolist()


@pytest.mark.parametrize("together", [True, False])
def test_sampled_segmentations_are_lossless(spark, together):
    texts = [w for pair in WORDS for w in pair] + [f"{a} and {b}" for a, b in WORDS]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1 if together else 7)
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert all(r.lossless for r in lattice.round_trip(docs, path, ["doc_id"]).collect())


def test_near_duplicates_keep_the_words_apart(spark):
    rows = [(i, w) for i, w in enumerate(w for pair in WORDS for w in pair)]
    rows += [(100 + i, "one two three four " + w) for i, (_, w) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert all(r.kept for r in minhash.near_duplicates(docs).collect())


def test_repeated_bytes_of_the_words(spark):
    docs = []
    for pair in WORDS[:4]:
        docs += [f"{pair[0]}|{pair[1]}", pair[1], "new " + pair[0][100:300] + " old", pair[0] * 2]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.n_removed for r in suffixdedup.repeated_bytes(df).collect()}
    seen: set[bytes] = set()
    for i, text in enumerate(docs):
        raw = text.encode()
        windows = [raw[k : k + 50] for k in range(len(raw) - 49)]
        gone = np.zeros(len(raw), bool)
        for k, w in enumerate(windows):
            if w in seen:
                gone[k : k + 50] = True
        seen |= set(windows)
        assert found[i] == gone.sum()


def test_pieces_of_one_hash_are_told_apart():
    texts = ["a" * 60, "b" * 60, "a" * 60, "c" * 60]
    data, offsets = flat(texts)
    same = np.ones(4, np.uint64)
    place, size = offsets[:-1], np.full(4, 60)
    pick, index = suffixdedup._pieces(same, same, size - 49, 4, data, place, size)
    assert len(pick) == 3 and index[0] == index[2] and len(set(index.tolist())) == 3


def test_one_byte_anywhere_tells_pieces_apart():
    rng = np.random.default_rng(3)
    for size in (50, 51, 56, 57, 63, 64, 200):
        piece = rng.integers(0, 256, size).astype(np.uint8)
        copies = np.tile(piece, size + 2)
        for k in range(size):
            copies[(k + 1) * size + k] ^= 1
        place = np.arange(size + 2) * size
        found = suffixdedup._unlike(copies, place, np.zeros(size + 2, np.int64), np.full(size + 2, size))
        assert found.tolist() == [False] + [True] * size + [False]


QUERIES = [f"op{n}" for n in range(1, 14)] + ["pipeline"]


def test_all_run_without_the_package_on_the_workers(tmp_path):
    """From another folder, with the package on the driver's path only."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
queries = entry.queries()
names = [n for n in queries if n.split("_")[0] in {QUERIES!r}]
assert len(names) == len({QUERIES!r}), names
for name in names:
    print(name, queries[name](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, timeout=900, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.startswith(("op", "pipe")))
    assert all(int(n) > 0 for n in counts.values()) and len(counts) == len(QUERIES)
