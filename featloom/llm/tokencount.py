"""Token counts of whole texts, exact, also for documents too large to encode at once.

A document above ``huge`` characters is encoded in overlapping chunks with offsets. Two neighbouring
chunks are spliced at a stable common boundary: a place in the overlap where both have a token start,
that follows white space, and from which both agree up to the last white space of the overlap. The
tokenizer's own rules prove it stable: white space ends every pre-token, and no normalisation or
special token reaches across a blank or line break. Where no such place exists the overlap is
doubled, at worst up to the end of the document.

Shorter documents meet the tokenizer by their words: unseen words are encoded together, one to a
line, and the offsets give each word's own count, which is kept for the words to come. The same rule
makes the sum exact; a full stop or comma between an ASCII letter and white space is a word too, as
letters and punctuation never share a pre-token. The memory of words is bounded; a full one starts afresh.

Null text counts as empty: 0 bytes, 0 tokens. An empty table gives an empty result; repeated rows
each get a row. Special strings inside texts count as the tokenizer file says.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

CHUNK = 16_384
OVERLAP = 512
HUGE = 65_536
#: Words kept in memory, and the longest one that is kept.
KNOWN_WORDS = 600_000
LONGEST_WORD = 256
LIMIT = 2048

_ENDING = re.compile("(?<=[A-Za-z])([.,])(?=[ \n])")


class Counter:
    """Counts tokens with one tokenizer file; lives as long as a partition."""

    def __init__(self, path: str, chunk=CHUNK, overlap=OVERLAP, huge=HUGE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap, self.huge = chunk, overlap, huge
        self.known: dict[str, int] = {}

    def _starts(self, text: str, at: int) -> np.ndarray:
        found = self.tokenizer.encode(text, add_special_tokens=False).offsets
        return np.fromiter((x[0] for x in found), np.int64, len(found)) + at

    def long_count(self, text: str) -> int:
        """Tokens of a text, from overlapping chunks."""
        total, begin, done, n = 0, 0, 0, len(text)
        ours, reach = self._starts(text[: self.chunk + self.overlap], 0), self.chunk + self.overlap
        while reach < n:
            border, end = begin + self.chunk, reach
            while True:
                after = min(border + max(self.chunk + self.overlap, 2 * (end - border)), n)
                ahead = self._starts(text[border:after], border)
                place = common_boundary(text, ours, ahead, border, end)
                if place is not None or end >= n:
                    break
                end = min(border + 2 * (end - border), n)  # widen the overlap
                ours = self._starts(text[begin:end], begin)
            if place is None:
                break  # ours reaches the end of the text
            total += int(np.count_nonzero((ours >= done) & (ours < place)))
            done, begin, ours, reach = place, border, ahead, after
        return total + int(np.count_nonzero(ours >= done))

    def _learn(self, words: list[str]) -> dict[str, int]:
        """Counts of words without blanks and line breaks, all encoded together."""
        counts: dict[str, int] = {}
        lines = [words[i : i + 16] for i in range(0, len(words), 16)]
        for at in range(0, len(lines), 256):
            some = lines[at : at + 256]
            found = self.tokenizer.encode_batch(
                ["\n".join(x) for x in some], add_special_tokens=False
            )
            for line, encoded in zip(some, found, strict=True):
                starts = [x[0] for x in encoded.offsets]
                end = before = 0
                for word in line:
                    end += len(word) + 1
                    upto = bisect_left(starts, end)
                    counts[word] = upto - before
                    before = upto
        return counts

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out = [0] * len(texts)
        split = {}
        fresh: set[str] = set()
        for i, text in enumerate(texts):
            if len(text) > self.huge:
                out[i] = self.long_count(text)
            else:
                split[i] = words = _ENDING.sub(r" \1", text).replace("\n", " ").split(" ")
                fresh.update(words)
        fresh.difference_update(self.known)
        fresh.discard("")
        long = {w for w in fresh if len(w) > LONGEST_WORD}
        table = self.known
        if len(table) + len(fresh) > KNOWN_WORDS:
            fresh |= {w for words in split.values() for w in words if w in table}
            self.known = table = {"": 0}
        table.update(self._learn([w for w in fresh if w not in long]))
        table[""] = 0
        single = self._learn(list(long))
        for i, words in split.items():
            try:
                out[i] = sum(map(table.__getitem__, words))
            except KeyError:
                out[i] = sum(single[w] if w in single else table[w] for w in words)
        return out


def common_boundary(text: str, ours, ahead, border: int, end: int) -> int | None:
    """The first stable boundary in (border, end) at which both chunks may be spliced."""
    stop = max(text.rfind(" ", border, end), text.rfind("\n", border, end))
    if stop < 0:
        return None
    mine = ours[(ours > border) & (ours < stop)]
    theirs = ahead[(ahead > border) & (ahead < stop)]
    for place in mine[np.isin(mine, theirs)].tolist():
        if text[place - 1] in " \n" and np.array_equal(mine[mine >= place], theirs[theirs >= place]):
            return place
    return None


def count_tokens(
    df: DataFrame,
    path: str,
    keep: list[str],
    text_col: str = "text",
    limit: int = LIMIT,
    **sizes: int,
) -> DataFrame:
    """Columns ``keep`` and n_bytes, n_tokens, over_limit; ``path`` is a tokenizer file on every machine.

    ``sizes``: chunk, overlap and huge, in characters. A kept column may not be called like a result.
    """
    if clash := {"n_bytes", "n_tokens", "over_limit"} & set(keep):
        raise ValueError(f"kept columns named like results: {sorted(clash)}")
    chosen = df.select(
        *keep,
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(F.col(text_col), F.lit("")).alias("__text"),
    )
    types = {f.name: f.dataType.simpleString() for f in chosen.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keep, "n_bytes"])
    holder: list[Counter] = []
    n_kept = len(keep) + 1

    def run(batch: pa.RecordBatch):
        if not holder:
            holder.append(Counter(path, **sizes))
        found: list[int] = []
        texts = batch.column(n_kept)
        for at in range(0, batch.num_rows, 500):
            found += holder[0].counts(texts.slice(at, 500).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:n_kept], pa.array(found, pa.int64())],
            names=[*batch.schema.names[:n_kept], "n_tokens"],
        )

    counted = map_arrow(chosen, run, f"{schema}, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
