"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic steps.

Features: densities of a learned and of a general lexicon, lexicon words near second-person words,
capitals, punctuation, symbols, digits and obfuscated spellings. The lexicon, the trees and the
calibration are learned from a bounded sample of labelled rows; what is calibrated is what lexicon and
trees of the other parts of the sample say of each part. Trees are grown in numpy on histograms with the
logistic loss. Of a repeated id the least text counts; equal texts with both labels count as toxic.

Null text counts as empty; an empty text gets the score of its all-zero features. An empty table
gives an empty result; repeated rows each get a row. Labels other than 0 and 1 are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_sample, checkpoint, flat, map_arrow

#: Bound of the training sample, in labelled documents.
TRAIN_DOCS = 8000
#: Parts of the sample for calibration.
FOLDS = 3
LEXICON_WORDS = 48
LEXICON_LEAST = 4
LEXICON_Z = 4.0
TREES = 60
DEPTH = 3
RATE = 0.15
BINS = 32
NEAR = 5
THRESHOLD = 0.3

# A general lexicon of insults and words of address in four languages.
GENERAL = frozenset(
    "awful clown coward creep disgusting dumb fool garbage idiot idiots imbecile jerk loser losers "
    "moron morons pathetic pig scum stupid trash ugly vermin worthless dumm dummkopf "
    "arschloch abschaum connard crétin débile imbécile salaud estúpido idiota basura".split()
)
ADDRESS = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre "
    "vos usted ustedes ti tus vosotros".split()
)

FEATURES = (
    "lexicon_density lexicon_kinds lexicon_hits general_density address_density address_near "
    "capitals exclamations questions punctuation symbols digits obfuscated obfuscated_hits "
    "word_length words"
).split()

_PUNCTUATION = str.maketrans({c: " " for c in ".,;:!?\"()[]{}<>|/\\-–—…«»“”„#%&*$+=~^_`"})
_LEET = str.maketrans("013457@$!", "oieastasi")
_LEET_WORD = re.compile(r"[a-z0-9@$!*]*[a-z][a-z0-9@$!*]*")

_UPPER, _LOWER, _DIGIT, _SHOUT, _ASK, _PUNCT, _SYMBOL, _OTHER = range(8)
_CLASS = np.full(256, _OTHER, np.uint8)
for _chars, _kind in (
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER),
    ("abcdefghijklmnopqrstuvwxyz", _LOWER),
    ("0123456789", _DIGIT),
    ("!", _SHOUT),
    ("?", _ASK),
    (".,;:'\"()-", _PUNCT),
    ("#*$%&|<>@~^=+_/\\{}[]", _SYMBOL),
):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _kind


def _char_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters of each class, letter-sign-letter places, whether a word may hold a sign) of each text.

    A word that holds a letter and a sign, besides ``!`` at its end, has them side by side, or ``!`` before
    another sign.
    """
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    kind = _CLASS[data]
    counts = np.bincount(row * 8 + kind, minlength=8 * n).reshape(n, 8)
    letter = kind <= _LOWER
    sign = (kind == _DIGIT) | (data == 0x40) | (data == 0x24) | (data == 0x2A)
    middle = np.zeros(len(data), bool)
    if len(data) > 2:
        middle[1:-1] = letter[:-2] & sign[1:-1] & letter[2:]
        middle[1:-1] &= (row[:-2] == row[1:-1]) & (row[2:] == row[1:-1])
    shout = data == 0x21
    beside = letter[:-1] & sign[1:] | (sign | shout)[:-1] & letter[1:] | shout[:-1] & sign[1:]
    beside &= row[:-1] == row[1:]
    mixed = np.bincount(row[:-1][beside], minlength=n) > 0
    return counts, np.bincount(row[middle], minlength=n), mixed


def features(texts: pa.Array, lexicon: frozenset[str]) -> np.ndarray:
    """One row of ``FEATURES`` for each text; null counts as empty."""
    out = np.zeros((len(texts), len(FEATURES)))
    data, offsets = flat(texts)
    known = lexicon | GENERAL
    for a, b in blocks(offsets):
        counts, hidden, mixed = _char_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        size = np.maximum(counts.sum(axis=1), 1)
        part = out[a:b]
        part[:, 6] = counts[:, _UPPER] / np.maximum(counts[:, _UPPER] + counts[:, _LOWER], 1)
        for column, kind in ((7, _SHOUT), (8, _ASK), (9, _PUNCT), (10, _SYMBOL), (11, _DIGIT)):
            part[:, column] = counts[:, kind] / size
        part[:, 12] = hidden / size
        for i, text in enumerate(texts.slice(a, b - a).to_pylist()):
            if text:
                _word_features(part[i], text, lexicon, known, mixed[i])
    return out


def _hides(word: str, known) -> bool:
    """Whether a known word is spelt so; ``*`` is put between letters, or for up to half of them."""
    plain = word.translate(_LEET)
    if "*" not in plain:
        return plain in known
    if plain.replace("*", "") in known:
        return True
    if 2 * plain.count("*") > len(plain):
        return False
    alike = (zip(plain, k, strict=True) for k in known if len(k) == len(plain))
    return any(all(c in ("*", own) for c, own in pairs) for pairs in alike)


def _word_features(row, text: str, lexicon, known, mixed: bool) -> None:
    low = text.lower()
    words = low.translate(_PUNCTUATION).split()
    n = max(len(words), 1)
    row[14], row[15] = len(text) / n, np.log1p(len(words))
    row[4] = sum(map(ADDRESS.__contains__, words)) / n
    if not known.isdisjoint(words):
        at = [i for i, w in enumerate(words) if w in known]
        own = [words[i] for i in at if words[i] in lexicon]
        row[0], row[1], row[2] = len(own) / n, len(set(own)), np.log1p(len(own))
        row[3] = sum(words[i] in GENERAL for i in at) / n
        if row[4]:
            near = sum(not ADDRESS.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]) for i in at)
            row[5] = near / n
    if mixed:
        found = (w.rstrip("!") for w in _LEET_WORD.findall(low))
        row[13] = sum(_hides(w, known) for w in found if not w.isalpha()) / n


@dataclass
class Forest:
    """Boosted trees as arrays: split feature and threshold of each inner node, value of each leaf."""

    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Forest:
    """Trees of ``DEPTH`` levels, grown level by level from gradient histograms."""
    rate = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    forest = Forest(float(np.log(rate / (1 - rate))))
    if not len(y) or y.min() == y.max():
        return forest
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    # Rare features are zero for nearly all rows: quantiles of their other values are edges too.
    for j, e in enumerate(edges):
        some = x[x[:, j] > 0, j]
        if len(some):
            own = np.quantile(some, np.linspace(0, 1, 9)[:-1]) - 1e-12
            edges[j] = np.unique(np.concatenate([e, own, [0.0]]))
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width = max(len(e) for e in edges) + 1
    margin = np.full(len(y), forest.base)
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            start = 2**level - 1
            for k in range(start, 2 * start + 1):
                rows = np.flatnonzero(node == k)
                best = _best_split(codes[rows], g[rows], h[rows], edges, width)
                if best is not None:
                    feature[k], cut = best
                    threshold[k] = edges[feature[k]][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        top = np.bincount(leaf, g, 2**DEPTH)
        value = -RATE * top / (np.bincount(leaf, h, 2**DEPTH) + 1.0)
        margin += value[leaf]
        forest.feature.append(feature)
        forest.threshold.append(threshold)
        forest.value.append(value)
    return forest


def _best_split(codes, g, h, edges, width) -> tuple[int, int] | None:
    if len(g) < 8:
        return None
    best, found = 1e-6, None
    total_g, total_h = g.sum(), h.sum()
    for j, e in enumerate(edges):
        left_g = np.cumsum(np.bincount(codes[:, j], g, width))[: len(e)]
        left_h = np.cumsum(np.bincount(codes[:, j], h, width))[: len(e)]
        right_h = total_h - left_h
        gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (right_h + 1)
        gain -= total_g**2 / (total_h + 1)
        gain[(left_h < 0.5) | (right_h < 0.5)] = 0
        if len(gain) and gain.max() > best:
            best, found = gain.max(), (j, int(gain.argmax()))
    return found


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and shares, read with straight lines between them."""
    order = np.argsort(margin, kind="stable")
    m, pooled = margin[order], []
    for value, label in zip(m, y[order], strict=True):
        pooled.append([float(value), float(label), 1.0])
        while len(pooled) > 1 and pooled[-2][1] / pooled[-2][2] >= pooled[-1][1] / pooled[-1][2]:
            a = pooled.pop()
            pooled[-1] = [x + y for x, y in zip(pooled[-1], a, strict=True)]
    if not pooled:
        return np.zeros(1), np.zeros(1)
    centre = np.array([s / n for s, _, n in pooled])
    prior = float(y.mean())
    share = np.array([(k + prior) / (n + 1) for _, k, n in pooled])
    return centre, np.maximum.accumulate(share)


@dataclass(frozen=True)
class Scorer:
    lexicon: frozenset[str]
    forest: Forest
    centre: np.ndarray
    share: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        margin = self.forest.margin(x)
        calibrated = np.interp(margin, self.centre, self.share)
        # A trace of the margin keeps the order inside flat blocks.
        return np.round((0.999 * calibrated + 0.001 / (1 + np.exp(-margin))).clip(0, 1), 6)


def _feature_table(df: DataFrame, keep: str, lexicon: frozenset[str]) -> DataFrame:
    def run(batch: pa.RecordBatch):
        x = features(batch.column(1), lexicon)
        rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), rows.cast(pa.list_(pa.float64()))], names=[keep, "x"]
        )

    kind = dict(df.dtypes)[keep]
    return map_arrow(df.select(keep, "text"), run, f"{keep} {kind}, x array<double>")


def learn_lexicon(sample: DataFrame) -> frozenset[str]:
    """Words that toxic texts (columns text, toxic) hold far more often than others, by document."""
    words = F.array_distinct(
        F.split(F.lower("text"), r"[\s.,;:!?\"()\[\]{}<>|/\\\-#%&*$+=~^_`]+")
    )
    counted = (
        sample.select("toxic", F.explode(words).alias("word"))
        .where(F.length("word").between(3, 30))
        .groupBy("word")
        .agg(F.sum("toxic").alias("bad"), F.count("*").alias("seen"))
    )
    sizes = sample.agg(F.sum("toxic").alias("bad"), F.count("*").alias("seen")).first()
    bad, good = sizes.bad or 0, (sizes.seen or 0) - (sizes.bad or 0)
    ok = F.col("seen") - F.col("bad")
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((ok + 0.5) / (good + 1.0))
    z = odds / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (ok + 0.5))
    top = (
        counted.where((F.col("bad") >= LEXICON_LEAST) & (odds > 1.5) & (z > LEXICON_Z))
        .orderBy(z.desc(), "word")
        .limit(LEXICON_WORDS)
        .select("word")
        .collect()
    )
    return frozenset(r.word for r in top)


def learn(documents: DataFrame, labels: DataFrame, seed: int = 3) -> Scorer:
    """A scorer from (doc_id, text) and (doc_id, toxic 0/1), on a bounded sample of the labels."""
    picked = bounded_sample(
        labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")),
        "doc_id",
        TRAIN_DOCS,
    )
    # At most TRAIN_DOCS rows of two numbers go to each task.
    joined = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    # One row a labelled id, then one row a text; where equal texts have both labels it counts as toxic.
    of_id = joined.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    one = of_id.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("__text")).agg(
        F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.first("text").alias("text")
    )
    fold = F.pmod(F.xxhash64(F.lit(seed), "__text"), F.lit(FOLDS))
    sample = checkpoint(one.select("doc_id", "text", "toxic", fold.cast("int").alias("fold")))
    # Calibrated on what words and trees of the other folds say of each fold, which they have not seen.
    margins, truth = [], []
    for k in range(FOLDS):
        x, y, mine = _examples(sample, learn_lexicon(sample.where(F.col("fold") != k)), k)
        if mine.any() and not mine.all():
            margins.append(boost(x[~mine], y[~mine]).margin(x[mine]))
            truth.append(y[mine])
    lexicon = learn_lexicon(sample)
    x, y, _ = _examples(sample, lexicon, 0)
    forest = boost(x, y)
    if margins:
        centre, share = isotonic(np.concatenate(margins), np.concatenate(truth))
    else:  # too few to set any apart
        centre, share = isotonic(forest.margin(x), y)
    return Scorer(lexicon, forest, centre, share)


def _examples(sample: DataFrame, lexicon: frozenset[str], fold: int):
    """(features, labels, which are of the fold) of the sample, by id: at most TRAIN_DOCS rows."""
    marks = sample.select("doc_id", "toxic", "fold")
    rows = sorted(_feature_table(sample, "doc_id", lexicon).join(marks, "doc_id").collect(), key=lambda r: r.doc_id)
    x = np.array([r.x for r in rows]).reshape(-1, len(FEATURES))
    return x, np.array([r.toxic for r in rows], float), np.array([r.fold == fold for r in rows], bool)


def score(df: DataFrame, scorer: Scorer, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and score, predicted; a kept column may not be called like these."""
    if clash := {"score", "predicted"} & set(keep):
        raise ValueError(f"kept columns named like results: {sorted(clash)}")
    chosen = df.select(*keep, F.col(text_col).alias("__text"))
    types = {f.name: f.dataType.simpleString() for f in chosen.schema.fields}
    n = len(keep)

    def run(batch: pa.RecordBatch):
        scores = scorer(features(batch.column(n), scorer.lexicon))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:n], pa.array(scores)], names=[*batch.schema.names[:n], "score"]
        )

    scored = map_arrow(chosen, run, "".join(f"`{c}` {types[c]}, " for c in keep) + "score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
