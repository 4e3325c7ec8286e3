"""Quality rules learned as a decision list over text statistics; DataFrame functions only.

Sequential covering: a rule is a conjunction of thresholds, grown condition by condition on one part
of the labelled rows, pruned on the other, and kept if it is precise there; the rows it covers leave
and the next rule is grown. The list becomes one ordered conditional expression.

Words are runs of characters other than blank and U+0009 to U+000D. Null text has no words and all
statistics are 0; so has an empty text. An empty table gives an empty result; repeated rows each get
a row. Without labelled rows the list is empty and keeps everything that the base rule keeps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, checkpoint

SPACE = r"[\x20\x09-\x0D]+"
#: Bound of the training sample, in labelled documents.
TRAIN_DOCS = 6000
MOST_RULES = 8
MOST_CONDITIONS = 3
LEAST_COVERED = 5
LEAST_PRECISION = 0.8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("__lines", "__capitals")
SHARES = ("symbol_share", "dup_share", "repeat_share", "word_length", "capital_share", "n_words")


def _repeat_words(words: str) -> Column:
    """Words in 3-word windows that are found twice or more: sorted window hashes, equal neighbours."""
    w = F.col(words)
    windows = F.when(
        F.size(w) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")),
        ),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    return F.sort_array(windows)


def _repeated_starts(sorted_windows: str) -> Column:
    s = F.col(sorted_windows)

    def twice(x, j):
        before = F.when(j > 0, F.get(s, j - 1)["h"] == x["h"])
        after = F.get(s, j + 1)["h"] == x["h"]
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))


def _covered(starts: str) -> Column:
    p = F.col(starts)
    fresh = F.transform(p, lambda at, j: F.least(F.lit(3), at - F.coalesce(F.get(p, j - 1), at - 3)))
    return F.aggregate(fresh, F.lit(0), lambda a, b: a + b)


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with ``COUNTS`` (long) and helper counts; columns of these names are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    has_word = F.lit(r"[^\x20\x09-\x0D]")
    df = df.withColumns(
        {
            "__words": F.filter(F.split(text, SPACE), lambda x: x != ""),
            "__line_list": F.filter(F.split(text, "\n"), lambda x: F.regexp(x, has_word)),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "__capitals": F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long"),
        }
    )
    df = df.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "__lines": F.size("__line_list").cast("long"),
            "n_dup_lines": (F.size("__line_list") - F.size(F.array_distinct("__line_list"))).cast("long"),
            "__windows": _repeat_words("__words"),
        }
    ).drop("__words", "__line_list")
    df = df.withColumn("__starts", _repeated_starts("__windows")).drop("__windows")
    return df.withColumn("n_repeat_words", _covered("__starts").cast("long")).drop("__starts")


def share_columns() -> dict[str, Column]:
    """The statistics that rules put thresholds on."""

    def share(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_share": share("n_dup_lines", "__lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
        "capital_share": share("__capitals", "word_chars"),
        "n_words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Rule:
    """All conditions (share, "<=" or ">", threshold) together reject a document."""

    conditions: tuple[tuple[str, str, float], ...]

    def expression(self) -> Column:
        shares, out = share_columns(), F.lit(True)
        for name, side, threshold in self.conditions:
            out = out & (shares[name] > threshold if side == ">" else shares[name] <= threshold)
        return out

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, side, threshold in self.conditions:
            column = x[:, SHARES.index(name)]
            out &= column > threshold if side == ">" else column <= threshold
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {s} {t:.6g}" for n, s, t in self.conditions)


def _grow(x: np.ndarray, bad: np.ndarray) -> tuple:
    """Conditions added while FOIL's gain is positive."""
    inside, conditions = np.ones(len(x), bool), []
    for _ in range(MOST_CONDITIONS):
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        if n == 0 or p == 0:
            break
        now, best = np.log2(p / (p + n)), (1e-9, None, None)
        for j, name in enumerate(SHARES):
            values = np.unique(x[inside, j])
            if len(values) > 64:
                values = np.unique(np.quantile(values, np.linspace(0, 1, 65)))
            for threshold in (values[:-1] + values[1:]) / 2:
                for side in (">", "<="):
                    hit = inside & ((x[:, j] > threshold) == (side == ">"))
                    q = (hit & bad).sum()
                    if q < LEAST_COVERED:
                        continue
                    gain = q * (np.log2(q / hit.sum()) - now)
                    if gain > best[0]:
                        best = (gain, (name, side, float(threshold)), hit)
        if best[1] is None:
            break
        # A second threshold on one side of a share takes the place of the first, which it implies.
        conditions = [c for c in conditions if c[:2] != best[1][:2]] + [best[1]]
        inside = best[2]
    return tuple(conditions)


def _worth(rule: Rule, x, bad) -> tuple[float, int]:
    hit = rule.covers(x)
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return ((p - n) / (p + n) if p + n else -1.0), p


def learn_list(x: np.ndarray, bad: np.ndarray, seed: int = 5) -> list[Rule]:
    """Ordered rules from rows of ``SHARES`` and whether each is of low quality."""
    rules: list[Rule] = []
    side = np.random.default_rng(seed).random(len(x)) < 0.67
    left = np.ones(len(x), bool)
    while len(rules) < MOST_RULES and (left & side & bad).sum() >= LEAST_COVERED:
        conditions = _grow(x[left & side], bad[left & side])
        if not conditions:
            break
        pruning = left & ~side
        options = [Rule(conditions[:k]) for k in range(len(conditions), 0, -1)]
        rule = max(options, key=lambda r: _worth(r, x[pruning], bad[pruning])[0])
        hit = rule.covers(x) & left
        if not hit.any() or (hit & bad).sum() / hit.sum() < LEAST_PRECISION:
            break
        if _worth(rule, x[pruning], bad[pruning])[0] < 2 * LEAST_PRECISION - 1:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def learn(documents: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules from (doc_id, text) and (doc_id, quality 0/1), on a bounded sample of the labels.

    They are learned from texts that the base rule keeps, as no others reach them.
    """
    picked = bounded_sample(
        labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality")),
        "doc_id",
        TRAIN_DOCS,
    )
    # At most TRAIN_DOCS rows of two numbers go to each task.
    sample = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    shares = F.struct(*(c.alias(f"s_{k}") for k, c in share_columns().items()))
    # Numbers only; written, so that the filter does not work them out once more.
    measured = checkpoint(
        with_statistics(sample).select("doc_id", "quality", base_failed().alias("failed"), shares.alias("s"))
    )
    # One row a labelled id, of repeated ones that of the least statistics.
    one = measured.where("NOT failed").groupBy("doc_id", "quality").agg(F.min("s").alias("s"))
    rows = one.select("doc_id", "quality", "s.*").collect()
    rows.sort(key=lambda r: r.doc_id)
    x = np.array([[r[f"s_{k}"] for k in SHARES] for r in rows], float).reshape(-1, len(SHARES))
    return learn_list(x, np.array([r.quality == 0 for r in rows], bool))


def base_failed() -> Column:
    """The fixed rule: fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the first rule that fits rejects, else the text stays."""
    out = None
    for rule in rules:
        when = F.when if out is None else out.when
        out = when(rule.expression(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(df: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows with ``COUNTS``, base_failed and kept."""
    df = with_statistics(df, text_col).withColumn("base_failed", base_failed())
    return df.withColumn("kept", ~F.col("base_failed") & verdict(rules)).drop(*EXTRA)
