"""Path, model-id and message expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from featloom import fixed


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot; empty for a name without one."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    """Base name without its last suffix."""
    return F.regexp_replace(base_name(path), r"^(.+)\.[^.]+$", "$1")


def strip_prefix(model_id: Column, prefixes: list[str] = fixed.PROVIDER_PREFIXES) -> Column:
    """Take every provider prefix off a model id."""
    return reduce(lambda c, p: F.replace(c, F.lit(p), F.lit("")), prefixes, model_id)


def encoder_family(model_id: Column) -> Column:
    """Family by the first marker found; the order of the markers decides."""
    (first, name), *rest = fixed.FAMILY_MARKERS
    chain = F.when(F.contains(model_id, F.lit(first)), name)
    for marker, family in rest:
        chain = chain.when(F.contains(model_id, F.lit(marker)), family)
    return chain.otherwise(fixed.DEFAULT_FAMILY)


def strip_non_ascii(message: Column) -> Column:
    return F.regexp_replace(message, r"[^\x00-\x7F]+", "")


def null_if_token(value: Column, tokens: list[str] = fixed.PANDAS_NA) -> Column:
    """Null for a missing-value token, else the text."""
    return F.when(~value.isin(tokens), value)


def feature_name(position: Column) -> Column:
    """``f0000``, ``f0001``, ... for a 0-based position.

    Padding instead of a format string, which is parsed again for every row.
    """
    digits = position.cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.concat(F.lit("f"), padded)


def corpus_of(path: Column, corpora=tuple(fixed.CORPUS_ID_TYPES)) -> Column:
    """Corpus whose name starts the file name; null when none does."""
    return F.regexp_extract(base_name(path), "^(" + "|".join(corpora) + ")", 1)


def media_path(directory: Column, filename: Column) -> Column:
    return F.concat_ws("/", F.regexp_replace(directory, "/+$", ""), filename)
