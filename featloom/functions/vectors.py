"""Vector arithmetic on ``array`` columns.

Everything except :func:`dense` is a built-in higher-order expression: it runs
in the JVM, needs no dimension at plan time and is safe on a stream. Vectors
are stored as ``array<float>`` and computed in double.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12
COSINE_FLOOR = 1e-8


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A fold written inside another lambda is evaluated again for every element,
    and the optimizer inlines a ``withColumn`` into the lambda. A lambda
    variable is the one thing it never inlines.
    """
    return F.transform(F.array(value), body)[0]


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; null when the widths differ."""
    products = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column, floor: float = NORM_FLOOR) -> Column:
    """Unit vector; a zero vector stays zero."""
    return bind(
        F.greatest(l2_norm(v), F.lit(floor)),
        lambda n: F.transform(doubles(v), lambda x: x / n),
    )


def cosine(a: Column, b: Column, floor: float = COSINE_FLOOR) -> Column:
    """Cosine similarity of two vectors of one row."""
    return dot(a, b) / (
        F.greatest(l2_norm(a), F.lit(floor)) * F.greatest(l2_norm(b), F.lit(floor))
    )


def append(v: Column, tail: Column) -> Column:
    return F.concat(doubles(v), doubles(tail))


def replace_head(v: Column, head: Column) -> Column:
    """Overwrite the first ``size(head)`` entries of ``v``."""
    kept = F.greatest(F.size(v) - F.size(head), F.lit(0))
    return F.concat(doubles(head), F.slice(doubles(v), F.size(head) + 1, kept))


def assert_width(v: Column, dims: int) -> Column:
    """``v`` itself, failing the query on any row of another width."""
    message = F.concat(F.lit(f"vector width is not {dims}: "), F.size(v).cast("string"))
    return F.when(v.isNull() | (F.size(v) == dims), v).otherwise(F.raise_error(message))


def pad(v: Column, width: Column | int, fill: float = 0.0) -> Column:
    """Right-pad to ``width`` entries."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.concat(doubles(v), F.array_repeat(F.lit(fill), (width - F.size(v)).cast("int")))


def hinge(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def clamp_min(x: Column, low: float) -> Column:
    return F.greatest(x, F.lit(low))


def tempered_exp(similarity: Column, tau: float = 0.1) -> Column:
    return F.exp(similarity / F.lit(tau))


def neg_log_ratio(part: Column, whole: Column) -> Column:
    return -F.log(part / whole)


ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "identity": lambda z: z,
    "tanh": np.tanh,
    "relu": lambda z: np.maximum(z, 0.0),
}


def dense(v: Column, weights, bias, activation: str = "tanh") -> Column:
    """``activation(W v + b)`` per row.

    A D x D head is D^2 multiply-adds per row, hundreds of times more than a
    fold can interpret, so each Arrow batch is one matrix product. The weights
    travel with the function: a head is a model constant whose size does not
    grow with the data. A null vector stays null; one of another width than the
    head's fails the query.
    """
    w = np.asarray(weights, dtype="float64")
    b = np.asarray(bias, dtype="float64")
    act = ACTIVATIONS[activation]

    @F.arrow_udf("array<double>")
    def head(vectors: pa.Array) -> pa.Array:
        valid = vectors.is_valid().to_numpy(zero_copy_only=False)
        widths = set(vectors.drop_null().value_lengths().unique().to_pylist())
        if widths - {w.shape[1]}:
            raise ValueError(f"vectors of widths {sorted(widths)} under a head of {w.shape[1]}")
        x = vectors.drop_null().flatten().to_numpy(zero_copy_only=False)
        x = x.astype("float64").reshape(-1, w.shape[1])
        y = act(x @ w.T + b)
        ends = np.concatenate([[0], np.cumsum(valid * w.shape[0])]).astype("int32")
        mask = pa.array(~valid) if not valid.all() else None
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(y.ravel()), mask=mask)

    return head(v)


def dense_with_projection(
    v: Column, weights, bias, extra_weights, extra_bias, activation: str = "tanh"
) -> Column:
    """``h = act(W v + b)`` followed by ``act(P h + c)``, appended to ``h``."""
    h = dense(v, weights, bias, activation)
    return F.concat(h, dense(h, extra_weights, extra_bias, activation))
