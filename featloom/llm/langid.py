"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into windows of ``WINDOW`` bytes. In each window one network reads forwards and one
backwards; every byte gets a distribution over the languages from both states, and a document's
distribution is the mean over its bytes. The network is trained in numpy by backpropagation
through time on a bounded sample of labelled rows.

Cell, with the byte's two projections from a table and one product with the state:
``g = sigmoid(A[byte] + h Ug)``, ``c = tanh(B[byte] + h Uc)``, ``h' = h + g (c - h)``.

Null text, or text without a letter: language ``und``, score 0. An empty table gives an empty
result; repeated rows each get a row. Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_sample, flat, map_arrow

WINDOW = 64
HIDDEN = 8
#: Bound of the training sample: so many documents, and so many characters from each.
TRAIN_DOCS = 3000
TRAIN_CHARS = 256
STEPS = 240
BATCH = 192
PAD = 256
UNDETERMINED = "und"


@dataclass(frozen=True)
class Network:
    """Weights by direction (forwards, backwards) and part (gate, candidate)."""

    langs: tuple[str, ...]
    table: np.ndarray  # direction, part, byte, H
    state: np.ndarray  # direction, part, H, H
    out: np.ndarray  # languages, 2H
    bias: np.ndarray  # languages, 1


def _windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows of bytes, their lengths, first window of each row); short windows are padded."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    first = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(sizes)), counts)
    start = (np.arange(first[-1]) - first[row]) * WINDOW
    length = np.minimum(WINDOW, sizes[row] - start)
    place = (offsets[:-1][row] + start)[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < length[:, None]
    cells = np.where(inside, data[np.minimum(place, max(len(data) - 1, 0))] if len(data) else 0, PAD)
    return cells.astype(np.int16), length, first


def _run(net: Network, direction: int, cells: np.ndarray) -> np.ndarray:
    """States of one direction, (position, window, H)."""
    n, h = len(cells), HIDDEN
    states = np.empty((WINDOW, n, h), np.float32)
    table, u = net.table[direction], net.state[direction]
    now = np.zeros((n, h), np.float32)
    mix, seen = np.empty((2, n, h), np.float32), np.empty((2, n, h), np.float32)
    columns = np.ascontiguousarray(cells.T, dtype=np.intp)
    for t in range(WINDOW) if direction == 0 else range(WINDOW - 1, -1, -1):
        np.matmul(now, u, out=mix)
        for part in (0, 1):
            np.take(table[part], columns[t], axis=0, out=seen[part], mode="clip")
        mix += seen
        mix[0] *= 0.5
        np.tanh(mix, out=mix)
        gate, step = mix
        gate *= 0.5
        gate += 0.5
        step -= now
        step *= gate
        now = np.add(now, step, out=states[t])
    return states


def position_probabilities(net: Network, ahead, back, t: int) -> np.ndarray:
    """(language, window) at one position, from the states of both directions."""
    scores = net.out[:, :HIDDEN] @ ahead[t].T
    scores += net.out[:, HIDDEN:] @ back[t].T
    scores += net.bias
    np.minimum(scores, 60, out=scores)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=0)
    return scores


def train(texts: list[bytes], labels: list[str], seed: int = 7) -> Network:
    """Backpropagation through time with Adam, every byte labelled with its document's language."""
    langs = tuple(sorted(set(labels)))
    if not langs:
        raise ValueError("no labelled rows to learn from")
    rng = np.random.default_rng(seed)
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    cells, length, first = _windows(data, np.concatenate([[0], np.cumsum(sizes)]))
    target = np.repeat([langs.index(x) for x in labels], np.diff(first)).astype(np.int64)
    k, h = len(langs), HIDDEN
    w = {
        "table": rng.normal(0, 0.5, (2, 2, 257, h)),
        "state": rng.normal(0, 0.35, (2, 2, h, h)),
        "out": rng.normal(0, 0.3, (k, 2 * h)),
        "bias": np.zeros((k, 1)),
    }
    w = {name: v.astype(np.float32) for name, v in w.items()}
    w["table"][:, 0] -= 1
    mean, var = ({n: np.zeros_like(v) for n, v in w.items()} for _ in range(2))
    # Each language fills the same share of a batch.
    by_lang = [np.flatnonzero(target == i) for i in range(k)]
    by_lang = [x for x in by_lang if len(x)]
    for step in range(1, STEPS + 1):
        if not by_lang:
            break
        picked = np.concatenate([rng.choice(x, max(1, BATCH // len(by_lang))) for x in by_lang])
        net = Network(langs, w["table"], w["state"], w["out"], w["bias"])
        grads = _gradients(net, cells[picked], length[picked], target[picked])
        rate = 0.03 * (1 - 0.9 * step / STEPS)
        for name, g in grads.items():
            mean[name] = 0.9 * mean[name] + 0.1 * g
            var[name] = 0.99 * var[name] + 0.01 * g * g
            scale = np.sqrt(var[name] / (1 - 0.99**step)) + 1e-8
            w[name] = (w[name] - rate * mean[name] / (1 - 0.9**step) / scale).astype(np.float32)
    return Network(langs, w["table"], w["state"], w["out"], w["bias"])


def _gradients(net: Network, cells, length, target) -> dict[str, np.ndarray]:
    n, h = len(cells), HIDDEN
    both = _run(net, 0, cells), _run(net, 1, cells)
    inside = (np.arange(WINDOW)[:, None] < length[None, :]).astype(np.float32)
    inside /= max(inside.sum(), 1)
    grads = {x: np.zeros_like(getattr(net, x)) for x in ("table", "state", "out", "bias")}
    spread = np.empty((WINDOW, n, 2 * h), np.float32)
    for t in range(WINDOW):
        p = position_probabilities(net, *both, t)
        p[target, np.arange(n)] -= 1
        p *= inside[t]
        grads["out"] += p @ np.concatenate([both[0][t], both[1][t]], axis=1)
        grads["bias"] += p.sum(axis=1, keepdims=True)
        spread[t] = p.T @ net.out
    for d, states in enumerate(both):
        behind = -1 if d == 0 else 1
        u, carry = net.state[d], np.zeros((n, h), np.float32)
        for t in range(WINDOW - 1, -1, -1) if d == 0 else range(WINDOW):
            before = t + behind
            old = states[before] if 0 <= before < WINDOW else np.zeros((n, h), np.float32)
            seen = cells[:, t]
            gate = 0.5 + 0.5 * np.tanh(0.5 * (net.table[d, 0][seen] + old @ u[0]))
            new = np.tanh(net.table[d, 1][seen] + old @ u[1])
            got = carry + spread[t, :, d * h : (d + 1) * h]
            carry = got * (1 - gate)
            for part, inner in enumerate(
                (got * (new - old) * gate * (1 - gate), got * gate * (1 - new * new))
            ):
                grads["state"][d, part] += old.T @ inner
                np.add.at(grads["table"][d, part], seen, inner)
                carry += inner @ u[part].T
    return grads


def learn(df: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> Network | None:
    """A network from a bounded sample of the rows with a language and a text; None without any."""
    known = df.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    place = F.pmod(F.xxhash64(F.col(text_col)), F.greatest(F.length(text_col) - TRAIN_CHARS, F.lit(1)))
    rows = bounded_sample(
        known.select(
            F.col(id_col).alias("key"),
            F.col(lang_col).alias("lang"),
            F.substring(F.col(text_col), (place + 1).cast("int"), F.lit(TRAIN_CHARS)).alias("part"),
        ),
        "key",
        TRAIN_DOCS,
    ).collect()
    return train([r.part.encode() for r in rows], [r.lang for r in rows]) if rows else None


def _spans(codes: np.ndarray, langs: tuple[str, ...]) -> list[dict]:
    if not len(codes):
        return []
    cut = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]])
    return [
        {"start": int(a), "end": int(b), "lang": langs[codes[a]]}
        for a, b in zip(cut[:-1], cut[1:], strict=True)
    ]


def identify(
    df: DataFrame, net: Network | None, text_col: str = "text", keep: list[str] = (), spans: bool = False
) -> DataFrame:
    """Columns ``keep`` and lang_pred, score; with ``spans`` also the runs of byte labels.

    Without a network every text is undetermined, with score 0 and no runs. A kept column may not be
    called like a result column.
    """
    if clash := {"lang_pred", "score", "lang_spans"} & set(keep):
        raise ValueError(f"kept columns named like results: {sorted(clash)}")
    chosen = df.select(*keep, F.col(text_col).alias("__text"))
    types = {f.name: f.dataType.simpleString() for f in chosen.schema.fields}
    shown = ", ".join(f"`{c}` {types[c]}" for c in keep)
    schema = (f"{shown}, " if shown else "") + "lang_pred string, score double"
    if spans:
        schema += ", lang_spans array<struct<start:long,end:long,lang:string>>"
    if net is None:
        none = [F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score")]
        if spans:
            none.append(F.array().cast("array<struct<start:long,end:long,lang:string>>").alias("lang_spans"))
        return df.select(*keep, *none)
    names = np.array([*net.langs, UNDETERMINED], object)
    kept = list(keep)

    def run(batch: pa.RecordBatch):
        texts = batch.column(batch.schema.get_field_index("__text"))
        letters = pa.compute.match_substring_regex(texts, r"\p{L}").fill_null(False)
        has = letters.to_numpy(zero_copy_only=False)
        data, offsets = flat(texts)
        best = np.full(batch.num_rows, len(net.langs))
        score = np.zeros(batch.num_rows)
        runs: list[list[dict]] = []
        for a, b in blocks(offsets, 1 << 19):
            total, n, labels = _pooled(net, data, offsets, a, b, spans)
            share = total / np.maximum(n, 1)[:, None]
            best[a:b] = np.where(has[a:b], share.argmax(axis=1), len(net.langs))
            score[a:b] = np.where(has[a:b], share.max(axis=1), 0.0)
            runs += [_spans(x, net.langs) for x in labels]
        columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
        columns += [pa.array(names[best], pa.string()), pa.array(np.round(score.clip(0, 1), 6))]
        if spans:
            columns.append(
                pa.array(
                    runs,
                    pa.list_(
                        pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
                    ),
                )
            )
        named = [*kept, "lang_pred", "score"] + ["lang_spans"] * spans
        yield pa.RecordBatch.from_arrays(columns, names=named)

    return map_arrow(chosen, run, schema)


def _pooled(net: Network, data, offsets, a: int, b: int, spans: bool):
    """Summed distributions and byte counts of rows a..b, and byte labels if asked for."""
    part = data[offsets[a] : offsets[b]]
    own = offsets[a : b + 1] - offsets[a]
    total = np.zeros((b - a, len(net.langs)))
    cells, length, first = _windows(part, own)
    sums = np.zeros((len(cells), len(net.langs)))
    codes = np.empty((len(cells), WINDOW), np.int16) if spans else None
    for at in range(0, len(cells), 2048):
        some = slice(at, at + 2048)
        states = _run(net, 0, cells[some]), _run(net, 1, cells[some])
        sum_ = np.zeros((len(net.langs), len(cells[some])), np.float32)
        for t in range(WINDOW):
            p = position_probabilities(net, *states, t)
            if spans:
                codes[some, t] = p.argmax(axis=0)
            p *= t < length[some]
            sum_ += p
        sums[some] = sum_.T
    filled = np.flatnonzero(np.diff(first))
    if len(filled):
        total[filled] = np.add.reduceat(sums, first[filled], axis=0)
    labels = []
    if spans:
        for i in range(b - a):
            labels.append(codes[first[i] : first[i + 1]].reshape(-1)[: own[i + 1] - own[i]])
    return total, np.diff(own), labels
