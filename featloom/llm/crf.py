"""A linear-chain conditional random field in numpy: training by its gradient, decoding by Viterbi.

Tags are BEGIN, INSIDE and OUTSIDE. A token has one code in each of several features; its emission is
the sum of the weights of its codes. Chains are stored flat, with the start of each chain.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BEGIN, INSIDE, OUTSIDE = range(3)
TAGS = 3


@dataclass
class Field:
    """Weights: ``emit`` by feature, code and tag, flat over features; ``move`` from tag to tag; ``start`` by tag."""

    emit: np.ndarray
    base: np.ndarray  # first row of each feature in ``emit``
    move: np.ndarray
    start: np.ndarray

    @classmethod
    def zeros(cls, sizes: list[int]) -> Field:
        base = np.cumsum([0, *sizes])
        return cls(np.zeros((base[-1], TAGS)), base[:-1], np.zeros((TAGS, TAGS)), np.zeros(TAGS))

    def emissions(self, codes: list[np.ndarray]) -> np.ndarray:
        out = self.emit[codes[0] + self.base[0]]
        for code, base in zip(codes[1:], self.base[1:], strict=True):
            out += self.emit[code + base]
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def expectations(e: np.ndarray, there: np.ndarray, move: np.ndarray, start: np.ndarray):
    """(log partition, tag marginals, expected moves, first marginals) of padded chains.

    ``e`` is chains x places x tags, ``there`` says which places are real; every chain has one at least.
    """
    n, width, _ = e.shape
    ahead, back = np.empty_like(e), np.zeros_like(e)
    ahead[:, 0] = start + e[:, 0]
    for t in range(1, width):
        step = _logsum(ahead[:, t - 1, :, None] + move, 1) + e[:, t]
        ahead[:, t] = np.where(there[:, t, None], step, ahead[:, t - 1])
    for t in range(width - 2, -1, -1):
        step = _logsum(move + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        back[:, t] = np.where(there[:, t + 1, None], step, 0.0)
    total = _logsum(ahead[:, -1], 1)
    tags = np.exp(ahead + back - total[:, None, None]) * there[:, :, None]
    pair = ahead[:, :-1, :, None] + move + (e[:, 1:] + back[:, 1:])[:, :, None, :]
    moves = (np.exp(pair - total[:, None, None, None]) * there[:, 1:, None, None]).sum(axis=(0, 1))
    return total, tags, moves, tags[:, 0].sum(axis=0)


def loss_and_gradient(field: Field, codes: np.ndarray, tags: np.ndarray, there: np.ndarray, seen: np.ndarray):
    """Negative log likelihood of padded chains and its gradient by (emit, move, start).

    ``codes`` is chains x places x features, ``seen`` masks features that are left out this time.
    """
    rows = codes + field.base
    e = (field.emit[rows] * seen[..., None]).sum(axis=2)
    total, marginal, moves, first = expectations(e, there, field.move, field.start)
    gold = np.eye(TAGS)[tags] * there[:, :, None]
    both = there[:, 1:]
    gold_moves = np.zeros((TAGS, TAGS))
    np.add.at(gold_moves, (tags[:, :-1][both], tags[:, 1:][both]), 1)
    score = (e * gold).sum() + field.start[tags[:, 0]].sum() + (gold_moves * field.move).sum()
    diff = marginal - gold
    emit = np.zeros_like(field.emit)
    use = seen.astype(bool) & there[:, :, None]
    place = rows[use]
    for k in range(TAGS):
        weight = np.broadcast_to(diff[:, :, None, k], use.shape)[use]
        emit[:, k] = np.bincount(place, weight, minlength=len(emit))
    return total.sum() - score, emit, moves - gold_moves, first - gold[:, 0].sum(axis=0)


def train(
    sizes: list[int],
    chains: list[tuple[np.ndarray, np.ndarray]],
    epochs: int = 8,
    batch: int = 256,
    rate: float = 0.1,
    decay: float = 1e-4,
    leave_out: float = 0.2,
    seed: int = 0,
) -> Field:
    """A field fitted to chains of (codes: places x features, tags) by adaptive gradient steps.

    A part of the features of each token is left out at random, so that no single one decides alone.
    """
    field = Field.zeros(sizes)
    rng = np.random.default_rng(seed)
    weights = [field.emit, field.move, field.start]
    squares = [np.full_like(w, 1e-2) for w in weights]
    order = sorted(range(len(chains)), key=lambda i: len(chains[i][1]))
    batches = [order[i : i + batch] for i in range(0, len(order), batch)]
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            rows = [chains[i] for i in batches[b]]
            width = max(len(t) for _, t in rows)
            codes = np.zeros((len(rows), width, len(sizes)), np.int64)
            tags = np.full((len(rows), width), OUTSIDE)
            there = np.zeros((len(rows), width), bool)
            for i, (c, t) in enumerate(rows):
                codes[i, : len(t)], tags[i, : len(t)], there[i, : len(t)] = c, t, True
            seen = (rng.random(codes.shape) >= leave_out) * 1.0
            _, *gradient = loss_and_gradient(field, codes, tags, there, seen)
            for w, g, s in zip(weights, gradient, squares, strict=True):
                g = g / len(rows) + decay * w
                s += g * g
                w -= rate * g / np.sqrt(s)
    return field


def surely_outside(field: Field, e: np.ndarray) -> np.ndarray:
    """Tokens that the best path leaves outside whatever their neighbours' tags are.

    To change such a token to OUTSIDE gains more on the token than it can lose on both moves.
    """
    sure = np.ones(len(e), bool)
    for x in (BEGIN, INSIDE):
        before = max(field.start[x] - field.start[OUTSIDE], (field.move[:, x] - field.move[:, OUTSIDE]).max())
        after = max(0.0, (field.move[x] - field.move[OUTSIDE]).max())
        sure &= e[:, OUTSIDE] - e[:, x] > before + after
    return sure


def viterbi(field: Field, e: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The best tags of flat chains; of equal paths the one with the later tag, OUTSIDE last, from the end.

    Tokens that are surely outside cut a chain into stretches, which are decoded side by side.
    """
    n = len(e)
    tags = np.full(n, OUTSIDE)
    if not n:
        return tags
    first = np.zeros(n + 1, bool)
    first[starts] = True
    first[n] = True
    sure = surely_outside(field, e)
    open_ = ~sure
    begin = open_.copy()
    begin[1:] &= sure[:-1] | first[1:-1]
    end = open_.copy()
    end[:-1] &= sure[1:] | first[1:-1]
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if not len(a):
        return tags
    order = np.argsort(a - b, kind="stable")  # longest first
    a, b = a[order], b[order]
    size = b - a
    at_start, at_end = first[a], first[b]
    best = np.where(at_start[:, None], field.start, field.move[OUTSIDE]) + e[a]
    came = [np.zeros((len(a), TAGS), np.int8)]
    live = len(a)
    final = np.empty((len(a), TAGS))
    for t in range(1, int(size[0]) + 1):
        now = int(np.searchsorted(-size, -t, side="left"))  # stretches longer than t
        final[now:live] = best[now:live]
        live = now
        if not live:
            break
        path = best[:live, :, None] + field.move
        back = TAGS - 1 - path[:, ::-1].argmax(axis=1)
        came.append(back.astype(np.int8))
        best = np.take_along_axis(path, back[:, None, :], 1)[:, 0] + e[a[:live] + t]
    final += np.where(at_end[:, None], 0.0, field.move[:, OUTSIDE])
    tag = TAGS - 1 - final[:, ::-1].argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, side="left"))  # stretches that reach place t
        tags[a[:live] + t] = tag[:live]
        if t:
            tag[:live] = came[t][np.arange(live), tag[:live]]
    return tags
