"""A small linear-chain conditional random field over feature arrays.

Scores are ``features @ weights`` for each place plus ``moves[a, b]`` for neighbours, with
``first`` for the first place. Fitting maximises the likelihood of tag sequences by
Adam over full batches, with forward-backward in log space; all sequences of about one
length run together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Chain:
    weights: np.ndarray  # features x tags
    moves: np.ndarray  # tags x tags
    first: np.ndarray  # tags

    def scores(self, features: np.ndarray) -> np.ndarray:
        return features @ self.weights.astype(features.dtype)


def marginals(chain: Chain, scores: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Forward-backward tag probabilities of many sequences laid end to end.

    Sequences are sorted by length, so that one step runs over all that still last."""
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    size, start = size[order], offsets[:-1][order]
    live = np.searchsorted(-size, -np.arange(size.max(initial=0)), "left")  # sequences longer than t
    forward = np.zeros(scores.shape)
    scores = scores.astype(np.float64)
    for t, n in enumerate(live):
        at = start[:n] + t
        if t == 0:
            forward[at] = scores[at] + chain.first
        else:
            forward[at] = scores[at] + _lse(forward[at - 1][:, :, None] + chain.moves, 1)
    backward = np.zeros(scores.shape)
    for t in range(len(live) - 2, -1, -1):
        at = start[: live[t + 1]] + t
        backward[at] = _lse(chain.moves + (scores[at + 1] + backward[at + 1])[:, None, :], 2)
    total = forward + backward
    total -= total.max(axis=1, keepdims=True)
    p = np.exp(total)
    return p / p.sum(axis=1, keepdims=True)


def viterbi(chain: Chain, scores: np.ndarray, before: int | None = None, after: int | None = None) -> list[int]:
    """Best tags of one sequence, between fixed tags before and after it where these are given."""
    best = scores[0] + (chain.first if before is None else chain.moves[before])
    back = []
    for row in scores[1:]:
        step = best[:, None] + chain.moves
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + row
    if after is not None:
        best = best + chain.moves[:, after]
    tags = [int(best.argmax())]
    for choice in reversed(back):
        tags.append(int(choice[tags[-1]]))
    return tags[::-1]


def _batches(features: list[np.ndarray], tags: list[np.ndarray], window: int):
    """Padded batches of windows, by the power of two of their length."""
    cut = [(f[i : i + window], t[i : i + window], i == 0)
           for f, t in zip(features, tags, strict=True) for i in range(0, len(t), window)]
    groups: dict[int, list] = {}
    for x in cut:
        groups.setdefault(int(len(x[1]) - 1).bit_length(), []).append(x)
    for rows in groups.values():
        long = max(len(t) for _, t, _ in rows)
        x = np.zeros((len(rows), long, rows[0][0].shape[1]))
        y = np.zeros((len(rows), long), dtype=np.int64)
        on = np.zeros((len(rows), long), dtype=bool)
        for i, (f, t, _) in enumerate(rows):
            x[i, : len(t)], y[i, : len(t)], on[i, : len(t)] = f, t, True
        yield x, y, on


def _gradient(chain: Chain, x: np.ndarray, y: np.ndarray, on: np.ndarray):
    """Gradient of the log-likelihood of a padded batch."""
    n, long, _ = x.shape
    k = len(chain.first)
    scores = x @ chain.weights
    forward, backward = np.zeros((long, n, k)), np.zeros((long, n, k))
    forward[0] = scores[:, 0] + chain.first
    for t in range(1, long):
        step = scores[:, t] + _lse(forward[t - 1][:, :, None] + chain.moves, 1)
        forward[t] = np.where(on[:, t, None], step, forward[t - 1])
    for t in range(long - 2, -1, -1):
        step = _lse(chain.moves + (scores[:, t + 1] + backward[t + 1])[:, None, :], 2)
        backward[t] = np.where(on[:, t + 1, None], step, 0.0)
    z = _lse(forward[-1], 1)
    p = np.exp(forward + backward - z[:, None]).transpose(1, 0, 2) * on[:, :, None]
    truth = np.eye(k)[y] * on[:, :, None]
    moves = np.zeros((k, k))
    for t in range(1, long):
        live = on[:, t]
        pair = (forward[t - 1][live][:, :, None] + chain.moves
                + (scores[live, t] + backward[t][live])[:, None, :] - z[live, None, None])
        moves += np.einsum("ni,nj->ij", truth[live, t - 1], truth[live, t]) - np.exp(pair).sum(axis=0)
    diff = truth - p
    return np.einsum("nlf,nlk->fk", x, diff), moves, diff[:, 0].sum(axis=0)


def fit(features: list[np.ndarray], tags: list[np.ndarray], k: int, start: Chain | None = None, steps: int = 120,
        rate: float = 0.1, l2: float = 1e-3, window: int = 64) -> Chain:
    """A chain fitted to tagged sequences; without sequences, one of zeros."""
    width = features[0].shape[1] if features else 1
    theta = [start.weights, start.moves, start.first] if start else [np.zeros((width, k)), np.zeros((k, k)), np.zeros(k)]
    theta = [t.copy() for t in theta]
    batches = list(_batches(features, tags, window))
    places = sum(int(on.sum()) for _, _, on in batches)
    if not places:
        return Chain(*theta)
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        total = [-l2 * t for t in theta]
        for x, y, on in batches:
            for part, g in zip(total, _gradient(Chain(*theta), x, y, on), strict=True):
                part += g / places
        for i, g in enumerate(total):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            theta[i] += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Chain(*theta)


def platt(x: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve from a score to a label, with Platt's softened targets."""
    good, bad = float((label == 1).sum()), float((label == 0).sum())
    if not len(x):
        return 1.0, 0.0
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 0.0, float(np.log((good + 1) / (bad + 1)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w, r = p * (1 - p) + 1e-9, p - target
        h = np.array([[np.sum(w * x * x) + 1e-3, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-3]])
        step = np.linalg.solve(h, np.array([np.sum(r * x) + 1e-3 * a, np.sum(r)]))
        size = np.abs(step).max()
        a, b = (a, b) - step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return float(a), float(b)
