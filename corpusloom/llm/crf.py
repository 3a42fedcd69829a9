"""A linear-chain conditional random field in numpy, over batches of padded sequences.

Label 0 is "outside". A sequence is a stretch of tokens with outside on both borders, which is exact where the tokens
around it can have no other label. A token has several features (their weights add up).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Crf:
    def __init__(self, emit: np.ndarray, move: np.ndarray):
        #: emit[feature, label], move[from, to]
        self.emit, self.move = emit, move

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Emission scores; ``features`` ends in the axis of a token's features, -1 being none."""
        return np.where(features[..., None] >= 0, self.emit[features], 0.0).sum(axis=-2)

    def marginals(self, e: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward over ``e`` [sequence, place, label]: token marginals, summed transitions, log partition."""
        b, n, k = e.shape
        fwd, bwd = np.zeros((n, b, k)), np.zeros((n, b, k))
        fwd[0] = self.move[0] + e[:, 0]
        for t in range(1, n):
            fwd[t] = _logsum(fwd[t - 1][:, :, None] + self.move, 1) + e[:, t]
        last = lengths - 1
        z = _logsum(fwd[last, np.arange(b)] + self.move[:, 0], 1)
        moves = np.zeros((b, k, k))
        for t in range(n - 1, -1, -1):
            if t + 1 < n:
                inner = _logsum(self.move + (e[:, t + 1] + bwd[t + 1])[:, None, :], 2)
                bwd[t] = np.where((last == t)[:, None], self.move[:, 0], inner)
                both = fwd[t][:, :, None] + self.move + (e[:, t + 1] + bwd[t + 1])[:, None, :] - z[:, None, None]
                moves += np.where((t < last)[:, None, None], np.exp(np.minimum(both, 0)), 0)
            else:
                bwd[t] = self.move[:, 0]
        p = np.exp(np.minimum(fwd + bwd - z[None, :, None], 0)).transpose(1, 0, 2)
        p[np.arange(n) >= lengths[:, None]] = 0
        moves[:, 0, :] += p[:, 0]
        moves[:, :, 0] += p[np.arange(b), last]
        return p, moves, z

    def viterbi(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The likeliest labels [sequence, place]; 0 beyond a sequence's end."""
        b, n, k = e.shape
        best = self.move[0] + e[:, 0]
        kept = [best]
        back = []
        for t in range(1, n):
            step = best[:, :, None] + self.move
            back.append(step.argmax(1))
            best = step.max(1) + e[:, t]
            kept.append(best)
        rows, last = np.arange(b), lengths - 1
        out = np.zeros((b, n), np.int64)
        label = (np.stack(kept)[last, rows] + self.move[:, 0]).argmax(1)
        for t in range(n - 1, -1, -1):
            if t + 1 < n:
                label = np.where(t < last, back[t][rows, label], label)
            out[:, t] = np.where(t <= last, label, 0)
        return out

    @classmethod
    def fit(cls, features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, weight: np.ndarray, n_features: int, k: int, steps: int = 300, ridge: float = 0.02) -> Crf:
        """Weighted maximum likelihood with a ridge, by Adam on whole batches; the same on every run."""
        emit, move = np.zeros((n_features, k)), np.zeros((k, k))
        b, n, m = features.shape
        real = (np.arange(n) < lengths[:, None]).astype(float) * weight[:, None]
        gold = np.eye(k)[labels] * real[..., None]
        gold_move = np.zeros((k, k))
        padded = np.concatenate([np.zeros((b, 1), np.int64), labels, np.zeros((b, 1), np.int64)], 1)
        for t in range(n + 1):
            np.add.at(gold_move, (padded[:, t], padded[:, t + 1]), np.where(t <= lengths, weight, 0))
        slots = np.where(features >= 0, features, n_features)

        def spread(per_token: np.ndarray) -> np.ndarray:
            out = np.zeros((n_features + 1, k))
            for j in range(m):
                np.add.at(out, slots[..., j].ravel(), per_token.reshape(-1, k))
            return out[:-1]

        target, total = spread(gold), max(weight.sum(), 1)
        state = [[w, np.zeros_like(w), np.zeros_like(w)] for w in (emit, move)]
        for step in range(1, steps + 1):
            model = cls(emit, move)
            p, moves, _ = model.marginals(model.scores(features), lengths)
            grads = (spread(p * real[..., None]) - target) / total + ridge / total * emit, ((moves * weight[:, None, None]).sum(0) - gold_move) / total + ridge / total * move
            for s, g in zip(state, grads):
                s[1] = 0.9 * s[1] + 0.1 * g
                s[2] = 0.99 * s[2] + 0.01 * g * g
                s[0] -= 0.2 * (s[1] / (1 - 0.9**step)) / (np.sqrt(s[2] / (1 - 0.99**step)) + 1e-9)
            emit, move = state[0][0], state[1][0]
        return cls(emit, move)


def batches(lengths: np.ndarray, cells: int = 1 << 20) -> Iterator[np.ndarray]:
    """Sequence numbers by rising length, in batches whose padded size stays under ``cells`` (or one sequence)."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        take = 1
        # lengths rise, so the padded size of a batch is its count times its last length
        while at + take < len(order) and (take + 1) * lengths[order[at + take]] <= cells and lengths[order[at + take]] <= 2 * lengths[order[at]] + 4:
            take += 1
        yield order[at : at + take]
        at += take


def padded(values: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of ``values`` from ``first`` on, ``lengths`` of them per sequence, padded with -1."""
    place = np.arange(lengths.max(initial=1))
    at = np.minimum(first[:, None] + place, len(values) - 1)
    out = values[at].copy()
    out[place >= lengths[:, None]] = -1
    return out
