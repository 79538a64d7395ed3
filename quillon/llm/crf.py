"""A linear-chain conditional random field over word-shape features.

The features of a token are its shape and its word, and those of its neighbours. What training saw in one sentence
only shares a row, and what it never saw takes that row. Training is full-batch Adam on the exact log-likelihood (forward-backward in numpy). Decoding is Viterbi
over a batch of sequences at once; sequences for which the all-O path is provably best are left out of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import numpy as np

BLOCKS = (("shape", 0), ("shape", -1), ("shape", 1), ("word", 0), ("word", -1), ("word", -2), ("word", 1))
EDGE = "\0"
TRIM_LEFT, TRIM_RIGHT = "\"'([{<", "\"')]}>,;:.!?"
CLASSES = str.maketrans({**{chr(c): "d" for c in range(48, 58)}, **{chr(c): "x" for c in range(97, 123)}, **{chr(c): "X" for c in range(65, 91)}})
RUNS = re.compile(r"x{4,}|X{4,}|d{9,}")


def core(token: str) -> str:
    """The token without the punctuation around it."""
    return token.lstrip(TRIM_LEFT).rstrip(TRIM_RIGHT) or token


def shape(token: str) -> str:
    """Letters to x or X, digits to d; other characters stay. Long runs of letters are cut to four, of digits to nine."""
    if len(token) > 64:
        return "long"
    if token.isalpha() and token.islower():
        return "xxxx"[: len(token)]
    s = core(token).translate(CLASSES)
    s = "".join(("X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c) if ord(c) > 127 else c for c in s) if not s.isascii() else s
    return RUNS.sub(lambda m: m[0][:9] if m[0][0] == "d" else m[0][:4], s)


def word(token: str) -> str:
    return core(token).lower()


class Crf:
    """weights[block] has a row of label weights for each known value, and a last row for the others."""

    def __init__(self, labels: Sequence[str]):
        self.labels = list(labels)
        self.index: dict[str, dict[str, int]] = {"shape": {}, "word": {}}
        self.weights: list[np.ndarray] = []
        self.trans = np.zeros((len(self.labels), len(self.labels)))
        self.start = np.zeros(len(self.labels))

    # -- features ------------------------------------------------------------------------------------------------
    def ids(self, token: str) -> tuple[int, int]:
        shapes, words = self.index["shape"], self.index["word"]
        return shapes.get(shape(token), len(shapes)), words.get(word(token), len(words))

    def features(self, s: np.ndarray, w: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """For each block the row of each token's value. s, w: ids of all tokens of all sequences, one after another; first marks where sequences begin."""
        n = len(s)
        near: dict[tuple[str, int], np.ndarray] = {}
        for name, x in (("shape", s), ("word", w)):
            edge = self.index[name][EDGE]
            near[name, 0] = x
            back = x
            for off in (-1, -2):
                back = np.concatenate([[edge], back[:-1]])[:n]
                back[first] = edge
                near[name, off] = back
            ahead = np.concatenate([x[1:], [edge]])[:n]
            ahead[:-1][first[1:]] = edge
            near[name, 1] = ahead
        return [near[b] for b in BLOCKS]

    def emissions(self, s: np.ndarray, w: np.ndarray, first: np.ndarray) -> np.ndarray:
        e = np.zeros((len(s), len(self.labels)))
        for rows, weight in zip(self.features(s, w, first), self.weights):
            e += weight[rows]
        return e

    # -- training ------------------------------------------------------------------------------------------------
    def fit(self, sequences: list[list[str]], tags: list[list[str]], rounds: int = 200, l2: float = 0.02, rate: float = 0.2) -> Crf:
        for name, of in (("shape", shape), ("word", word)):
            often = Counter(v for q in sequences for v in {of(t) for t in q})
            seen = sorted({v for v, n in often.items() if n > 1} | {EDGE})
            self.index[name] = {v: i for i, v in enumerate(seen)}
        got = [self.ids(t) for q in sequences for t in q]
        s, w = np.array([g[0] for g in got]), np.array([g[1] for g in got])
        lengths = np.array([len(q) for q in sequences])
        first = np.zeros(len(s), dtype=bool)
        first[np.cumsum(lengths) - lengths] = True
        y = np.array([self.labels.index(t) for q in tags for t in q])
        rows, k = self.features(s, w, first), len(self.labels)
        self.weights = [np.zeros((len(self.index[name]) + 1, k)) for name, _ in BLOCKS]
        m, longest = len(sequences), int(lengths.max())
        pos = np.arange(len(s)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        seq = np.repeat(np.arange(m), lengths)
        live = np.zeros((m, longest), dtype=bool)
        live[seq, pos] = True
        params = [*self.weights, self.trans, self.start]
        gold = [np.zeros_like(p) for p in params]
        for g, r in zip(gold, rows):
            np.add.at(g, (r, y), 1)
        np.add.at(gold[-2], (y[:-1][~first[1:]], y[1:][~first[1:]]), 1)
        np.add.at(gold[-1], y[first], 1)
        sums = []  # by block: the rows that occur, and how to add up what their tokens have
        for r in rows:
            order = np.argsort(r, kind="stable")
            at = np.nonzero(np.diff(r[order], prepend=-1))[0]
            sums.append((r[order][at], order, at))
        moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, rounds + 1):
            flat = sum(weight[r] for r, weight in zip(rows, self.weights))
            e = np.ones((m, longest, k))
            e[seq, pos] = np.exp(flat - flat.max(1, keepdims=True))
            go = np.exp(self.trans)
            # each step is scaled to sum to one, so products stay in range
            alpha, beta, scale = np.zeros_like(e), np.ones_like(e), np.ones((m, longest, 1))
            for t in range(longest):
                nxt = e[:, t] * (np.exp(self.start) if t == 0 else alpha[:, t - 1] @ go)
                total = nxt.sum(1, keepdims=True)
                alpha[:, t] = nxt / total if t == 0 else np.where(live[:, t, None], nxt / total, alpha[:, t - 1])
                scale[:, t] = total
            for t in range(longest - 2, -1, -1):
                prev = ((e[:, t + 1] * beta[:, t + 1]) @ go.T) / scale[:, t + 1]
                beta[:, t] = np.where(live[:, t + 1, None], prev, 1.0)
            p = (alpha * beta)[seq, pos]
            want = [np.zeros_like(x) for x in params]
            for g, (r, order, at) in zip(want, sums):
                g[r] = np.add.reduceat(p[order], at, axis=0)
            for t in range(1, longest):
                on = live[:, t]
                want[-2] += go * (alpha[on, t - 1].T @ (e[on, t] * beta[on, t] / scale[on, t]))
            want[-1] += p[first].sum(0)
            for i, x in enumerate(params):
                g = gold[i] - want[i] - l2 * x
                moment[i] = 0.9 * moment[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                x += rate * (moment[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
        for j, label in enumerate(self.labels):
            if label.startswith("I-"):  # an inner label only follows its own kind
                self.start[j] = -1e4
                self.trans[[i for i, x in enumerate(self.labels) if x[2:] != label[2:]], j] = -1e4
        o = self.labels.index("O")
        self.gain = [np.delete(weight, o, 1).max(1) - weight[:, o] for weight in self.weights]
        return self

    # -- decoding ------------------------------------------------------------------------------------------------
    def doubtful(self, s: np.ndarray, w: np.ndarray, first: np.ndarray) -> np.ndarray:
        """By sequence: may some path beat the all-O path? False only where no token's gain by leaving O, bounded block by block, makes up for the transitions."""
        if not len(s):
            return np.zeros(0, dtype=bool)
        o = self.labels.index("O")
        # a path that leaves O for n tokens uses at most n + 1 other transitions, or n and a start
        most = max(float(self.trans.max()) - float(self.trans[o, o]), 0.0)
        gain = np.full(len(s), 2 * most + max(float(self.start.max() - self.start[o]), 0.0))
        for rows, g in zip(self.features(s, w, first), self.gain):
            gain += g[rows]
        return np.maximum.reduceat(gain, np.nonzero(first)[0]) > 0

    def viterbi(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of all tokens; e has the sequences one after another. All sequences advance together, the long ones first."""
        m, k = len(lengths), len(self.labels)
        out = np.zeros(len(e), dtype=np.int64)
        if not len(e):
            return out
        order = np.argsort(-lengths, kind="stable")
        begin, long = (np.cumsum(lengths) - lengths)[order], lengths[order]
        back = np.zeros((len(e), k), dtype=np.int8)
        score = e[begin] + self.start
        live = m
        for t in range(1, int(long[0])):
            live = int(np.searchsorted(-long[:live], -t, side="left"))
            step = score[:live, :, None] + self.trans[None]
            best = step.argmax(1)
            at = begin[:live] + t
            back[at] = best
            score[:live] = np.take_along_axis(step, best[:, None, :], 1)[:, 0] + e[at]
        y = score.argmax(1)
        for t in range(int(long[0]) - 1, -1, -1):
            live = int(np.searchsorted(-long, -t, side="left"))
            at = begin[:live] + t
            out[at] = y[:live]
            if t:
                y[:live] = back[at, y[:live]]
        return out
