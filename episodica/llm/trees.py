"""Gradient-boosted trees over all rows: sums of small tables of bins, wherever the rows are; quick to apply in tasks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

ROUNDS, DEPTH, RATE, LEAF, BINS = 40, 3, 0.3, 10, 16
#: Gradients are summed as whole multiples of 1 / SCALE, so that sums are exact and the same however rows are dealt.
SCALE = float(1 << 20)
#: Rows whose sums are taken together.
CHUNK = 1 << 15

Tree = tuple[np.ndarray, np.ndarray, np.ndarray]


class Trees:
    """Regression trees over log-odds with a calibration line; each tree is arrays of a complete binary tree."""

    def __init__(self, start: float, trees: list[Tree], slope: float = 1.0, shift: float = 0.0):
        self.start, self.trees, self.slope, self.shift = start, trees, slope, shift

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds before calibration, to three digits: few different ones, which can be counted."""
        out = np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            out += value[_walk(x, feature, cut, DEPTH)]
        return np.round(out, 3)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(self.raw(x))

    def scaled(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30)))


def _walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Node of every row after ``depth`` levels."""
    node = np.zeros(len(x), np.int64)
    for _ in range(depth):
        f = feature[node]
        right = np.where(f >= 0, x[np.arange(len(x)), np.maximum(f, 0)] > cut[node], False)
        node = 2 * node + 1 + right
    return node


def cuts_of(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Cuts between quantiles of a column, given as its distinct values and their weights."""
    order = np.argsort(values)
    values, upto = values[order], np.cumsum(n[order])
    at = np.searchsorted(upto, np.linspace(0, 1, BINS + 1)[1:-1] * upto[-1])
    c = values[np.minimum(at, len(values) - 1)]
    return np.unique(np.concatenate([c[c < values[-1]], values[:1]]))


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """For each value the number of cuts that it exceeds."""
    return np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1).astype(np.uint8)


class Rows:
    """Binned rows with labels and weights, and the log-odds that the trees so far give them."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, n: np.ndarray):
        self.bins, self.y, self.n = bins, y, n
        self._score, self._done = None, 0

    def sums(self, start: float, trees: list[Tree], feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
        """Of every node of a level, feature and bin: gradients, second-order terms and weights of the rows there."""
        if self._score is None:
            self._score = np.full(len(self.y), start)
        for f, c, value in trees[self._done :]:
            self._score += value[_walk(self.bins, f, c, DEPTH)]
        self._done = len(trees)
        p = 1 / (1 + np.exp(-self._score))
        parts = np.rint(self.n * (self.y - p) * SCALE), np.rint(self.n * np.maximum(p * (1 - p), 1e-6) * SCALE), self.n
        width, level = self.bins.shape[1], 2**depth
        out = np.zeros((3, level * width * (BINS + 1)))
        for lo in range(0, len(self.y), CHUNK):
            bins = self.bins[lo : lo + CHUNK]
            node = _walk(bins, feature, cut, depth) - (level - 1)
            cell = ((node[:, None] * width + np.arange(width)) * (BINS + 1) + bins).ravel()
            for k, part in enumerate(parts):
                out[k] += np.bincount(cell, np.repeat(part[lo : lo + CHUNK], width), out.shape[1])
        return out.reshape(3, level, width, BINS + 1)


Sums = Callable[[float, list[Tree], np.ndarray, np.ndarray, int], np.ndarray]


def boosted(cuts: Sequence[np.ndarray], share: float, sums: Sums) -> Trees:
    """Logistic loss, second-order leaf values; ``sums`` adds up ``Rows.sums`` of all rows."""
    share = float(np.clip(share, 1e-3, 1 - 1e-3))
    start, grown = float(np.log(share / (1 - share))), []
    within = np.arange(BINS + 1) < np.array([len(c) for c in cuts])[:, None]
    nodes = 2 ** (DEPTH + 1) - 1
    for _ in range(ROUNDS):
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        for depth in range(DEPTH):
            first = 2**depth - 1
            for i, (g, h, n) in enumerate(np.moveaxis(sums(start, grown, feature, cut, depth), 1, 0), first):
                left = [np.cumsum(part, axis=1) for part in (g / SCALE, h / SCALE, n)]
                (g_all, h_all, n_all), (gl, hl, nl) = (part[0, -1] for part in left), left
                gain = gl**2 / (hl + 1) + (g_all - gl) ** 2 / (h_all - hl + 1) - g_all**2 / (h_all + 1)
                gain[~(within & (nl >= LEAF) & (n_all - nl >= LEAF))] = 0
                k, b = np.unravel_index(gain.argmax(), gain.shape)
                split = gain[k, b] > 1e-3
                if split:
                    feature[i], cut[i] = k, b
                sides = ((gl[k, b], hl[k, b]), (g_all - gl[k, b], h_all - hl[k, b])) if split else ((g_all, h_all), (0.0, 0.0))
                for child, (gs, hs) in enumerate(sides, 2 * i + 1):
                    value[child] = RATE * gs / (hs + 1)
        value[: 2**DEPTH - 1] = 0
        grown.append((feature, cut, value))
    real = [(f, np.array([cuts[k][int(b)] if k >= 0 else 0.0 for k, b in zip(f, c)]), v) for f, c, v in grown]
    return Trees(start, real)


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for rows at hand."""
    n = np.ones(len(y))
    cuts = [cuts_of(c, n) for c in x.T]
    return boosted(cuts, y.mean(), Rows(binned(x, cuts), y, n).sums)


def calibrated(trees: Trees, raw: np.ndarray, y: np.ndarray, n: np.ndarray, kinds: list[np.ndarray], precision: float) -> tuple[Trees, list[float]]:
    """Fit the calibration line on other rows than the trees, then the lowest threshold of each kind with that precision (2: none).

    Rows are counted: ``n`` rows have that log-odds and label.
    """
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton's method with a weak prior at the identity
        p = 1 / (1 + np.exp(-np.clip(slope * raw + shift, -30, 30)))
        w, e = n * p * (1 - p), n * (y - p)
        a, b, c = (w * raw * raw).sum() + 1, (w * raw).sum(), w.sum() + 1
        gs, gc = (e * raw).sum() - (slope - 1), e.sum() - shift
        det = a * c - b * b
        ds, dc = (c * gs - b * gc) / det, (a * gc - b * gs) / det
        slope, shift = max(slope + np.clip(ds, -1, 1), 1e-3), shift + np.clip(dc, -1, 1)
    model = Trees(trees.start, trees.trees, float(slope), float(shift))
    p, thresholds = model.scaled(raw), []
    for kind in kinds:
        order = np.argsort(-p[kind], kind="stable")
        q, hit, many = p[kind][order], (n * y)[kind][order], n[kind][order]
        good = np.flatnonzero((np.cumsum(hit) / np.cumsum(many) >= precision) & np.append(q[1:] < q[:-1], True)) if len(q) else []
        thresholds.append(max(0.5, float(q[good[-1]])) if len(good) else 2.0)
    return model, thresholds
