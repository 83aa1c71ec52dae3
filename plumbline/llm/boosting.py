"""Gradient boosted trees for two classes, on binned features, fitted to rows wherever they are.

A level of a tree needs no rows but their gradients, added up by node, feature and bin
(``gradients``); these sums may come from many tasks. They are whole numbers, so that they do
not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Gradients are counted in these units.
UNIT = 1 << 24


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Tree:
    """Feature and cut of each inner node, and value of each leaf, nodes in level order."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    #: Levels that are split already.
    level: int = 0

    def places(self, binned: np.ndarray) -> np.ndarray:
        """Node or leaf of each row, counted within the level reached."""
        at, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(self.level):
            at = 2 * at + 1 + (binned[rows, self.feature[at]] > self.cut[at])
        return at - (2**self.level - 1)


class BoostedTrees:
    """Trees of a fixed depth, each fitted to what the ones before leave of the logistic loss."""

    def __init__(self, trees: int = 40, depth: int = 3, bins: int = 32, rate: float = 0.2, smooth: float = 1.0):
        self.trees, self.depth, self.bins, self.rate, self.smooth = trees, depth, bins, rate, smooth
        self.base, self.cuts, self.grown = 0.0, [], []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)]).astype(np.int64)

    def start(self, share: float) -> BoostedTrees:
        """Before any tree: the share of examples."""
        share = np.clip(share, 1e-3, 1 - 1e-3)
        self.base, self.grown = float(np.log(share / (1 - share))), []
        return self

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, self.bins + 1)[1:-1])) for i in range(x.shape[1])]
        binned, n = self.binned(x), np.ones(len(y), np.int64)
        return self.start(y.mean()).grow(lambda: self.gradients(binned, y, n))

    def grow(self, gradients: Callable[[], tuple[np.ndarray, np.ndarray]]) -> BoostedTrees:
        while self.unfinished:
            self.plant()
            self.split(*gradients())
        return self

    @property
    def unfinished(self) -> bool:
        return len(self.grown) < self.trees or self.grown[-1].level < self.depth

    def plant(self) -> None:
        """A new tree, if the last one has all its levels."""
        if not self.grown or self.grown[-1].level == self.depth:
            nodes = 2**self.depth - 1
            self.grown.append(Tree(np.zeros(nodes, np.int64), np.full(nodes, self.bins, np.int64), np.zeros(nodes + 1)))

    def gradients(self, binned: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of slope and curve of the loss over rows that count ``n`` times: [node of the level to split, feature, bin]."""
        tree = self.grown[-1]
        width, features = 2**tree.level, binned.shape[1]
        p = sigmoid(self.output(binned, self.grown[:-1]))
        slope, curve = np.rint((p - y) * UNIT) * n, np.rint(p * (1 - p) * UNIT) * n
        first = tree.places(binned) * self.bins
        shape = (width, features, self.bins)
        g, h = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for f in range(features):
            cell = first + binned[:, f]
            g[:, f] = np.bincount(cell, slope, width * self.bins).reshape(width, self.bins)
            h[:, f] = np.bincount(cell, curve, width * self.bins).reshape(width, self.bins)
        return g, h

    def split(self, slope: np.ndarray, curve: np.ndarray) -> None:
        """Splits the next level of the last tree by the sums over all rows."""
        tree = self.grown[-1]
        width, first = 2**tree.level, 2**tree.level - 1
        g, h = slope.cumsum(axis=2) / UNIT, curve.cumsum(axis=2) / UNIT
        total_g, total_h = g[:, :, -1:], h[:, :, -1:]
        gain = g**2 / (h + self.smooth) + (total_g - g) ** 2 / (total_h - h + self.smooth) - total_g**2 / (total_h + self.smooth)
        for node in range(width):
            f, where = np.unravel_index(gain[node, :, :-1].argmax(), gain[node, :, :-1].shape)
            if gain[node, f, where] > 1e-9:
                tree.feature[first + node], tree.cut[first + node] = f, where
            if tree.level == self.depth - 1:
                # A node that is not split has all its rows to the left.
                where = min(tree.cut[first + node], self.bins - 1)
                f = tree.feature[first + node]
                left_g, left_h = g[node, f, where], h[node, f, where]
                tree.value[2 * node] = -left_g / (left_h + self.smooth)
                tree.value[2 * node + 1] = -(total_g[node, f, 0] - left_g) / (total_h[node, f, 0] - left_h + self.smooth)
        tree.level += 1

    def output(self, binned: np.ndarray, grown: list[Tree] | None = None) -> np.ndarray:
        output = np.full(len(binned), self.base)
        for tree in self.grown if grown is None else grown:
            output += self.rate * tree.value[tree.places(binned)]
        return output

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.output(self.binned(x))) if len(x) else np.zeros(0)
