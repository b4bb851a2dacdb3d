"""Cover trees over unit vectors and their dual traversal, in numpy."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np

#: Added to every bound on distances, for rounding.
SLACK = 1e-6
#: Pairs of nodes that are compared at a time.
_AT_ONCE = 1 << 15
_DENSE = 1 << 10
#: Classes of covering radii, and what a product of unit vectors in single precision may be off.
_RADII, _SINGLE = np.array([0.02, 0.1, 0.25, 0.5]), 1e-4


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square over- or underflows."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distance(dot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * dot, 0.0))


def spread_points(x: np.ndarray, most: int) -> np.ndarray:
    """Places of at most ``most`` rows, each the farthest from those before it: every prefix is a net of the rest."""
    chosen, least = [0], distance(x @ x[0])
    while len(chosen) < min(most, len(x)) and least.max() > 0:
        chosen.append(int(least.argmax()))
        np.minimum(least, distance(x @ x[chosen[-1]]), out=least)
    return np.array(chosen)


def first_radius(reach: float) -> float:
    """The largest halved radius at which pairs of unit balls' nodes can be farther apart than ``reach`` allows: larger ones would prune nothing."""
    radius = 1.0
    while 2 * radius + reach >= 2 and radius > 0.1:
        radius /= 2
    return radius


class CoverTree:
    """Nested levels over the rows of ``x``.

    The top nodes are given (``label`` of each row, their centres ``top``); each level
    below covers the rows of a node by balls of half the radius around rows that are
    farther than that from each other, a node's own centre first.  The last level
    is the rows themselves.  The first level has radius ``first``.  Rows are put in an order in which every node is a range;
    ``order`` has their former places.  ``own`` is a radius that a row has itself.
    """

    def __init__(self, x: np.ndarray, label: np.ndarray, top: np.ndarray, own: np.ndarray | None = None, first: float = 1.0, least: float = 0.0625) -> None:
        n = len(x)
        labels, centres = [np.asarray(label, np.int64)], []
        radius = first
        while radius >= least:
            new, centre = self._halved(x, labels[-1], centres[-1] if centres else None, radius)
            labels.append(new)
            centres.append(centre)
            radius /= 2
        self.order = order = np.lexsort(labels[::-1])
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.x = x[order]
        self.starts, self.centres, self.radius, self.rows, self.singles = [], [], [], [], {}
        own = np.zeros(n) if own is None else own[order]
        for k, values in enumerate(labels):
            values = values[order]
            first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
            if k:
                self.rows.append(place[centres[k - 1][values[first]]])
            vectors = self.x[self.rows[-1]] if k else top[values[first]]
            reach = distance(np.einsum("ij,ij->i", self.x, np.repeat(vectors, np.diff(np.append(first, n)), axis=0))) + own
            self._level(first, vectors, np.maximum.reduceat(reach, first))
        self.top = labels[0][order][self.starts[0][:-1]]
        self._level(np.arange(n), self.x, own)

    def _level(self, starts, centres, radius) -> None:
        self.starts.append(np.append(starts, len(self.x)))
        self.centres.append(centres)
        self.radius.append(radius)

    @staticmethod
    def _halved(x: np.ndarray, label: np.ndarray, centre: np.ndarray | None, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(label of each row, centre row of each label) of the next level."""
        order = np.argsort(label, kind="stable")
        first = np.flatnonzero(np.append(True, label[order][1:] != label[order][:-1]))
        sizes = np.diff(np.append(first, len(x)))
        new, centres = np.empty(len(x), np.int64), []
        single = order[first[sizes == 1]]
        new[single] = np.arange(len(single))
        centres.extend(single)
        least = 1.0 - radius * radius / 2
        for s, size in zip(first[sizes > 1], sizes[sizes > 1], strict=True):
            left = order[s : s + size]
            if centre is not None:  # nested: the node's centre is one on the next level
                c = centre[label[left[0]]]
                left = np.append(c, left[left != c])
            while len(left):
                near = x[left] @ x[left[:256]].T >= least
                free = np.ones(len(left), bool)
                for k in range(near.shape[1]):
                    if free[k]:
                        mine = near[:, k] & free
                        mine[k] = True
                        new[left[mine]] = len(centres)
                        centres.append(left[k])
                        free &= ~mine
                left = left[free]
        return new, np.array(centres, np.int64)

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of the nodes on the next level."""
        below = self.starts[level + 1]
        return np.searchsorted(below, self.starts[level][nodes]), np.searchsorted(below, self.starts[level][nodes + 1])

    def narrow(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(centres in single precision, class of radius) of the nodes of a level."""
        if level not in self.singles:
            self.singles[level] = self.centres[level].astype(np.float32), np.searchsorted(_RADII, self.radius[level])
        return self.singles[level]

    def to_bytes(self) -> bytes:
        """All but the vectors."""
        out = io.BytesIO()
        named = {f"s{k}": s for k, s in enumerate(self.starts[:-1])} | {f"r{k}": r for k, r in enumerate(self.radius)} | {f"c{k}": c for k, c in enumerate(self.rows)}
        np.savez(out, top=self.top, **named)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes, x: np.ndarray, top: np.ndarray) -> CoverTree:
        """``x``: the rows in the tree's order; ``top``: the centres of all top labels."""
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as f:
            levels = sum(k.startswith("r") for k in f.files)
            tree.x, tree.top, tree.rows, tree.singles = x, f["top"], [f[f"c{k}"] for k in range(levels - 2)], {}
            tree.starts = [f[f"s{k}"] for k in range(levels - 1)] + [np.arange(len(x) + 1)]
            tree.centres = [top[tree.top], *(x[r] for r in tree.rows), x]
            tree.radius = [f[f"r{k}"] for k in range(levels)]
        return tree


def dual(a: CoverTree, b: CoverTree, reach: float, i: np.ndarray, j: np.ndarray, inside: Callable, undecided: Callable) -> None:
    """Finds the pairs of rows within ``reach``, from pairs (i, j) of top nodes.

    A pair of nodes whose distance less both covering radii is over ``reach`` is pruned;
    ``inside(level, i, j)`` gets pairs whose distance with both radii is within it, so all
    their rows are; ``undecided(i, j)`` gets pairs of rows that are neither, which is
    by the slack of the bounds or by the rows' own radii.  Goes depth first, so what is held is bounded.
    """
    last = len(a.starts) - 1

    def tested(level: int, dot: np.ndarray, ra, rb):
        d, s = distance(dot), ra + rb
        sure = d + s <= reach - SLACK
        return sure, ~sure & (d - s <= reach + SLACK)

    def settle(level: int, i, j, sure, some) -> None:
        if sure.any():
            inside(level, i[sure], j[sure])
        if some.any():
            if level == last:
                undecided(i[some], j[some])
            else:
                expand(level, i[some], j[some])

    def listed(level: int, i, j) -> None:
        for at in range(0, len(i), _AT_ONCE):
            x, y = i[at : at + _AT_ONCE], j[at : at + _AT_ONCE]
            dot = np.einsum("ij,ij->i", a.centres[level][x], b.centres[level][y])
            settle(level, x, y, *tested(level, dot, a.radius[level][x], b.radius[level][y]))

    def dense(level: int, p: int, q: int, r: int, s: int) -> None:
        """Nodes p to q of one tree with r to s of the other: a product in single precision for each two classes of radius leaves few to be tested."""
        one, its = a.narrow(level)
        two, theirs = b.narrow(level)
        for u in np.unique(its[p:q]):
            rows = p + np.flatnonzero(its[p:q] == u)
            for v in np.unique(theirs[r:s]):
                columns = r + np.flatnonzero(theirs[r:s] == v)
                bound = reach + SLACK + a.radius[level][rows].max() + b.radius[level][columns].max()
                least = np.float32(1.0 - bound * bound / 2 - _SINGLE if bound < 2 else -2.0)
                step = max(1, (1 << 20) // len(columns))
                for at in range(0, len(rows), step):
                    x, y = np.nonzero(one[rows[at : at + step]] @ two[columns].T >= least)
                    listed(level, rows[at + x], columns[y])

    def expand(level: int, i, j) -> None:
        a0, a1 = a.children(level, i)
        b0, b1 = b.children(level, j)
        size = (a1 - a0) * (b1 - b0)
        many = size >= _DENSE
        for p, q, r, s in zip(a0[many], a1[many], b0[many], b1[many], strict=True):
            dense(level + 1, p, q, r, s)
        few = np.flatnonzero(~many)
        ends = np.cumsum(size[few])
        at = 0
        while at < len(few):
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _AT_ONCE, "right"))
            to = max(to, at + 1)
            own = few[at:to]
            n = size[own]
            pair = np.repeat(own, n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = (b1 - b0)[pair]
            listed(level + 1, a0[pair] + k // wide, b0[pair] + k % wide)
            at = to

    listed(0, i, j)


def joined(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least row that each of ``n`` rows reaches by edges (u, v), or by those that ``label`` stands for."""
    label = np.arange(n) if label is None else label
    while True:
        x, y = label[u], label[v]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while True:
            above = label[label]
            if (above == label).all():
                break
            label = above
