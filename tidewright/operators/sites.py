"""A tree over fixed places, which finds the nearest of many for batches of points, ties included."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LEAF, BATCH = 16, 4096
#: Pairs of a point and a leaf that are held at once; more are taken in halves of the points.
MOST_PAIRS = 1 << 18


class SiteTree:
    """Places (n, dimensions), all finite, halved along the widest side of their box down to leaves of LEAF or fewer.

    A box's least and greatest distances bound those of its places in floating point too, as every step
    rounds monotonically; so a place is left out only if it is farther than those found.
    """

    def __init__(self, places: np.ndarray) -> None:
        n = len(places)
        depth = max(0, int(np.ceil(np.log2(n / LEAF))))
        cuts = [(n * np.arange((1 << level) + 1)) >> level for level in range(depth + 1)]
        order = np.arange(n)
        for level in range(depth):
            for i, (a, b) in enumerate(zip(cuts[level].tolist(), cuts[level][1:].tolist(), strict=False)):
                part = places[order[a:b]]
                side = part[:, np.argmax(np.ptp(part, axis=0))]
                order[a:b] = order[a:b][np.argpartition(side, int(cuts[level + 1][2 * i + 1]) - a)]
        counts = np.diff(cuts[depth])
        slot = cuts[depth][:-1, None] + np.arange(counts.max())
        #: By leaf, the places' numbers, -1 where there is none.
        self.members = np.where(np.arange(counts.max()) < counts[:, None], order[np.minimum(slot, n - 1)], -1)
        self.places = places
        #: By level, each box's least and greatest corner and its number of places.
        self.levels = [(*(f.reduceat(places[order], c[:-1]) for f in (np.minimum, np.maximum)), np.diff(c)) for c in cuts]

    def near(self, points: np.ndarray, k: int = 1, widen: Callable[[np.ndarray], np.ndarray] = lambda d: d) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): for point i the places j up to the k-th nearest, and those as near as that, or within what widen makes of its squared distance.

        A point that is no number has none.
        """
        found = [tuple(x + o for x, o in zip(self._batch(points[b : b + BATCH], k, widen), (b, 0), strict=True)) for b in range(0, len(points), BATCH)]
        return tuple(np.concatenate([f[s] for f in found] or [np.zeros(0, np.int64)]) for s in (0, 1))

    def _batch(self, points: np.ndarray, k: int, widen: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        m = len(points)
        p = np.flatnonzero(~np.isnan(points).any(axis=1))
        node, bound = np.zeros(len(p), np.int64), np.full(m, np.inf)
        for level, (low, high, count) in enumerate(self.levels):
            if level:
                p, node = np.repeat(p, 2), np.repeat(2 * node, 2)
                node[1::2] += 1
            least, most = np.zeros(len(p)), np.zeros(len(p))
            for d in range(points.shape[1]):
                below, above = points[p, d] - low[node, d], high[node, d] - points[p, d]
                least += np.maximum(0.0, np.maximum(-below, -above)) ** 2
                most += np.maximum(below, above) ** 2
            enough = count[node] >= k
            np.minimum.at(bound, p[enough], most[enough])
            live = least <= widen(bound)[p]
            p, node, least = p[live], node[live], least[live]
            if len(p) > MOST_PAIRS and m > 1:
                (i, j), (after, more) = self._batch(points[: m // 2], k, widen), self._batch(points[m // 2 :], k, widen)
                return np.concatenate([i, after + m // 2]), np.concatenate([j, more])
        # The nearest leaf's places narrow the bound before the other leaves are opened.
        first = np.full(m, np.inf)
        np.minimum.at(first, p, least)
        ahead = least == first[p]
        self._narrow(bound, *self._open(points, p[ahead], node[ahead])[::2], k)
        live = least <= widen(bound)[p]
        i, j, far = self._open(points, p[live], node[live])
        self._narrow(bound, i, far, k)
        live = far <= widen(bound)[i]
        return i[live], j[live]

    def _open(self, points: np.ndarray, p: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, place, squared distance) of the leaves' places; points stay in order."""
        j = self.members[leaf]
        there = j >= 0
        i, j = np.broadcast_to(p[:, None], j.shape)[there], j[there]
        far = np.zeros(len(i))
        for d in range(points.shape[1]):
            far += (self.places[j, d] - points[i, d]) ** 2
        return i, j, far

    @staticmethod
    def _narrow(bound: np.ndarray, i: np.ndarray, far: np.ndarray, k: int) -> None:
        """Lowers each point's bound to its k-th least distance, if there are so many."""
        if k == 1:
            np.minimum.at(bound, i, far)
            return
        order = np.lexsort((far, i))
        start = np.searchsorted(i, np.arange(len(bound)))
        has = np.searchsorted(i, np.arange(len(bound)), "right") - start >= k
        bound[has] = np.minimum(bound[has], far[order][start[has] + k - 1])
