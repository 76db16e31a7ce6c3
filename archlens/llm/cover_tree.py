"""Cover trees over norm-augmented vectors, and exact best-first search by inner product.

A vector x gets one more component, sqrt(M^2 - |x|^2), with M the largest norm,
so that all have norm M and the inner product with a query falls as the
distance to it grows. Each node covers its points within a radius of its
centre; the radius bounds every inner product below the node.
"""
from __future__ import annotations

import heapq

import numpy as np

BASE = 1.3        # a level's covering radius to the next one's
LEAF = 128        # points that are not divided further
FAN = 128         # centres below a node
SLACK = 1e-9      # of the bounds, for rounding


class CoverTree:
    """Rows of ``points`` ordered so that every node's points lie together, and the nodes over them.

    ``order`` maps places to given rows. Node k covers places low[k] to high[k], the first
    of which is its centre, within ``radius[k]``. Its places up to loose[k] lie in no child
    (all of a leaf's); the rest are those of its children first[k] to last[k]. Children's
    centres are further apart than the level's radius. Groups of ``LEAF`` points or fewer, and
    points that the first ``FAN`` centres do not cover, stay loose.
    """

    def __init__(self, points: np.ndarray):
        n = len(points)
        norms = np.einsum("ij,ij->i", points, points)
        self.top = float(norms.max()) if n else 0.0
        lifted = np.concatenate([points, np.sqrt(np.maximum(self.top - norms, 0))[:, None]], axis=1)
        order = np.arange(n)
        nodes = [[0, n, 0.0, n, 0, 0]]  # low, high, radius, end of the loose places, first and last child

        def reach(low: int, high: int) -> np.ndarray:
            """Distances to the centre, from differences, so that equal points are at zero."""
            away = lifted[order[low:high]] - lifted[order[low]]
            return np.sqrt(np.einsum("ij,ij->i", away, away))

        levels = [(0, reach(0, n).max() if n else 0.0)]
        while levels:
            node, covered = levels.pop()
            low, high = nodes[node][:2]
            nodes[node][2] = float(reach(low, high).max()) if high > low else 0.0
            if high - low <= LEAF or not 0 < nodes[node][2] < np.inf:
                continue
            within = min(covered, nodes[node][2]) / BASE
            groups, loose, rest = [], [order[low:low + 1]], order[low:high]
            while len(rest) and len(groups) + len(loose) <= FAN:  # the node's own centre comes first
                away = lifted[rest] - lifted[rest[0]]
                near = np.einsum("ij,ij->i", away, away) <= within * within
                mine = rest[near]
                if not groups and len(loose) == 1:
                    mine = mine[1:]
                (groups if len(mine) > LEAF else loose).append(mine)
                rest = rest[~near]
            inside = np.concatenate([*loose, rest])
            order[low:high] = np.concatenate([inside, *groups])
            at = low + len(inside)
            nodes[node][3:] = [at, len(nodes), len(nodes) + len(groups)]
            for group in groups:
                levels.append((len(nodes), within))
                nodes.append([at, at + len(group), 0.0, at + len(group), 0, 0])
                at += len(group)
        table = np.array(nodes, dtype=np.float64)
        self.low, self.high, self.loose, self.first, self.last = (table[:, c].astype(np.int64) for c in (0, 1, 3, 4, 5))
        self.radius = table[:, 2]
        self.order, self.points = order, np.ascontiguousarray(points[order])


class Search:
    """One query against a tree; what it computes serves all its windows."""

    def __init__(self, tree: CoverTree, query: np.ndarray):
        self.tree, self.query = tree, query
        self.square = float(query @ query)
        self._opened: dict[int, tuple] = {}

    def _bounds(self, score: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) inner product below nodes whose centre has ``score``."""
        away = np.sqrt(np.maximum(self.tree.top + self.square - 2 * score, 0))
        plain = np.sqrt(self.square) * radius
        most = np.minimum(score + plain, score + (np.where(radius < away, radius * (2 * away - radius), away * away) / 2))
        least = np.maximum(score - plain, score - radius * (2 * away + radius) / 2)
        slack = SLACK * (np.abs(score) + plain + self.tree.top + self.square)
        return least - slack, most + slack

    def _open(self, node: int) -> tuple:
        """Scores of a node's loose places, its children and their bounds."""
        if node not in self._opened:
            tree = self.tree
            kids = np.arange(tree.first[node], tree.last[node])
            inside = tree.points[tree.low[node]:tree.loose[node]] @ self.query
            least, most = self._bounds(tree.points[tree.low[kids]] @ self.query, tree.radius[kids])
            self._opened[node] = (np.arange(tree.low[node], tree.loose[node]), inside, kids, least, most)
        return self._opened[node]

    def best(self, count: int, allowed: np.ndarray, rank: np.ndarray, low: float = -np.inf,
             high: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the ``count`` best ``allowed`` places with scores from ``low`` to ``high``.

        Higher scores come first, ties by ``rank`` of the place. Nodes whose bounds miss the
        window are skipped; the others open in order of the best score they may hold.
        """
        places, scores = np.zeros(0, dtype=np.int64), np.zeros(0)

        def offer(at: np.ndarray, score: np.ndarray) -> None:
            nonlocal places, scores
            fits = (score >= low) & (score <= high) & allowed[at]
            if len(scores) == count:
                fits &= score >= scores[-1]
            if fits.any():
                at, score = np.concatenate([places, at[fits]]), np.concatenate([scores, score[fits]])
                kept = np.lexsort((rank[at], -score))[:count]
                places, scores = at[kept], score[kept]

        waiting = [(-np.inf, 0)]
        while waiting:
            most, node = heapq.heappop(waiting)
            if len(scores) == count and -most < scores[-1]:
                break
            at, score, kids, least, upper = self._open(node)
            offer(at, score)
            floor = max(low, scores[-1]) if len(scores) == count else low
            for k in np.flatnonzero((least <= high) & (upper >= floor)):
                heapq.heappush(waiting, (-min(upper[k], high), int(kids[k])))
        return places, scores
