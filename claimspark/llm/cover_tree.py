"""Cover trees over vectors and the dual-tree search for largest inner products."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Node:
    """A ball: a centre, a covering radius, and children or points in it."""

    centre: np.ndarray
    radius: float
    points: np.ndarray  # places in the tree's matrix
    children: list["Node"] = field(default_factory=list)


#: Points that are not split further, and points whose distances are taken together.
LEAF, BLOCK = 64, 256


class CoverTree:
    """Nested balls: the centres of a node's children are apart by more than half its covering radius.

    A centre that covers no other point would be a child of a single point; these are kept
    together as one leaf, which is bounded and compared as one matrix.
    """

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        self.root = self._node(np.arange(len(rows)), rows.mean(0) if len(rows) else np.zeros(rows.shape[1]))

    def _node(self, points: np.ndarray, centre: np.ndarray, split: bool = True) -> Node:
        distances = np.linalg.norm(self.rows[points] - centre, axis=1)
        node = Node(centre, float(distances.max(initial=0.0)), points)
        if split and len(points) > LEAF and node.radius:
            balls, single = self._net(points, node.radius / 2)
            if balls:
                node.children = [self._node(own, centre) for own, centre in balls]
                if len(single):
                    node.children.append(self._node(single, self.rows[single].mean(0), split=False))
        return node

    def _net(self, points: np.ndarray, gap: float) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Balls of radius ``gap`` around points that none of the others covers, and the points that are alone in theirs.

        Greedy: the first point that no centre covers becomes one. Distances are taken for a
        block of points at a time.
        """
        balls, single, left = [], [], points
        while len(left):
            block, rest = left[:BLOCK], left[BLOCK:]
            near = self._near(block, block, gap)
            centres, free = [], np.ones(len(block), bool)
            owner = np.full(len(block), -1)
            for place in range(len(block)):
                if free[place]:
                    own = near[place] & free
                    own[place] = True
                    owner[own], free[own] = len(centres), False
                    centres.append(block[place])
            own = self._near(np.array(centres), rest, gap)
            covered = own.any(0)
            first = own.argmax(0)
            for n, centre in enumerate(centres):
                held = np.concatenate([block[owner == n], rest[covered & (first == n)]])
                if len(held) > 1:
                    balls.append((held, self.rows[centre]))
                else:
                    single.append(centre)
            left = rest[~covered]
        return balls, np.array(single, np.int64)

    def _near(self, some: np.ndarray, others: np.ndarray, gap: float) -> np.ndarray:
        a, b = self.rows[some], self.rows[others]
        squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
        return squares <= gap * gap


class TopK:
    """The best scores of each query so far; equal scores prefer the smaller id."""

    def __init__(self, queries: int, k: int, least: np.ndarray) -> None:
        self.k, self.least = k, least.copy()
        self.compared = 0  # pairs whose score was taken
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` (queries, candidates); -inf where a candidate is not to be taken."""
        some = min(scores.shape[1], 4 * self.k)
        if some < scores.shape[1]:  # the k-th largest and all that equal it
            cut = np.partition(scores, -self.k, axis=1)[:, -self.k]
            worst = np.maximum(cut, self.scores[queries, -1])
            rows, columns = np.nonzero((scores >= worst[:, None]) & (scores > -np.inf))
        else:
            rows, columns = np.nonzero(scores > -np.inf)
        if not len(rows):
            return
        touched, place = np.unique(rows, return_inverse=True)
        own = queries[touched]
        number = np.concatenate([np.repeat(np.arange(len(own)), self.k), place])
        value = np.concatenate([self.scores[own].ravel(), scores[rows, columns]])
        name = np.concatenate([self.ids[own].ravel(), ids[columns]])
        order = np.lexsort((name, -value, number))
        number = number[order]
        rank = np.arange(len(number)) - np.searchsorted(number, number)
        best = order[rank < self.k]
        self.scores[own] = value[best].reshape(-1, self.k)
        self.ids[own] = name[best].reshape(-1, self.k)
        self.least[own] = np.maximum(self.least[own], self.scores[own, -1])


def search(queries: CoverTree, query_ids: np.ndarray, candidates: CoverTree, ids: np.ndarray, k: int, least: np.ndarray) -> TopK:
    """The ``k`` largest inner products of each query, dual-tree.

    A pair of balls is left out where the largest inner product that it can hold, <q, c>
    plus what the covering radii allow, is below the worst k-th score of the query
    ball's points. ``least`` are lower bounds of the k-th scores that are known before.
    Candidates with a query's own id are passed over. Scores must be whole numbers
    that doubles hold.
    """
    best = TopK(len(query_ids), k, least)

    def bounds(node: Node, others: list[Node]) -> np.ndarray:
        centres = np.array([o.centre for o in others])
        radii = np.array([o.radius for o in others])
        # |<q, c> - <q0, c0>| <= |q0| rc + |c0| rq + rq rc, and a little for rounding
        inner = centres @ node.centre
        slack = np.linalg.norm(node.centre) * radii + (np.linalg.norm(centres, axis=1) + radii) * node.radius
        return inner + slack + 1e-9 * (np.abs(inner) + slack) + 1e-6

    def visit(node: Node, other: Node) -> None:
        if node.children and (not other.children or node.radius >= other.radius):
            for child in node.children:
                if bounds(child, [other])[0] >= best.least[child.points].min():
                    visit(child, other)
        elif other.children:
            limit = bounds(node, other.children)
            for place in np.argsort(-limit):
                if limit[place] >= best.least[node.points].min():
                    visit(node, other.children[place])
        else:
            scores = queries.rows[node.points] @ candidates.rows[other.points].T
            best.compared += scores.size
            own = query_ids[node.points][:, None] == ids[other.points][None, :]
            scores[own | (scores < best.least[node.points][:, None])] = -np.inf
            best.add(node.points, scores, ids[other.points])

    if len(query_ids) and len(ids) and bounds(queries.root, [candidates.root])[0] >= best.least.min():
        visit(queries.root, candidates.root)
    return best
