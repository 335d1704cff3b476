"""The best of every question, kept by tasks that score many questions at once."""

from __future__ import annotations

import numpy as np

#: Scores held together in a task.
CELLS = 1 << 19
#: No score.
NONE = -np.inf


def leading(scores: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the ``k`` best rows of every column of scores, and of all that tie with the last of them
    until the ids decide."""
    n = min(k, len(scores)) - 1
    edge = -np.partition(-scores, n, axis=0)[n]
    i, j = np.nonzero((scores >= edge) & (scores > NONE))
    return queries[j], ids[i], scores[i, j]


def best_of(parts: list[tuple[np.ndarray, ...]], k: int) -> list[tuple[np.ndarray, ...]]:
    """The ``k`` best (query, id, score) of every query among all parts, ties by id."""
    if not parts:
        return []
    q, c, s = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return [(q[keep], c[keep], s[keep])]


class Best:
    """What a task keeps: ``k`` of every question, and on the way no more than ``CELLS``, or twice what it keeps.

    What is under the last of a question's ``k`` so far is let go at once.
    """

    def __init__(self, k: int):
        self.k, self.parts, self.held, self.most = k, [], 0, 0
        self.asked, self.floor = np.zeros(0, np.int64), np.zeros(0)

    def add(self, scores: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> None:
        if not scores.size:
            return
        q, c, s = leading(scores, ids, queries, self.k)
        if len(self.asked):
            at = np.minimum(np.searchsorted(self.asked, q), len(self.asked) - 1)
            keep = (self.asked[at] != q) | (s >= self.floor[at])
            q, c, s = q[keep], c[keep], s[keep]
        self.parts.append((q, c, s))
        self.held += len(q)
        if self.held > max(CELLS, self.most):
            self.parts = best_of(self.parts, self.k)
            q, _, s = self.parts[0]
            self.held, self.most = len(q), 2 * len(q)
            # A question's rows stand together, best first.
            last = np.append(q[1:] != q[:-1], True)
            self.asked = q[last]
            full = np.diff(np.flatnonzero(np.append(True, last))) >= self.k
            self.floor = np.where(full, s[last], NONE)

    def rows(self) -> list[tuple[np.ndarray, ...]]:
        return best_of(self.parts, self.k)
