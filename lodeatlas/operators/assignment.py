"""Maximum-weight bipartite matching for small, bounded sides."""

from __future__ import annotations

import numpy as np


def best_assignment(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the matching with the largest total weight; only positive weights are used.

    Successive shortest augmenting paths with potentials, O(n^2 m).
    """
    rows, cols = weight.shape
    size = max(rows, cols)
    cost = np.zeros((size + 1, size + 1))
    cost[1 : rows + 1, 1 : cols + 1] = -np.maximum(weight, 0)
    u, v, match = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, int)
    for row in range(1, size + 1):
        match[0], free = row, 0
        reach, back, done = np.full(size + 1, np.inf), np.zeros(size + 1, int), np.zeros(size + 1, bool)
        while match[free]:
            done[free] = True
            slack = cost[match[free]] - u[match[free]] - v
            better = ~done & (slack < reach)
            better[0] = False
            reach[better], back[better] = slack[better], free
            open_ = np.where(done, np.inf, reach)
            open_[0] = np.inf
            nxt = int(open_.argmin())
            step = open_[nxt]
            u[match[done]] += step
            v[done] -= step
            reach[~done] -= step
            free = nxt
        while free:
            match[free] = match[back[free]]
            free = back[free]
    pairs = ((int(match[c]) - 1, c - 1) for c in range(1, cols + 1))
    return [(r, c) for r, c in pairs if 0 <= r < rows and weight[r, c] > 0]
