"""What many pairs connect, told in few links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def groups(near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of each connected part of a boolean matrix (rows and columns are the two sides of a graph)."""
    todo = near.any(axis=1)
    for start in range(len(near)):
        if not todo[start]:
            continue
        rows, cols = np.zeros(near.shape[0], dtype=bool), np.zeros(near.shape[1], dtype=bool)
        front = np.array([start])
        rows[start] = True
        while len(front):
            new_cols = np.flatnonzero(near[front].any(axis=0) & ~cols)
            cols[new_cols] = True
            new_rows = near[:, new_cols].any(axis=1) & ~rows
            rows |= new_rows
            front = np.flatnonzero(new_rows)
        todo &= ~rows
        yield np.flatnonzero(rows), np.flatnonzero(cols)


class Forest:
    """Disjoint sets of node numbers; each set's root is its smallest node."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] = up.setdefault(up[y], up[y])
        return x

    def join(self, nodes: list[int]) -> None:
        """All of ``nodes`` belong to one set."""
        first = min(roots := {self.root(x) for x in nodes})
        for r in roots:
            self.up[r] = first

    def links(self) -> list[tuple[int, int]]:
        """``(node, root)`` for each node that is not a root."""
        return [(x, r) for x in self.up if (r := self.root(x)) != x]
