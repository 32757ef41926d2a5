"""Agglomerative clustering of a few thousand points: linkage tables, leaf order and cuts, in numpy."""

from __future__ import annotations

import numpy as np


def distances(x: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    if metric == "correlation":
        c = x - x.mean(1, keepdims=True)
        norm = np.linalg.norm(c, axis=1)
        c = c / np.where(norm > 0, norm, 1)[:, None]
        return np.maximum(1 - c @ c.T, 0)
    g = (x * x).sum(1)
    return np.sqrt(np.maximum(g[:, None] + g[None] - 2 * x @ x.T, 0))


def merges(d: np.ndarray, method: str = "average", size: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Pairs of rows (x, y, height) by nearest-neighbour chains, in an order in which parts come before wholes.

    After a merge either row number names the new cluster. size has the points of each row, one by default.
    """
    n = len(d)
    d = np.array(d, dtype=float)
    if not np.isfinite(d).all():
        raise ValueError("distances must be finite")
    np.fill_diagonal(d, np.inf)
    size = np.ones(n) if size is None else np.array(size, dtype=float)
    alive = np.ones(n, dtype=bool)
    chain: list[int] = []
    merges = []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            x = chain[-1]
            row = np.where(alive, d[x], np.inf)
            y = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[y]:
                y = chain[-2]
                break
            chain.append(y)
        del chain[-2:]
        h = d[x, y]
        a, b = size[x], size[y]
        if method == "ward":
            s = size
            new = np.sqrt(np.maximum(((a + s) * d[x] ** 2 + (b + s) * d[y] ** 2 - s * h**2) / (a + b + s), 0))
        else:
            new = (a * d[x] + b * d[y]) / (a + b)
        merges.append((x, y, float(h)))
        d[y], d[:, y] = new, new
        d[y, y] = np.inf
        alive[x] = False
        size[y] = a + b
    return merges


def linkage(d: np.ndarray, method: str = "average") -> np.ndarray:
    """Rows (left, right, height, size) of a small distance matrix; clusters are numbered as they are made.

    ``ward`` takes Euclidean distances, ``average`` any; a distance that is not finite is an error.
    """
    n = len(d)
    pairs = sorted(merges(d, method), key=lambda m: m[2])
    name, count = list(range(n)), [1] * n
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for k, (x, y, h) in enumerate(pairs):
        i, j = top(x), top(y)
        a, b = sorted((name[i], name[j]))
        out.append((a, b, h, count[i] + count[j]))
        up[i] = j
        name[j], count[j] = n + k, count[i] + count[j]
    return np.array(out).reshape(-1, 4)


def leaves(z: np.ndarray) -> list[int]:
    """Order of the leaves, left before right."""
    n = len(z) + 1
    out, stack = [], [2 * n - 2]
    while stack:
        i = int(stack.pop())
        if i < n:
            out.append(i)
        else:
            stack += [z[i - n, 1], z[i - n, 0]]
    return out


def cut(z: np.ndarray, k: int) -> np.ndarray:
    """Labels 0.. of at most k clusters, numbered by their first leaf."""
    n = len(z) + 1
    group: dict[int, list[int]] = {i: [i] for i in range(n)}
    for step in range(max(0, n - k)):
        a, b = int(z[step, 0]), int(z[step, 1])
        group[n + step] = group.pop(a) + group.pop(b)
    labels = np.zeros(n, dtype=int)
    for label, members in enumerate(sorted(group.values(), key=min)):
        labels[members] = label
    return labels
