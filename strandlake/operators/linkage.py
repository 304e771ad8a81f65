"""Agglomerative clustering of a bounded distance matrix, and the order of leaves."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

METHODS = ("ward.D2", "complete", "average", "single")
#: The most rows that a distance matrix may have.
MOST = 5000


def merges(distance: np.ndarray, method: str = "ward.D2") -> list[tuple[int, int, float, int]]:
    """(left, right, height, size) of each merge by rising height: rows are -1 to -n, the cluster of the i-th merge is i.

    Follows chains of nearest neighbours, which these linkages allow in any order,
    and updates distances by the Lance-Williams formula.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    n = len(distance)
    if n > MOST:
        raise ValueError(f"{n} rows; a distance matrix may have {MOST}; sample first")
    d = np.array(distance, np.float64)
    if method == "ward.D2":
        d *= d
    np.fill_diagonal(d, np.inf)
    size = np.ones(n)
    found: list[tuple[float, int, int]] = []
    chain: list[int] = []
    alive = np.ones(n, bool)
    while len(found) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            b = int(d[a].argmin())
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        del chain[-2:]
        a, b = min(a, b), max(a, b)
        gap = d[a, b]
        found.append((float(gap), a, b))
        if method == "ward.D2":
            new = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * gap) / (size[a] + size[b] + size)
        elif method == "average":
            new = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        else:
            new = np.maximum(d[a], d[b]) if method == "complete" else np.minimum(d[a], d[b])
        alive[b] = False
        new[~alive] = np.inf
        new[a] = np.inf
        d[a], d[:, a] = new, new
        d[b], d[:, b] = np.inf, np.inf
        size[a] += size[b]
    name, count = list(range(n)), [1] * n  # by lowest row of a cluster
    label = {i: -(i + 1) for i in range(n)}
    out = []
    for step, (gap, a, b) in enumerate(sorted(found, key=lambda f: f[0]), 1):
        a, b = _root(name, a), _root(name, b)
        left, right = _sides(label[a], label[b])
        a, b = min(a, b), max(a, b)
        name[b] = a
        count[a] += count[b]
        label[a] = step
        out.append((left, right, float(np.sqrt(gap)) if method == "ward.D2" else gap, count[a]))
    return out


def _root(name: list[int], i: int) -> int:
    while name[i] != i:
        name[i] = name[name[i]]
        i = name[i]
    return i


def _sides(a: int, b: int) -> tuple[int, int]:
    """A row stands left of a cluster, the earlier cluster left of the later, of two rows the lower one left."""
    if a < 0 and b < 0:
        return max(a, b), min(a, b)
    return min(a, b), max(a, b)


def leaf_order(steps: list[tuple[int, int, float, int]], n: int) -> list[int]:
    """Rows (from 0) from left to right."""
    if n <= 1:
        return list(range(n))
    out, stack = [], [len(steps)]
    while stack:
        i = stack.pop()
        if i < 0:
            out.append(-i - 1)
        else:
            stack += [steps[i - 1][1], steps[i - 1][0]]
    return out


@dataclass
class Dendrogram:
    """Merges, leaf order, labels in leaf order and a colour per class."""

    merges: list
    order: list[int]
    labels: list[str]
    names: list[str]
    colors: dict[str, str] = field(default_factory=dict)


def colors(classes: list[str]) -> dict[str, str]:
    """Evenly spaced hues."""
    import colorsys

    names = sorted(set(classes))
    rgb = [colorsys.hsv_to_rgb(i / max(1, len(names)), 0.65, 0.85) for i in range(len(names))]
    return {c: "#" + "".join(f"{round(255 * v):02x}" for v in x) for c, x in zip(names, rgb)}


def dendrogram(x: np.ndarray, classes: list[str], names: list[str] | None = None, metric: str = "euclidean", method: str = "ward.D2") -> Dendrogram:
    from strandlake.operators.distance import between

    steps = merges(between(np.asarray(x, np.float64), np.asarray(x, np.float64), metric), method)
    order = leaf_order(steps, len(x))
    return Dendrogram(steps, order, [classes[i] for i in order], [(names or [str(i) for i in range(len(x))])[i] for i in order], colors(classes))
