"""Clusters of a leaf order under a homogeneity threshold."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass


@dataclass
class Cluster:
    indices: list[int]
    classes: list[str]


def homogeneity(classes: list[str]) -> float:
    return max(Counter(classes).values()) / len(classes) if classes else 0.0


def dominant(classes: list[str]) -> str:
    """The most frequent class; of equal ones the first in order."""
    return min(Counter(classes).items(), key=lambda x: (-x[1], x[0]))[0]


def runs(indices: list[int]) -> list[list[int]]:
    """Contiguous runs of sorted positions; a single position is one run."""
    out: list[list[int]] = []
    for i in indices:
        if out and out[-1][-1] == i - 1:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def is_complete(classes: list[str], totals: Counter) -> bool:
    """Whether all rows of any class are here."""
    return any(n == totals[c] for c, n in Counter(classes).items())


class _Segmenter:
    def __init__(self, labels: list[str], threshold: float, min_size: int) -> None:
        self.labels, self.threshold, self.min_size = labels, threshold, min_size
        self.totals = Counter(labels)
        self.clusters: list[list[int]] = []
        self.free = [True] * len(labels)

    def of(self, indices: list[int]) -> list[str]:
        return [self.labels[i] for i in indices]

    def fits(self, indices: list[int]) -> bool:
        return homogeneity(self.of(indices)) >= self.threshold

    def add(self, indices: list[int]) -> None:
        self.clusters.append(list(indices))
        for i in indices:
            self.free[i] = False

    def grow(self, cluster: list[int], indices: list[int]) -> None:
        cluster.extend(indices)
        for i in indices:
            self.free[i] = False

    def unassigned(self) -> list[int]:
        return [i for i, f in enumerate(self.free) if f]

    def rare_classes(self) -> None:
        for c in sorted(self.totals):
            if self.totals[c] < self.min_size:
                for run in runs([i for i, x in enumerate(self.labels) if x == c]):
                    self.add(run)

    def pure(self) -> None:
        for run in runs(self.unassigned()):
            begin = 0
            for j in range(1, len(run) + 1):
                if j == len(run) or self.labels[run[j]] != self.labels[run[begin]]:
                    if j - begin >= self.min_size:
                        self.add(run[begin:j])
                    begin = j

    def longest_from(self, i: int, stop: int) -> int:
        """The last position up to which the stretch from i stays homogeneous, at its first failure."""
        j = i
        while j + 1 < stop and self.free[j + 1] and self.fits(list(range(i, j + 2))):
            j += 1
        return j

    def expand(self) -> None:
        i, n = 0, len(self.labels)
        while i < n:
            if not self.free[i]:
                i += 1
                continue
            last = self.clusters[-1] if self.clusters else None
            if last and max(last) == i - 1 and self.fits([*last, i]):
                self.grow(last, [i])
                i += 1
                continue
            j = self.longest_from(i, n)
            if j - i + 1 >= self.min_size:
                self.add(list(range(i, j + 1)))
            i = j + 1

    def remaining(self) -> None:
        for run in runs(self.unassigned()):
            host = next((c for c in self.clusters if max(c) == run[0] - 1 and self.fits([*c, *run])), None)
            if host is not None:
                self.grow(host, run)
            elif len(run) >= self.min_size:
                i = run[0]
                while i <= run[-1]:
                    j = self.longest_from(i, run[-1] + 1)
                    if j - i + 1 >= self.min_size:
                        self.add(list(range(i, j + 1)))
                    i = j + 1

    def last_merge(self) -> None:
        for run in runs(self.unassigned()):
            hosts = [c for c in self.clusters if max(c) == run[0] - 1]
            best = max(hosts, key=lambda c: homogeneity(self.of([*c, *run])), default=None)
            if best is not None and self.fits([*best, *run]):
                self.grow(best, run)

    def force(self) -> None:
        rest = self.unassigned()
        for c in sorted(set(self.of(rest))):
            for run in runs([i for i in rest if self.labels[i] == c]):
                self.add(run)

    def may_join(self, a: list[int], b: list[int]) -> bool:
        x, y = self.of(a), self.of(b)
        full_x, full_y = is_complete(x, self.totals), is_complete(y, self.totals)
        if full_x and full_y:
            return dominant(x) == dominant(y)
        if full_x:
            return set(y) == {dominant(x)}
        if full_y:
            return set(x) == {dominant(y)}
        return self.fits([*a, *b])

    def join_neighbours(self, passes: int = 10) -> None:
        for _ in range(passes):
            changed, i = False, 0
            while i + 1 < len(self.clusters):
                a, b = self.clusters[i], self.clusters[i + 1]
                if max(a) + 1 == min(b) and self.may_join(a, b):
                    self.clusters[i : i + 2] = [[*a, *b]]
                    changed = True
                else:
                    i += 1
            if not changed:
                break


def segment(labels: list[str], threshold: float = 0.8, min_size: int = 3) -> list[Cluster]:
    """Clusters of the labels of a leaf order; every position is in one.

    Rare classes and pure runs come first, then runs that stay homogeneous grow
    from what is left, runs next to a cluster join it if it stays homogeneous, the
    rest is forced into pure runs, and neighbours merge while that is allowed.
    Numbered by first position, from 1 in list order.
    """
    s = _Segmenter(list(labels), threshold, min_size)
    for phase in (s.rare_classes, s.pure, s.expand, s.remaining, s.last_merge, s.force, s.join_neighbours):
        phase()
    return [Cluster(sorted(c), s.of(sorted(c))) for c in sorted(s.clusters, key=min)]


def assignment(labels: list[str], threshold: float = 0.8, min_size: int = 3) -> list[int]:
    """The cluster number of each position."""
    out = [0] * len(labels)
    for number, cluster in enumerate(segment(labels, threshold, min_size), 1):
        for i in cluster.indices:
            out[i] = number
    return out
