"""Connected components of an edge table: hooking and contraction as joins, then a union-find over what is left."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm._store import cut, drop

#: Edges that the closing union-find may hold in one task (16 bytes each); above, rounds of joins contract them first.
CLOSING = 1 << 20


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node that each reaches) of the edges u[i] - v[i]."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = list(range(len(nodes)))
    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[max(a, b)] = min(a, b)
    top = np.array(root, np.int64)
    while (top != top[top]).any():
        top = top[top]
    return nodes, nodes[top] if len(nodes) else nodes


def _close(edges: pd.DataFrame) -> pd.DataFrame:
    nodes, top = union_find(edges["u"].to_numpy(np.int64), edges["v"].to_numpy(np.int64))
    return pd.DataFrame({"u": nodes, "p": top})


def _jump(hook: DataFrame) -> tuple[DataFrame, int]:
    """hook (u, p: a node that u reaches) with every p a root, and how many times the pointers were doubled."""
    times = 0
    while True:
        up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        if hook.join(up, "p", "left_semi").isEmpty():
            return hook, times
        old = hook
        hook = cut(hook.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p")), "cc-jump")
        drop(old)
        times += 1


def components(edges: DataFrame, closing: int | None = None, rounds: list[int] | None = None) -> DataFrame:
    """(node, component) for every node of edges (u, v): the smallest node that it reaches.

    While there are more than ``closing`` edges, a round hooks each node to its
    smallest neighbour, doubles the pointers until all end at roots, and contracts
    the edges to those that still join different roots.  A root that no node hooks
    to has a smaller neighbour in the next round, so two rounds at least halve the
    roots; a path or a star takes one round.  What is left then fits one task, and
    a union-find closes it.  ``closing`` 0 leaves all to the rounds; the result is
    the same.  Every table is written to the shared folder, so a lost executor
    costs a task and no lineage grows.  ``rounds`` collects the doublings of each
    round.
    """
    closing = CLOSING if closing is None else closing
    left = cut(_ordered(edges), "cc-edges")
    found = None

    def follow(found: DataFrame | None, hook: DataFrame) -> DataFrame:
        """What found points to, moved on by hook; nodes that hook alone knows join."""
        if found is None:
            return hook
        up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        return found.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"))

    n = left.count()
    while n > closing:
        both = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = cut(both.groupBy("u").agg(F.min("v").alias("p")).where("p < u"), "cc-hook")
        hook, times = _jump(hook)
        if rounds is not None:
            rounds.append(times)
        roots = both.select("u").distinct().join(hook, "u", "left").select("u", F.coalesce("p", "u").alias("p"))
        roots = cut(roots, "cc-roots")
        old, found = found, cut(follow(found, roots), "cc-found")
        drop(hook, *([old] if old is not None else []))
        a = roots.select("u", F.col("p").alias("pu"))
        b = roots.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        old, left = left, cut(_ordered(left.join(a, "u").join(b, "v").select(F.col("pu").alias("u"), F.col("pv").alias("v"))), "cc-edges")
        drop(old, roots)
        n = left.count()
    if n or found is None:
        last = left.select(F.lit(0).alias("all"), "u", "v").groupBy("all").applyInPandas(_close, "u long, p long")
        old, found = found, cut(follow(found, last), "cc-found")
        if old is not None:
            drop(old)
    drop(left)
    return found.select(F.col("u").alias("node"), F.col("p").alias("component"))
