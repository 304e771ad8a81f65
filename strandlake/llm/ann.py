"""Approximate nearest neighbours by query-aware collision counting."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm._store import cut, pick

#: Projections, and the share of them in which a vector must fall into the query's window to be verified.
PROJECTIONS, SHARE = 128, 0.875
#: Widening of the windows from round to round: while the best vectors have less than half the collisions wanted, and after.
FAR, NEAR = 2.0, 1.15
#: Entries on either side of a query that its first windows span, about.
FIRST = 64
#: Rows of an index block; the most queries, and bytes of their vectors, that are sent to all blocks at once.
BLOCK, QUERY_BLOCK, QUERY_BYTES = 1 << 13, 1 << 14, 16 << 20
#: Queries that a task counts collisions for at the same time.
_TOGETHER = 64
SEED = 11


def lines(dim: int, m: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    """m directions (columns), in orthogonal bases turned at random and scaled so that a unit vector's projections have mean square 1.

    Over one basis the squares of a vector's projections add up to its squared
    length, so collision counts tell distances apart better than with independent
    directions.
    """
    rng = np.random.default_rng([seed, dim])
    width = min(m, dim)
    bases = [np.linalg.qr(rng.standard_normal((dim, width)))[0] for _ in range(-(-m // width))]
    return np.concatenate(bases, axis=1)[:, :m] * math.sqrt(dim)


def stop_width(m: int = PROJECTIONS, share: float = SHARE, sure: float = 0.5) -> float:
    """Half window width, in units of a distance d, at which a vector at distance d collides in share * m projections but for ``sure`` standard deviations.

    A projection moves such a vector by d times a number that is normal, about, so
    it collides with probability erf(t / sqrt 2) at half width t * d.
    """
    low, high = 0.0, 10.0
    for _ in range(60):
        t = (low + high) / 2
        p = math.erf(t / math.sqrt(2))
        low, high = (t, high) if m * p - sure * math.sqrt(m * p * (1 - p)) < share * m else (low, t)
    return high


class Index:
    """Sorted arrays of one projection each, over one block of vectors of equal length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, sorted_: np.ndarray, order: np.ndarray) -> None:
        self.ids, self.x, self.sorted, self.order = ids, x, sorted_, order
        self.lines = lines(x.shape[1], len(sorted_))

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray, m: int = PROJECTIONS) -> "Index":
        at = np.ascontiguousarray((x @ lines(x.shape[1], m)).T)
        order = np.argsort(at, axis=1, kind="stable")
        return cls(ids, x, np.take_along_axis(at, order, axis=1), order.astype(np.int32))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each query (places, distances, vectors verified) of the k nearest found, ties to the smaller id; rows whose id is the query's own take no part.

        Windows around a query's projections widen round by round (virtual
        rehashing) and count collisions of the entries that they newly cover.
        Vectors that reach the threshold are verified with their true distance.
        Once k are found, the windows grow to the width at which any vector nearer
        than the k-th would have reached the threshold, and the search ends there,
        or when the windows cover all.
        """
        out = []
        for i in range(0, len(queries), _TOGETHER):
            out += self._search(queries[i : i + _TOGETHER], own[i : i + _TOGETHER], k)
        return out

    def _search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
        n, m = len(self.ids), len(self.sorted)
        at = queries @ self.lines
        need, stop = math.ceil(SHARE * m), stop_width(m)
        hits = np.zeros((len(queries), n), np.int64)
        distance = np.full((len(queries), n), np.inf)
        done = self.ids[None, :] == own[:, None]
        skipped = done.sum(axis=1)
        left = np.stack([line.searchsorted(at[:, j]) for j, line in enumerate(self.sorted)], axis=1)
        right = left.copy()
        width = self._first_widths(at)
        flat, base = self.order.reshape(-1), np.arange(m) * n
        active = np.arange(len(queries))
        while len(active):
            low, high = at[active] - width[active, None], at[active] + width[active, None]
            a = np.stack([line.searchsorted(low[:, j], "left") for j, line in enumerate(self.sorted)], axis=1)
            b = np.stack([line.searchsorted(high[:, j], "right") for j, line in enumerate(self.sorted)], axis=1)
            a, b = np.minimum(a, left[active]), np.maximum(b, right[active])
            going = []
            for r, i in enumerate(active):
                begins = np.concatenate([base + a[r], base + right[i]]).tolist()
                ends = np.concatenate([base + left[i], base + b[r]]).tolist()
                hits[i] += np.bincount(np.concatenate([flat[s:e] for s, e in zip(begins, ends)]), minlength=n)
                new = np.flatnonzero((hits[i] >= need) & ~done[i])
                self._verify(distance, done, i, new, queries[i])
                if not a[r].any() and (b[r] == n).all():
                    self._verify(distance, done, i, np.flatnonzero(~done[i]), queries[i])
                    continue
                if done[i].sum() - skipped[i] >= k:
                    far = stop * np.partition(distance[i], k - 1)[k - 1]
                    if width[i] >= far:
                        continue
                    width[i] = far
                else:
                    best = np.partition(hits[i], max(0, n - k))[max(0, n - k)]
                    width[i] *= FAR if 2 * best < need else NEAR
                going.append(i)
            left[active], right[active] = a, b
            active = np.array(going, np.int64)
        out = []
        for i in range(len(queries)):
            found = np.flatnonzero(np.isfinite(distance[i]))
            best = found[np.lexsort((self.ids[found], distance[i][found]))][:k]
            out.append((best, distance[i][best], len(found)))
        return out

    def _verify(self, distance: np.ndarray, done: np.ndarray, i: int, rows: np.ndarray, query: np.ndarray) -> None:
        if len(rows):
            distance[i, rows] = np.sqrt(((self.x[rows] - query) ** 2).sum(axis=1))
            done[i, rows] = True

    def _first_widths(self, at: np.ndarray) -> np.ndarray:
        """Half the widths that a few dozen entries of a projection span around each query, and more than 0."""
        n, spans = len(self.ids), []
        for j in range(0, len(self.sorted), 8):
            i = self.sorted[j].searchsorted(at[:, j])
            spans.append(self.sorted[j][np.minimum(n - 1, i + FIRST)] - self.sorted[j][np.maximum(0, i - FIRST)])
        return np.maximum(np.median(spans, axis=0) / 2, max(1e-6 * float(np.abs(self.sorted).max()), 1e-300))


_INDEX = "dim int, ids binary, row binary, x binary, at binary, place binary"
_FOUND = "query_id long, row long, vec_id long, score double"


def _build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One index row for each length of the vectors of a partition, which holds one block."""
    parts = list(batches)
    rows = pd.concat(parts) if parts else pd.DataFrame({"dim": []})
    for dim, group in rows.groupby("dim"):
        index = Index.of(group["vec_id"].to_numpy(np.int64), np.stack(group["embedding"].to_numpy()).astype(np.float64))
        held = [index.ids, group["row"].to_numpy(np.int64), index.x, index.sorted, index.order]
        yield pd.DataFrame([[int(dim), *[np.ascontiguousarray(a).tobytes() for a in held]]], columns=[c.split(" ")[0] for c in _INDEX.split(", ")])


def _search_blocks(batches: Iterator[pa.RecordBatch], queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of each index block for each query (ids and vectors by length)."""
    for batch in batches:
        for i in range(batch.num_rows):
            dim, *held = (c[i] for c in batch.columns)
            ids, rows, x, at, order = (np.frombuffer(c.as_buffer(), t) for c, t in zip(held, (np.int64, np.int64, np.float64, np.float64, np.int32)))
            n, dim = len(ids), dim.as_py()
            if dim not in queries:
                continue
            own, asked = queries[dim]
            found = Index(ids, x.reshape(n, dim), at.reshape(-1, n), order.reshape(-1, n)).search(asked, own, k)
            places = np.concatenate([p for p, *_ in found])
            columns = [np.repeat(own, [len(p) for p, *_ in found]), rows[places], ids[places], np.concatenate([d for _, d, _ in found])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split(" ")[0] for c in _FOUND.split(", ")])


def search(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The k nearest found, by Euclidean distance, for each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score.

    Rows are dealt once into blocks of about BLOCK, whose sorted projections are
    written to the shared folder.  Queries are sent to the blocks QUERY_BLOCK
    (and QUERY_BYTES) at a time; a block counts their collisions where its rows
    lie, so collisions are never shuffled, and returns k rows a query, which are
    ranked over all blocks.

    Vectors that are null, empty, zero or hold a null or non-finite component
    take no part, nor do rows with a null vec_id. Only vectors of equal length
    are compared. A query's own vec_id is no candidate, however often it occurs;
    other repeated rows count once each. Repeated rows of a query ask once. Where
    a query's vec_id has several vectors, all of them ask, and a row's score is its
    distance to the nearest of them. Extra columns are ignored. An empty table, or
    one without queries, gives no rows.
    """
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = pick(vectors, "vec_id", "embedding").select("vec_id", x.cast("array<double>").alias("embedding")).where(fine & F.col("vec_id").isNotNull())
    rows = cut(rows.withColumn("dim", F.size("embedding")), "vectors")
    asked = cut(rows.where(F.pmod("vec_id", F.lit(every)) == 0).distinct(), "queries")
    n, size = rows.count(), asked.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    blocks = max(1, math.ceil(n / BLOCK))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    dealt = numbered.repartitionById(blocks, F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    index = cut(dealt.mapInPandas(_build, _INDEX), "index")
    # queries of one vec_id go together, so that each part ranks them for good
    parts = max(1, math.ceil(size[0] / max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * size[1])))))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
    answers = []
    for part in range(parts):
        held = {int(dim): (g["vec_id"].to_numpy(np.int64), np.stack(g["embedding"].to_numpy()).astype(np.float64)) for dim, g in asked.where(F.col("part") == part).toPandas().groupby("dim")}
        found = index.mapInArrow(partial(_search_blocks, queries=held, k=k), _FOUND)
        # a row that several vectors of a query found counts once
        found = found.groupBy("query_id", "row", "vec_id").agg(F.min("score").alias("score"))
        best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id", "row"))).where(F.col("rank") <= k)
        best = best.select("query_id", "rank", "vec_id", "score")
        answers.append(best if parts == 1 else cut(best, "answers"))
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of every row for the rows whose vec_id is divisible by 100, over all embeddings."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=100, k=10)
