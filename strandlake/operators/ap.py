"""Affinity propagation (Frey and Dueck, 2007), alone and in two stages over classes."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.operators.distance import between

#: The most rows that one message-passing run may have.
MOST = 5000


def similarities(x: np.ndarray, r: float = 2) -> np.ndarray:
    return -(between(x, x) ** r)


def propagate(s: np.ndarray, damping: float = 0.9, max_steps: int = 500, stable_steps: int = 50, preference: float | None = None) -> np.ndarray:
    """The exemplar of each row. Preferences default to the median similarity of different rows; ties go to the lower row."""
    n = len(s)
    if n > MOST:
        raise ValueError(f"{n} rows; message passing takes {MOST}; sample first")
    if n <= 1:
        return np.arange(n)
    s = np.array(s, np.float64)
    off = ~np.eye(n, dtype=bool)
    np.fill_diagonal(s, np.median(s[off]) if preference is None else preference)
    r, a = np.zeros((n, n)), np.zeros((n, n))
    rows = np.arange(n)
    last, same = None, 0
    for _ in range(max_steps):
        total = a + s
        top = total.argmax(1)
        first = total[rows, top]
        total[rows, top] = -np.inf
        second = total.max(1)
        new = s - first[:, None]
        new[rows, top] = s[rows, top] - second
        r = damping * r + (1 - damping) * new
        support = np.maximum(r, 0)
        support[rows, rows] = r[rows, rows]
        new = support.sum(0)[None, :] - support
        own = new[rows, rows].copy()
        new = np.minimum(new, 0)
        new[rows, rows] = own
        a = damping * a + (1 - damping) * new
        chosen = (a + r)[rows, rows] > 0
        same = same + 1 if last is not None and (chosen == last).all() else 0
        last = chosen
        if same >= stable_steps and chosen.any():
            break
    exemplars = np.flatnonzero(last) if last is not None and last.any() else np.array([int(s.sum(0).argmax())])
    out = exemplars[s[:, exemplars].argmax(1)]
    out[exemplars] = exemplars
    # each cluster's best representative takes over
    for e in exemplars:
        members = np.flatnonzero(out == e)
        out[members] = members[s[np.ix_(members, members)].sum(0).argmax()]
    return out


def _class_stage(group: pd.DataFrame, r: float) -> pd.DataFrame:
    group = group.sort_values("id")
    found = propagate(similarities(np.stack(group["x"].to_numpy()), r))
    ids = group["id"].to_numpy()
    return pd.DataFrame({"id": ids, "class": group["class"].to_numpy(), "exemplar": ids[found]})


def _final_stage(group: pd.DataFrame, r: float) -> pd.DataFrame:
    group = group.sort_values("id")
    found = propagate(similarities(np.stack(group["x"].to_numpy()), r), max_steps=1000, stable_steps=100)
    ids = group["id"].to_numpy()
    heads = ids[found]
    order = {e: i + 1 for i, e in enumerate(sorted(set(heads)))}
    return pd.DataFrame({"id": ids, "cluster": [order[e] for e in heads], "exemplar_id": heads})


def _sample(rows: DataFrame, limit: int, seed: int) -> DataFrame | None:
    """floor(limit / classes) rows of each class by a seeded hash, or None if rows do not exceed limit."""
    sizes = rows.groupBy("class").count().collect()
    if sum(r["count"] for r in sizes) <= limit:
        return None
    order = Window.partitionBy("class").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    return rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max(1, limit // len(sizes))).drop("k")


def _nearest_in_class(batches, points: dict):
    for batch in batches:
        out = []
        for name, x in zip(batch["class"], batch["x"]):
            ids, heads = points[name]
            out.append(ids[between(np.asarray(x, np.float64)[None], heads)[0].argmin()])
        yield pd.DataFrame({"id": batch["id"], "class": batch["class"], "exemplar": np.array(out, np.int64)})


def per_class(rows: DataFrame, r: float = 2, limit: int = MOST, seed: int = 123) -> DataFrame:
    """(id, class, exemplar): affinity propagation inside each class of rows (id, class, x).

    If rows exceed limit, a sample of each class is clustered, and every other
    row joins the nearest exemplar of its class.
    """
    shape = "id long, class string, exemplar long"
    part = _sample(rows, limit, seed)
    if part is None:
        return rows.groupBy("class").applyInPandas(partial(_class_stage, r=r), shape)
    found = rows.sparkSession.createDataFrame(part.groupBy("class").applyInPandas(partial(_class_stage, r=r), shape).toPandas(), shape)  # about limit rows
    points: dict = {}
    for row in part.join(found.select(F.col("exemplar").alias("id")).distinct(), "id", "left_semi").orderBy("id").collect():
        ids, heads = points.setdefault(row["class"], ([], []))
        ids.append(row["id"])
        heads.append(row["x"])
    points = {name: (np.array(ids), np.array(heads, np.float64)) for name, (ids, heads) in points.items()}
    rest = rows.select("id", "class", "x").join(found.select("id"), "id", "left_anti").select("id", "class", "x")
    return found.unionByName(rest.mapInPandas(partial(_nearest_in_class, points=points), shape))


def two_stage(rows: DataFrame, r: float = 2, rest: str = "none", limit: int = MOST) -> DataFrame:
    """(id, class, cluster, exemplar_id, is_selected, is_exemplar) for rows (id, class, x) of a table of any size.

    Exemplars of every class go through a second run together; beyond ``limit``
    of them, as sampled() does, so that each still gets a cluster.  With rest "none",
    rows that are no class's exemplar are not clustered (cluster null); with
    "follow" they go where the exemplar of their class went that per_class() gave
    them.  is_selected tells the rows that took part in the second run.
    """
    if rest not in ("none", "follow"):
        raise ValueError("rest must be 'none' or 'follow'")
    first = per_class(rows, r, limit)
    chosen = rows.join(first.select(F.col("exemplar").alias("id")).distinct(), "id", "left_semi")
    final = sampled(chosen.select("id", "class", "x").cache(), r, limit).select("id", "cluster", "exemplar_id")
    selected = F.col("own").isNotNull().alias("is_selected")
    if rest == "none":
        out = rows.select("id", "class").join(final, "id", "left").withColumn("own", F.col("cluster"))
    else:
        own = final.select("id", F.col("cluster").alias("own"))
        out = first.join(final.withColumnRenamed("id", "exemplar"), "exemplar").join(own, "id", "left")
    return out.select("id", "class", "cluster", "exemplar_id", selected, F.coalesce(F.col("exemplar_id") == F.col("id"), F.lit(False)).alias("is_exemplar"))


def sampled(rows: DataFrame, r: float = 2, limit: int = MOST, seed: int = 123) -> DataFrame:
    """(id, class, cluster, exemplar_id) of all rows of a table of any size.

    If rows exceed limit, floor(limit / classes) of each class, drawn by a seeded
    hash, are clustered, and every other row joins the nearest exemplar.
    """
    from strandlake.operators.distance import nearest_exemplar

    n = rows.count()
    part = rows
    if n > limit:
        each = max(1, limit // max(1, rows.select("class").distinct().count()))
        order = Window.partitionBy("class").orderBy(F.xxhash64("id", F.lit(seed)), "id")
        part = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).drop("k")
    found = part.select(F.lit(0).alias("all"), "id", "x").groupBy("all").applyInPandas(partial(_final_stage, r=r), "id long, cluster int, exemplar_id long")
    found = rows.sparkSession.createDataFrame(found.toPandas(), "id long, cluster int, exemplar_id long")  # limit rows at most
    if n <= limit:
        return rows.select("id", "class").join(found, "id")
    heads = rows.join(F.broadcast(found.where("id = exemplar_id")), "id").select("id", "x", "cluster")
    points = [(row["id"], list(row["x"])) for row in heads.collect()]
    rest = nearest_exemplar(rows.join(F.broadcast(found.select("id")), "id", "left_anti"), points).select("id", F.col("exemplar").alias("exemplar_id"))
    numbers = found.select("exemplar_id", "cluster").distinct()
    joined = found.select("id", "cluster", "exemplar_id").unionByName(rest.join(F.broadcast(numbers), "exemplar_id").select("id", "cluster", "exemplar_id"))
    return rows.select("id", "class").join(joined, "id")
