"""Why a model predicts what it does: impurity importances and Shapley values of trees."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from strandlake.operators.ml import Trained, tree_paths

log = logging.getLogger("strandlake")


def _parts(model) -> list:
    """A forest itself, or the binary models of one-against-rest."""
    return list(model.models) if hasattr(model, "models") else [model]


def feature_importance(spark: SparkSession, trained: Trained, top_n: int = 10) -> DataFrame:
    """(motif, gain, rank): shares of impurity that splits on a motif remove, averaged over the class models; the first top_n."""
    gain = np.mean([m.featureImportances.toArray() for m in _parts(trained.model)], axis=0)
    order = sorted(range(len(gain)), key=lambda i: (-gain[i], trained.motifs[i]))[:top_n]
    return spark.createDataFrame([(trained.motifs[i], float(gain[i]), r + 1) for r, i in enumerate(order)], "motif string, gain double, rank int")


#: Where a result may name its feature columns, in the order in which they are looked for (fixed values).
FEATURE_FIELDS = ("motifs_used", "selected_motifs", "feature_names", "motif_names")


def feature_columns(result: dict, available: list[str], method: str = "xgb") -> list[str]:
    """The feature columns of a training result: the first of FEATURE_FIELDS that is not empty (lists, or lists by class), else the columns of its train_data but class; those that ``available`` lacks are dropped with a warning."""
    if method != "xgb":
        raise ValueError("feature columns are those of a boosted model")
    names: list[str] = []
    for field in FEATURE_FIELDS:
        held = result.get(field) or []
        names = list(dict.fromkeys(x for v in held.values() for x in v)) if isinstance(held, dict) else list(dict.fromkeys(held))
        if names:
            break
    if not names and result.get("train_data") is not None:
        names = [c for c in result["train_data"].columns if c.lower() != "class"]
    if missing := [x for x in names if x not in set(available)]:
        log.warning("%d feature columns are not there and are dropped: %s", len(missing), ", ".join(missing[:10]))
    names = [x for x in names if x in set(available)]
    if not names:
        raise ValueError("no feature columns")
    return names


def path_shapley(x: np.ndarray, paths, n_features: int) -> np.ndarray:
    """Shapley values (rows by features) of one tree, path by path.

    A path pays its value times the product, over its features, of 1 or 0 (the
    row follows or not) for known features and of the share for unknown ones. The
    weights of all sizes of known sets come from the product's polynomial.
    """
    out = np.zeros((len(x), n_features))
    for features, value in paths:
        d = len(features)
        if not d or not value:
            continue
        follows = np.stack([(x[:, f] > low) & (x[:, f] <= high) for f, low, high, _ in features], 1).astype(np.float64)
        share = np.array([s for *_, s in features])
        weights = [1.0 / d]  # k! (d - 1 - k)! / d!
        for k in range(1, d):
            weights.append(weights[-1] * k / (d - k))
        for i, (f, *_) in enumerate(features):
            poly = np.zeros((len(x), d))
            poly[:, 0] = 1
            for j in range(d):
                if j != i:
                    moved = np.zeros_like(poly)
                    moved[:, 1:] = poly[:, :-1] * follows[:, j, None]
                    poly = poly * share[j] + moved
            out[:, f] += value * (follows[:, i] - share[i]) * (poly @ np.array(weights))
    return out


def _explain(batches: Iterator[pd.DataFrame], models: list, motifs: list[str]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        x = np.stack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, len(motifs)))
        for level, trees in models:
            phi = sum((w * path_shapley(x, paths, len(motifs)) for w, paths in trees), np.zeros((len(x), len(motifs))))
            yield pd.DataFrame({"seq_id": np.repeat(batch["seq_id"].to_numpy(), len(motifs)), "class": level, "motif": motifs * len(batch), "value": x.reshape(-1), "shap": phi.reshape(-1)})


def shap_values(trained: Trained, rows: DataFrame) -> DataFrame:
    """(seq_id, class, motif, value, shap) for (seq_id, features): what each motif's count adds to a class's score, tree by tree.

    Trees go to the tasks as plain paths, rows stay where they are.
    """
    from pyspark.ml.functions import vector_to_array

    models = []
    if hasattr(trained.model, "models"):
        for level, part in zip(trained.levels, trained.model.models):
            models.append((level, [(w, tree_paths(t)) for w, t in zip(part.treeWeights, part.trees)]))
    else:
        trees = trained.model.trees
        for i, level in enumerate(trained.levels):
            models.append((level, [(1.0 / len(trees), tree_paths(t, i)) for t in trees]))
    arrays = rows.select("seq_id", vector_to_array("features").alias("x"))
    return arrays.mapInPandas(partial(_explain, models=models, motifs=trained.motifs), "seq_id long, class string, motif string, value double, shap double")
