"""Training and evaluation of tree ensembles on motif counts."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators import metrics

log = logging.getLogger("strandlake")

#: Settings of the boosted trees (fixed values).
BOOST = {"maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
ROUNDS = 100


@dataclass
class Trained:
    """A model, its measures on the test rows, and what it was trained on."""

    method: str
    model: object
    motifs: list[str]
    levels: list[str]
    predictions: DataFrame
    confusion: DataFrame
    accuracy: float | None
    kappa: float | None
    interval: tuple[float, float] | None
    cv: dict = field(default_factory=dict)
    seconds: float = 0.0


def motif_features(counts: DataFrame, vocabulary: list[str], motifs: list[str]) -> tuple[DataFrame, list[str]]:
    """(seq_id, class, features): the counts of the chosen motifs, by their places in the dense array. Motifs that the vocabulary lacks are dropped with a warning; none left is an error."""
    at = {k: i for i, k in enumerate(vocabulary)}
    unique = list(dict.fromkeys(motifs))
    used = [m for m in unique if m in at]
    if len(used) < len(unique):
        log.warning("%d motifs are not among the k-mers and are dropped", len(unique) - len(used))
    if not used:
        raise ValueError("none of the selected motifs is among the k-mers")
    places = F.array(*[F.lit(at[m]) for m in used])
    picked = F.transform(places, lambda i: F.get(F.col("counts"), i).cast("double"))
    return counts.select("seq_id", "class", array_to_vector(picked).alias("features")), used


def _label(levels: list[str]) -> Column:
    """A class's place among the sorted training classes; null for others."""
    out = F.lit(None).cast("double")
    for i, level in enumerate(levels):
        out = F.when(F.col("class") == level, F.lit(float(i))).otherwise(out)
    return out


def folds_of(n_folds: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("seq_id", F.lit(seed)), F.lit(n_folds)).cast("int")


def _forest(seed: int, trees: int) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, seed=seed, maxDepth=10)


def _boosted(seed: int, rounds: int, settings: dict | None = None) -> OneVsRest:
    """Boosting is binary in Spark ML, so each class is told from the rest; the class models are fitted side by side."""
    return OneVsRest(classifier=GBTClassifier(maxIter=rounds, seed=seed, **(BOOST | (settings or {}))), parallelism=4)


def try_counts(p: int) -> list[str]:
    """Three numbers of features a split tries: 2, halfway, all."""
    return [str(x) for x in sorted({min(2, p), max(1, (2 + p) // 2), p})]


def tree_paths(tree, level: int | None = None) -> list[tuple[list[tuple[int, float, float, float]], float]]:
    """Root-to-leaf paths of a Spark tree: one (feature, low, high, share) per different feature of a path, and the leaf's value.

    A row follows the path if low < x <= high for each feature; share is the part
    of training rows that go on at the feature's splits. With a level, the value
    is that class's share of the leaf (classification), else the prediction.
    """
    paths = []

    def weight(node) -> float:
        return float(node.impurityStats().count())

    def value(node) -> float:
        if level is None:
            return float(node.prediction())
        stats = np.array(list(node.impurityStats().stats()))
        return float(stats[level] / stats.sum()) if stats.sum() else 0.0

    stack = [(tree._call_java("rootNode"), {})]
    while stack:
        node, met = stack.pop()
        if node.subtreeDepth() == 0:
            paths.append(([(f, *x) for f, x in met.items()], value(node)))
            continue
        cut = node.split()
        f, t = int(cut.featureIndex()), float(cut.threshold())
        total = weight(node)
        for child, side in ((node.leftChild(), 0), (node.rightChild(), 1)):
            low, high, share = met.get(f, (-np.inf, np.inf, 1.0))
            low, high = (low, min(high, t)) if side == 0 else (max(low, t), high)
            stack.append((child, {**met, f: (low, high, share * weight(child) / total)}))
    return paths


def round_errors(model, held: DataFrame, fold: int) -> DataFrame:
    """(round, fold, error) of a one-against-rest boosted model on held rows (label, features): the share of wrong rows after each round, from the trees as plain paths."""
    parts = [[(float(w), tree_paths(t)) for w, t in zip(m.treeWeights, m.trees)] for m in model.models]

    def margins(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, label = np.stack(batch["x"].to_numpy()), batch["label"].to_numpy()
            total = np.zeros((len(parts), len(x)))
            for i in range(max(map(len, parts))):
                for c, trees in enumerate(parts):
                    if i < len(trees):
                        w, paths = trees[i]
                        for conditions, value in paths:
                            on = np.ones(len(x), bool)
                            for f, low, high, _ in conditions:
                                on &= (x[:, f] > low) & (x[:, f] <= high)
                            total[c, on] += w * value
                yield pd.DataFrame({"round": [i + 1], "wrong": [int((total.argmax(0) != label).sum())], "n": [len(x)]})

    counted = held.select("label", vector_to_array("features").alias("x")).mapInPandas(margins, "round int, wrong long, n long")
    return counted.groupBy("round").agg((F.sum("wrong") / F.sum("n")).alias("error")).withColumn("fold", F.lit(fold))


def _search_rounds(rows: DataFrame, estimator: OneVsRest, n_folds: int) -> dict:
    """The first round of the least mean error over the folds, its accuracy and deviation."""
    errors: list[tuple[int, int, float]] = []
    for fold in range(n_folds):
        part, held = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        if part.isEmpty() or held.isEmpty():
            continue
        errors += [(r["round"], r["fold"], r["error"]) for r in round_errors(estimator.fit(part), held, fold).collect()]
    best = metrics.best_round(rows.sparkSession.createDataFrame(errors, "round int, fold int, error double")).first()
    return {"accuracy": best["accuracy"], "sd": best["sd"], "best_round": best["best_round"], "folds": best["folds"]}


def train(train_rows: DataFrame, test_rows: DataFrame, motifs: list[str], method: str = "xgb", cv_folds: int = 10, rounds: int = ROUNDS, trees: int = 100, seed: int = 123, settings: dict | None = None) -> Trained:
    """Train on (seq_id, class, features), predict and measure on test rows.

    method "rf": a random forest, whose features per split are chosen by
    cross-validation; "xgb": gradient-boosted trees, one class against the rest,
    up to ``rounds`` rounds. Its folds' errors are taken after every round, and the
    model is fitted anew with the first round of the least mean error (cv holds it
    as best_round). ``settings`` replaces single settings of BOOST.
    cv_folds below 2 skips cross-validation. Test rows of classes that were not
    trained have no actual level and drop out of the measures.
    """
    if method not in ("rf", "xgb"):
        raise ValueError("method must be 'rf' or 'xgb'")
    began = time.time()
    base = train_rows.withColumn("fold", folds_of(max(2, cv_folds), seed)).cache()
    levels = sorted(r[0] for r in base.select("class").distinct().collect())
    rows = base.withColumn("label", _label(levels))
    cv: dict = {}
    evaluator = MulticlassClassificationEvaluator(metricName="accuracy")
    if method == "rf":
        estimator = _forest(seed, trees)
        if cv_folds >= 2:
            grid = ParamGridBuilder().addGrid(estimator.featureSubsetStrategy, try_counts(len(motifs))).build()
            search: CrossValidatorModel = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator, numFolds=cv_folds, foldCol="fold", seed=seed, parallelism=2).fit(rows)
            best = max(range(len(grid)), key=lambda i: search.avgMetrics[i])
            cv = {"accuracy": search.avgMetrics[best], "sd": search.stdMetrics[best], "features_per_split": next(iter(grid[best].values()))}
            model = search.bestModel
        else:
            model = estimator.fit(rows)
    else:
        estimator = _boosted(seed, rounds, settings)
        if cv_folds >= 2:
            cv = _search_rounds(rows, estimator, cv_folds)
            estimator = _boosted(seed, cv["best_round"], settings)
        model = estimator.fit(rows)
    names = F.array(*[F.lit(x) for x in levels])
    predicted = model.transform(test_rows).select("seq_id", F.col("class").alias("actual"), F.get(names, F.col("prediction").cast("int")).alias("predicted"))
    # a row for each two classes: held here, so that measures do not predict anew
    table = train_rows.sparkSession.createDataFrame(metrics.confusion(predicted, levels).collect(), "predicted string, actual string, n long")
    row = metrics.accuracy_kappa(table).first()
    total, correct = (row["total"], row["correct"]) if row and row["total"] else (0, 0)
    interval = metrics.exact_interval(correct, total) if total else None
    base.unpersist()
    return Trained(method, model, motifs, levels, predicted, table, row["accuracy"] if total else None, row["kappa"] if total else None, interval, cv, time.time() - began)


def compare(train_rows: DataFrame, test_rows: DataFrame, motifs: list[str], cv_folds: int = 5, rounds: int = ROUNDS, trees: int = 500, seed: int = 123, grid: list[dict] | None = None) -> tuple[dict[str, Trained], str]:
    """Both methods, and the name of the more accurate one; a tie goes to xgb.

    ``grid`` lists settings of the boosted trees to choose from (with cv_folds of
    2 or more): the one whose best round has the highest accuracy over the folds,
    of equal ones the first.
    """
    rf = train(train_rows, test_rows, motifs, "rf", cv_folds, rounds, trees, seed)
    tried = [train(train_rows, test_rows, motifs, "xgb", cv_folds, rounds, trees, seed, settings) for settings in grid or [{}]]
    xgb = max(tried, key=lambda t: t.cv.get("accuracy", 0.0))
    return {"rf": rf, "xgb": xgb}, "rf" if (rf.accuracy or 0) > (xgb.accuracy or 0) else "xgb"
