"""Measures of predictions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def confusion(rows: DataFrame, levels: list | None = None) -> DataFrame:
    """(predicted, actual, n); rows whose classes are not among the levels drop out, as do nulls."""
    rows = rows.where("predicted is not null and actual is not null")
    if levels is not None:
        rows = rows.where(F.col("predicted").isin(levels) & F.col("actual").isin(levels))
    return rows.groupBy("predicted", "actual").agg(F.count("*").alias("n"))


def accuracy_kappa(table: DataFrame) -> DataFrame:
    """(total, correct, accuracy, kappa) of a confusion table; kappa is null where chance alone would be right always, all null without rows."""
    total = table.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("predicted") == F.col("actual"), F.col("n")).otherwise(0)).alias("correct"))
    by_p = table.groupBy(F.col("predicted").alias("level")).agg(F.sum("n").alias("p"))
    by_a = table.groupBy(F.col("actual").alias("level")).agg(F.sum("n").alias("a"))
    chance = by_p.join(by_a, "level").agg(F.coalesce(F.sum(F.col("p") * F.col("a")), F.lit(0)).alias("chance"))
    both = total.withColumn("one", F.lit(1)).join(chance.withColumn("one", F.lit(1)), "one")
    expected = F.col("chance") / (F.col("total") * F.col("total"))
    accuracy = F.col("correct") / F.col("total")
    return both.select("total", "correct", accuracy.alias("accuracy"), F.try_divide(accuracy - expected, 1 - expected).alias("kappa"))


def _tail(k: int, n: int, p: float) -> float:
    """Probability of at least k successes of n."""
    if k <= 0:
        return 1.0
    if p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return min(1.0, math.fsum(math.exp(log(i)) for i in range(k, n + 1)))


def exact_interval(correct: int, total: int, level: float = 0.95) -> tuple[float, float]:
    """The Clopper-Pearson interval of a share, by bisection on the binomial tails."""
    a = (1 - level) / 2

    def solve(f) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) else (low, mid)
        return (low + high) / 2

    lower = 0.0 if correct == 0 else solve(lambda p: _tail(correct, total, p) < a)
    upper = 1.0 if correct == total else solve(lambda p: 1 - _tail(correct + 1, total, p) > a)
    return lower, upper


def best_model(rows: DataFrame) -> DataFrame:
    """(model, accuracy, rank) of (model, accuracy): best first; the first name in reverse order wins a tie, so that xgb goes before rf."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("accuracy"), F.desc("model"))))


def best_round(errors: DataFrame) -> DataFrame:
    """From fold errors (round, fold, error): the first round of the least mean error, its accuracy and population deviation, and how many folds."""
    per = errors.groupBy("round").agg(F.avg("error").alias("mean_error"), F.stddev_pop("error").alias("sd_error"), F.count("*").alias("folds"))
    # equal means may differ in their last digits by the order of addition
    best = per.agg(F.min(F.struct(F.round("mean_error", 12).alias("m"), "round", "mean_error", "sd_error", "folds")).alias("b"))
    return best.select(F.col("b.round").alias("best_round"), (1 - F.col("b.mean_error")).alias("accuracy"), F.col("b.sd_error").alias("sd"), F.col("b.folds").alias("folds"))
