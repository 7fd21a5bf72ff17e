"""Scores of predictions, for any grouping, as aggregations over one predictions table.

``predictions`` has truth, predicted, probability (of class 1) and whatever the grouping
needs (fold, model, subject).  Nothing is scored fold by fold in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _on(keys: list[str], left: str, right: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def confusion(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, truth, predicted, n: only pairs that occur."""
    return predictions.groupBy(*keys, "truth", "predicted").agg(F.count("*").alias("n"))


def confusion_matrix(predictions: DataFrame, keys: list[str], labels: list) -> DataFrame:
    """One row per truth label and a column ``pred_<label>`` each."""
    cells = [F.coalesce(F.sum(F.when(F.col("predicted") == x, F.col("n"))), F.lit(0)).alias(f"pred_{x}") for x in labels]
    return confusion(predictions, keys).groupBy(*keys, "truth").agg(*cells)


def by_class(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, support, predicted_n, hits, recall, precision, f1 over all labels seen on either side; 0 for 0/0."""
    cells = confusion(predictions, keys)
    both = cells.select(*keys, F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("h"))
    both = both.unionByName(cells.select(*keys, F.col("predicted").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")))
    out = both.groupBy(*keys, "label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted_n"), F.sum("h").alias("hits"))
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    precision = F.when(F.col("predicted_n") > 0, F.col("hits") / F.col("predicted_n")).otherwise(0.0)
    f1 = F.when(F.col("support") + F.col("predicted_n") > 0, 2 * F.col("hits") / (F.col("support") + F.col("predicted_n"))).otherwise(0.0)
    return out.withColumns({"recall": recall, "precision": precision, "f1": f1})


def classification(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, accuracy, balanced_accuracy (classes present in truth), macro_f1 (all classes), kappa."""
    c = by_class(predictions, keys)
    total = F.sum("support")
    observed = F.sum("hits") / total
    expected = F.sum(F.col("support") * F.col("predicted_n")) / (total * total)
    return c.groupBy(*keys).agg(
        total.alias("n"),
        observed.alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.when(expected < 1, (observed - expected) / (1 - expected)).otherwise(0.0).alias("kappa"),
    )


def _scored(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, probability, n, pos: one row per distinct probability, so that ties meet before any window."""
    return predictions.groupBy(*keys, "probability").agg(F.count("*").alias("n"), F.sum("truth").alias("pos"))


def roc_auc(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, positives, negatives, roc_auc: tie-aware (Mann-Whitney); null for one class."""
    frame = Window.partitionBy(*keys).orderBy("probability").rowsBetween(Window.unboundedPreceding, -1)
    ranked = _scored(predictions, keys).withColumn("below", F.coalesce(F.sum("n").over(frame), F.lit(0)))
    # average rank of ties: those below, and the middle of the tied
    ranks = F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2))
    p, n = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return ranked.groupBy(*keys).agg(p.alias("positives"), n.alias("negatives"), F.when((p > 0) & (n > 0), (ranks - p * (p + 1) / 2) / (p * n)).alias("roc_auc"))


def average_precision(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, average_precision: recall steps times precision at each distinct threshold; null without positives."""
    down = Window.partitionBy(*keys).orderBy(F.desc("probability")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = _scored(predictions, keys).withColumn("precision", F.sum("pos").over(down) / F.sum("n").over(down))
    return steps.groupBy(*keys).agg(F.when(F.sum("pos") > 0, F.sum(F.col("pos") * F.col("precision")) / F.sum("pos")).alias("average_precision"))


def calibration_bins(predictions: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """keys, bin, n, mean_truth, mean_probability: the first bin is closed below, all are closed above.

    Edges are i / bins in double arithmetic, compared as written: rounding up first would
    move a probability on an edge.
    """
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    place = F.size(F.filter(edges, lambda e: F.col("probability") > e))
    return predictions.groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"), F.avg("truth").alias("mean_truth"), F.avg("probability").alias("mean_probability"))


def calibration(predictions: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """keys, ece: gaps between mean truth and mean probability, weighted by the bins' shares."""
    gap = F.abs(F.col("mean_truth") - F.col("mean_probability"))
    return calibration_bins(predictions, keys, bins).groupBy(*keys).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def brier(predictions: DataFrame, keys: list[str]) -> DataFrame:
    return predictions.groupBy(*keys).agg(F.avg(F.pow(F.col("probability") - F.col("truth"), 2)).alias("brier"))


def constant_rate(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """keys, constant_rate: the share of 1 for labels 0 and 1, else of the commonest label."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    two = F.min(F.col(label).cast("string").isin("0", "1"))
    ones = F.sum(F.when(F.col(label).cast("string") == "1", F.col("n")).otherwise(0))
    return counts.groupBy(*keys).agg((F.when(two, ones).otherwise(F.max("n")) / F.sum("n")).alias("constant_rate"))


def score(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """All scores of binary predictions, one row per group: five small aggregates joined on the keys."""
    out = classification(predictions, keys)
    for part in (roc_auc(predictions, keys), average_precision(predictions, keys), brier(predictions, keys), calibration(predictions, keys)):
        out = out.join(part, keys) if keys else out.crossJoin(part)
    return out


def per_subject(predictions: DataFrame, keys: list[str], subject: str = "subject_id") -> DataFrame:
    """Scores of each subject that has at least two classes in truth."""
    both = [*keys, subject]
    classes = predictions.groupBy(*both).agg(F.countDistinct("truth").alias("classes"), F.avg("probability").alias("mean_probability"), F.avg("truth").alias("rate"))
    out = classification(predictions, both).join(roc_auc(predictions, both), both).join(classes.where("classes >= 2"), both)
    return out.select(*both, "n", "balanced_accuracy", "kappa", "roc_auc", "mean_probability", "rate")


def worst_subject(subjects: DataFrame, keys: list[str], subject: str = "subject_id", by: str = "balanced_accuracy") -> DataFrame:
    """keys, worst_subject and its score; of equals the first in order."""
    return subjects.groupBy(*keys).agg(F.min(F.struct(by, subject)).alias("w")).select(*keys, F.col(f"w.{subject}").alias("worst_subject"), F.col(f"w.{by}").alias(f"worst_{by}"))


def over_folds(scores: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, folds and for each name mean, sd (of the folds as they are) and min; nulls are left out."""
    cells = [f.alias(f"{n}_{s}") for n in names for s, f in (("mean", F.avg(n)), ("sd", F.stddev_pop(n)), ("min", F.min(n)))]
    return scores.groupBy(*keys).agg(F.count("*").alias("folds"), *cells)


def personal_summary(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Over subjects: mean, sd and worst calibration error, mean Brier score, per variant."""
    return scores.groupBy(*(keys or ["variant"])).agg(F.count("*").alias("subjects"), F.avg("ece").alias("ece_mean"), F.stddev_pop("ece").alias("ece_sd"), F.max("ece").alias("ece_worst"), F.avg("brier").alias("brier_mean"))
