"""Coverage of subjects and conditions, paired differences, ablation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(df: DataFrame, subject: str, label: str) -> DataFrame:
    """subject, label, n by both, by either and in total, in one pass; null means all."""
    return df.groupingSets([(subject, label), (subject,), (label,), ()], subject, label).agg(F.grouping(subject).alias("all_subjects"), F.grouping(label).alias("all_labels"), F.count("*").alias("n"))


def scorable(df: DataFrame, subject: str, label: str, positive: str) -> DataFrame:
    """subject, rows, positives, scorable: some but not all rows are positive."""
    out = df.groupBy(subject).agg(F.count("*").alias("rows"), F.count(F.when(F.col(label) == positive, 1)).alias("positives"))
    return out.withColumn("scorable", (F.col("positives") > 0) & (F.col("positives") < F.col("rows")))


def retention(whole: DataFrame, kept: DataFrame, label: str) -> DataFrame:
    """label, rows, kept, share kept."""
    a = whole.groupBy(label).agg(F.count("*").alias("rows"))
    b = kept.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("kept"))
    out = a.join(b, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label").na.fill(0, ["kept"])
    return out.withColumn("share", F.col("kept") / F.col("rows"))


def paired(left: DataFrame, right: DataFrame, subject: str, score: str) -> DataFrame:
    """subject, left, right, difference (right less left) for subjects scored on both sides."""
    a = left.where(F.col(score).isNotNull()).select(subject, F.col(score).alias("left"))
    b = right.where(F.col(score).isNotNull()).select(subject, F.col(score).alias("right"))
    return a.join(b, subject).withColumn("difference", F.col("right") - F.col("left"))


def paired_summary(pairs: DataFrame) -> DataFrame:
    d = F.col("difference")
    return pairs.agg(F.count("*").alias("subjects"), F.avg(d).alias("mean"), F.count(F.when(d > 0, 1)).alias("better"), F.count(F.when(d < 0, 1)).alias("worse"), F.count(F.when(d == 0, 1)).alias("tied"))


def bootstrap(differences: list[float], resamples: int = 10_000, seed: int = 0, level: float = 0.95) -> dict[str, float]:
    """Percentile interval of the mean difference; one number per subject, so it runs on the driver."""
    if len(differences) < 2:
        raise ValueError("two subjects at least")
    x = np.sort(np.asarray(differences, float))
    draws = np.random.default_rng(seed).integers(0, len(x), (resamples, len(x)))
    low, high = np.quantile(x[draws].mean(1), [(1 - level) / 2, (1 + level) / 2])
    return {"mean": float(x.mean()), "low": float(low), "high": float(high), "crosses_zero": bool(low <= 0 <= high)}


def verdict(interval: dict[str, float]) -> str:
    if interval["crosses_zero"]:
        return "no difference shown"
    return "right is higher" if interval["low"] > 0 else "left is higher"


def ablation_plan(groups: dict[str, list[str]]) -> dict[tuple[str, str], list[str]]:
    """(kind, group) and its features: everything, each group alone, everything without each group."""
    whole = sorted(n for names in groups.values() for n in names)
    plan = {("full", "all"): whole}
    for g, names in groups.items():
        plan["alone", g] = sorted(names)
        rest = sorted(set(whole) - set(names))
        if rest:
            plan["without", g] = rest
    return plan


def contributions(scores: DataFrame, score: str) -> DataFrame:
    """group, alone, without, contribution (full less without), ranked from the largest."""
    full = scores.where("kind = 'full'").agg(F.max(score).alias("full"))
    by = scores.where("kind <> 'full'").groupBy("group").agg(F.max(F.when(F.col("kind") == "alone", F.col(score))).alias("alone"), F.max(F.when(F.col("kind") == "without", F.col(score))).alias("without"))
    return by.crossJoin(F.broadcast(full)).withColumn("contribution", F.col("full") - F.col("without")).orderBy(F.desc_nulls_last("contribution"), "group")
