"""Choosing what one subject's calibration learns from and what is scored.

Each strategy adds ``part`` to the rows: "enrol", "evaluate", or null for rows that are too
near to what was learned from.  Frames partition by subject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows

STRATEGIES = ("prospective", "cross_session", "per_condition", "blocks", "prefix")


def _part(enrol: Column, evaluate: Column) -> Column:
    return F.when(enrol, "enrol").when(evaluate, "evaluate")


def enrol(df: DataFrame, subject: str, start: str, label: str, fraction: float, strategy: str = "per_condition", blocks: int = 4, length: float = 60.0, gap: float = 3600.0, tie: list[str] | None = None) -> DataFrame:
    """``df`` with ``part``.

    prospective: up to the moment by which every label was seen, and at least ``fraction``
    of the session; what starts more than a window later is scored.  cross_session: the
    first session against the later ones.  per_condition: the opening ``fraction`` of every
    run of one label.  blocks: ``blocks`` openings of equal parts of the session.  prefix:
    one block.  Block strategies leave a window's length free on both sides.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if not 0 < fraction < 1:
        raise ValueError("the fraction lies between 0 and 1")
    whole = Window.partitionBy(subject)
    t, margin = F.col(start), F.lit(float(length))
    if strategy == "cross_session":
        out = windows.sessions(df, [subject], start, gap, tie)
        several = F.max("session").over(whole) > 0
        return out.withColumn("part", _part(several & (F.col("session") == 0), several & (F.col("session") > 0))).drop("session")
    out = df.withColumn("_first", F.min(start).over(whole)).withColumn("_last", F.max(start).over(whole))
    duration = F.col("_last") - F.col("_first")
    if strategy == "prospective":
        seen = F.min(start).over(Window.partitionBy(subject, label))
        cut = F.greatest(F.max("_seen").over(whole), F.col("_first") + duration * F.lit(float(fraction)))
        out = out.withColumn("_seen", seen).withColumn("_cut", cut)
        part = F.when(duration <= 0, F.lit("evaluate")).otherwise(_part(t <= F.col("_cut"), t > F.col("_cut") + margin))
        return out.withColumn("part", part).drop("_first", "_last", "_seen", "_cut")
    if strategy == "per_condition":
        out = windows.label_runs(out, [subject], [start, *(tie or [])], label)
        spans = out.groupBy(subject, "run").agg(F.min(start).alias("begin"), F.max(start).alias("last"))
        spans = spans.groupBy(subject).agg(F.collect_list(F.struct("begin", (F.col("begin") + (F.col("last") - F.col("begin")) * F.lit(float(fraction))).alias("finish"))).alias("_spans"))
        out = out.drop("run").join(spans, subject)
    else:
        n = blocks if strategy == "blocks" else 1
        piece = duration / F.lit(n)
        out = out.withColumn("_spans", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((F.col("_first") + i * piece).alias("begin"), (F.col("_first") + i * piece + duration * F.lit(fraction / n)).alias("finish"))))
    inside = F.exists("_spans", lambda s: (t >= s["begin"]) & (t <= s["finish"]))
    near = F.exists("_spans", lambda s: (t > s["begin"] - margin) & (t < s["finish"] + margin))
    part = _part(inside, ~near)
    if strategy != "per_condition":
        part = F.when(duration <= 0, F.lit("evaluate")).otherwise(part)
    return out.withColumn("part", part).drop("_first", "_last", "_spans")


def prevalence(enrolled: DataFrame, subject: str, truth: str) -> DataFrame:
    """subject and the share of positives in what it enrolled: the arithmetic baseline."""
    return enrolled.where("part = 'enrol'").groupBy(subject).agg(F.avg(truth).alias("prevalence"))


def usable_subjects(enrolled: DataFrame, subject: str, truth: str) -> DataFrame:
    """Subjects with both classes on both sides; the others cannot be calibrated or scored."""
    classes = enrolled.where("part is not null").groupBy(subject, "part").agg(F.countDistinct(truth).alias("classes"))
    return classes.where("classes >= 2").groupBy(subject).agg(F.count("*").alias("sides")).where("sides = 2").select(subject)
