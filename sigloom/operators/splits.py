"""Splits by subject: no subject is ever on both sides of a fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import subject_order


def subjects_of(df: DataFrame, subject: str) -> DataFrame:
    return df.select(F.col(subject).alias("subject_id")).where("subject_id is not null").distinct()


def numbered(subjects: DataFrame) -> DataFrame:
    """subject_id and its place in subject order, from 0 (one row per subject, not per window)."""
    return subjects.withColumn("place", F.row_number().over(Window.orderBy(*subject_order("subject_id"))) - 1)


def leave_one_out(subjects: DataFrame, limit: int = 10_000) -> DataFrame:
    """fold, subject_id, role: each subject is the test of one fold.

    As many rows as subjects squared, so more than ``limit`` subjects are refused; compare
    fold and place instead of joining there.
    """
    order = numbered(subjects)
    n = order.count()
    if not 2 <= n <= limit:
        raise ValueError(f"leave-one-out needs 2 to {limit} subjects, not {n}")
    folds = order.select(F.col("place").alias("fold"))
    return folds.crossJoin(order).select("fold", "subject_id", F.when(F.col("fold") == F.col("place"), "test").otherwise("train").alias("role"))


def hashed_order(subject: Column, seed: int) -> Column:
    """A shuffle that any engine can repeat: SHA-256 of seed and subject."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), subject.cast("string")), 256)


def group_folds(subjects: DataFrame, folds: int, seed: int) -> DataFrame:
    """subject_id, fold: subjects shuffled by hash and dealt in turn."""
    n = subjects.count()
    if not 2 <= folds <= n:
        raise ValueError(f"{folds} folds for {n} subjects")
    place = F.row_number().over(Window.orderBy(hashed_order(F.col("subject_id"), seed), "subject_id")) - 1
    return subjects.withColumn("fold", (place % folds).cast("int"))


def held_out_cohort(subjects: DataFrame, share: float, seed: int) -> DataFrame:
    """subject_id, role: ``share`` of the subjects (at least one, never all) are the test."""
    n = subjects.count()
    if n < 2 or not 0 < share < 1:
        raise ValueError("a held-out cohort needs two subjects and a share between 0 and 1")
    test = min(max(round(n * share), 1), n - 1)
    place = F.row_number().over(Window.orderBy(hashed_order(F.col("subject_id"), seed), "subject_id"))
    return subjects.select("subject_id", F.when(place <= test, "test").otherwise("train").alias("role"))


def cohort_split(subjects: DataFrame, train_prefix: str, test_prefix: str) -> DataFrame:
    """subject_id, role by the beginning of the name; subjects of neither are left out."""
    if train_prefix.startswith(test_prefix) or test_prefix.startswith(train_prefix):
        raise ValueError("the prefixes overlap")
    role = F.when(F.col("subject_id").startswith(train_prefix), "train").when(F.col("subject_id").startswith(test_prefix), "test")
    out = subjects.withColumn("role", role).where("role is not null")
    if out.select("role").distinct().count() < 2:
        raise ValueError("a side has no subjects")
    return out


def cross_cohort(subjects: DataFrame, train_prefix: str, test_prefix: str, share: float, seed: int) -> DataFrame:
    """split, subject_id, role: one training set, tested inside its cohort and on the other one."""
    roles = cohort_split(subjects, train_prefix, test_prefix)
    inside = held_out_cohort(roles.where("role = 'train'").select("subject_id"), share, seed)
    train = inside.where("role = 'train'")
    a = inside.select(F.lit("in_domain").alias("split"), "subject_id", "role")
    b = train.union(roles.where("role = 'test'")).select(F.lit("cross_cohort").alias("split"), "subject_id", "role")
    return a.union(b)


def rows_of(df: DataFrame, split: DataFrame, subject: str, role: str) -> DataFrame:
    """Rows whose subject has the role: a semi join."""
    side = split.where(F.col("role") == role).select(F.col("subject_id").alias("_subject"))
    return df.join(side, F.col(subject) == F.col("_subject"), "left_semi")
