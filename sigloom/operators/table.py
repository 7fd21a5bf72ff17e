"""The feature table: from long features to one wide row per window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(features: DataFrame, row_keys: list[str], min_coverage: float = 0.9, rows: DataFrame | None = None) -> DataFrame:
    """name, n, rows, kept: features found (and finite) in at least ``min_coverage`` of the rows.

    ``rows`` names the rows when some have no feature at all.
    """
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    total = (rows if rows is not None else features).select(*row_keys).distinct().agg(F.count("*").alias("rows"))
    counts = features.where(finite).select(*row_keys, "name").distinct().groupBy("name").agg(F.count("*").alias("n"))
    # one row: a cross join with a single count
    return counts.crossJoin(F.broadcast(total)).withColumn("kept", F.col("n") >= F.lit(float(min_coverage)) * F.col("rows"))


def assemble(features: DataFrame, row_keys: list[str], min_coverage: float = 0.9, rows: DataFrame | None = None) -> tuple[DataFrame, list[str], int]:
    """The wide table, its sorted feature names, and how many rows were dropped for lacking one.

    Names come to the driver (a catalogue of features, not data).  The pivot gets them
    explicitly, so it is one aggregation.
    """
    names = sorted(r.name for r in coverage(features, row_keys, min_coverage, rows).where("kept").select("name").collect())
    if not names:
        raise ValueError(f"no feature reaches a coverage of {min_coverage}")
    everything = (rows if rows is not None else features).select(*row_keys).distinct()
    wide = pivot(features, row_keys, names)
    kept = wide.dropna(subset=names)
    dropped = everything.count() - kept.count()
    return kept, names, dropped


def pivot(features: DataFrame, row_keys: list[str], names: list[str]) -> DataFrame:
    """One row per key with a column per name; a value that is no finite number is null."""
    value = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    return features.groupBy(*row_keys).agg(*[F.max(F.when(F.col("name") == n, value)).alias(n) for n in names])


def unpivot(table: DataFrame, row_keys: list[str], names: list[str]) -> DataFrame:
    return table.unpivot(row_keys, names, "name", "value")


def select_features(table: DataFrame, meta: list[str], names: list[str]) -> DataFrame:
    """``meta`` and the named features, in that order."""
    if not names:
        raise ValueError("a table needs features")
    lacking = [n for n in names if n not in table.columns]
    if lacking:
        raise KeyError(f"no such features: {lacking}")
    return table.select(*meta, *names)


def concat_tables(tables: list[DataFrame], versions: list[str]) -> DataFrame:
    """Rows of tables that have the same columns in the same order and the same version."""
    if len(set(versions)) > 1:
        raise ValueError(f"versions differ: {sorted(set(versions))}")
    first = tables[0]
    for t in tables[1:]:
        if t.columns != first.columns:
            raise ValueError("columns or their order differ")
    out = first
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def fuse(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Windows of two devices by subject, start and duration: a full outer equi-join, with which device had them."""
    a = left.withColumn(f"has_{names[0]}", F.lit(True))
    b = right.withColumn(f"has_{names[1]}", F.lit(True))
    clash = set(left.columns) & set(right.columns) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    return a.join(b, keys, "full").na.fill(False, [f"has_{n}" for n in names])


def binary(label: str | Column, positive: str) -> Column:
    column = F.col(label) if isinstance(label, str) else label
    return F.coalesce((column == positive).cast("int"), F.lit(0))


def indicators(codes: str, status: str, known: list[str], prefix: str) -> list[Column]:
    """Quality as features: flagged, rejected, number of codes, and one column per known code."""
    c = F.coalesce(F.col(codes), F.array().cast("array<string>"))
    out = [(F.size(c) > 0).cast("int").alias(f"qc_{prefix}_flagged"), F.coalesce((F.col(status) == "rejected").cast("int"), F.lit(0)).alias(f"qc_{prefix}_rejected"), F.size(c).alias(f"qc_{prefix}_codes")]
    return out + [F.array_contains(c, k).cast("int").alias(f"qc_{prefix}_{k}") for k in known]


def tally(df: DataFrame, signal: str, codes: str, device: str = "") -> DataFrame:
    """code ("signal:code", with the device before it unless it is the wrist) and how often it was given."""
    name = F.concat(F.lit(f"{device}:" if device else ""), F.col(signal), F.lit(":"), F.col("_code"))
    return df.select(signal, F.explode(codes).alias("_code")).groupBy(name.alias("code")).agg(F.count("*").alias("n"))
