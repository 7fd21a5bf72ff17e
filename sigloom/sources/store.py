"""Feature tables and facts as Parquet; scores as JSON and fixed-width text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = "_meta"
#: Meta columns of a table and what an older file lacks them as.
DEFAULTS = {"window_start_s": "double", "start_time": "timestamp", "window_ids": "array<string>", "recording_ids": "array<string>", "vector_id": "string", "source_fact_ids": "array<string>"}


def save_table(table: DataFrame, path: str, names: list[str], version: str, policy: str, dropped: int = 0, window_seconds: float | None = None, qc_codes: dict[str, int] | None = None, partition_by: list[str] | None = None) -> None:
    """The rows under ``path``/data and one row of meta under ``path``/meta."""
    writer = table.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/data")
    meta = json.dumps({"feature_names": names, "feature_set_version": version, "qc_policy_version": policy, "dropped_incomplete": dropped, "window_seconds": window_seconds, "qc_codes": qc_codes or {}}, sort_keys=True)
    table.sparkSession.range(1).select(F.lit(meta).alias("meta")).write.mode("overwrite").parquet(f"{path}/meta")


def load_table(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The rows and the meta; columns that an older file lacks come as nulls."""
    rows = spark.read.parquet(f"{path}/data")
    for name, kind in DEFAULTS.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows, json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])


class FactStore:
    """Facts in a Parquet folder that only grows: a correction supersedes, nothing is edited."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def facts(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def append(self, facts: DataFrame) -> None:
        """Adds facts; one that supersedes another has a reason."""
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        lacking = [n for n in names if n not in facts.columns]
        rows = facts.withColumns({n: F.lit(None).cast("string") for n in lacking}).select(*names) if lacking else facts.select(*names)
        silent = F.col("supersedes").isNotNull() & (F.coalesce(F.col("reason"), F.lit("")) == "")
        rows = rows.where(F.when(silent, F.raise_error(F.lit("a fact that supersedes another needs a reason")).cast("boolean")).otherwise(F.lit(True)))
        rows.write.mode("append").parquet(self.path)

    def lineage(self, fact_id: str) -> DataFrame:
        """The fact, and what it derives from or supersedes, all the way back."""
        self.facts().createOrReplaceTempView("_facts")
        return self.spark.sql(
            """WITH RECURSIVE up(fact_id, depth) AS (
                 SELECT CAST(:id AS STRING), 0
                 UNION ALL
                 SELECT p.parent, up.depth + 1 FROM up JOIN (
                   SELECT fact_id, explode(array_compact(concat(coalesce(derived_from, array()), array(supersedes)))) AS parent FROM _facts
                 ) p ON p.fact_id = up.fact_id
               ) SELECT f.*, d.depth FROM (SELECT fact_id, min(depth) AS depth FROM up GROUP BY fact_id) d JOIN _facts f ON f.fact_id = d.fact_id""",
            args={"id": fact_id},
        )


def fixed_width(rows: DataFrame, columns: list[str]) -> str:
    """A small result, all its rows, as aligned text."""
    found = [[("-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)) for v in r] for r in rows.select(*columns).toLocalIterator()]
    width = [max(len(c), *(len(r[k]) for r in found)) if found else len(c) for k, c in enumerate(columns)]
    lines = ["  ".join(c.rjust(w) for c, w in zip(columns, width, strict=True))]
    return "\n".join(lines + ["  ".join(v.rjust(w) for v, w in zip(r, width, strict=True)) for r in found])
