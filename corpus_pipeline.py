"""The corpus pipeline: language, near duplicates, benchmark leaks, source mix, shards.

Each stage works on all that its predecessor kept and is written before the next reads it.

1. language_id: documents that the nearest-centroid classifier rejects go.
2. near_duplicates: of documents that links (five-word shingles, Jaccard 0.8) connect, the
   smallest doc_id stays.
3. decontamination: documents that hold a ten-word passage of the benchmark go.
4. mixing: documents come in the order of the weighted fair queue; one that the mix takes
   twice is there twice, one that it doesn't take is not there.  No document is dropped for
   having no words.
5. sharding: each row's shard and slot.

An empty table passes through; nulls follow each operator's own rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import common, decontaminate, jaccard_join, language_id, mixing, sharding

#: SQL cannot express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs, F.lit(True))
    return language_id.drop_rejected(docs, model)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_per_component(docs, n=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, mode="documents")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_stream(docs, weights=(5, 2, 1), share=1.5, cap=2)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs, shards=8)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.written(docs)
    return docs
