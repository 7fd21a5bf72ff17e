"""The sleep folder: recordings paired with their hypnograms by file name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows

#: File names (cohort, subject, night, kind), stages of the hypnogram, channels.
FILE_NAME = r"^(SC4|ST7)(\d\d)(\d)[A-Z0-9]{2}-(PSG|Hypnogram)\.edf$"
COHORTS = {"SC4": "SC", "ST7": "ST"}
STAGES = {"Sleep stage W": "W", "Sleep stage 1": "N1", "Sleep stage 2": "N2", "Sleep stage 3": "N3", "Sleep stage 4": "N3", "Sleep stage R": "REM"}
CHANNELS = ("EEG Fpz-Cz", "EEG Pz-Oz", "EOG horizontal", "EMG submental")
EPOCH_SECONDS = 30.0


def parsed_names(files: DataFrame) -> DataFrame:
    """``files`` (file) with subject_id, night and kind; other files are left out."""
    part = [F.regexp_extract("file", FILE_NAME, k) for k in (1, 2, 3, 4)]
    cohort = F.element_at(F.create_map(*[F.lit(x) for kv in COHORTS.items() for x in kv]), part[0])
    return files.where(F.col("file").rlike(FILE_NAME)).select("*", F.concat(cohort, part[1]).alias("subject_id"), part[2].cast("int").alias("night"), part[3].alias("kind"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """file and length, without reading contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.edf").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


def nights(files: DataFrame) -> DataFrame:
    """subject_id, night, psg, hypnogram: only pairs."""
    named = parsed_names(files)
    a = named.where("kind = 'PSG'").select("subject_id", "night", F.col("file").alias("psg"))
    b = named.where("kind = 'Hypnogram'").select("subject_id", "night", F.col("file").alias("hypnogram"))
    return a.join(b, ["subject_id", "night"])


def unpaired(files: DataFrame) -> DataFrame:
    """Files whose other half is missing: anti joins both ways."""
    named = parsed_names(files)
    a, b = named.where("kind = 'PSG'"), named.where("kind = 'Hypnogram'")
    keys = ["subject_id", "night"]
    return a.join(b, keys, "left_anti").select("file").union(b.join(a, keys, "left_anti").select("file"))


def verify(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """file, problem: unpaired files and files that could not be parsed (``parsed`` has file and error)."""
    broken = parsed.where("error is not null").select("file", F.col("error").alias("problem")).distinct()
    return unpaired(files).withColumn("problem", F.lit("unpaired")).union(broken)


def hypnograms(annotations: DataFrame) -> DataFrame:
    """subject_id, night, epoch_idx, stage of annotation rows (file, seq, onset_s, duration_s, text)."""
    return windows.expand_annotations(parsed_names(annotations), ["subject_id", "night"], STAGES, EPOCH_SECONDS)


def trimmed_nights(signals: DataFrame, hypnogram: DataFrame, margin_epochs: int = 60) -> tuple[DataFrame, DataFrame]:
    """Signals and hypnogram of each night, cut to its sleep and ``margin_epochs`` on both sides.

    ``signals``: subject_id, night, signal, rate, start_time, samples, and first_sample if a
    night comes in several rows (those outside the cut are left out).  Start times move by
    what is cut off; a night without a date starts in 1970, never now.  Nights without sleep
    stay whole; epochs are numbered again from 0.
    """
    keys = ["subject_id", "night"]
    kept = windows.trim_sleep(hypnogram, keys, margin_epochs)
    span = kept.groupBy(*keys).agg(F.min("epoch_idx").alias("_lo"), F.max("epoch_idx").alias("_hi"))
    out = signals.join(span, keys)
    first = F.bround(F.col("_lo") * F.lit(EPOCH_SECONDS) * F.col("rate")).cast("long")
    end = F.bround((F.col("_hi") + 1) * F.lit(EPOCH_SECONDS) * F.col("rate")).cast("long")
    at = windows.first_sample_of(signals)
    begin, stop = F.greatest(first - at, F.lit(0).cast("long")), F.least(end - at, F.size("samples").cast("long"))
    start = F.coalesce("start_time", F.timestamp_seconds(F.lit(0))) + F.make_dt_interval(secs=F.col("_lo") * F.lit(EPOCH_SECONDS))
    if "first_sample" in signals.columns:
        out = out.where(begin < stop).withColumns({"first_sample": F.greatest(at - first, F.lit(0).cast("long")), "samples": F.slice("samples", (begin + 1).cast("int"), (stop - begin).cast("int"))})
    else:
        out = out.withColumn("samples", F.slice("samples", (first + 1).cast("int"), F.greatest(end - first, F.lit(0)).cast("int")))
    out = out.withColumn("start_time", start).drop("_lo", "_hi")
    renumbered = kept.join(span, keys).withColumn("epoch_idx", F.col("epoch_idx") - F.col("_lo")).drop("_lo", "_hi")
    return out, renumbered
