"""Seeded signals with known answers: pulses, beats, breaths, skin, movement, sleep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "subject_id string, device string, signal string, rate double, samples array<double>"


def pulse(bpm: float, seconds: float, rate: float = 64.0, amplitude: float = 100.0) -> np.ndarray:
    t = np.arange(int(seconds * rate)) / rate
    return amplitude * (np.sin(2 * np.pi * bpm / 60 * t) + 0.4 * np.sin(4 * np.pi * bpm / 60 * t + 0.5))


def beat_train(mean_rr: float, sdnn: float, seconds: float, rng: np.random.Generator, rate: float = 700.0) -> tuple[np.ndarray, np.ndarray]:
    """Electrocardiogram-like signal and the intervals (ms) that it was made from."""
    n = int(seconds * rate)
    rr = np.maximum(rng.normal(mean_rr, sdnn, int(seconds * 1000 / mean_rr) + 5), 300.0)
    at = np.cumsum(rr) / 1000
    t, x = np.arange(n) / rate, np.zeros(n)
    for b in at[at < seconds - 0.3]:
        for shift, width, height in ((0.0, 0.012, 1.0), (0.03, 0.012, -0.25), (0.25, 0.05, 0.2)):
            lo, hi = np.searchsorted(t, [b + shift - 5 * width, b + shift + 5 * width])
            x[lo:hi] += height * np.exp(-0.5 * ((t[lo:hi] - b - shift) / width) ** 2)
    return x, np.diff(at[at < seconds - 0.3]) * 1000


def breathing(per_minute: float, seconds: float, rate: float = 700.0, drift: float = 0.5) -> np.ndarray:
    t = np.arange(int(seconds * rate)) / rate
    return np.sin(2 * np.pi * per_minute / 60 * t) + drift * t / seconds


def wrist_subject(seed: int, seconds: float = 420.0) -> Iterator[tuple[str, float, np.ndarray]]:
    """(signal, rate, samples): the first half at rest, the second under stress."""
    rng = np.random.default_rng(seed)
    half = seconds / 2
    rest, stress = 62 + 4 * rng.random(), 84 + 6 * rng.random()
    yield "BVP", 64.0, np.concatenate([pulse(rest, half), pulse(stress, half)]) + rng.normal(0, 5, 2 * int(half * 64))
    n = int(half * 4)
    level = np.concatenate([np.full(n, 2.0), np.linspace(2.5, 5.0, n)]) + 0.3 * rng.random()
    yield "EDA", 4.0, level + 0.05 * np.maximum(0, np.sin(np.arange(2 * n) / 9)) + rng.normal(0, 0.002, 2 * n)
    yield "TEMP", 4.0, np.concatenate([np.full(n, 33.0), np.linspace(33.0, 32.2, n)]) + rng.normal(0, 0.01, 2 * n)
    m = int(seconds * 32)
    for axis, mean in (("x", 5.0), ("y", -10.0), ("z", 62.0)):
        yield f"ACC_{axis}", 32.0, mean + rng.normal(0, 1.0, m)


def wrist_cohort(spark: SparkSession, subjects: int = 6, seconds: float = 420.0) -> tuple[DataFrame, DataFrame]:
    """Signals made on the executors, and their label runs."""

    def run(batches):
        for b in batches:
            for k in b.column("id").to_pylist():
                rows = [(f"P{k + 1:02d}", "wrist", s, r, x.tolist()) for s, r, x in wrist_subject(k, seconds)]
                yield pa.record_batch([pa.array([row[i] for row in rows]) for i in range(5)], names=["subject_id", "device", "signal", "rate", "samples"])

    signals = spark.range(0, subjects, 1, min(subjects, 8)).mapInArrow(run, SCHEMA)
    who = spark.range(subjects).select(F.format_string("P%02d", F.col("id") + 1).alias("subject_id"))
    half = seconds / 2
    runs = who.select("subject_id", F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(n).alias("label"), F.lit(a).alias("begin_s"), F.lit(z).alias("end_s")) for c, n, a, z in ((1, "baseline", 0.0, half), (2, "stress", half, seconds))])).alias("r")).select("subject_id", "r.*")
    return signals, runs


def sleep_wave(stage: str, seconds: float, rng: np.random.Generator, rate: float = 100.0) -> np.ndarray:
    """EEG whose main rhythm is the stage's."""
    hz, size = {"W": (10.0, 20.0), "N1": (6.0, 20.0), "N2": (13.0, 25.0), "N3": (1.5, 80.0), "REM": (5.0, 15.0)}[stage]
    t = np.arange(int(seconds * rate)) / rate
    return size * np.sin(2 * np.pi * hz * t) + rng.normal(0, 4.0, len(t))
