"""Recordings in several rows give what whole ones give."""

import random

import pytest
from pyspark.sql import functions as F

from sigloom.operators import windows
from sigloom.plans import build, synthetic
from sigloom.sources import sleep

SCHEMA = "subject_id string, device string, signal string, rate double, first_sample bigint, samples array<double>"


def in_rows(signals, seconds):
    """Each signal in rows of ``seconds``, as the readers give them."""
    step = F.floor(F.col("rate") * seconds).cast("int")
    out = signals.withColumn("first_sample", F.explode(F.sequence(F.lit(0), F.size("samples") - 1, step)))
    return out.withColumn("samples", F.slice("samples", F.col("first_sample") + 1, step)).withColumn("first_sample", F.col("first_sample").cast("long"))


@pytest.mark.parametrize("seconds", [47.0, 600.0])
def test_chunked_and_whole_signals_build_the_same(spark, seconds):
    signals, runs = synthetic.wrist_cohort(spark, 2, 780.0)
    signals = signals.cache()
    columns = ["subject_id", "start_s", "label", "signal", "status", "name", F.round("value", 9).alias("value")]
    whole = build.build(signals, runs, "wrist", 60.0, 30.0).select(columns)
    rows = build.build(in_rows(signals, seconds), runs, "wrist", 60.0, 30.0).select(columns)
    want = sorted(map(str, whole.collect()))
    assert want == sorted(map(str, rows.collect()))
    assert whole.select("subject_id", "start_s").distinct().count() == 2 * 2 * 12


def test_cutting_against_slices(spark):
    rng = random.Random(3)
    whole, rows, wanted = {}, [], []
    for s, rate in (("a", 0.7), ("b", 4.0), ("c", 33.3)):
        x = [rng.random() for _ in range(int(400 * rate))]
        whole[s] = (rate, x)
        at = 0
        while at < len(x):
            n = rng.randint(1, max(2, int(90 * rate)))
            rows.append(("P", "d", s, rate, at, x[at : at + n]))
            at += n
    for k in range(0, 391):
        wanted.append(("P", "d", float(k), k))
    got = windows.cut_spans(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(wanted, "subject_id string, device string, start_s double, tag int"), ["subject_id", "device"], 10.0, slot_s=25.0).collect()
    found = {(r.signal, r.tag): r.samples for r in got}
    assert len(found) == len(got)
    for s, (rate, x) in whole.items():
        for _, _, start, tag in wanted:
            first = round(start * rate)
            end = first + round(10.0 * rate)
            assert found.get((s, tag)) == (x[first:end] if end <= len(x) else None), (s, tag)


def test_missing_and_repeated_rows(spark):
    x = [float(i) for i in range(100)]
    rows = [("P", "d", "s", 1.0, 0, x[:30]), ("P", "d", "s", 1.0, 0, x[:30]), ("P", "d", "s", 1.0, 20, x[20:40]), ("P", "d", "s", 1.0, 50, x[50:]), ("P", "d", "e", 1.0, 0, []), ("P", "d", "n", 1.0, 0, None)]
    wanted = spark.createDataFrame([("P", "d", float(k)) for k in range(0, 100, 10)], "subject_id string, device string, start_s double")
    got = {r.start_s: r.samples for r in windows.cut_spans(spark.createDataFrame(rows, SCHEMA), wanted, ["subject_id", "device"], 20.0).collect()}
    want = [v if not 40 <= v < 50 else None for v in x]
    assert got == {float(k): want[k : k + 20] for k in range(0, 81, 10)}


def test_nights_in_rows_are_trimmed_alike(spark):
    x = [float(i) for i in range(30 * 12)]
    whole = spark.createDataFrame([("S", 1, "EEG Fpz-Cz", 1.0, None, x)], "subject_id string, night int, signal string, rate double, start_time timestamp, samples array<double>")
    stages = ["W", "W", "W", "N1", "N2", None, "REM", "W", "W", "W", "W", "W"]
    hyp = spark.createDataFrame([("S", 1, i, s) for i, s in enumerate(stages)], "subject_id string, night int, epoch_idx int, stage string")
    columns = ["device", "start_s", "label", "signal", "samples"]
    a = build.sleep_epochs(*sleep.trimmed_nights(whole, hyp, 1)).select(columns).collect()
    b = build.sleep_epochs(*sleep.trimmed_nights(in_rows(whole, 100.0), hyp, 1)).select(columns).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) == 5
    assert min(a).samples == x[60:90]


def test_cutting_has_no_cross_join(spark):
    signals, runs = synthetic.wrist_cohort(spark, 1, 180.0)
    plan = build._labelled(signals, runs, 60.0, 30.0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
