import pytest
from pyspark.sql import functions as F

from sigloom.functions import features, quality
from sigloom.operators import metrics, models
from sigloom.plans import build, synthetic


@pytest.fixture(scope="module")
def long(spark):
    signals, runs = synthetic.wrist_cohort(spark, 3, 300.0)
    return build.build(signals, runs, "wrist", 60.0, 30.0).cache()


def test_wrist_build_has_the_whole_catalogue(long):
    wide, names, dropped, tally = build.feature_table(long)
    assert set(names) == {n for group in features.FEATURES_BY_SIGNAL.values() for n in group} and len(names) == 28
    assert dropped == 0
    by = {r.label: r for r in wide.groupBy("label").agg(F.avg("pulse_rate_median").alias("rate"), F.avg("eda_slope_per_min").alias("slope"), F.count("*").alias("n")).collect()}
    assert by["stress"].rate > by["baseline"].rate + 10
    assert by["stress"].slope > by["baseline"].slope
    # windows that straddle the change of condition are left out
    assert by["stress"].n == by["baseline"].n == 3 * 4


def test_a_fault_rejects_its_signal_and_is_tallied(spark):
    signals, runs = synthetic.wrist_cohort(spark, 2, 180.0)
    broken = signals.withColumn("samples", F.when((F.col("signal") == "EDA") & (F.col("subject_id") == "P01"), F.transform("samples", lambda v: F.lit(2.0))).otherwise(F.col("samples")))
    found = build.build(broken, runs, "wrist", 60.0, 30.0).cache()
    wide, _, dropped, tally = build.feature_table(found, 0.4)
    assert tally["EDA:flatline"] == 4 and dropped == 4
    assert wide.select("subject_id").distinct().collect() == [("P02",)]


def test_a_stricter_policy_changes_verdicts_only(spark):
    signals, runs = synthetic.wrist_cohort(spark, 1, 180.0)
    strict = quality.WRIST.changed("wrist-strict", eda_high=3.0)
    found = build.build(signals, runs, "wrist", 60.0, 30.0, {"wrist": strict}).where("signal = 'EDA' and label = 'stress'")
    assert found.select("status").distinct().collect() == [("rejected",)]
    assert found.where("name is not null").count() == 0


def test_measure_handles_what_is_not_there(spark):
    df = spark.createDataFrame([("BVP", 64.0, None), ("BVP", 64.0, []), ("other", 1.0, [1.0]), ("BVP", 64.0, synthetic.pulse(70, 30).tolist())], "signal string, rate double, samples array<double>")
    got = features.measure(df).collect()
    assert [r.codes for r in got][:3] == [["missing"], ["missing"], None]
    assert got[3]["values"]["pulse_rate_mean"] == pytest.approx(70, rel=0.05)


def test_features_know_their_signal():
    assert features.signal_of("scl_mean") == "EDA"
    assert features.signal_of("chest_scl_mean") == "chest:EDA"
    assert features.signal_of("pz_entropy") == "EEG Pz-Oz"
    assert sum(map(len, features.CHEST_FEATURES_BY_SIGNAL.values())) == 35
    with pytest.raises(KeyError):
        features.signal_of("unknown")


def test_table_to_scores(long):
    wide, names, _, _ = build.feature_table(long)
    rows = wide.withColumn("label", (F.col("label") == "stress").cast("double")).cache()
    folds = [(s, F.col("subject_id") == s) for s in ("P01", "P02")]
    found, skipped = models.evaluate(rows, names, folds, models.logistic, ["subject_id"])
    assert not skipped and metrics.score(found, []).first().balanced_accuracy > 0.9
