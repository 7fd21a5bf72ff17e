import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom import schemas
from sigloom.functions import arrays, features, ids, quality
from sigloom.operators import compare, enrolment, lineage, metrics, models, splits, table, windows


def column(spark, values, expression):
    df = spark.createDataFrame([(list(map(float, values)),)], "x array<double>")
    return df.select(expression(F.col("x")).alias("v")).first()["v"]


def test_array_statistics_agree_with_numpy(spark):
    x = np.random.default_rng(0).normal(5, 2, 50)
    assert column(spark, x, arrays.mean) == pytest.approx(x.mean())
    assert column(spark, x, arrays.sd) == pytest.approx(x.std())
    assert column(spark, x, lambda c: arrays.sd(c, 1)) == pytest.approx(x.std(ddof=1))
    assert column(spark, x, lambda c: arrays.percentile(c, 0.95)) == pytest.approx(np.percentile(x, 95))
    assert column(spark, x, arrays.diff) == pytest.approx(np.diff(x))
    h = column(spark, x, arrays.hjorth)
    assert h["mobility"] == pytest.approx(np.sqrt(np.diff(x).var() / x.var()))
    assert column(spark, x, lambda c: arrays.moving_average(c, 5))[0] == pytest.approx(np.mean([x[0]] * 3 + list(x[1:3])))


def test_variance_does_not_cancel(spark):
    x = 1e9 + np.arange(10.0)
    assert column(spark, x, arrays.variance) == pytest.approx(8.25)


def test_missing_is_looked_for_first(spark):
    for x in ([], [1.0, float("nan")], [float("inf")]):
        assert column(spark, x, arrays.missing) is True
    assert column(spark, [1.0, float("nan")], quality.eda_codes) == ["missing"]
    assert column(spark, [], quality.eda_codes) == ["flatline"]
    assert column(spark, [], lambda c: quality.temp_codes(c, 4.0)) == ["missing"]


def test_flat_conductance_has_no_responses(spark):
    found = column(spark, [2.0] * 240, lambda c: features.eda_columns(c, 4.0)["scr_count_per_min"])
    assert found == 0


def test_short_windows_have_no_features(spark):
    assert column(spark, [1.0, 2.0, 3.0], lambda c: features.eda_columns(c, 4.0)["eda_mean"]) is None
    assert column(spark, [1.0], lambda c: features.temp_columns(c, 4.0)["temp_mean"]) is None


def test_acceleration_rules(spark):
    df = spark.createDataFrame([([128.0] * 9 + [1.0],) * 3, ([1.0] * 10,) * 3, ([1.0], [1.0], None)], "x array<double>, y array<double>, z array<double>")
    codes = [r[0] for r in df.select(quality.acc_codes(F.col("x"), F.col("y"), F.col("z"))).collect()]
    assert codes == [["saturated"], ["flatline"], ["missing_axes"]]


def test_status_and_revision(spark):
    df = spark.createDataFrame([(["motion"],), (["flatline", "motion"],), ([],)], "c array<string>")
    assert [r[0] for r in df.select(quality.status(F.col("c"), quality.WRIST)).collect()] == ["warning", "rejected", "valid"]
    assert quality.WRIST.changed("wrist-2", eda_jump=0.5)["eda_jump"] == 0.5


def test_windows_that_fit(spark):
    df = spark.createDataFrame([("a", 4.0, [float(i) for i in range(41)])], "s string, rate double, samples array<double>")
    got = windows.cut_windows(df, 5.0, 2.5, ["s"]).collect()
    assert [(r.start_sample, r.end_sample) for r in got] == [(0, 20), (10, 30), (20, 40)]
    assert got[1].samples[0] == 10.0
    with pytest.raises(ValueError):
        windows.sliding_starts(F.lit(1.0), 5.0, 6.0)


def test_labels_are_unanimous_or_nothing(spark):
    w = spark.createDataFrame([("a", 0.0, 10.0), ("a", 5.0, 10.0), ("a", 20.0, 10.0)], "s string, start_s double, length_s double")
    runs = spark.createDataFrame([("a", 0.0, 10.0, "rest"), ("a", 10.0, 20.0, "stress"), ("a", 20.0, 25.0, "rest"), ("a", 25.0, 40.0, None)], "s string, begin_s double, end_s double, label string")
    got = {r.start_s: r.label for r in windows.label_windows(w, runs, "s").collect()}
    assert got == {0.0: "rest", 5.0: None, 20.0: None}


def test_context_never_crosses_a_run(spark):
    df = spark.createDataFrame([("a", 0, i, float(i)) for i in range(3)] + [("a", 1, 9, 90.0)], "s string, run int, t int, v double")
    got = {r.t: r for r in windows.with_context(df, ["s", "run"], ["t"], ["v"]).collect()}
    assert (got[0].v_prev1, got[0].v_next1, got[2].v_next2) == (0.0, 1.0, 2.0)
    assert got[0].v_mean5 == pytest.approx((0 + 0 + 0 + 1 + 2) / 5)
    assert got[9].v_prev1 == got[9].v_mean5 == 90.0


def test_covered_minutes_counts_overlap_once(spark):
    df = spark.createDataFrame([("a", t) for t in (0.0, 5.0, 10.0, 300.0)], "s string, t double")
    assert windows.covered_minutes(df, ["s"], "t", 60.0).first()["minutes"] == pytest.approx((70 + 60) / 60)


def test_later_annotations_overwrite_and_movement_is_unscored(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 90.0, "Sleep stage W"), (1, 1, 30.0, 30.0, "Sleep stage 4"), (1, 2, 60.0, 30.0, "Movement time")], "n int, seq int, onset_s double, duration_s double, text string")
    from sigloom.sources.sleep import STAGES

    got = {r.epoch_idx: r.stage for r in windows.expand_annotations(df, ["n"], STAGES).collect()}
    assert got == {0: "W", 1: "N3", 2: None}


def test_assemble_drops_rows_and_says_so(spark):
    rows = [(i, n, float(i)) for i in range(10) for n in ("a", "b") if not (n == "b" and i == 0)] + [(0, "rare", 1.0), (1, "a2", float("nan"))]
    long = spark.createDataFrame(rows, "k int, name string, value double")
    wide, names, dropped = table.assemble(long, ["k"], 0.9)
    assert names == ["a", "b"] and dropped == 1 and wide.count() == 9
    with pytest.raises(ValueError):
        table.assemble(long, ["k"], 1.1)


def test_tables_refuse_what_does_not_match(spark):
    one = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(KeyError):
        table.select_features(one, ["a"], ["c"])
    with pytest.raises(ValueError):
        table.select_features(one, ["a"], [])
    with pytest.raises(ValueError):
        table.concat_tables([one, one.select("b", "a")], ["1", "1"])
    with pytest.raises(ValueError):
        table.concat_tables([one, one], ["1", "2"])
    with pytest.raises(ValueError):
        table.fuse(one, one, ["a"])
    assert table.concat_tables([one, one], ["1", "1"]).count() == 2


@pytest.mark.parametrize("make", [lambda s: splits.leave_one_out(s), lambda s: splits.group_folds(s, 3, 1).withColumn("role", F.lit("test")).select("fold", "subject_id", "role")])
def test_no_subject_on_both_sides(spark, make):
    subjects = spark.createDataFrame([(f"S{i}",) for i in range(12)], "subject_id string")
    got = make(subjects)
    assert got.groupBy("fold", "subject_id").agg(F.countDistinct("role").alias("n")).where("n > 1").count() == 0
    assert got.where("role = 'test'").select("subject_id").distinct().count() == 12


def test_subjects_sort_by_number(spark):
    subjects = spark.createDataFrame([("S10",), ("S9",), ("SC1",), ("ST1",), ("S1",)], "subject_id string")
    assert [r.subject_id for r in splits.numbered(subjects).orderBy("place").collect()] == ["S1", "S9", "S10", "SC1", "ST1"]


def test_split_refusals(spark):
    one = spark.createDataFrame([("S1",)], "subject_id string")
    for call in (lambda: splits.leave_one_out(one), lambda: splits.group_folds(one, 2, 0), lambda: splits.held_out_cohort(one, 0.3, 0), lambda: splits.cohort_split(one, "S", "S1"), lambda: splits.cohort_split(one, "S1", "T")):
        with pytest.raises(ValueError):
            call()


def test_constant_model_scores_half_and_no_agreement(spark):
    p = spark.createDataFrame([(1 if i < 30 else 0, 0, 0.3) for i in range(100)], "truth int, predicted int, probability double")
    got = metrics.score(p, []).first()
    assert (got.balanced_accuracy, got.kappa, got.roc_auc) == (0.5, 0.0, 0.5)
    assert got.ece == pytest.approx(0.0) and got.average_precision == pytest.approx(0.3)


def test_calibration_bins_close_above(spark):
    p = spark.createDataFrame([(1, 0.0), (0, 0.1), (1, 0.2), (1, 0.3), (1, 1.0)], "truth int, probability double")
    got = {r.bin: r.n for r in metrics.calibration_bins(p, []).collect()}
    assert got == {0: 2, 1: 1, 2: 1, 9: 1}


def test_one_class_has_no_area(spark):
    p = spark.createDataFrame([(1, 1, 0.4)], "truth int, predicted int, probability double")
    assert metrics.roc_auc(p, []).first().roc_auc is None


def test_bootstrap_repeats_from_its_seed():
    x = [0.1, 0.2, -0.05, 0.3, 0.15, 0.2]
    one = compare.bootstrap(x, 2000, 7)
    assert one == compare.bootstrap(x, 2000, 7)
    assert one["low"] < one["mean"] < one["high"]
    assert compare.verdict(compare.bootstrap([-0.1, 0.1, 0.0, 0.05, -0.05], 500)) == "no difference shown"
    with pytest.raises(ValueError):
        compare.bootstrap([0.1])


def session(spark):
    rows = [("a", float(t), "stress" if 600 <= t < 900 else "rest", t // 5) for t in range(0, 1200, 5)]
    return spark.createDataFrame(rows, "s string, t double, label string, i int")


@pytest.mark.parametrize("strategy", [s for s in enrolment.STRATEGIES if s != "cross_session"])
def test_enrolment_leaves_a_margin(spark, strategy):
    got = enrolment.enrol(session(spark), "s", "t", "label", 0.2, strategy, tie=["i"]).collect()
    inside = [r.t for r in got if r.part == "enrol"]
    outside = [r.t for r in got if r.part == "evaluate"]
    assert inside and outside
    if strategy == "prospective":
        assert min(outside) > max(inside) + 60 and max(inside) == 600
    else:
        assert min(abs(a - b) for a in inside for b in outside) >= 60


def test_enrolment_refusals(spark):
    for bad in ({"strategy": "other"}, {"fraction": 1.0}):
        with pytest.raises(ValueError):
            enrolment.enrol(session(spark), "s", "t", "label", **({"fraction": 0.1} | bad))


def test_content_ids_cover_what_they_say(spark):
    df = spark.createDataFrame([("r1", 0, 10, "EDA"), ("r1", 0, 10, "EDA"), ("r1", 0, 11, "EDA"), ("r1|x", 0, 10, "EDA")], "r string, a int, b int, c string")
    got = [r[0] for r in df.select(ids.id_of("win", {"recording_id": F.col("r"), "start_sample": F.col("a"), "end_sample": F.col("b"), "channels": F.col("c")})).collect()]
    assert got[0] == got[1] and len(set(got)) == 3 and got[0].startswith("win-") and len(got[0]) == 36
    with pytest.raises(ValueError):
        ids.id_of("win", {"label": F.lit("x")})


def test_invariants_raise_or_list(spark):
    df = spark.createDataFrame([(4.0, ["EDA"], ["uS"]), (0.0, ["EDA"], ["uS", "V"])], "sampling_rate_hz double, channels array<string>, units array<string>")
    assert len(schemas.violations(df, "recordings").first().broken) == 2
    with pytest.raises(Exception, match="positive rate|units"):
        schemas.checked(df, "recordings").collect()
    with pytest.raises(KeyError):
        schemas.rate_of("BVP", "chest")


def test_invalidation_reaches_any_source(spark):
    rejected = spark.createDataFrame([("w1",)], "window_id string")
    feats = spark.createDataFrame([("f1", ["w1", "w2"]), ("f2", ["w3"])], "feature_id string, source_window_ids array<string>")
    preds = spark.createDataFrame([("p1", ["f1"], ["w2"], ["x"]), ("p2", ["f2"], ["w1"], ["y"]), ("p3", ["f2"], ["w3"], ["z"])], "prediction_id string, feature_ids array<string>, source_window_ids array<string>, source_fact_ids array<string>")
    got = {(r.layer, r.id) for r in lineage.invalidated(rejected, feats, preds).collect()}
    assert got == {("window", "w1"), ("feature", "f1"), ("prediction", "p1"), ("prediction", "p2"), ("fact", "x"), ("fact", "y")}


def test_supersession_chain_and_cycle(spark):
    facts = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", None)], "fact_id string, supersedes string")
    assert {r.fact_id: r.latest_id for r in lineage.latest(facts).collect()} == {"a": "c", "b": "c", "c": "c", "d": "d"}
    ring = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b")], "fact_id string, supersedes string")
    with pytest.raises(ValueError):
        lineage.latest(ring, max_rounds=5)


def test_references_round_trip(spark):
    ref = lineage.source_reference({"prediction": F.lit("p1"), "model": F.lit("m")})
    assert spark.range(1).select(lineage.parse_reference(ref).alias("m")).first().m == {"prediction": "p1", "model": "m"}


def test_a_model_refuses_other_features():
    lineage.accepts(["a", "b"], "1", ["a", "b"], "1")
    for names, version in ((["b", "a"], "1"), (["a"], "1"), (["a", "b"], "2")):
        with pytest.raises(ValueError):
            lineage.accepts(["a", "b"], "1", names, version)


def cohort(spark):
    rng = np.random.default_rng(0)
    rows = [(f"S{s}", float(y), float(y + rng.normal(0, 0.4)), float(rng.normal())) for s in range(6) for y in (0, 1) for _ in range(20)]
    return spark.createDataFrame(rows, "subject_id string, label double, a double, b double").cache()


def test_evaluation_learns_and_skips(spark):
    rows = cohort(spark)
    folds = [("S0", F.col("subject_id") == "S0"), ("none", (F.col("subject_id") == "S1") & (F.col("label") == 1))]
    found, skipped = models.evaluate(rows, ["a", "b"], folds, models.logistic, ["subject_id"])
    assert skipped == ["none"]
    assert metrics.score(found, []).first().roc_auc > 0.9


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_calibration_stays_a_probability(spark, method):
    rows = cohort(spark)
    found, _ = models.evaluate(rows, ["a", "b"], [("S0", F.col("subject_id") == "S0")], models.logistic, ["subject_id"], models.grouped_calibration(method, "subject_id", 3))
    p = [r.probability for r in found.collect()]
    assert 0 <= min(p) <= max(p) <= 1 and len(set(p)) > 2


def test_digests_follow_parameters(spark):
    rows = models.balanced(cohort(spark))
    one = models.logistic(["a", "b"], 10).fit(rows)
    assert models.parameter_digest(one) == models.parameter_digest(models.logistic(["a", "b"], 10).fit(rows))
    assert models.parameter_digest(one) != models.parameter_digest(models.logistic(["a", "b"], 1000).fit(rows))


def test_runs_and_artifacts_are_named_by_what_they_are(spark):
    sides = spark.createDataFrame([(0, "S1", "train"), (0, "S2", "test"), (1, "S2", "train"), (1, "S1", "test")], "fold int, subject_id string, role string")
    runs = lineage.training_runs(sides, "stress", "d1", "loso", "1.3", "p1", {"c": 1}, 0)
    got = lineage.model_artifacts(runs, "logistic", "1", "stress", ["a", "b"], "1.3", "x").collect()
    assert len({r.training_run_id for r in got}) == len({r.model_id for r in got}) == 2
    assert [r.training_run_id for r in lineage.training_runs(sides, "stress", "d1", "loso", "1.3", "p1", {"c": 1}, 0).collect()] == [r.training_run_id for r in got]
    both = spark.createDataFrame([(0, "S1", "train"), (0, "S1", "test")], "fold int, subject_id string, role string")
    with pytest.raises(Exception, match="wasn't trained on"):
        lineage.training_runs(both, "stress", "d1", "loso", "1.3", "p1", {}, 0).collect()


def test_a_replacement_cites_what_is_in_force(spark):
    schema = "fact_id string, study_id string, subject_id string, field string, value string, transform_id string, derived_from array<string>, supersedes string, reason string, source_record_ref string"
    facts = spark.createDataFrame([("a", "X", "S1", "balance", "1", None, None, None, None, ""), ("b", "X", "S1", "balance", "2", None, None, "a", "typing", ""), ("m", "X", "S1", "stress", "0", "t", ["a"], None, None, "r")], schema)
    stale = lineage.stale_predictions(facts, ["stress"], lineage.latest(facts))
    new = lineage.replacements(stale, spark.createDataFrame([("m", "1")], "fact_id string, value string"), facts).first()
    assert (new.supersedes, new.derived_from, new.value) == ("m", ["b"], "1") and "balance 1 to 2" in new.reason


def test_pieces_of_a_sequence(spark):
    df = spark.createDataFrame([("a", t) for t in (0.0, 30.0, 60.0, 200.0, 500.0, 530.0)], "s string, t double")
    assert sorted(r.t for r in windows.sequence_pieces(df, ["s"], "t").collect()) == [0.0, 30.0, 60.0, 500.0, 530.0]


def test_fused_versions():
    assert features.fused_version("wrist", "chest") == "1.3+chest-1.0"
    assert (features.unit_of("chest_hr_mean"), features.unit_of("fpz_entropy")) == ("bpm", "")
