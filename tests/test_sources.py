import datetime as dt
import pickle
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom import schemas
from sigloom.plans import build, synthetic
from sigloom.sources import archive, edf, sleep, store


def write_night(folder, name="SC4011E0", stages=(("Sleep stage W", 60.0), ("Sleep stage 2", 60.0), ("Sleep stage 4", 30.0))):
    rng = np.random.default_rng(0)
    seconds = int(sum(d for _, d in stages))
    wave = np.concatenate([synthetic.sleep_wave(sleep.STAGES.get(s, "W"), d, rng) for s, d in stages])
    channels = [(c, "uV", 3000, wave if "EEG" in c else rng.normal(0, 10, seconds * 100)) for c in sleep.CHANNELS]
    edf.write_edf(f"{folder}/{name}-PSG.edf", channels, 30.0)
    at, notes = 0.0, []
    for stage, d in stages:
        notes.append((at, d, stage))
        at += d
    edf.write_edf(f"{folder}/{name[:7]}C-Hypnogram.edf", [], 0.0, notes)
    return wave


def test_signals_round_trip(spark, tmp_path):
    wave = write_night(tmp_path)
    spark.dataSource.register(edf.EdfSource)
    rows = spark.read.format("edf").option("path", f"{tmp_path}/*PSG.edf").option("channels", "EEG Fpz-Cz").option("records", "2").load().orderBy("first_record").collect()
    assert [r.signal for r in rows] == ["EEG Fpz-Cz"] * 3 and [r.first_sample for r in rows] == [0, 6000, 12000]
    assert rows[0].rate == 100.0
    assert np.abs(np.concatenate([r.samples for r in rows]) - np.clip(wave, -100, 100)).max() < 0.03
    whole = edf.read_edf(spark, str(tmp_path), channels=["EEG Fpz-Cz"]).where("signal is not null").first()
    assert whole.samples == [x for r in rows for x in r.samples]


def test_annotations_both_ways(spark, tmp_path):
    write_night(tmp_path)
    spark.dataSource.register(edf.EdfSource)
    got = spark.read.format("edf").option("path", f"{tmp_path}/*Hypnogram.edf").option("table", "annotations").load().orderBy("seq").collect()
    assert [(r.onset_s, r.duration_s, r.text) for r in got] == [(0.0, 60.0, "Sleep stage W"), (60.0, 60.0, "Sleep stage 2"), (120.0, 30.0, "Sleep stage 4")]
    assert edf.read_edf(spark, str(tmp_path), "annotations").where("text is not null").count() == 3


def test_header_rules(tmp_path):
    assert edf.start_time("01.02.84", "03.04.05") == dt.datetime(2084, 2, 1, 3, 4, 5, tzinfo=dt.UTC)
    assert edf.start_time("01.02.85", "03.04.05").year == 1985
    assert edf.start_time("xx.02.85", "03.04.05") is None
    path = f"{tmp_path}/a.edf"
    edf.write_edf(path, [("A", "uV", 10, np.zeros(50))], 1.0, declared=9)
    with pytest.raises(edf.EdfError, match="truncated"):
        edf.EdfReader.header(path)
    edf.write_edf(path, [("A", "uV", 10, np.zeros(50))], 1.0, declared=-1)
    assert edf.EdfReader.header(path).records == 5
    with pytest.raises(edf.EdfError):
        edf.parse_header(b"x", 1)


def test_annotation_lists():
    data = b"+0\x14\x14\x00+1.5\x152\x14one\x14two\x14\x00bad\x14x\x14\x00+3\x15z\x14late\x14\x00"
    assert list(edf.tals(data)) == [(1.5, 2.0, "one"), (1.5, 2.0, "two"), (3.0, 0.0, "late")]


def test_a_broken_file_is_a_row_not_a_failure(spark, tmp_path):
    write_night(tmp_path)
    (tmp_path / "SC4021E0-PSG.edf").write_bytes(b"not a recording")
    parsed = edf.read_edf(spark, str(tmp_path))
    files = sleep.list_files(spark, str(tmp_path))
    got = {r.file: r.problem for r in sleep.verify(files, parsed).collect()}
    assert "SC4021E0-PSG.edf" in got
    assert sleep.nights(files).select("subject_id", "night").collect() == [("SC01", 1)]


def test_sleep_night_to_features(spark, tmp_path):
    write_night(tmp_path)
    hyp = sleep.hypnograms(edf.read_edf(spark, str(tmp_path), "annotations").where("text is not null"))
    assert {r.epoch_idx: r.stage for r in hyp.collect()} == {0: "W", 1: "W", 2: "N2", 3: "N2", 4: "N3"}
    signals = sleep.parsed_names(edf.read_edf(spark, str(tmp_path)).where("signal is not null"))
    long = build.sleep_features(build.sleep_epochs(signals, hyp)).cache()
    wide, names, dropped, _ = build.feature_table(long)
    assert len(names) == 48 and dropped == 0 and wide.count() == 5
    top = {r.label: max((r[f"fpz_{b}_rel"], b) for b in ("delta", "theta", "alpha", "sigma", "beta"))[1] for r in wide.collect()}
    assert top == {"W": "alpha", "N2": "sigma", "N3": "delta"}


def write_archive(path, subjects=2):
    with zipfile.ZipFile(path, "w") as z:
        for k in range(1, subjects + 1):
            rng = np.random.default_rng(k)
            wrist = {"ACC": rng.normal(0, 1, (320, 3)), "BVP": rng.normal(0, 1, (640, 1)), "EDA": rng.normal(2, 0.1, (40, 1)), "TEMP": rng.normal(33, 0.1, (40, 1))}
            chest = {"ECG": rng.normal(0, 1, (7000, 1))}
            label = np.repeat([1, 0, 2], [3500, 1400, 2100])
            z.writestr(f"D/S{k + 8}/S{k + 8}.pkl", pickle.dumps({"signal": {"wrist": wrist, "chest": chest}, "label": label}))


def test_archive_reads_members_and_labels(spark, tmp_path):
    path = f"{tmp_path}/a.zip"
    write_archive(path)
    spark.dataSource.register(archive.WearableSource)
    rows = spark.read.format("wearable_zip").option("path", path).load()
    assert {r.signal for r in rows.where("device = 'wrist'").select("signal").distinct().collect()} == {"ACC_x", "ACC_y", "ACC_z", "BVP", "EDA", "TEMP"}
    assert rows.where("signal = 'ECG'").select(F.sum(F.size("samples"))).first()[0] == 14_000
    one = spark.read.format("wearable_zip").option("path", path).option("subjects", "S10").option("devices", "wrist").load()
    assert {r.subject_id for r in one.select("subject_id").distinct().collect()} == {"S10"}
    labels = spark.read.format("wearable_zip").option("path", path).option("table", "labels").load().where("subject_id = 'S9'").orderBy("begin_s").collect()
    assert [(r.code, r.label, r.begin_s, r.end_s) for r in labels] == [(1, "baseline", 0.0, 5.0), (0, None, 5.0, 7.0), (2, "stress", 7.0, 10.0)]


def test_pickles_may_only_hold_arrays():
    import os

    x = np.arange(4.0)
    assert np.array_equal(archive.load_arrays(pickle.dumps({"a": x}))["a"], x)
    with pytest.raises(pickle.UnpicklingError):
        archive.load_arrays(pickle.dumps(os.getcwd))


def test_archive_subjects_in_number_order():
    assert list(archive.subjects_of(["x/S10/S10.pkl", "x/S9/S9.pkl", "x/S9/other.csv"])) == ["S9", "S10"]


def test_tables_round_trip_and_older_files_load(spark, tmp_path):
    df = spark.createDataFrame([("S1", "rest", 1.5)], "subject_id string, label string, f double")
    store.save_table(df, f"{tmp_path}/t", ["f"], "1.3", "p", 2, 60.0, {"EDA:flatline": 1})
    rows, meta = store.load_table(spark, f"{tmp_path}/t")
    assert meta["feature_names"] == ["f"] and meta["dropped_incomplete"] == 2 and meta["qc_codes"] == {"EDA:flatline": 1}
    assert rows.first().f == 1.5 and rows.first().vector_id is None


def test_facts_only_grow(spark, tmp_path):
    facts = store.FactStore(spark, f"{tmp_path}/facts", schemas.FACTS)
    first = spark.createDataFrame([("a", "S", "1", "balance", "1")], "fact_id string, study_id string, subject_id string, field string, value string")
    empty = {"transform_id": F.lit("t"), "derived_from": F.lit(None).cast("array<string>"), "supersedes": F.lit(None).cast("string"), "reason": F.lit(None).cast("string"), "source_record_ref": F.lit(""), "recorded_at": F.lit(None).cast("timestamp")}
    facts.append(first.withColumns(empty))
    second = first.withColumns(empty | {"fact_id": F.lit("b"), "supersedes": F.lit("a"), "reason": F.lit("typing error")})
    facts.append(second)
    facts.append(first.withColumns(empty | {"fact_id": F.lit("m"), "field": F.lit("stress"), "derived_from": F.array(F.lit("b"))}))
    assert {r.fact_id: r.depth for r in facts.lineage("m").collect()} == {"m": 0, "b": 1, "a": 2}
    with pytest.raises(Exception, match="needs a reason"):
        facts.append(second.withColumns({"fact_id": F.lit("c"), "reason": F.lit(None).cast("string")}))


def test_fixed_width_holds_every_row(spark):
    assert len(store.fixed_width(spark.range(1500), ["id"]).splitlines()) == 1501


def test_fixed_width(spark):
    text = store.fixed_width(spark.createDataFrame([("a", 1.0), ("bb", None)], "name string, v double"), ["name", "v"])
    assert text.splitlines() == ["name      v", "   a  1.000", "  bb      -"]


def test_nights_are_cut_to_their_sleep(spark):
    hyp = spark.createDataFrame([("SC01", 1, i, "N2" if 10 <= i < 14 else "W") for i in range(30)], "subject_id string, night int, epoch_idx long, stage string")
    signals = spark.createDataFrame([("SC01", 1, "EEG", 2.0, None, [float(i) for i in range(30 * 60)])], "subject_id string, night int, signal string, rate double, start_time timestamp, samples array<double>")
    cut, kept = sleep.trimmed_nights(signals, hyp, 2)
    row = cut.select("samples", F.unix_seconds("start_time").alias("t")).first()
    assert (row.samples[0], row.samples[-1], row.t) == (8 * 60.0, 16 * 60 - 1.0, 240)
    assert sorted(r.epoch_idx for r in kept.collect()) == list(range(8))
