"""From signals to a feature table: window, label, judge, measure, assemble.

``signals``: subject_id, device, signal, rate, samples with one row per recording channel
(accelerometry as ACC_x, ACC_y, ACC_z), or several rows with their first_sample, as the
readers give them.  Labels filter before anything is computed, and
each channel is cut once.  Statistics run as expressions; pulse, electrocardiogram and
respiration go through one Arrow stage that judges and measures together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features, quality
from ..operators import table, windows

KEYS = ["subject_id", "device", "start_s"]
NAMES = features.FEATURES_BY_SIGNAL


def _labelled(signals: DataFrame, runs: DataFrame, length: float, stride: float) -> DataFrame:
    """Windows of every channel that lie in one labelled condition.

    The windows of a subject are numbered, labelled by a range join without samples, and
    only then cut out of the signals.
    """
    ends = signals.groupBy("subject_id", "device", "signal").agg(F.max((windows.first_sample_of(signals) + F.size("samples")) / F.col("rate")).alias("end"))
    spans = ends.groupBy("subject_id", "device").agg(F.min("end").alias("duration"))
    starts = spans.select("subject_id", "device", F.explode(windows.sliding_starts(F.col("duration"), length, stride)).alias("start_s")).withColumn("length_s", F.lit(float(length)))
    named = windows.label_windows(starts, runs, "subject_id").where("label is not null")
    return windows.cut_spans(signals, named.select("subject_id", "device", "start_s", "label"), ["subject_id", "device"], length)


def _long(df: DataFrame, codes: Column, policy: quality.Policy, values: Column, names: tuple[str, ...], signal: str, prefix: str = "") -> DataFrame:
    """One row per feature (a field of ``values``), with its signal's verdict; a rejected signal gives codes and no features."""
    judged = df.select(*KEYS, "label", codes.alias("codes"), values.alias("_v"))
    judged = judged.withColumn("status", quality.status(F.col("codes"), policy))
    pairs = F.array(*[F.struct(F.lit(prefix + n).alias("name"), F.col(f"_v.{n}").alias("value")) for n in names])
    measured = F.when(F.col("status") != "rejected", F.filter(pairs, lambda p: p["value"].isNotNull() & ~F.isnan(p["value"])))
    out = judged.select(*KEYS, "label", F.lit(signal).alias("signal"), "status", "codes", F.explode_outer(measured).alias("f"))
    return out.select(*KEYS, "label", "signal", "status", "codes", F.col("f.name").alias("name"), F.col("f.value").alias("value"))


def _axes(cut: DataFrame) -> DataFrame:
    axis = {a: F.first(F.when(F.col("signal") == f"ACC_{a}", F.col("samples")), ignorenulls=True).alias(a) for a in "xyz"}
    return cut.where(F.col("signal").startswith("ACC_")).groupBy(*KEYS, "label", "rate").agg(*axis.values())


def wrist_features(cut: DataFrame, rates: dict[str, float], policy: quality.Policy = quality.WRIST) -> DataFrame:
    """Long features of wrist windows; the pulse is charged for motion in the same window."""
    x = F.col("samples")
    acc = _axes(cut)
    xyz = (F.col("x"), F.col("y"), F.col("z"))
    moved = acc.select(*KEYS, quality.in_motion(*xyz, policy).alias("moved"))
    parts = [
        _long(cut.where("signal = 'EDA'"), quality.eda_codes(x, policy), policy, features.eda_columns(x, rates["EDA"]), NAMES["EDA"], "EDA"),
        _long(cut.where("signal = 'TEMP'"), quality.temp_codes(x, rates["TEMP"], policy), policy, features.temp_columns(x, rates["TEMP"]), NAMES["TEMP"], "TEMP"),
        _long(acc, quality.acc_codes(*xyz, policy), policy, features.acc_columns(*xyz, rates["ACC"], policy["g_scale"]), NAMES["ACC"], "ACC"),
    ]
    pulse = features.measure(cut.where("signal = 'BVP'"), {"BVP": policy}).join(moved, KEYS, "left")
    pulse = pulse.withColumn("codes", quality.with_motion(F.col("codes"), F.col("moved")))
    return _kernel_long(pulse, policy, "BVP").unionByName(parts[0]).unionByName(parts[1]).unionByName(parts[2])


def _kernel_long(measured: DataFrame, policy: quality.Policy, signal: str | None = None) -> DataFrame:
    judged = measured.withColumn("status", quality.status(F.col("codes"), policy))
    found = F.when(F.col("status") != "rejected", F.col("values"))
    out = judged.select(*KEYS, "label", (F.lit(signal) if signal else F.col("signal")).alias("signal"), "status", "codes", F.explode_outer(found).alias("name", "value"))
    return out


def chest_features(cut: DataFrame, rate: float = 700.0, policy: quality.Policy = quality.CHEST) -> DataFrame:
    """Long features of chest windows, named chest_*; movement is charged to no signal."""
    x = F.col("samples")
    acc = _axes(cut)
    xyz = (F.col("x"), F.col("y"), F.col("z"))
    parts = [
        _kernel_long(features.measure(cut.where("signal in ('ECG', 'Resp')"), {"ECG": policy, "Resp": policy}), policy),
        _long(cut.where("signal = 'EDA'"), quality.eda_codes(x, policy), policy, features.eda_columns(x, rate), NAMES["EDA"], "EDA", "chest_"),
        _long(cut.where("signal = 'Temp'"), quality.temp_codes(x, rate, policy), policy, features.temp_columns(x, rate), NAMES["TEMP"], "Temp", "chest_"),
        _long(cut.where("signal = 'EMG'"), quality.emg_codes(x), policy, features.emg_columns(x), features.CHEST_FEATURES_BY_SIGNAL["EMG"], "EMG"),
        _long(acc, quality.acc_codes(*xyz, policy), policy, features.acc_columns(*xyz, rate, policy["g_scale"]), NAMES["ACC"], "ACC", "chest_"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sleep_features(epochs: DataFrame, policy: quality.Policy = quality.SLEEP, rate: float = 100.0) -> DataFrame:
    """Long features of scored 30-second epochs: subject_id, device (the night), start_s, label (the stage), signal, rate, samples."""
    x = F.col("samples")
    spectral = features.measure(epochs.where("signal <> 'EMG submental'"), dict.fromkeys(features.KERNEL_SIGNALS, policy))
    chin = epochs.where("signal = 'EMG submental'")
    codes = F.when(F.size(x) < 4, F.array(F.lit("too_short"))).when(quality.a.missing(x), F.array(F.lit("missing"))).otherwise(quality.flat_codes(x, 0.0, policy["flat_sd"] / 10))
    return _kernel_long(spectral, policy).unionByName(_long(chin, codes, policy, features.emg_columns(x, "chin_emg"), features.SLEEP_FEATURES_BY_CHANNEL["EMG submental"], "EMG submental"))


def build(signals: DataFrame, runs: DataFrame, device: str, length: float = 60.0, stride: float = 5.0, policies: dict[str, quality.Policy] | None = None) -> DataFrame:
    """Long features of one device's labelled windows.  Write the result before you assemble it: three readers follow."""
    rates = {"EDA": 4.0, "TEMP": 4.0, "ACC": 32.0}
    chosen = (policies or {}).get(device, quality.WRIST if device == "wrist" else quality.CHEST)
    cut = _labelled(signals.where(F.col("device") == device), runs, length, stride)
    return wrist_features(cut, rates, chosen) if device == "wrist" else chest_features(cut, 700.0, chosen)


def feature_table(long: DataFrame, min_coverage: float = 0.9) -> tuple[DataFrame, list[str], int, dict[str, int]]:
    """Wide table, feature names, rows dropped, and the tally of quality codes.

    A window of two devices is one row: device is not part of its key.
    """
    keys = ["subject_id", "start_s", "label"]
    wide, names, dropped = table.assemble(long.where("name is not null"), keys, min_coverage, rows=long)
    verdicts = long.select(*KEYS, "signal", "codes").distinct()
    named = verdicts.select(F.when(F.col("device") == "chest", F.concat(F.lit("chest:"), "signal")).otherwise(F.col("signal")).alias("signal"), "codes")
    tally = {r["code"]: r["n"] for r in table.tally(named, "signal", "codes").collect()}  # one row per code
    return wide, names, dropped, tally


def sleep_epochs(signals: DataFrame, hypnogram: DataFrame, epoch: float = 30.0) -> DataFrame:
    """Scored epochs of each channel of a night: signals (subject_id, night, signal, rate, samples, maybe first_sample) cut by hypnogram rows."""

    def span(start: Column, rate: Column) -> tuple[Column, Column]:
        return F.bround(start * rate).cast("long"), F.bround((start + F.lit(epoch)) * rate).cast("long")

    scored = hypnogram.where("stage is not null").select("subject_id", "night", (F.col("epoch_idx") * F.lit(epoch)).alias("start_s"), F.col("stage").alias("label"))
    cut = windows.cut_spans(signals, scored, ["subject_id", "night"], epoch, span)
    # nights are a day apart, so that time orders a subject's epochs
    start = F.col("night") * F.lit(86_400.0) + F.col("start_s")
    return cut.select("subject_id", F.col("night").cast("string").alias("device"), start.alias("start_s"), "label", "signal", "rate", "samples")
