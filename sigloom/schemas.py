"""Schemas of the tables that the library makes, and the invariants that hold in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is measured, at which rate per device, and the codes of the label track.
MODALITIES = ("eeg", "bvp", "eda", "ecg", "temp", "acc", "resp", "eog", "emg", "spo2")
WRIST_RATES = {"ACC": 32.0, "BVP": 64.0, "EDA": 4.0, "TEMP": 4.0}
CHEST_RATES = dict.fromkeys(("ACC", "ECG", "EMG", "EDA", "Temp", "Resp"), 700.0)
SIGNAL_MODALITY = {"ACC": "acc", "BVP": "bvp", "EDA": "eda", "TEMP": "temp", "Temp": "temp", "ECG": "ecg", "EMG": "emg", "Resp": "resp"}
LABEL_RATE = 700.0
LABELS = {1: "baseline", 2: "stress", 3: "amusement", 4: "meditation"}
AXES = ("x", "y", "z")

RECORDINGS = "recording_id string, study_id string, subject_id string, modality string, sampling_rate_hz double, start_time timestamp, duration_seconds double, channels array<string>, units array<string>, device_name string, device_model string, source_uri string, source_hash string, source_fact_ids array<string>, metadata map<string,string>"
SIGNALS = "recording_id string, subject_id string, signal string, rate double, chunk int, first_sample bigint, samples array<double>"
LABEL_RUNS = "subject_id string, code int, label string, begin_s double, end_s double"
WINDOWS = "window_id string, recording_id string, subject_id string, signal string, epoch_idx int, start_s double, length_s double, start_sample bigint, end_sample bigint, start_time timestamp, label string, preprocessing_run_id string, qc_status string, qc_codes array<string>, qc_policy_version string"
FEATURES = "feature_id string, subject_id string, window_id string, name string, value double, unit string, feature_set string, feature_set_version string"
FACTS = "fact_id string, study_id string, subject_id string, field string, value string, transform_id string, derived_from array<string>, supersedes string, reason string, source_record_ref string, recorded_at timestamp"

#: Invariants by table: what must hold of a row, and what is said when it doesn't.
INVARIANTS = {
    "recordings": {
        "sampling_rate_hz > 0": "a recording needs a positive rate",
        "size(units) = 0 or size(units) = size(channels)": "as many units as channels, or none",
    },
    "windows": {
        "end_sample > start_sample": "a window holds samples",
        "qc_status <> 'rejected' or size(qc_codes) > 0": "a rejected window has a reason",
    },
    "features": {"window_id is not null": "a feature names its window", "feature_set_version is not null": "a feature names its version"},
    "vectors": {"size(feature_names) > 0": "a vector holds features", "size(feature_names) = size(feature_ids)": "a name for every feature"},
    "predictions": {
        "predicted_class is not null or predicted_value is not null": "a prediction predicts something",
        "end_time > start_time": "a prediction covers time",
        "probability is null or probability between 0 and 1": "a probability lies in 0 to 1",
        "size(source_window_ids) > 0": "a prediction names its windows",
        "coalesce(model_id, '') <> '' and coalesce(training_run_id, '') <> '' and coalesce(feature_set_version, '') <> ''": "a prediction names model, run and feature set",
    },
}


def channels_of(signal: str) -> list[str]:
    return [f"{signal}_{axis}" for axis in AXES] if signal == "ACC" else [signal]


def rate_of(signal: str, device: str) -> float:
    table = {"wrist": WRIST_RATES, "chest": CHEST_RATES}
    if device not in table or signal not in table[device]:
        raise KeyError(f"no signal {signal} on device {device}")
    return table[device][signal]


def checked(df: DataFrame, table: str) -> DataFrame:
    """``df`` whose rows raise an error when they break an invariant of ``table``."""
    out = df
    for rule, message in INVARIANTS[table].items():
        broken = ~F.coalesce(F.expr(rule), F.lit(True))
        out = out.where(F.when(broken, F.raise_error(F.lit(f"{table}: {message}")).cast("boolean")).otherwise(F.lit(True)))
    return out


def violations(df: DataFrame, table: str) -> DataFrame:
    """Rows that break an invariant, with ``broken`` (the messages); nothing is raised."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(rule), F.lit(True)), F.lit(message)) for rule, message in INVARIANTS[table].items()]))
    return df.withColumn("broken", found).where(F.size("broken") > 0)
