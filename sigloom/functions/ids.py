"""Content identifiers: a prefix and 32 hex digits of a SHA-256 over a canonical string.

The canonical string is name=value, in the order given, escaped and joined; doubles are
written as shortest round-trip text by Spark, so integers, strings and rounded decimals
are what identifiers should cover.  What an identifier leaves out (a verdict, a label) can
change without changing the identifier.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix and fields of each kind of identifier.
KINDS = {
    "rec": ("study_id", "subject_id", "modality", "sampling_rate_hz", "start_time", "duration_seconds", "channels", "device_name", "device_model", "source_uri", "source_hash"),
    "win": ("recording_id", "start_sample", "end_sample", "channels", "preprocessing_run_id"),
    "prep": ("version", "bvp_low_hz", "bvp_high_hz", "bvp_order", "eda_low_pass_hz"),
    "feat": ("name", "value", "feature_set", "feature_set_version", "channel", "source_window_ids", "transform_id"),
    "fvec": ("subject_id", "window_id", "feature_ids", "feature_names", "feature_set_version"),
    "trun": ("task", "dataset_version", "split_strategy", "train_subjects", "validation_subjects", "test_subjects", "feature_set_version", "preprocessing_version", "hyperparameters", "seed", "code_commit"),
    "model": ("name", "version", "task", "training_run_id", "expected_features", "feature_set_version", "artifact_hash"),
    "pred": ("study_id", "subject_id", "task", "start_time", "end_time", "predicted_class", "predicted_value", "probability", "model_id", "training_run_id", "feature_set_version", "feature_ids", "source_fact_ids"),
}


def text_of(value: Column) -> Column:
    """One value as text; null is empty, and the separators are escaped."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"([\\|=;])", r"\\$1")


def list_of(values: Column, ordered: bool = True) -> Column:
    """An array as text; a set is sorted first."""
    return F.array_join(F.transform(values if ordered else F.array_sort(values), text_of), ";")


def content_id(prefix: str, **fields: Column) -> Column:
    """``prefix-`` and the digest of name=value pairs in the order given."""
    canonical = F.concat_ws("|", *[F.concat(F.lit(f"{k}="), v) for k, v in fields.items()])
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(canonical, 256), 1, 32))


def id_of(kind: str, columns: dict[str, Column]) -> Column:
    """The identifier of a kind; fields not given are null, others are refused."""
    unknown = set(columns) - set(KINDS[kind])
    if unknown:
        raise ValueError(f"a {kind} identifier doesn't cover {sorted(unknown)}")
    return content_id(kind, **{k: text_of(columns[k]) if k in columns else F.lit("") for k in KINDS[kind]})


def refuse(condition: Column, message: str, value: Column) -> Column:
    """``value``, or an error where ``condition`` holds: an invariant checked while the plan runs."""
    return F.when(F.coalesce(condition, F.lit(False)), F.raise_error(F.lit(message))).otherwise(value)
