"""Traceable predictions: export, what does not resolve, what a revision invalidates, facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids


def export_predictions(scored: DataFrame, study: str, task: str, model_id: str, run_id: str, version: str, length: float) -> DataFrame:
    """Predictions with both halves of their lineage.

    ``scored``: subject_id, start_time (null falls back to seconds since 1970 in start_s),
    start_s, predicted, probability, vector_id, window_ids, feature_ids, fact_ids.
    """
    begin = F.coalesce("start_time", F.timestamp_micros((F.col("start_s") * 1_000_000).cast("long")))
    out = scored.select(
        F.lit(study).alias("study_id"),
        "subject_id",
        F.lit(task).alias("task"),
        begin.alias("start_time"),
        (begin + F.make_dt_interval(secs=F.lit(float(length)))).alias("end_time"),
        F.col("predicted").cast("string").alias("predicted_class"),
        F.lit(None).cast("double").alias("predicted_value"),
        "probability",
        F.lit(model_id).alias("model_id"),
        F.lit(run_id).alias("training_run_id"),
        F.lit(version).alias("feature_set_version"),
        "vector_id",
        F.col("window_ids").alias("source_window_ids"),
        "feature_ids",
        F.col("fact_ids").alias("source_fact_ids"),
    )
    covered = {k: F.col(k) for k in ("study_id", "subject_id", "task", "predicted_class", "model_id", "training_run_id", "feature_set_version")}
    times = {k: F.unix_micros(k).cast("string") for k in ("start_time", "end_time")}
    numbers = {"probability": F.format_string("%.9f", "probability")}
    columns = {k: ids.text_of(v) for k, v in (covered | times | numbers).items()}
    columns |= {"feature_ids": ids.list_of(F.col("feature_ids"), ordered=False), "source_fact_ids": ids.list_of(F.col("source_fact_ids"), ordered=False)}
    fields = {k: columns.get(k, F.lit("")) for k in ids.KINDS["pred"]}
    return out.withColumn("prediction_id", ids.content_id("pred", **fields))


def training_runs(splits: DataFrame, task: str, dataset: str, strategy: str, version: str, preprocessing: str, hyperparameters: dict, seed: int, commit: str = "") -> DataFrame:
    """fold, train_subjects, test_subjects, training_run_id of splits (fold, subject_id, role).

    A run needs subjects on both sides, and no subject on two; anything else is an error.
    """
    side = {r: F.sort_array(F.collect_set(F.when(F.col("role") == r, F.col("subject_id").cast("string")))) for r in ("train", "test")}
    runs = splits.groupBy("fold").agg(side["train"].alias("train_subjects"), side["test"].alias("test_subjects"))
    runs = runs.withColumn("train_subjects", ids.refuse(F.size("train_subjects") == 0, "a run trains on somebody", F.col("train_subjects")))
    runs = runs.withColumn("test_subjects", ids.refuse((F.size("test_subjects") == 0) | F.arrays_overlap("train_subjects", "test_subjects"), "a run tests on somebody it wasn't trained on", F.col("test_subjects")))
    settings = ";".join(f"{k}:{v}" for k, v in sorted(hyperparameters.items()))
    fields = {"task": task, "dataset_version": dataset, "split_strategy": strategy, "feature_set_version": version, "preprocessing_version": preprocessing, "hyperparameters": settings, "seed": str(seed), "code_commit": commit}
    columns = {k: ids.text_of(F.lit(v)) for k, v in fields.items()} | {"train_subjects": ids.list_of(F.col("train_subjects")), "test_subjects": ids.list_of(F.col("test_subjects"))}
    return runs.withColumn("training_run_id", ids.content_id("trun", **{k: columns.get(k, F.lit("")) for k in ids.KINDS["trun"]}))


def model_artifacts(runs: DataFrame, name: str, version: str, task: str, features: list[str], feature_version: str, digest: str) -> DataFrame:
    """``runs`` with expected_features (in order) and model_id."""
    if not features:
        raise ValueError("a model expects features")
    expected = F.array(*[F.lit(f) for f in features])
    columns = {k: ids.text_of(F.lit(v)) for k, v in (("name", name), ("version", version), ("task", task), ("feature_set_version", feature_version), ("artifact_hash", digest))}
    columns |= {"training_run_id": ids.text_of(F.col("training_run_id")), "expected_features": ids.list_of(expected)}
    return runs.withColumn("expected_features", expected).withColumn("model_id", ids.content_id("model", **{k: columns[k] for k in ids.KINDS["model"]}))


def bundle(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON document per key: its predictions by start, as a nested array.

    Keys should bound the array (a subject's session, a fold of one subject).
    """
    names = sorted(c for c in predictions.columns if c not in keys)
    rows = F.sort_array(F.collect_list(F.struct("start_time", "prediction_id", *[c for c in names if c not in ("start_time", "prediction_id")])))
    return predictions.groupBy(*keys).agg(F.count("*").alias("n"), F.to_json(rows).alias("predictions"))


def unresolved(references: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """kind, id: references that name nothing.  Per kind: rows, their reference column (array or not), targets, their id."""
    out: DataFrame | None = None
    for kind, (rows, column, targets, target) in references.items():
        is_list = dict(rows.dtypes)[column].startswith("array")
        named = rows.select(F.explode(column).alias("id") if is_list else F.col(column).alias("id")).where("id is not null").distinct()
        lost = named.join(targets.select(F.col(target).alias("_id")), F.col("id") == F.col("_id"), "left_anti").select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"))
        out = lost if out is None else out.union(lost)
    if out is None:
        raise ValueError("no references given")
    return out


def invalidated(rejected: DataFrame, features: DataFrame, predictions: DataFrame) -> DataFrame:
    """layer, id: windows that a revision rejects, features of any of them, predictions of either, facts of those.

    rejected: window_id.  features: feature_id, source_window_ids.  predictions:
    prediction_id, feature_ids, source_window_ids, source_fact_ids.
    """
    bad = rejected.select("window_id").distinct()
    touched = features.select("feature_id", F.explode("source_window_ids").alias("window_id")).join(bad, "window_id", "left_semi").select("feature_id").distinct()
    by_feature = predictions.select("prediction_id", F.explode("feature_ids").alias("feature_id")).join(touched, "feature_id", "left_semi").select("prediction_id")
    by_window = predictions.select("prediction_id", F.explode("source_window_ids").alias("window_id")).join(bad, "window_id", "left_semi").select("prediction_id")
    stale = by_feature.union(by_window).distinct()
    facts = predictions.join(stale, "prediction_id", "left_semi").select(F.explode("source_fact_ids").alias("id")).distinct()
    layers = (("window", bad, "window_id"), ("feature", touched, "feature_id"), ("prediction", stale, "prediction_id"), ("fact", facts, "id"))
    out: DataFrame | None = None
    for name, df, column in layers:
        part = df.select(F.lit(name).alias("layer"), F.col(column).cast("string").alias("id"))
        out = part if out is None else out.union(part)
    return out


def in_force(facts: DataFrame) -> DataFrame:
    """Facts that no other fact supersedes."""
    return facts.join(facts.select(F.col("supersedes").alias("_old")).where("_old is not null"), F.col("fact_id") == F.col("_old"), "left_anti")


def latest(facts: DataFrame, checkpoint=None, max_rounds: int = 64) -> DataFrame:
    """fact_id, latest_id: the end of each fact's chain of supersessions, by doubling.

    Each round doubles the part of a chain that is known, so a chain of a million needs 20.
    ``checkpoint`` (a function of a DataFrame) cuts lineage on long chains.
    """
    successor = facts.where("supersedes is not null").groupBy(F.col("supersedes").alias("fact_id")).agg(F.min("fact_id").alias("next_id"))
    jump = facts.select("fact_id").join(successor, "fact_id", "left").select("fact_id", F.coalesce("next_id", "fact_id").alias("latest_id"))
    for _ in range(max_rounds):
        hop = jump.select(F.col("fact_id").alias("_at"), F.col("latest_id").alias("_to"))
        further = jump.join(hop, F.col("latest_id") == F.col("_at"), "left")
        further = further.select("fact_id", F.coalesce("_to", "latest_id").alias("latest_id"), (F.coalesce("_to", "latest_id") != F.col("latest_id")).alias("moved"))
        further = checkpoint(further) if checkpoint else further.checkpoint(eager=True)
        moved = further.where("moved").limit(1).count()
        jump = further.select("fact_id", "latest_id")
        if not moved:
            return jump
    raise ValueError("a chain of supersessions doesn't end")


def stale_predictions(facts: DataFrame, model_fields: list[str], latest_ids: DataFrame) -> DataFrame:
    """Model values in force that rest on a superseded fact, with what replaced it and the reason to give.

    fact_id, subject_id, field, value, superseded (old fact, new fact, field, was, now),
    current_inputs, reason.
    """
    live = in_force(facts).where(F.col("field").isin(model_fields)).select("fact_id", "subject_id", "field", "value", "derived_from")
    inputs = live.select("fact_id", F.posexplode("derived_from").alias("at", "input_id"))
    old = facts.select(F.col("fact_id").alias("input_id"), F.col("field").alias("input_field"), F.col("value").alias("was"))
    new = facts.select(F.col("fact_id").alias("latest_id"), F.col("value").alias("now"))
    moved = inputs.join(latest_ids.select(F.col("fact_id").alias("input_id"), "latest_id"), "input_id", "left").join(old, "input_id", "left").join(new, "latest_id", "left")
    moved = moved.withColumn("changed", F.coalesce(F.col("latest_id") != F.col("input_id"), F.lit(False)))
    item = F.struct("at", "input_id", "latest_id", "input_field", "was", "now")
    grouped = moved.groupBy("fact_id").agg(F.sort_array(F.collect_list(F.when(F.col("changed"), item))).alias("superseded"), F.sort_array(F.collect_list(F.struct("at", F.coalesce("latest_id", "input_id").alias("id")))).alias("inputs"))
    grouped = grouped.where(F.size("superseded") > 0)
    change = F.transform("superseded", lambda s: F.concat(F.coalesce(s["input_field"], F.lit("?")), F.lit(" "), F.coalesce(s["was"], F.lit("?")), F.lit(" to "), F.coalesce(s["now"], F.lit("?"))))
    reason = F.concat(F.lit("inputs were corrected: "), F.array_join(change, "; "))
    return grouped.join(live.drop("derived_from"), "fact_id").select("fact_id", "subject_id", "field", "value", "superseded", F.transform("inputs", lambda x: x["id"]).alias("current_inputs"), reason.alias("reason"))


def derived_facts(predictions: DataFrame, field: str, confidence: bool = True) -> DataFrame:
    """Facts to write for predictions: the class, and its probability as a second fact."""
    pairs = [F.struct(F.lit(field).alias("field"), F.col("predicted_class").alias("value"))]
    if confidence:
        pairs.append(F.struct(F.lit(f"{field}_confidence").alias("field"), F.col("probability").cast("string").alias("value")))
    ref = source_reference({"prediction": F.col("prediction_id"), "model": F.col("model_id"), "run": F.col("training_run_id")})
    out = predictions.select("study_id", "subject_id", "source_fact_ids", "model_id", ref.alias("source_record_ref"), F.explode(F.array(*pairs)).alias("f"), "start_time")
    out = out.where("f.value is not null").select("study_id", "subject_id", F.col("f.field").alias("field"), F.col("f.value").alias("value"), F.col("model_id").alias("transform_id"), F.col("source_fact_ids").alias("derived_from"), "source_record_ref", F.col("start_time").alias("recorded_at"))
    return out.withColumn("fact_id", ids.content_id("fact", **{k: ids.text_of(F.col(k)) for k in ("study_id", "subject_id", "field", "value", "source_record_ref")}))


def replacements(stale: DataFrame, new_values: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts that replace stale model values: fact_id of ``new_values`` (fact_id, value) names the old one.

    The new fact rests on the inputs in force and carries the reason that ``stale`` gives.
    """
    fresh = new_values.select(F.col("fact_id").alias("_old"), F.col("value").alias("_value"))
    old = facts.select(F.col("fact_id").alias("_id"), "study_id", "transform_id", "source_record_ref")
    out = stale.join(fresh, F.col("fact_id") == F.col("_old")).join(old, F.col("fact_id") == F.col("_id"))
    out = out.select("study_id", "subject_id", "field", F.col("_value").alias("value"), "transform_id", F.col("current_inputs").alias("derived_from"), F.col("_old").alias("supersedes"), "reason", "source_record_ref")
    return out.withColumn("fact_id", ids.content_id("fact", **{k: ids.text_of(F.col(k)) for k in ("study_id", "subject_id", "field", "value", "supersedes")}))


def source_reference(parts: dict[str, Column]) -> Column:
    """k=v pairs, ended by semicolons."""
    return F.concat(*[x for k, v in parts.items() for x in (F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("")), F.lit(";"))])


def parse_reference(column: Column) -> Column:
    return F.map_filter(F.str_to_map(column, F.lit(";"), F.lit("=")), lambda k, _: k != "")


def accepts(expected: list[str], version: str, names: list[str], found_version: str) -> None:
    """Refuses features that a model wasn't trained on: other names, another order, another version."""
    if version != found_version:
        raise ValueError(f"the model expects feature set {version}, not {found_version}")
    if list(expected) != list(names):
        lacking = [n for n in expected if n not in names]
        raise ValueError(f"features missing: {lacking}" if lacking else "features differ in name or order")


def next_prediction(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """The newest prediction per key, by start and then identifier."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("start_time"), F.desc("prediction_id")))
    return predictions.withColumn("_place", newest).where("_place = 1").drop("_place")
