"""Registered queries that fit models, build tables from synthetic signals, or stream.

They register beside those of ``queries``.  Most have no SQL twin; tests hold them against
known answers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import features, quality
from .operators import enrolment, metrics, models, table
from .plans import build, synthetic
from .queries import query, r6, read, rounded, vectors
from .streaming import windows as streams

NAMES = [f"x{i}" for i in range(12)]


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, subject, label (0, 1) and twelve features of each embedding."""
    rows = vectors(spark, sf_dir).select("vec_id", F.format_string("S%d", F.col("vec_id") % 6).alias("subject_id"), (F.col("label") >= 5).cast("double").alias("label"), *[F.element_at("x", i + 1).alias(n) for i, n in enumerate(NAMES)])
    return rows.cache()


def by_subject(model: str, spark: SparkSession, sf_dir: str, calibration=None, **options) -> DataFrame:
    rows = embedded(spark, sf_dir)
    folds = [(f"fold{i}", F.pmod("vec_id", F.lit(6)).isin(2 * i, 2 * i + 1)) for i in range(3)]
    factory = lambda names, n: models.MODELS[model](names, n, **options)
    found, _ = models.evaluate(rows, NAMES, folds, factory, ["vec_id", "subject_id"], calibration)
    return found


def scores(found: DataFrame) -> DataFrame:
    """Scores by fold.  They read the predictions a dozen times: these are written once, and no later task holds a model."""
    streams.shared_folder(found.sparkSession)
    return rounded(metrics.score(found.checkpoint(eager=True), ["fold"]), "accuracy", "balanced_accuracy", "macro_f1", "kappa", "roc_auc", "average_precision", "brier", "ece")


@query()
def logistic_folds(spark, sf_dir):
    return scores(by_subject("logistic", spark, sf_dir))


@query()
def linear_svm_folds(spark, sf_dir):
    return scores(by_subject("linear_svm", spark, sf_dir))


@query()
def random_forest_folds(spark, sf_dir):
    return scores(by_subject("random_forest", spark, sf_dir, trees=30))


@query()
def gradient_boosting_folds(spark, sf_dir):
    return scores(by_subject("gradient_boosting", spark, sf_dir, rounds=8))


@query("""WITH e AS (SELECT vec_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS truth, CAST((vec_id % 6) // 2 AS INTEGER) AS k FROM embeddings),
c AS (SELECT f.k, truth, count(*) AS n FROM e, (SELECT DISTINCT k FROM e) f WHERE e.k <> f.k GROUP BY ALL), m AS (SELECT k, arg_max(truth, (n, -truth)) AS predicted, sum(n * truth) / sum(n) AS p FROM c GROUP BY k)
SELECT 'fold' || e.k AS fold, count(*) AS n, round(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(any_value(p), 6) AS probability FROM e JOIN m USING (k) GROUP BY e.k""")
def majority_folds(spark, sf_dir):
    found = by_subject("majority", spark, sf_dir)
    return found.groupBy("fold").agg(F.count("*").alias("n"), r6(F.avg((F.col("truth") == F.col("predicted")).cast("double"))).alias("accuracy"), r6(F.max("probability")).alias("probability"))


@query()
def isotonic_folds(spark, sf_dir):
    return scores(by_subject("logistic", spark, sf_dir, models.grouped_calibration("isotonic", "subject_id", 3)))


@query()
def sigmoid_folds(spark, sf_dir):
    return scores(by_subject("logistic", spark, sf_dir, models.grouped_calibration("sigmoid", "subject_id", 3)))


@query()
def personalisation(spark, sf_dir):
    """Raw, cohort, personal and prevalence probabilities of the same rows, scored per subject."""
    rows = embedded(spark, sf_dir).withColumn("start", F.col("vec_id") * 5.0)
    rows = enrolment.enrol(rows, "subject_id", "start", "label", 0.3, "blocks", length=5.0)
    subjects = sorted(r.subject_id for r in rows.select("subject_id").distinct().collect())
    found, _ = models.personalise(rows, NAMES, models.logistic, "subject_id", subjects)
    return rounded(metrics.calibration(found, ["subject_id", "variant"]).join(metrics.brier(found, ["subject_id", "variant"]), ["subject_id", "variant"]), "ece", "brier")


@query()
def ablation_folds(spark, sf_dir):
    """Balanced accuracy with everything, each group of features alone, and without it."""
    from .operators import compare

    rows = embedded(spark, sf_dir)
    groups = {"low": NAMES[:6], "high": NAMES[6:]}
    out = None
    for (kind, group), names in compare.ablation_plan(groups).items():
        found, _ = models.evaluate(rows, names, [("half", F.pmod("vec_id", F.lit(6)) < 3)], models.logistic, ["vec_id"])
        part = metrics.classification(found, []).select(F.lit(kind).alias("kind"), F.lit(group).alias("group"), "balanced_accuracy")
        out = part if out is None else out.union(part)
    return rounded(compare.contributions(out, "balanced_accuracy"), "alone", "without", "full", "contribution")


@query()
def wrist_table(spark, sf_dir):
    """Synthetic wrist signals of as many subjects as there are regions: windows, quality, features, one wide table."""
    subjects = read(spark, sf_dir, "region").count()
    signals, runs = synthetic.wrist_cohort(spark, subjects)
    long = build.build(signals, runs, "wrist", 60.0, 30.0).cache()
    wide, names, _, _ = build.feature_table(long)
    return wide.select("subject_id", "start_s", "label", *[r6(n).alias(n) for n in names])


@query()
def spectral_measures(spark, sf_dir):
    """The EEG kernel over embeddings as 16-second windows at 4 samples a second: twenty measures each."""
    rows = vectors(spark, sf_dir).select("vec_id", F.lit("EEG Fpz-Cz").alias("signal"), F.lit(4.0).alias("rate"), F.col("x").alias("samples"))
    found = features.measure(rows)
    names = features.SLEEP_FEATURES_BY_CHANNEL["EEG Fpz-Cz"]
    return found.select("vec_id", quality.status(F.col("codes"), quality.SLEEP).alias("status"), *[r6(F.element_at("values", n)).alias(n) for n in names])


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = read(spark, sf_dir, name).schema
    # a pattern, as a stream takes no path of a single file; it finds a folder of files as well
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query("""SELECT user_id, CAST(floor(epoch_us(ts) / 1e6 / 86400) AS BIGINT) AS day, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def streaming_tumbling(spark, sf_dir):
    frame = streams.tumbling(streams.timed(stream_of(spark, sf_dir, "events")), ["user_id"], "ts", "value", "1 day", "2 hours")
    found = streams.drain(frame, f"t{uuid.uuid4().hex}", "complete")
    return found.select("user_id", F.floor(F.unix_micros("window_start") / 86_400e6).alias("day"), "n", r6("mean").alias("mean"))


@query("""WITH b AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 21600000000 THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM b) SELECT user_id, min(t) AS begin_us, count(*) AS n FROM s GROUP BY user_id, g""")
def streaming_sessions(spark, sf_dir):
    frame = streams.sessions(streams.timed(stream_of(spark, sf_dir, "events")), ["user_id"], "ts", "6 hours", "2 hours")
    found = streams.drain(frame, f"s{uuid.uuid4().hex}", "complete")
    return found.select("user_id", F.unix_micros("begin").alias("begin_us"), "n")


@query()
def fused_devices(spark, sf_dir):
    """Long features of two devices as one coverage-checked table."""
    rows = vectors(spark, sf_dir).select((F.col("vec_id") % 20).alias("subject_id"), F.row_number().over(Window.partitionBy(F.col("vec_id") % 20).orderBy("vec_id")).alias("start_s"), "x")
    keys = ["subject_id", "start_s"]
    wrist = features.spread(rows, keys, features.temp_columns(F.col("x"), 4.0))
    chest = features.spread(rows.where("start_s % 7 <> 0"), keys, features.emg_columns(F.col("x")))
    long = table.unpivot(wrist, keys, wrist.columns[2:]).union(table.unpivot(chest, keys, chest.columns[2:]))
    wide, names, _ = table.assemble(long, ["subject_id", "start_s"], 0.8)
    return wide.select("subject_id", "start_s", *[r6(n).alias(n) for n in names])
