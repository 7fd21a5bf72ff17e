"""Subject-wise model evaluation on pyspark.ml.

The loop over folds is the only imperative part; every fold's predictions land in one table
that ``metrics`` scores in one pass.  Tables are materialised once, folds filter them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES, LABEL, WEIGHT = "features", "label", "weight"
EPSILON = 1e-6


def balanced(df: DataFrame, label: str = LABEL) -> DataFrame:
    """``df`` with a weight that gives every class the same total: rows / (classes * rows of the class)."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    weight = F.lit(None).cast("double")
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, F.lit(total / (len(counts) * n))).otherwise(weight)
    return df.withColumn(WEIGHT, weight)


def _assembled(names: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=names, outputCol="raw_features")


def logistic(names: list[str], rows: int) -> Pipeline:
    scaler = StandardScaler(inputCol="raw_features", outputCol=FEATURES, withMean=True, withStd=True)
    # an L2 penalty of 1 against a sum over rows is 1 / rows against Spark's mean
    model = LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, maxIter=200, regParam=1.0 / max(rows, 1), standardization=False)
    return Pipeline(stages=[_assembled(names), scaler, model])


def linear_svm(names: list[str], rows: int) -> Pipeline:
    scaler = StandardScaler(inputCol="raw_features", outputCol=FEATURES, withMean=True, withStd=True)
    model = LinearSVC(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, maxIter=100, regParam=1.0 / max(rows, 1))
    return Pipeline(stages=[_assembled(names), scaler, model])


def random_forest(names: list[str], rows: int, trees: int = 300) -> Pipeline:
    # deep trees: rows remember their nodes, else each level sends every tree to every task and walks it from the root; the trees are the same
    model = RandomForestClassifier(featuresCol="raw_features", labelCol=LABEL, weightCol=WEIGHT, numTrees=trees, minInstancesPerNode=5, maxDepth=16, seed=0, cacheNodeIds=True)
    return Pipeline(stages=[_assembled(names), model])


def gradient_boosting(names: list[str], rows: int, rounds: int = 40) -> Pipeline:
    model = GBTClassifier(featuresCol="raw_features", labelCol=LABEL, weightCol=WEIGHT, maxIter=rounds, maxDepth=5, seed=0)
    return Pipeline(stages=[_assembled(names), model])


def gradient_boosting_many(names: list[str], rows: int, rounds: int = 20) -> Pipeline:
    """More than two classes: one boosted model per class."""
    base = GBTClassifier(featuresCol="raw_features", labelCol=LABEL, maxIter=rounds, maxDepth=5, seed=0)
    return Pipeline(stages=[_assembled(names), OneVsRest(classifier=base, featuresCol="raw_features", labelCol=LABEL, weightCol=WEIGHT)])


class Majority(Estimator):
    """Predicts the commonest label (of equals the smallest) with its share as probability of class 1."""

    def _fit(self, dataset: DataFrame) -> Model:
        counts = sorted((-r["n"], r[LABEL]) for r in dataset.groupBy(LABEL).agg(F.count("*").alias("n")).collect())
        total = -sum(n for n, _ in counts)
        ones = sum(-n for n, v in counts if v == 1)
        return _Constant(float(counts[0][1]), ones / total)


class _Constant(Model):
    def __init__(self, label: float = 0.0, share: float = 0.0):
        super().__init__()
        self.label, self.share = label, share

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("prediction", F.lit(self.label)).withColumn("p1", F.lit(self.share))


def majority(names: list[str], rows: int) -> Estimator:
    return Majority()


MODELS: dict[str, Callable[[list[str], int], Estimator]] = {"logistic": logistic, "linear_svm": linear_svm, "random_forest": random_forest, "gradient_boosting": gradient_boosting, "majority": majority}


def margin(df: DataFrame) -> Column:
    """Probability of class 1, or a logistic curve of the margin for models without one."""
    if "p1" in df.columns:
        return F.col("p1")
    if "probability" in df.columns:
        return F.element_at(vector_to_array("probability"), 2)
    return 1 / (1 + F.exp(-F.element_at(vector_to_array("rawPrediction"), 2)))


def predict(model: Model, df: DataFrame, keep: list[str]) -> DataFrame:
    """keep, truth, predicted, p."""
    out = model.transform(df)
    return out.select(*keep, F.col(LABEL).cast("int").alias("truth"), F.col("prediction").cast("int").alias("predicted"), margin(out).alias("p"))


def evaluate(table: DataFrame, names: list[str], folds: list[tuple[str, Column]], factory: Callable[[list[str], int], Estimator], keep: list[str], calibration: Callable | None = None) -> tuple[DataFrame | None, list[str]]:
    """Predictions of every fold (fold, keep, truth, predicted, probability), and the folds skipped for one class.

    ``folds``: name and the condition that a row is in the test.  ``table`` has ``names``,
    label (0, 1, ...) and ``keep``.
    """
    out: DataFrame | None = None
    skipped = []
    for fold, test in folds:
        train, held = table.where(~test), table.where(test)
        if train.select(LABEL).distinct().limit(2).count() < 2 or held.select(LABEL).distinct().limit(2).count() < 2:
            skipped.append(fold)
            continue
        weighted = balanced(train)
        model = factory(names, weighted.count()).fit(weighted)
        found = predict(model, held, keep)
        if calibration:
            found = calibration(weighted, names, factory, found)
        found = found.select(F.lit(fold).alias("fold"), *keep, "truth", "predicted", F.col("p").alias("probability"))
        out = found if out is None else out.union(found)
    return out, skipped


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return F.ln(q / (1 - q))


def isotonic(points: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A calibrator fitted on p and truth: monotone, clipped outside what it saw."""
    model = IsotonicRegression(featuresCol="p", labelCol="truth").fit(points.select(F.col("p").cast("double"), F.col("truth").cast("double")))
    return lambda df: model.transform(df).withColumn("p", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0))).drop("prediction")


def sigmoid(points: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Platt scaling on the logit."""
    assembled = VectorAssembler(inputCols=["_logit"], outputCol="_x")
    rows = points.select(logit(F.col("p")).alias("_logit"), F.col("truth").cast("double").alias("truth"))
    model = LogisticRegression(featuresCol="_x", labelCol="truth", maxIter=100, regParam=1.0 / max(rows.count(), 1)).fit(assembled.transform(rows))
    weight, bias = float(model.coefficients[0]), float(model.intercept)
    return lambda df: df.withColumn("p", 1 / (1 + F.exp(-(F.lit(weight) * logit(F.col("p")) + F.lit(bias)))))


CALIBRATORS = {"isotonic": isotonic, "sigmoid": sigmoid}


def grouped_calibration(method: str, subject: str, inner: int = 5) -> Callable:
    """For ``evaluate``: a calibrator fitted on out-of-fold probabilities whose folds are groups of subjects.

    The classes stay the base model's; only the probability changes.
    """

    def run(train: DataFrame, names: list[str], factory: Callable, found: DataFrame) -> DataFrame:
        subjects = train.select(subject).distinct().count()
        k = min(inner, subjects)
        if k < 2:
            return found
        side = F.pmod(F.xxhash64(F.col(subject)), F.lit(k))
        points: DataFrame | None = None
        for i in range(k):
            part, held = train.where(side != i), train.where(side == i)
            if part.select(LABEL).distinct().limit(2).count() < 2:
                continue
            p = predict(factory(names, part.count()).fit(part), held, [])
            points = p if points is None else points.union(p)
        return found if points is None else CALIBRATORS[method](points)(found)

    return run


def parameter_digest(model: Model) -> str:
    """Digest of a fitted model's parameters: arrays by shape and value, trees by their text."""
    stage = model.stages[-1] if hasattr(model, "stages") else model
    if hasattr(stage, "coefficients"):
        text = json.dumps([list(map(float, stage.coefficients)), float(stage.intercept)])
    elif hasattr(stage, "toDebugString"):
        text = stage.toDebugString.split("\n", 1)[-1]
    else:
        text = repr(sorted((p.name, str(v)) for p, v in stage.extractParamMap().items()))
    return hashlib.sha256(text.encode()).hexdigest()


def manifest(name: str, names: list[str], scores: dict, skipped: list[str], seed: int, hyperparameters: dict | None = None) -> str:
    """What an evaluation was: one JSON text, keys sorted."""
    return json.dumps({"model": name, "features": names, "scores": scores, "skipped": skipped, "seed": seed, "hyperparameters": hyperparameters or {}}, sort_keys=True, default=str)


def personalise(table: DataFrame, names: list[str], factory: Callable, subject: str, subjects: list[str], method: str = "isotonic") -> tuple[DataFrame | None, list[str]]:
    """Four probabilities for the same rows: raw, calibrated on the cohort, on the subject, and prevalence.

    ``table`` has names, label, subject and part (of ``enrolment``).  Rows come back with
    variant, truth, predicted and probability; subjects without both classes on both sides
    are skipped.
    """
    out: DataFrame | None = None
    skipped = []
    for who in subjects:
        train, own = table.where(F.col(subject) != who), table.where(F.col(subject) == who)
        enrolled, held = own.where("part = 'enrol'"), own.where("part = 'evaluate'")
        if any(side.select(LABEL).distinct().limit(2).count() < 2 for side in (train, enrolled, held)):
            skipped.append(who)
            continue
        weighted = balanced(train)
        model = factory(names, weighted.count()).fit(weighted)
        raw, points = predict(model, held, [subject]), predict(model, enrolled, [])
        share = enrolled.agg(F.avg(LABEL)).first()[0]
        variants = {"raw": raw, "cohort": grouped_calibration(method, subject)(weighted, names, factory, raw), "personal": CALIBRATORS[method](points)(raw), "prevalence": raw.withColumn("p", F.lit(float(share)))}
        for name, found in variants.items():
            part = found.select(F.lit(name).alias("variant"), F.col(subject).alias("subject_id"), "truth", "predicted", F.col("p").alias("probability"))
            out = part if out is None else out.union(part)
    return out, skipped
