"""A forest that remembers its rows' nodes is the same forest, and predicts once."""

from pyspark.sql import functions as F

from sigloom import model_queries
from sigloom.operators import models


def frame(spark):
    x = [F.rand(i).alias(f"x{i}") for i in range(4)]
    rows = spark.range(0, 600, 1, 1).select("id", *x)
    label = (F.col("x0") + F.col("x1") * F.col("x2") > 0.75).cast("double")
    return rows.withColumn("label", label).withColumn("weight", F.lit(1.0)).cache()


def test_rows_remember_their_nodes_and_the_trees_are_the_same(spark):
    rows, names = frame(spark), [f"x{i}" for i in range(4)]
    now = models.random_forest(names, 600, trees=5)
    walked = models.random_forest(names, 600, trees=5)
    assert now.getStages()[-1].getCacheNodeIds()
    walked.getStages()[-1].setCacheNodeIds(False)
    one, two = (models.parameter_digest(p.fit(rows)) for p in (now, walked))
    assert one == two


def test_scores_read_written_predictions(spark):
    rows = frame(spark).withColumn("subject_id", F.lit("S0"))
    names = [f"x{i}" for i in range(4)]
    found, _ = models.evaluate(rows, names, [("half", F.col("id") % 2 == 0)], lambda n, k: models.random_forest(n, k, 3), ["id", "subject_id"])
    scored = model_queries.scores(found)
    assert "UDF" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert scored.first()["n"] == 300
