import datetime as dt

from pyspark.sql import functions as F

from sigloom.streaming import windows as streams


def events(spark, tmp_path):
    base = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    rows = [("a", base + dt.timedelta(minutes=m), lab, float(m)) for m, lab in ((0, "x"), (1, "x"), (2, "y"), (90, "y"), (91, "x"), (600, "z"))]
    spark.createDataFrame(rows, "k string, ts timestamp, label string, v double").coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema("k string, ts timestamp, label string, v double").parquet(f"{tmp_path}/in")


def test_sliding_matches_batch(spark, tmp_path):
    stream = events(spark, tmp_path)
    got = streams.drain(streams.sliding(stream, ["k"], "ts", "v", "60 minutes", "30 minutes", "1 hour"), "sliding_test", "complete")
    batch = spark.read.parquet(f"{tmp_path}/in").groupBy("k", F.window("ts", "60 minutes", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    assert sorted((r.window_start, r.n) for r in got.collect()) == sorted((r.w.start, r.n) for r in batch.collect())


def test_sessions_break_at_gaps(spark, tmp_path):
    got = streams.drain(streams.sessions(events(spark, tmp_path), ["k"], "ts", "30 minutes", "1 hour"), "sessions_test", "complete")
    assert sorted(r.n for r in got.collect()) == [1, 2, 3]


def test_runs_keep_one_open_run(spark, tmp_path):
    got = streams.drain(streams.runs(events(spark, tmp_path), "k", "ts", "label", "1 minute"), "runs_test")
    assert [(r.label, r.n) for r in got.orderBy("begin_us").collect()][:3] == [("x", 2), ("y", 2), ("x", 1)]


def test_store_appends_once(spark, tmp_path):
    stream = events(spark, tmp_path).select("k", "v")
    for _ in range(2):
        streams.to_store(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
