"""What a drained stream gives is written by the executors, and is the whole of it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_streaming import events

from sigloom import model_queries, queries
from sigloom.streaming import windows as streams


@pytest.mark.parametrize("mode", ["complete", "append"])
def test_drained_rows_lie_in_files_and_not_in_the_driver(spark, tmp_path, mode):
    stream = streams.timed(events(spark, tmp_path))
    frame = streams.tumbling(stream, ["k"], "ts", "v", "1 hour", "1 minute")
    got = streams.drain(frame, f"drain_{mode}_test", mode)
    assert got.inputFiles()
    assert sorted(r.n for r in got.collect()) == ([1, 2, 3] if mode == "complete" else [2, 3])  # no watermark passes the last window


def test_every_batch_counts(spark, tmp_path):
    base = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    for m in range(3):
        spark.createDataFrame([("a", base + dt.timedelta(minutes=10 * m), 1.0)], "k string, ts timestamp, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = streams.drain(streams.sessions(stream, ["k"], "ts", "15 minutes", "1 hour"), "batches_test", "complete")
    assert [r.n for r in got.collect()] == [3]


def test_a_stream_of_nothing_is_empty(spark, tmp_path):
    spark.createDataFrame([], "k string, ts timestamp, v double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ts timestamp, v double").option("pathGlobFilter", "none").parquet(f"{tmp_path}/in")
    got = streams.drain(streams.sessions(stream, ["k"], "ts", "15 minutes", "1 hour"), "nothing_test", "complete")
    assert got.columns == ["k", "begin", "end", "n"] and not got.collect()


@pytest.mark.parametrize("name", ["streaming_sessions", "streaming_tumbling"])
def test_a_table_in_several_files_is_read(spark, sf_dir, tmp_path, name):
    queries.read(spark, sf_dir, "events").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    want, got = (getattr(model_queries, name)(spark, d).agg(F.count("*"), F.sum("n")).first() for d in (sf_dir, str(tmp_path)))
    assert got == want and got[1] == queries.read(spark, sf_dir, "events").count()


def test_tumbling_days_do_not_pass_through_the_driver(spark, sf_dir):
    assert model_queries.streaming_tumbling(spark, sf_dir).inputFiles()
