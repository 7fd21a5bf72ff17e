"""Structured Streaming twins of the event windows.

Watermarks bound the state; results match the batch operators once the watermark has
passed.  Sessions use ``session_window``; runs that depend on the row before keep one row
of state per key.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(events: DataFrame, at: str = "ts") -> DataFrame:
    """``events`` with a timestamp that has a zone; watermarks need one."""
    return events.withColumn(at, F.col(at).cast("timestamp"))


def statistics(column: str) -> list:
    return [F.count("*").alias("n"), F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max")]


def sliding(events: DataFrame, keys: list[str], at: str, value: str, length: str, stride: str, late: str) -> DataFrame:
    frame = events.withWatermark(at, late).groupBy(*keys, F.window(at, length, stride).alias("w")).agg(*statistics(value))
    return frame.select(*keys, F.col("w.start").alias("window_start"), "n", "mean", "min", "max")


def tumbling(events: DataFrame, keys: list[str], at: str, value: str, length: str, late: str) -> DataFrame:
    return sliding(events, keys, at, value, length, length, late)


def sessions(events: DataFrame, keys: list[str], at: str, gap: str, late: str) -> DataFrame:
    frame = events.withWatermark(at, late).groupBy(*keys, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("n"))
    return frame.select(*keys, F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "n")


def runs(events: DataFrame, key: str, at: str, label: str, late: str) -> DataFrame:
    """key, label, begin, end, n of every run of one label, given out when the next run starts or nothing more can come.

    Rows of one batch are sorted by time; state is one open run per key.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        open_run = list(state.get) if state.exists else None
        if state.hasTimedOut:
            out.append(open_run)
            state.remove()
        else:
            rows = pd.concat(frames).sort_values([at, label])
            for when, name in zip(rows[at], rows[label], strict=True):
                when = pd.Timestamp(when).value // 1000
                if open_run and open_run[0] == name:
                    open_run = [name, open_run[1], max(open_run[2], when), open_run[3] + 1]
                else:
                    if open_run:
                        out.append(open_run)
                    open_run = [name, when, when, 1]
            state.update(tuple(open_run))
            state.setTimeoutTimestamp(max(open_run[2] // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame([(keys[0], r[0], r[1], r[2], r[3]) for r in out], columns=["key", "label", "begin_us", "end_us", "n"])

    kind = dict(events.dtypes)[key]
    return events.withWatermark(at, late).select(key, at, label).groupBy(key).applyInPandasWithState(step, f"key {kind}, label string, begin_us long, end_us long, n long", "label string, begin long, end long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where the session names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="ckpt"))
    return sc.getCheckpointDir()


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a bounded stream gives, as a table in a Parquet folder beside the shared checkpoints.

    The executors write the rows; none pass through the driver.  In complete mode a batch
    replaces what the batch before it wrote.
    """
    spark = stream.sparkSession
    path, checkpoint = (f"{shared_folder(spark)}/{kind}-{name}" for kind in ("rows", "stream"))
    if mode == "append":
        to_store(stream, path, checkpoint).awaitTermination()
    else:
        nothing = spark.range(0).select(*[F.lit(None).cast(c.dataType).alias(c.name) for c in stream.schema])
        nothing.write.parquet(path)  # what a stream without a batch gives
        kept = stream.writeStream.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path))
        kept.option("checkpointLocation", checkpoint).queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def to_store(stream: DataFrame, path: str, checkpoint: str):
    """Appends to a Parquet folder, once per row whatever fails; gives the running query."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
