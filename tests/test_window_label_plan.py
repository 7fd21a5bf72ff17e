"""Labels of hours on odd rows, against the query's SQL; and what a task of it holds."""

import datetime as dt
import random

from oracles import compare, connection

from sigloom import queries

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_odd_rows_get_the_labels_of_the_sql(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    at = lambda hours, us=0: base + dt.timedelta(hours=hours, microseconds=us)
    rows = [
        (1, [(1, at(0), "a"), (2, at(1), "a"), (3, at(2), "b"), (4, at(4), "b")]),  # all on the hour, an hour starts with the last event
        (2, [(1, at(0), "a")]),  # one event
        (3, [(1, at(0), "a"), (2, at(0), "b"), (3, at(0.5), "b"), (4, at(0.5), "a"), (5, at(3.2), "a"), (6, at(3.2), "b")]),  # equal times
        (4, [(1, at(0), "a"), (2, at(1.5), None), (3, at(3.5), None), (4, at(6), "a"), (5, at(6.1), "a")]),  # no label
        (5, [(1, None, "a"), (2, at(0), "b"), (3, at(2.2), "b"), (4, None, "c")]),  # no time
        (6, [(1, None, "a")]),
        (None, [(1, at(0), "a"), (2, at(5.5), "a"), (3, at(9), "b")]),  # no user
        (7, [(1, at(0), "a"), (2, at(1, -1), "b"), (3, at(1, 1), "a"), (4, at(3), "c"), (5, at(3, 1), "a"), (6, at(5), "a")]),  # a microsecond beside the hour
        (8, [(None, at(0), "b"), (1, at(0), "a"), (2, at(2), "a")]),  # an event without a number beside another of its time
    ]
    dice = random.Random(0)
    rows += [(100 + u, [(k, at(dice.choice([0.25, 0.5, 1, 3]) * dice.randrange(40)), dice.choice(["a", "a", "a", "b", None])) for k in range(dice.randrange(1, 30))]) for u in range(40)]
    found = [(k, when, user, label, 1.0, "") for user, some in rows for k, when, label in some]
    spark.createDataFrame(found, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    part = next(p for p in (tmp_path / "in").iterdir() if p.suffix == ".parquet")
    (tmp_path / "events").mkdir()
    part.rename(tmp_path / "events/events.parquet")
    compare(queries.window_label_range_join(spark, f"{tmp_path}/events"), connection(f"{tmp_path}/events"), queries.SQL["window_label_range_join"])


def test_hours_are_neither_joined_nor_sorted(spark, sf_dir):
    plan = queries.window_label_range_join(spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    above = plan[: plan.index("Generate explode")]
    assert not any(x in above for x in ("Join", "Aggregate", "Sort", "Window"))
