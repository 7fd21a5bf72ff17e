"""Windows over signals and over events, runs, sessions and neighbour context.

Frames partition by the caller's keys; nothing here collects.  Event windows explode each
event into the few windows that hold it, so the shuffle carries one row per event and
window and aggregates before it moves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: str | Column) -> Column:
    """Seconds since 1970 of a timestamp with or without a zone, as double."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp")) / F.lit(1e6)


def sliding_starts(duration: Column, length: float, stride: float) -> Column:
    """Starts 0, stride, ... of the windows that fit; array<double>, empty if none fits."""
    if length <= 0 or stride <= 0 or stride > length:
        raise ValueError("length and stride are positive, and the stride is not longer than the window")
    last = F.floor((duration - F.lit(float(length))) / F.lit(float(stride))).cast("int")
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: i * F.lit(float(stride)))).otherwise(F.array().cast("array<double>"))


def sample_range(start: Column, length: Column, rate: Column) -> tuple[Column, Column]:
    """First sample and the one past the last; halves round to even."""
    first = F.bround(start * rate).cast("long")
    return first, first + F.bround(length * rate).cast("long")


def cut_windows(signals: DataFrame, length: float, stride: float, keys: list[str]) -> DataFrame:
    """One row per window of each signal row (rate, samples): epoch_idx, start_s, start_sample, end_sample, samples.

    Windows that the signal doesn't fill are left out.  The samples of a signal row should
    be one recording; overlapping windows repeat samples length / stride times, so ask for
    the columns that you need before you cut.
    """
    starts = sliding_starts(F.size("samples") / F.col("rate"), length, stride)
    out = signals.select(*keys, "rate", "samples", F.posexplode(starts).alias("epoch_idx", "start_s"))
    first, end = sample_range(F.col("start_s"), F.lit(float(length)), F.col("rate"))
    out = out.withColumn("start_sample", first).withColumn("end_sample", end).where(F.col("end_sample") <= F.size("samples"))
    return out.withColumn("samples", F.slice("samples", (F.col("start_sample") + 1).cast("int"), (F.col("end_sample") - F.col("start_sample")).cast("int")))


def first_sample_of(signals: DataFrame) -> Column:
    """Place of a row's first sample in its recording; a row without the column is a whole recording."""
    return F.coalesce(F.col("first_sample").cast("long"), F.lit(0).cast("long")) if "first_sample" in signals.columns else F.lit(0).cast("long")


def cut_spans(signals: DataFrame, wanted: DataFrame, keys: list[str], length: float, span: Callable[[Column, Column], tuple[Column, Column]] | None = None, slot_s: float | None = None) -> DataFrame:
    """The columns of ``wanted`` (keys, start_s, ...) with signal, rate, samples of every signal that reaches the window's end.

    ``signals`` (keys, signal, rate, samples, and first_sample if a recording comes in several
    rows) are dealt into slots of ``slot_s`` seconds, each with a halo of one window, and a
    window is cut from the slot of its start: no task holds more than a slot, and samples
    move once.  ``span`` gives the sample range of a window from its start and the rate.
    Where rows overlap the first one counts; samples between rows that are missing are null.
    """
    slot_s = float(slot_s or 5 * length)
    span = span or (lambda start, rate: sample_range(start, F.lit(float(length)), rate))
    rate, per, halo = F.col("rate"), F.lit(slot_s) * F.col("rate"), F.lit(float(length)) * F.col("rate") + 2
    rows = signals.select(*keys, "signal", "rate", first_sample_of(signals).alias("_at"), "samples").where("size(samples) > 0")
    stop = F.col("_at") + F.size("samples")
    low = F.greatest(F.floor((F.col("_at") - halo) / per) - 1, F.lit(0).cast("long"))
    dealt = rows.withColumn("_slot", F.explode(F.sequence(low, F.greatest(low, F.floor(stop / per)))))
    begin = F.greatest(F.floor(F.col("_slot") * per), F.col("_at"))
    end = F.least(F.ceil((F.col("_slot") + 1) * per + halo), stop)
    dealt = dealt.withColumn("_begin", begin).withColumn("_end", end).where("_begin < _end")
    piece = F.struct(F.col("_begin").alias("at"), F.slice("samples", (F.col("_begin") - F.col("_at") + 1).cast("int"), (F.col("_end") - F.col("_begin")).cast("int")).alias("x"))
    dealt = dealt.select(*keys, "_slot", "signal", "rate", piece.alias("_piece"))
    # dealt by slot alone, so that neither the aggregation nor the join below moves samples again
    dealt = dealt.repartition(*keys, "_slot").groupBy(*keys, "_slot", "signal", "rate").agg(F.sort_array(F.collect_list("_piece")).alias("_pieces"))
    last = F.element_at("_pieces", -1)
    sizes = F.aggregate("_pieces", F.lit(0).cast("long"), lambda n, p: n + F.size(p["x"]))
    gapless = last["at"] + F.size(last["x"]) - F.col("_pieces")[0]["at"] == sizes
    at = F.col("_pieces")[0]["at"]

    def append(x: Column, p: Column) -> Column:
        gap = p["at"] - at - F.size(x)
        skip = F.least(F.greatest(-gap, F.lit(0).cast("long")), F.size(p["x"]).cast("long")).cast("int")
        return F.concat(x, F.array_repeat(F.lit(None).cast("double"), F.greatest(gap, F.lit(0).cast("long")).cast("int")), F.slice(p["x"], skip + 1, F.size(p["x"]) - skip))

    mended = F.aggregate("_pieces", F.array().cast("array<double>"), append)
    chunks = dealt.select(*keys, "_slot", "signal", "rate", at.alias("_at"), F.when(gapless, F.flatten("_pieces.x")).otherwise(mended).alias("samples"))
    rest = [n for n in wanted.columns if n not in keys]
    asked = wanted.groupBy(*keys, F.floor(F.col("start_s") / F.lit(slot_s)).alias("_slot")).agg(F.collect_list(F.struct(*rest)).alias("_wanted"))
    cut = chunks.join(asked, [*keys, "_slot"]).withColumn("_w", F.explode("_wanted"))
    first, end = span(F.col("_w.start_s"), rate)
    cut = cut.withColumn("_first", first - F.col("_at")).withColumn("_end", end - F.col("_at")).where("_first >= 0 and _end <= size(samples)")
    return cut.select(*keys, *[F.col(f"_w.{n}").alias(n) for n in rest], "signal", "rate", F.slice("samples", (F.col("_first") + 1).cast("int"), (F.col("_end") - F.col("_first")).cast("int")).alias("samples"))


def event_windows(events: DataFrame, keys: list[str], at: str, length: float, stride: float) -> DataFrame:
    """``events`` once per sliding window that holds them: window_idx and window_start (seconds).

    Windows start at each key's first event; only those that end by its last event count.
    """
    if length <= 0 or stride <= 0 or stride > length:
        raise ValueError("length and stride are positive, and the stride is not longer than the window")
    span = events.groupBy(*keys).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    last = F.floor((F.col("_last") - F.col("_first") - F.lit(float(length))) / F.lit(float(stride)))
    out = events.join(span.where(last >= 0).withColumn("_windows", last), keys)
    offset = F.col(at) - F.col("_first")
    low = F.greatest(F.floor((offset - F.lit(float(length))) / F.lit(float(stride))) + 1, F.lit(0))
    high = F.least(F.floor(offset / F.lit(float(stride))), F.col("_windows"))
    out = out.withColumn("window_idx", F.explode(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    return out.withColumn("window_start", F.col("_first") + F.col("window_idx") * F.lit(float(stride))).drop("_first", "_last", "_windows")


def tumbling(events: DataFrame, keys: list[str], at: str, length: float) -> DataFrame:
    """``events`` with epoch_idx: tumbling windows from each key's first event."""
    first = events.groupBy(*keys).agg(F.min(at).alias("_first"))
    return events.join(first, keys).withColumn("epoch_idx", F.floor((F.col(at) - F.col("_first")) / F.lit(float(length)))).drop("_first")


def unanimous(label: str | Column) -> Column:
    """Aggregate: the label if all rows agree and none is null, else null.  Never a majority."""
    column = F.col(label) if isinstance(label, str) else label
    agree = (F.min(column) == F.max(column)) & (F.count(column) == F.count(F.lit(1)))
    return F.when(agree, F.min(column))


def label_windows(windows: DataFrame, runs: DataFrame, key: str, broadcast: bool = False) -> DataFrame:
    """``windows`` (start_s, length_s) with the unanimous label of the runs (begin_s, end_s, label) that they touch.

    A range join on one key; label runs are few per subject.  Pass ``broadcast`` only for
    a run table whose size you have checked.
    """
    side = runs.select(F.col(key).alias("_key"), "begin_s", "end_s", F.col("label").alias("_label"))
    overlap = (F.col(key) == F.col("_key")) & (F.col("begin_s") < F.col("start_s") + F.col("length_s")) & (F.col("end_s") > F.col("start_s"))
    joined = windows.join(F.broadcast(side) if broadcast else side, overlap, "left")
    return joined.groupBy(*windows.columns).agg(unanimous("_label").alias("label"))


def label_epochs(rows: DataFrame, key: str, at: str, order: list[Column], label: str, length: float) -> DataFrame:
    """key, start_s, label of every epoch of ``length`` from a key's first row to its last.

    What a row says holds until the next one, in ``order`` (which begins with ``at``); an
    epoch has the unanimous label of what it touches, as in ``label_windows``.  Rows in a
    row that say the same are one stretch, and the stretch in which an epoch starts knows
    when the next one begins: nothing is joined, and no epoch is sorted or kept.
    """
    frame, whole = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key)
    here, until, first, last, start, step = F.col(at), F.col("_until"), F.col("_first"), F.col("_last"), F.col("start_s"), F.lit(float(length))
    rows = rows.where(here.isNotNull()).withColumns({"_until": F.lead(at).over(frame), "_first": F.min(at).over(whole), "_last": F.max(at).over(whole)})
    rows = rows.where(until.isNull() | (until > here))  # the last row stays: an epoch that starts with it touches nothing
    before = F.lag(F.struct(F.col(label).alias("label"))).over(frame)
    rows = rows.withColumn("_new", until.isNull() | before.isNull() | ~F.col(label).eqNullSafe(before["label"]))
    rows = rows.where("_new").withColumn("_until", F.lead(at).over(frame))
    final = F.floor((last - first) / step)
    low = F.greatest(F.floor((here - first) / step), F.lit(0).cast("long"))
    high = F.least(F.coalesce(F.floor((until - first) / step) + 1, final), final)
    numbers = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    epochs = rows.withColumn("_i", F.explode(numbers)).withColumn("start_s", first + F.col("_i") * step)
    epochs = epochs.where((start >= here) & (until.isNull() | (start < until)))
    alone = F.col(key).isNotNull() & ((until >= start + step) | (until == last))
    return epochs.select(key, "start_s", F.when(alone, F.col(label)).alias("label"))


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(label), F.lit("unlabelled")).alias("label")).agg(F.count("*").alias("n"))


def runs_of(df: DataFrame, keys: list[str], order: list[str], new_run: Column, name: str = "run") -> DataFrame:
    """``df`` with a run number from 0 that grows where ``new_run`` holds (it may use lag over the order)."""
    frame = Window.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumn("_new", F.when(F.coalesce(new_run, F.lit(False)), 1).otherwise(0))
    return flagged.withColumn(name, F.sum("_new").over(frame.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")).drop("_new")


def sessions(df: DataFrame, keys: list[str], at: str, gap: float = 3600.0, tie: list[str] | None = None) -> DataFrame:
    """``df`` with ``session``: a gap longer than ``gap`` seconds starts a new one."""
    order = [at, *(tie or [])]
    before = F.lag(at).over(Window.partitionBy(*keys).orderBy(*order))
    return runs_of(df, keys, order, F.col(at) - before > F.lit(float(gap)), "session")


def label_runs(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """``df`` with ``run``: contiguous rows of one label (null equals null)."""
    frame = Window.partitionBy(*keys).orderBy(*order)
    changed = (F.row_number().over(frame) > 1) & ~F.col(label).eqNullSafe(F.lag(label).over(frame))
    return runs_of(df, keys, order, changed)


def epoch_runs(df: DataFrame, keys: list[str], at: str, step: float = 30.0, slack: float = 1.0) -> DataFrame:
    """``df`` with ``run``: a new one wherever neighbours are not ``step`` apart, give or take ``slack``."""
    before = F.lag(at).over(Window.partitionBy(*keys).orderBy(at))
    return runs_of(df, keys, [at], F.abs(F.col(at) - before - F.lit(float(step))) > F.lit(float(slack)))


def with_context(df: DataFrame, keys: list[str], order: list[str], columns: list[str], offsets: tuple[int, ...] = (-2, -1, 1, 2), reach: int = 2) -> DataFrame:
    """``df`` with neighbours and a centred mean of each column inside its run (``keys``).

    Past a run's edge the edge row repeats; the mean always divides by 2 * reach + 1.
    """
    frame = Window.partitionBy(*keys).orderBy(*order)
    whole = frame.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df
    new: dict[str, Column] = {}
    for name in columns:
        at = {0: F.col(name)}
        for k in sorted({*offsets, *range(-reach, reach + 1)} - {0}):
            edge = F.first(name).over(whole) if k < 0 else F.last(name).over(whole)
            inside = F.lag(F.struct(F.col(name).alias("v")), -k).over(frame) if k < 0 else F.lead(F.struct(F.col(name).alias("v")), k).over(frame)
            at[k] = F.when(inside.isNotNull(), inside["v"]).otherwise(edge)
        new |= {f"{name}_{'prev' if k < 0 else 'next'}{abs(k)}": at[k] for k in offsets}
        total = at[-reach]
        for k in range(-reach + 1, reach + 1):
            total = total + at[k]
        new[f"{name}_mean{2 * reach + 1}"] = total / F.lit(2 * reach + 1)
    return out.withColumns(new)


#: Which sleep columns carry context, by ending or by name.
CARRIED_ENDINGS = ("_delta_rel", "_theta_rel", "_alpha_rel", "_sigma_rel", "_beta_rel", "_entropy", "_edge95", "_total_power")
CARRIED_NAMES = ("eog_slow_rel", "eog_amplitude_sd", "chin_emg_rms")


def carried_columns(names: list[str]) -> list[str]:
    return [n for n in names if n.endswith(CARRIED_ENDINGS) or n in CARRIED_NAMES]


def covered_minutes(df: DataFrame, keys: list[str], start: str, length: float) -> DataFrame:
    """keys and minutes: the length of the union of the windows, overlaps counted once."""
    frame = Window.partitionBy(*keys).orderBy(start)
    reach = F.max(F.col(start) + F.lit(float(length))).over(frame.rowsBetween(Window.unboundedPreceding, -1))
    added = F.lit(float(length)) - F.greatest(F.coalesce(reach - F.col(start), F.lit(0.0)), F.lit(0.0))
    return df.withColumn("_added", added).groupBy(*keys).agg((F.sum("_added") / 60.0).alias("minutes"))


def expand_annotations(annotations: DataFrame, keys: list[str], stages: dict[str, str], epoch: float = 30.0) -> DataFrame:
    """keys, epoch_idx, stage from annotation runs (onset_s, duration_s, text, seq): later ones overwrite.

    ``stages`` maps texts to stages; others are unscored and give null.
    """
    pairs = [F.lit(x) for kv in stages.items() for x in kv]
    known = F.element_at(F.create_map(*pairs), F.col("text")) if pairs else F.lit(None).cast("string")
    first = F.bround(F.col("onset_s") / epoch).cast("long")
    count = F.bround(F.col("duration_s") / epoch).cast("long")
    rows = annotations.withColumn("stage", known).where(count > 0).withColumn("epoch_idx", F.explode(F.sequence(first, first + count - 1)))
    return rows.groupBy(*keys, "epoch_idx").agg(F.max_by(F.struct("stage"), F.col("seq")).getField("stage").alias("stage"))


def trim_sleep(hypnogram: DataFrame, keys: list[str], margin: int, wake: str = "W") -> DataFrame:
    """Epochs from ``margin`` before the first non-wake scored one to ``margin`` after the last; all if there is none."""
    asleep = F.when(F.col("stage").isNotNull() & (F.col("stage") != wake), F.col("epoch_idx"))
    span = hypnogram.groupBy(*keys).agg(F.min(asleep).alias("_lo"), F.max(asleep).alias("_hi"))
    inside = F.col("_lo").isNull() | F.col("epoch_idx").between(F.col("_lo") - margin, F.col("_hi") + margin)
    return hypnogram.join(span, keys).where(inside).drop("_lo", "_hi")


def subject_order(subject: str | Column) -> list[Column]:
    """Sort keys: letters first, then the trailing number as a number, then the whole."""
    column = F.col(subject) if isinstance(subject, str) else subject
    return [F.regexp_replace(column, r"[0-9]+$", ""), F.regexp_extract(column, r"([0-9]+)$", 1).try_cast("long").asc_nulls_first(), column]


def sequence_pieces(df: DataFrame, keys: list[str], at: str, step: float = 30.0, slack: float = 1.0, least: int = 2) -> DataFrame:
    """``df`` with ``run``, without runs of fewer than ``least`` rows: what a sequence model can train on."""
    out = epoch_runs(df, keys, at, step, slack)
    size = F.count("*").over(Window.partitionBy(*keys, "run"))
    return out.withColumn("_size", size).where(F.col("_size") >= least).drop("_size")
