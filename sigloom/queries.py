"""Registered queries over the driver's tables, each with SQL that gives the same rows where SQL can.

Roles: users, customers or sources are subjects; event types or 64-sample embeddings are
signals; a logistic curve of a document's length stands for a model's probability.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays as a
from .functions import features, ids, quality
from .operators import compare, enrolment, lineage, metrics, splits, table, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
HOUR, DAY = 3600.0, 86_400.0


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


# ---------------------------------------------------------------- views on the tables

EV = "ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS t, value FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", windows.seconds("ts").alias("t"), "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", a.doubles(F.col("embedding")).alias("x"))


#: x[i] as rows, i from 1; and the vectors as double lists.
VEC = "vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
SAMPLES = f"{VEC}, s AS (SELECT vec_id, label, i, x[i] AS v FROM vec, unnest(range(1, 65)) AS u(i))"
PREDICTIONS = """pr AS (
  SELECT d.doc_id, source AS subject_id, lang AS fold, CAST(quality AS INTEGER) AS truth,
    1 / (1 + exp(-(CAST(n_chars AS DOUBLE) - 3000) / 2000)) AS probability,
    CASE WHEN 1 / (1 + exp(-(CAST(n_chars AS DOUBLE) - 3000) / 2000)) >= 0.5 THEN 1 ELSE 0 END AS predicted
  FROM documents d JOIN labels USING (doc_id)
)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = 1 / (1 + F.exp(-(F.col("n_chars").cast("double") - 3000) / 2000))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("subject_id"), F.col("lang").alias("fold"), p.alias("probability"))
    truth = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("truth"))
    return docs.join(truth, "doc_id").withColumn("predicted", (F.col("probability") >= 0.5).cast("int"))


# ---------------------------------------------------------------- windows


@query(f"""WITH {EV}, sp AS (SELECT user_id, min(t) AS f, max(t) AS l FROM ev GROUP BY user_id),
b AS (SELECT ev.*, t - f AS o, floor((l - f - 21600) / 3600) AS nw FROM ev JOIN sp USING (user_id) WHERE floor((l - f - 21600) / 3600) >= 0)
SELECT user_id, w AS window_idx, count(*) AS n, round(avg(value), 6) AS mean
FROM b, unnest(range(CAST(greatest(floor((o - 21600) / 3600) + 1, 0) AS BIGINT), CAST(least(floor(o / 3600), nw) AS BIGINT) + 1)) AS u(w)
GROUP BY user_id, w""")
def sliding_windows(spark, sf_dir):
    rows = windows.event_windows(events(spark, sf_dir), ["user_id"], "t", 6 * HOUR, HOUR)
    return rows.groupBy("user_id", "window_idx").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


TUMBLED = f"{EV}, ep AS (SELECT ev.*, CAST(floor((t - min(t) OVER (PARTITION BY user_id)) / 21600) AS BIGINT) AS epoch_idx FROM ev)"


@query(f"""WITH {TUMBLED} SELECT user_id, epoch_idx, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS lowest, max(value) AS highest,
  round((arg_max(value, (t, event_id)) - arg_min(value, (t, event_id))) / 360, 6) AS slope_per_min FROM ep GROUP BY user_id, epoch_idx""")
def tumbling_epochs(spark, sf_dir):
    at = F.struct("t", "event_id")
    slope = (F.max_by("value", at) - F.min_by("value", at)) / 360
    return windows.tumbling(events(spark, sf_dir), ["user_id"], "t", 6 * HOUR).groupBy("user_id", "epoch_idx").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("sd"), F.min("value").alias("lowest"), F.max("value").alias("highest"), r6(slope).alias("slope_per_min"))


@query(f"""WITH {TUMBLED} SELECT user_id, epoch_idx, count(*) AS n, CASE WHEN count(DISTINCT event_type) = 1 AND count(event_type) = count(*) THEN min(event_type) END AS label FROM ep GROUP BY user_id, epoch_idx""")
def window_label_unanimous(spark, sf_dir):
    return windows.tumbling(events(spark, sf_dir), ["user_id"], "t", 6 * HOUR).groupBy("user_id", "epoch_idx").agg(F.count("*").alias("n"), windows.unanimous("event_type").alias("label"))


@query(f"""WITH {TUMBLED}, l AS (SELECT CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS label FROM ep GROUP BY user_id, epoch_idx)
SELECT coalesce(label, 'unlabelled') AS label, count(*) AS n FROM l GROUP BY 1""")
def label_counts(spark, sf_dir):
    return windows.label_counts(window_label_unanimous(spark, sf_dir))


@query(f"""WITH {EV}, r AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS e FROM ev),
runs AS (SELECT user_id, event_type AS label, t AS begin_s, e AS end_s FROM r WHERE e > t),
w AS (SELECT user_id, f + i * 3600 AS start_s FROM (SELECT user_id, min(t) AS f, max(t) AS l FROM ev GROUP BY user_id), unnest(range(0, CAST(floor((l - f) / 3600) AS BIGINT) + 1)) AS u(i))
SELECT w.user_id, round(w.start_s, 6) AS start_s, CASE WHEN min(label) = max(label) AND count(label) = count(*) THEN min(label) END AS label
FROM w LEFT JOIN runs ON runs.user_id = w.user_id AND begin_s < w.start_s + 3600 AND end_s > w.start_s GROUP BY w.user_id, w.start_s""")
def window_label_range_join(spark, sf_dir):
    """Hours of each user's whole span against runs of a label track: what an event says holds until the next one."""
    order = [F.col("t"), F.col("event_id").asc_nulls_last()]
    return rounded(windows.label_epochs(events(spark, sf_dir), "user_id", "t", order, "event_type", HOUR), "start_s")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS nation, i AS idx, CAST(round_even(i * (n_nationkey + 0.5), 0) AS BIGINT) AS start_sample,
  CAST(round_even(i * (n_nationkey + 0.5), 0) + round_even(3 * (n_nationkey + 0.5), 0) AS BIGINT) AS end_sample FROM nation, unnest(range(0, 8)) AS u(i)""")
def sample_ranges(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("idx"))
    first, end = windows.sample_range(F.col("idx").cast("double"), F.lit(3.0), F.col("nation") + F.lit(0.5))
    return rows.select("nation", "idx", first.alias("start_sample"), end.alias("end_sample"))


@query(f"""WITH {VEC} SELECT vec_id, CAST(i AS INTEGER) AS epoch_idx, i * 8 AS start_sample, i * 8 + 16 AS end_sample, round(list_aggregate(x[i * 8 + 1:i * 8 + 16], 'avg'), 6) AS mean FROM vec, unnest(range(0, 7)) AS u(i)""")
def cut_windows(spark, sf_dir):
    signals = vectors(spark, sf_dir).select("vec_id", F.lit(4.0).alias("rate"), F.col("x").alias("samples"))
    return windows.cut_windows(signals, 4.0, 2.0, ["vec_id"]).select("vec_id", "epoch_idx", "start_sample", "end_sample", r6(a.mean(F.col("samples"))).alias("mean"))


@query("""SELECT source AS subject, row_number() OVER (ORDER BY regexp_replace(source, '[0-9]+$', ''), TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) NULLS FIRST, source) AS place
FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)""")
def subject_order(spark, sf_dir):
    subjects = splits.subjects_of(read(spark, sf_dir, "documents"), "source")
    return splits.numbered(subjects).select(F.col("subject_id").alias("subject"), (F.col("place") + 1).cast("long").alias("place"))


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def select_features(spark, sf_dir):
    return table.select_features(read(spark, sf_dir, "orders"), ["o_orderkey"], ["o_totalprice", "o_orderpriority"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders")
def binary_label(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", table.binary("o_orderstatus", "F").alias("y"))


@query("SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def concat_tables(spark, sf_dir):
    one = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    two = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return table.concat_tables([one, two], ["1", "1"])


# ---------------------------------------------------------------- features


@query(f"""WITH {SAMPLES}, p AS (SELECT s.vec_id, s.i, s.v, (SELECT 0) AS z FROM s),
ton AS (SELECT p.vec_id, p.i, p.v, avg(vec.x[greatest(least(p.i + k, 64), 1)]) AS tonic FROM p JOIN vec USING (vec_id), unnest(range(-8, 8)) AS u(k) GROUP BY p.vec_id, p.i, p.v),
ph AS (SELECT *, v - tonic AS q, lag(v - tonic) OVER (PARTITION BY vec_id ORDER BY i) AS before FROM ton)
SELECT vec_id, round(avg(v), 6) AS eda_mean, round(stddev_pop(v), 6) AS eda_sd, round(min(v), 6) AS eda_min, round(max(v), 6) AS eda_max, round((arg_max(v, i) - arg_min(v, i)) / (16.0 / 60), 6) AS eda_slope_per_min,
  round(avg(tonic), 6) AS scl_mean, round(count(*) FILTER (WHERE q > 0.01 AND before <= 0.01) / (16.0 / 60), 6) AS scr_count_per_min, round(coalesce(avg(q) FILTER (WHERE q > 0.01), 0), 6) AS scr_amplitude_mean,
  round((sum(v) - (arg_max(v, i) + arg_min(v, i)) / 2) / 4, 6) AS eda_auc FROM ph GROUP BY vec_id""")
def eda_features(spark, sf_dir):
    found = features.spread(vectors(spark, sf_dir), ["vec_id"], features.eda_columns(F.col("x"), 4.0))
    return rounded(found, *found.columns[1:])


@query(f"""WITH {SAMPLES} SELECT vec_id, round(avg(v), 6) AS temp_mean, round(stddev_pop(v), 6) AS temp_sd, round(min(v), 6) AS temp_min, round(max(v), 6) AS temp_max, round((arg_max(v, i) - arg_min(v, i)) / (16.0 / 60), 6) AS temp_slope_per_min FROM s GROUP BY vec_id""")
def temp_features(spark, sf_dir):
    found = features.spread(vectors(spark, sf_dir), ["vec_id"], features.temp_columns(F.col("x"), 4.0))
    return rounded(found, *found.columns[1:])


ACC = f"""{VEC}, m AS (SELECT vec_id, i, x[i] AS ax, x[i + 21] AS ay, x[i + 42] AS az, sqrt(x[i] * x[i] + x[i + 21] * x[i + 21] + x[i + 42] * x[i + 42]) / 0.5 AS g FROM vec, unnest(range(1, 22)) AS u(i)),
mm AS (SELECT *, lag(g) OVER (PARTITION BY vec_id ORDER BY i) AS before, avg(g) OVER (PARTITION BY vec_id) AS centre FROM m)"""


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = [F.slice("x", 1 + 21 * k, 21).alias(n) for k, n in enumerate(("ax", "ay", "az"))]
    return vectors(spark, sf_dir).select("vec_id", "label", *part)


@query(f"""WITH {ACC} SELECT vec_id, round(avg(g), 6) AS acc_magnitude_mean, round(stddev_pop(g), 6) AS acc_magnitude_sd, round(max(g), 6) AS acc_magnitude_max, round(avg(abs(g - before)) * 32, 6) AS acc_jerk_mean, round(sum(abs(g - centre)), 6) AS acc_activity_count,
  round(stddev_pop(ax) / 0.5, 6) AS acc_x_sd, round(stddev_pop(ay) / 0.5, 6) AS acc_y_sd, round(stddev_pop(az) / 0.5, 6) AS acc_z_sd FROM mm GROUP BY vec_id""")
def acc_features(spark, sf_dir):
    found = features.spread(axes(spark, sf_dir), ["vec_id"], features.acc_columns(F.col("ax"), F.col("ay"), F.col("az"), 32.0, 0.5))
    return rounded(found, *found.columns[1:])


@query(f"""WITH {SAMPLES}, c AS (SELECT vec_id, v - avg(v) OVER (PARTITION BY vec_id) AS q FROM s)
SELECT vec_id, round(sqrt(avg(q * q)), 6) AS chest_emg_rms, round(avg(abs(q)), 6) AS chest_emg_mav, round(quantile_cont(abs(q), 0.95), 6) AS chest_emg_p95, round(max(q) - min(q), 6) AS chin_emg_range FROM c GROUP BY vec_id""")
def emg_features(spark, sf_dir):
    chin = features.emg_columns(F.col("x"), "chin_emg")["chin_emg_range"].alias("chin_emg_range")
    found = features.spread(vectors(spark, sf_dir), ["vec_id", chin], features.emg_columns(F.col("x")))
    return rounded(found, *found.columns[1:])


@query(f"""WITH {SAMPLES}, d AS (SELECT vec_id, i, v, v - lag(v) OVER w AS d1 FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY i)), e AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY vec_id ORDER BY i) AS d2 FROM d)
SELECT vec_id, round(var_pop(v), 6) AS activity, round(sqrt(var_pop(d1) / var_pop(v)), 6) AS mobility, round(sqrt(var_pop(d2) / var_pop(d1)) / sqrt(var_pop(d1) / var_pop(v)), 6) AS complexity FROM e GROUP BY vec_id""")
def hjorth(spark, sf_dir):
    h = vectors(spark, sf_dir).select("vec_id", a.hjorth(F.col("x")).alias("h"))
    return h.select("vec_id", *[r6(F.col(f"h.{n}")).alias(n) for n in ("activity", "mobility", "complexity")])


@query(f"""WITH {SAMPLES}, c AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY vec_id) AS q FROM s), d AS (SELECT vec_id, (q < 0) <> (lag(q) OVER (PARTITION BY vec_id ORDER BY i) < 0) AS x FROM c)
SELECT vec_id, round(count(*) FILTER (WHERE x) / 16.0, 6) AS zero_crossings FROM d GROUP BY vec_id""")
def zero_crossings(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", r6(a.sign_changes(features.centred(F.col("x"))) / 16.0).alias("zero_crossings"))


SPECTRUM = f"""{SAMPLES}, pw AS (SELECT vec_id, k, pow(sum(v * cos(2 * pi() * k * (i - 1) / 64)), 2) + pow(sum(v * sin(2 * pi() * k * (i - 1) / 64)), 2) AS p FROM s, unnest(range(0, 33)) AS u(k) GROUP BY vec_id, k)"""
BINS = {"delta": (1, 4), "theta": (5, 8), "alpha": (9, 12), "sigma": (13, 16), "beta": (17, 30)}


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", "label", a.power_spectrum(F.col("x"), 64).alias("p"))


@query(f"WITH {SPECTRUM} SELECT vec_id, " + ", ".join(f"round(sum(p) FILTER (WHERE k BETWEEN {lo} AND {hi}), 6) AS {n}" for n, (lo, hi) in BINS.items()) + " FROM pw GROUP BY vec_id")
def dft_band_power(spark, sf_dir):
    return spectra(spark, sf_dir).select("vec_id", *[r6(a.band(F.col("p"), *e)).alias(n) for n, e in BINS.items()])


@query(f"WITH {SPECTRUM} SELECT vec_id, " + ", ".join(f"round(sum(p) FILTER (WHERE k BETWEEN {lo} AND {hi}) / sum(p) FILTER (WHERE k BETWEEN 1 AND 30), 6) AS {n}_rel" for n, (lo, hi) in BINS.items()) + ", round(sum(p) FILTER (WHERE k BETWEEN 1 AND 4) / sum(p) FILTER (WHERE k BETWEEN 5 AND 8), 6) AS delta_theta_ratio FROM pw GROUP BY vec_id")
def relative_band_power(spark, sf_dir):
    whole = a.band(F.col("p"), 1, 30)
    ratio = a.band(F.col("p"), *BINS["delta"]) / a.band(F.col("p"), *BINS["theta"])
    return spectra(spark, sf_dir).select("vec_id", *[r6(a.band(F.col("p"), *e) / whole).alias(f"{n}_rel") for n, e in BINS.items()], r6(ratio).alias("delta_theta_ratio"))


@query(f"""WITH {SPECTRUM}, c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY k) AS up, sum(p) OVER (PARTITION BY vec_id) AS whole FROM pw)
SELECT vec_id, CAST(min(k) FILTER (WHERE up >= 0.95 * whole) AS INTEGER) AS edge95, round(-sum(p / whole * ln(p / whole)) / ln(33), 6) AS entropy, arg_max(k, p) AS dominant_bin FROM c GROUP BY vec_id""")
def spectral_shape(spark, sf_dir):
    p = F.col("p")
    return spectra(spark, sf_dir).select("vec_id", a.edge(p, 0.95).alias("edge95"), r6(a.entropy(p)).alias("entropy"), a.argmax(p).alias("dominant_bin"))


@query(f"""WITH {SPECTRUM}, d AS (SELECT vec_id, arg_max(k, p) AS m FROM pw WHERE k BETWEEN 2 AND 16 GROUP BY vec_id)
SELECT vec_id, round(sum(CASE WHEN abs(k - m) <= 1 THEN p ELSE 0 END + CASE WHEN abs(k - 2 * m) <= 1 THEN p ELSE 0 END) / sum(p), 6) AS concentration FROM pw JOIN d USING (vec_id) WHERE k BETWEEN 1 AND 32 GROUP BY vec_id""")
def pulse_concentration(spark, sf_dir):
    rows = spectra(spark, sf_dir).withColumn("m", a.argmax(F.slice("p", 3, 15)) + 2)
    near = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.lit(0.0), lambda s, k: s + F.when(F.abs(k - F.col("m")) <= 1, F.get("p", k)).otherwise(0.0) + F.when(F.abs(k - 2 * F.col("m")) <= 1, F.get("p", k)).otherwise(0.0))
    return rows.select("vec_id", r6(near / a.band(F.col("p"), 1, 32)).alias("concentration"))


@query(f"""WITH {VEC} SELECT vec_id, CAST(i - 1 AS INTEGER) AS at, round(avg(x[greatest(least(i + k, 64), 1)]), 6) AS tonic FROM vec, unnest(range(1, 65)) AS u(i), unnest(range(-8, 8)) AS w(k) GROUP BY vec_id, i""")
def moving_average_edge_padded(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("vec_id", F.posexplode(a.moving_average(F.col("x"), 16)).alias("at", "tonic"))
    return rounded(rows, "tonic")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, x: gaps in seconds between a user's events, in order."""
    ordered = events(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("user_id", a.diff(F.col("t")).alias("x"))


GAPS = f"""{EV}, gaps AS (SELECT user_id, row_number() OVER w AS i, t - lag(t) OVER w AS x FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)),
g AS (SELECT user_id, i - 1 AS i, x FROM gaps WHERE x IS NOT NULL),
walk AS (SELECT user_id, i, x, x AS last, true AS keep FROM g WHERE i = 1 UNION ALL SELECT g.user_id, g.i, g.x, CASE WHEN abs(g.x - w.last) <= 0.2 * w.last THEN g.x ELSE w.last END, abs(g.x - w.last) <= 0.2 * w.last FROM walk w JOIN g ON g.user_id = w.user_id AND g.i = w.i + 1)"""


@query(f"WITH RECURSIVE {GAPS} SELECT user_id, i, round(x, 6) AS x, keep FROM walk")
def rr_malik_clean(spark, sf_dir):
    rows = intervals(spark, sf_dir).select("user_id", F.posexplode(F.arrays_zip("x", a.kept_intervals(F.col("x"), 0.2).alias("keep"))).alias("i", "z"))
    return rows.select("user_id", (F.col("i") + 1).cast("long").alias("i"), r6(F.col("z.x")).alias("x"), F.col("z.keep").alias("keep"))


@query(f"""WITH RECURSIVE {GAPS}, st AS (SELECT *, x - lag(x) OVER w AS d, lag(keep) OVER w AS k FROM walk WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, count(*) FILTER (WHERE keep) AS n, round(avg(x) FILTER (WHERE keep), 6) AS rr_mean, round(stddev_samp(x) FILTER (WHERE keep), 6) AS sdnn,
  round(sqrt(avg(d * d) FILTER (WHERE keep AND k)), 6) AS rmssd, round(avg(CASE WHEN abs(d) > 50 THEN 1.0 ELSE 0.0 END) FILTER (WHERE keep AND k), 6) AS pnn50 FROM st GROUP BY user_id""")
def rmssd_sdnn_pnn50(spark, sf_dir):
    rows = intervals(spark, sf_dir).where(F.size("x") > 0).withColumn("keep", a.kept_intervals(F.col("x"), 0.2))
    good = F.transform(F.filter(F.arrays_zip("x", "keep"), lambda z: z["keep"]), lambda z: z["x"])
    n = F.size("x")
    both = F.zip_with(F.slice("keep", F.lit(2), n - 1), F.slice("keep", F.lit(1), n - 1), lambda p, q: p & q)
    steps = F.transform(F.filter(F.arrays_zip(a.diff(F.col("x")).alias("d"), both.alias("k")), lambda z: z["k"]), lambda z: z["d"])
    rows = rows.select("user_id", good.alias("g"), steps.alias("d"))
    some = F.size("d") > 0
    sdnn = F.when(F.size("g") > 1, a.sd(F.col("g"), 1))
    rmssd = F.when(some, F.sqrt(a.mean(F.transform("d", lambda v: v * v))))
    pnn = F.when(some, a.mean(F.transform("d", lambda v: F.when(F.abs(v) > 50, 1.0).otherwise(0.0))))
    return rows.select("user_id", F.size("g").cast("long").alias("n"), r6(a.mean(F.col("g"))).alias("rr_mean"), r6(sdnn).alias("sdnn"), r6(rmssd).alias("rmssd"), r6(pnn).alias("pnn50"))


# ---------------------------------------------------------------- quality

EDA_QC = f"""{SAMPLES}, e AS (SELECT vec_id, label, i, v * 10 + 1 AS q, (v * 10 + 1) - lag(v * 10 + 1) OVER (PARTITION BY vec_id ORDER BY i) AS d FROM s),
c AS (SELECT vec_id, label, min(q) AS lo, max(q) AS hi, stddev_pop(q) AS sd, max(abs(d)) AS jump FROM e GROUP BY vec_id, label),
codes AS (SELECT vec_id, label, list_filter([CASE WHEN lo < 0 THEN 'negative' END, CASE WHEN sd <= 1e-4 THEN 'flatline' END, CASE WHEN lo < 0.01 OR hi > 60 THEN 'out_of_range' END, CASE WHEN jump > 1 THEN 'discontinuity' END], lambda z: z IS NOT NULL) AS codes FROM c)"""
STATUS = "CASE WHEN len(list_filter(codes, lambda z: z NOT IN ('motion', 'discontinuity'))) > 0 THEN 'rejected' WHEN len(codes) > 0 THEN 'warning' ELSE 'valid' END"


def eda_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("vec_id", "label", quality.eda_codes(F.transform("x", lambda v: v * 10 + 1)).alias("codes"))
    return rows.withColumn("status", quality.status(F.col("codes"), quality.WRIST))


@query(f"WITH {EDA_QC} SELECT vec_id, array_to_string(codes, ',') AS codes, {STATUS} AS status FROM codes")
def qc_eda(spark, sf_dir):
    return eda_verdicts(spark, sf_dir).select("vec_id", F.array_join("codes", ",").alias("codes"), "status")


@query(f"""WITH {SAMPLES}, c AS (SELECT vec_id, min(v) * 40 + 33 AS lo, max(v) * 40 + 33 AS hi, abs(arg_max(v, i) - arg_min(v, i)) * 40 / (64 / 240.0) AS slope FROM s GROUP BY vec_id),
codes AS (SELECT vec_id, list_filter([CASE WHEN lo < 25 OR hi > 40 THEN 'out_of_range' END, CASE WHEN slope > 2 THEN 'discontinuity' END], lambda z: z IS NOT NULL) AS codes FROM c)
SELECT vec_id, array_to_string(codes, ',') AS codes, {STATUS} AS status FROM codes""")
def qc_temp(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("vec_id", quality.temp_codes(F.transform("x", lambda v: v * 40 + 33), 4.0).alias("codes"))
    return rows.select("vec_id", F.array_join("codes", ",").alias("codes"), quality.status(F.col("codes"), quality.WRIST).alias("status"))


@query(f"""WITH {VEC}, p AS (SELECT vec_id, i, round(x[i] * 400) AS v FROM vec, unnest(range(1, 64)) AS u(i)),
r AS (SELECT vec_id, avg(CASE WHEN abs(abs(v) - 128) <= 0.5 + 1e-5 * 128 THEN 1.0 ELSE 0.0 END) AS share FROM p GROUP BY vec_id)
SELECT vec_id, CASE WHEN share > 0.01 THEN 'saturated' ELSE '' END AS codes, CASE WHEN share > 0.01 THEN 'rejected' ELSE 'valid' END AS status FROM r""")
def qc_acc(spark, sf_dir):
    rows = axes(spark, sf_dir)
    scaled = [F.transform(n, lambda v: F.round(v * 400)) for n in ("ax", "ay", "az")]
    rows = rows.select("vec_id", quality.acc_codes(*scaled).alias("codes"))
    return rows.select("vec_id", F.array_join("codes", ",").alias("codes"), quality.status(F.col("codes"), quality.WRIST).alias("status"))


@query(f"WITH {EDA_QC} SELECT 'EDA:' || code AS code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM codes) GROUP BY 1")
def qc_tally(spark, sf_dir):
    return table.tally(eda_verdicts(spark, sf_dir).withColumn("signal", F.lit("EDA")), "signal", "codes")


KNOWN = ["negative", "flatline", "out_of_range", "discontinuity"]


@query(f"WITH {EDA_QC} SELECT vec_id, CASE WHEN len(codes) > 0 THEN 1 ELSE 0 END AS qc_eda_flagged, CASE WHEN {STATUS} = 'rejected' THEN 1 ELSE 0 END AS qc_eda_rejected, CAST(len(codes) AS INTEGER) AS qc_eda_codes, " + ", ".join(f"CASE WHEN list_contains(codes, '{k}') THEN 1 ELSE 0 END AS qc_eda_{k}" for k in KNOWN) + " FROM codes")
def qc_indicators(spark, sf_dir):
    return eda_verdicts(spark, sf_dir).select("vec_id", *table.indicators("codes", "status", KNOWN, "eda"))


@query(f"""WITH {EDA_QC}, {ACC[len(VEC) + 2:]}, mv AS (SELECT vec_id, stddev_pop(g * 0.5) > 0.08 AS moved FROM m GROUP BY vec_id),
j AS (SELECT vec_id, CASE WHEN moved THEN list_append(codes, 'motion') ELSE codes END AS codes FROM codes JOIN mv USING (vec_id))
SELECT vec_id, array_to_string(codes, ',') AS codes, {STATUS} AS status FROM j""")
def motion_cross_signal(spark, sf_dir):
    policy = quality.WRIST.changed("wrist-unit-g", g_scale=1.0)
    moved = axes(spark, sf_dir).select("vec_id", quality.in_motion(F.col("ax"), F.col("ay"), F.col("az"), policy).alias("moved"))
    rows = eda_verdicts(spark, sf_dir).join(moved, "vec_id", "left").withColumn("codes", quality.with_motion(F.col("codes"), F.col("moved")))
    return rows.select("vec_id", F.array_join("codes", ",").alias("codes"), quality.status(F.col("codes"), policy).alias("status"))


@query("SELECT n_nationkey AS id, 'a recording needs a positive rate' AS broken FROM nation WHERE n_nationkey % 5 = 0")
def invariant_violations(spark, sf_dir):
    from . import schemas

    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 5 == 0, 0.0).otherwise(4.0).alias("sampling_rate_hz"), F.array(F.lit("EDA")).alias("channels"), F.array(F.lit("uS")).alias("units"))
    return schemas.violations(rows, "recordings").select("id", F.array_join("broken", "; ").alias("broken"))


# ---------------------------------------------------------------- table

LONG = f"{EV}, lf AS (SELECT user_id, event_type AS name, avg(value) AS value FROM ev GROUP BY ALL)"


def long_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id", F.col("event_type").alias("name")).agg(F.avg("value").alias("value"))


@query(f"WITH {LONG}, t AS (SELECT count(DISTINCT user_id) AS rows FROM ev) SELECT name, count(*) AS n, any_value(rows) AS rows, count(*) >= 0.9 * any_value(rows) AS kept FROM lf, t GROUP BY name")
def coverage_columns(spark, sf_dir):
    return table.coverage(long_features(spark, sf_dir), ["user_id"], 0.9)


@query(f"WITH {LONG} SELECT user_id, " + ", ".join(f"round(max(value) FILTER (WHERE name = '{n}'), 6) AS {n}" for n in EVENT_TYPES) + " FROM lf GROUP BY user_id HAVING " + " AND ".join(f"count(*) FILTER (WHERE name = '{n}') > 0" for n in EVENT_TYPES))
def assemble_table(spark, sf_dir):
    wide, names, _ = table.assemble(long_features(spark, sf_dir), ["user_id"], 0.5)
    return rounded(wide, *names)


@query(f"WITH {LONG}, w AS (SELECT user_id, " + ", ".join(f"max(value) FILTER (WHERE name = '{n}') AS {n}" for n in EVENT_TYPES) + " FROM lf GROUP BY user_id) " + " UNION ALL ".join(f"SELECT user_id, '{n}' AS name, round({n}, 6) AS value FROM w" for n in EVENT_TYPES))
def unpivot_table(spark, sf_dir):
    names = list(EVENT_TYPES)
    return rounded(table.unpivot(table.pivot(long_features(spark, sf_dir), ["user_id"], names), ["user_id"], names), "value")


@query(f"""WITH {EV}, l AS (SELECT user_id AS subject, CAST(floor(t / 86400) AS BIGINT) % 30 AS day, count(*) AS n_events FROM ev GROUP BY ALL),
r AS (SELECT o_custkey AS subject, CAST(floor(epoch_us(o_orderdate) / 1e6 / 86400) AS BIGINT) % 30 AS day, count(*) AS n_orders FROM orders GROUP BY ALL)
SELECT coalesce(l.subject, r.subject) AS subject, coalesce(l.day, r.day) AS day, coalesce(n_events, 0) AS n_events, coalesce(n_orders, 0) AS n_orders, n_events IS NOT NULL AS has_wrist, n_orders IS NOT NULL AS has_chest FROM l FULL JOIN r ON l.subject = r.subject AND l.day = r.day""")
def device_fusion(spark, sf_dir):
    day = lambda t: (F.floor(t / DAY).cast("long") % 30).alias("day")
    left = events(spark, sf_dir).groupBy(F.col("user_id").alias("subject"), day(F.col("t"))).agg(F.count("*").alias("n_events"))
    right = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("subject"), day(windows.seconds("o_orderdate"))).agg(F.count("*").alias("n_orders"))
    return table.fuse(left, right, ["subject", "day"], ("wrist", "chest")).na.fill(0, ["n_events", "n_orders"])


# ---------------------------------------------------------------- runs, sessions, context

SESSIONS = f"""{EV}, b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 21600 THEN 1 ELSE 0 END AS new FROM ev),
ses AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM b)"""


@query(f"WITH {SESSIONS} SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(min(t), 3) AS begin_s, round(max(t), 3) AS end_s FROM ses GROUP BY user_id, session")
def sessions(spark, sf_dir):
    rows = windows.sessions(events(spark, sf_dir), ["user_id"], "t", 6 * HOUR, ["event_id"])
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.min("t"), 3).alias("begin_s"), F.round(F.max("t"), 3).alias("end_s"))


LABEL_RUNS = f"""{EV}, b AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
lr AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM b)"""


@query(f"WITH {LABEL_RUNS} SELECT user_id, run, min(event_type) AS label, count(*) AS n FROM lr GROUP BY user_id, run")
def label_runs(spark, sf_dir):
    rows = windows.label_runs(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "event_type")
    return rows.groupBy("user_id", "run").agg(F.min("event_type").alias("label"), F.count("*").alias("n"))


@query(f"""WITH {EV}, b AS (SELECT *, CASE WHEN abs(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) - 36000) > 35000 THEN 1 ELSE 0 END AS new FROM ev)
SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM b""")
def epoch_runs(spark, sf_dir):
    return windows.epoch_runs(events(spark, sf_dir), ["user_id"], "t", 10 * HOUR, 35_000.0).select("event_id", "run")


def _neighbour(k: int) -> str:
    frame = "(PARTITION BY user_id, session ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    order = "(PARTITION BY user_id, session ORDER BY t, event_id)"
    return f"coalesce(lag(value, {k}) OVER {order}, first_value(value) OVER {frame})" if k > 0 else f"coalesce(lead(value, {-k}) OVER {order}, last_value(value) OVER {frame})"


@query(f"WITH {SESSIONS} SELECT event_id, {_neighbour(2)} AS value_prev2, {_neighbour(1)} AS value_prev1, {_neighbour(-1)} AS value_next1, {_neighbour(-2)} AS value_next2, round(({_neighbour(2)} + {_neighbour(1)} + value + {_neighbour(-1)} + {_neighbour(-2)}) / 5, 6) AS value_mean5 FROM ses")
def context_lag_lead_mean(spark, sf_dir):
    rows = windows.sessions(events(spark, sf_dir), ["user_id"], "t", 6 * HOUR, ["event_id"])
    rows = windows.with_context(rows, ["user_id", "session"], ["t", "event_id"], ["value"])
    return rounded(rows.select("event_id", "value_prev2", "value_prev1", "value_next1", "value_next2", "value_mean5"), "value_mean5")


@query(f"""WITH {EV}, o AS (SELECT user_id, t, max(t + 21600) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev)
SELECT user_id, round(sum(21600 - greatest(coalesce(reach - t, 0), 0)) / 60, 3) AS minutes FROM o GROUP BY user_id""")
def covered_minutes(spark, sf_dir):
    rows = windows.covered_minutes(events(spark, sf_dir), ["user_id"], "t", 6 * HOUR)
    return rows.select("user_id", F.round("minutes", 3).alias("minutes"))


ROLES = {"user": "N2", "assistant": "W"}
HYPNOGRAM = """an AS (SELECT conv_id, turn AS seq, turn * 60 AS onset_s, 30 * (1 + length(text) % 4) AS duration_s, role FROM conversations),
ex AS (SELECT conv_id, CAST(round_even(onset_s / 30.0, 0) AS BIGINT) + k AS epoch_idx, seq, CASE role WHEN 'user' THEN 'N2' WHEN 'assistant' THEN 'W' END AS stage FROM an, unnest(range(0, CAST(duration_s / 30 AS BIGINT))) AS u(k)),
hyp AS (SELECT conv_id, epoch_idx, stage FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, epoch_idx ORDER BY seq DESC) AS r FROM ex) WHERE r = 1)"""


def hypnogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), (F.col("turn") * 60.0).alias("onset_s"), (30.0 * (1 + F.length("text") % 4)).alias("duration_s"), F.col("role").alias("text"))
    return windows.expand_annotations(rows, ["conv_id"], ROLES)


@query(f"WITH {HYPNOGRAM} SELECT conv_id, epoch_idx, stage FROM hyp")
def hypnogram_expand(spark, sf_dir):
    return hypnogram(spark, sf_dir)


@query(f"""WITH {HYPNOGRAM}, sp AS (SELECT conv_id, min(epoch_idx) FILTER (WHERE stage <> 'W') AS lo, max(epoch_idx) FILTER (WHERE stage <> 'W') AS hi FROM hyp GROUP BY conv_id)
SELECT conv_id, epoch_idx, stage FROM hyp JOIN sp USING (conv_id) WHERE lo IS NULL OR epoch_idx BETWEEN lo - 1 AND hi + 1""")
def sleep_trim(spark, sf_dir):
    return windows.trim_sleep(hypnogram(spark, sf_dir), ["conv_id"], 1)


# ---------------------------------------------------------------- splits

SUBJECTS = "su AS (SELECT DISTINCT source AS subject_id FROM documents WHERE source IS NOT NULL)"
PLACED = f"{SUBJECTS}, pl AS (SELECT subject_id, row_number() OVER (ORDER BY regexp_replace(subject_id, '[0-9]+$', ''), TRY_CAST(nullif(regexp_extract(subject_id, '([0-9]+)$', 1), '') AS BIGINT) NULLS FIRST, subject_id) - 1 AS place FROM su)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.subjects_of(read(spark, sf_dir, "documents"), "source")


@query(f"WITH {PLACED} SELECT f.place AS fold, s.subject_id, CASE WHEN f.place = s.place THEN 'test' ELSE 'train' END AS role FROM pl f, pl s")
def loso_splits(spark, sf_dir):
    return splits.leave_one_out(sources(spark, sf_dir)).withColumn("fold", F.col("fold").cast("long"))


@query(f"WITH {SUBJECTS} SELECT subject_id, CAST((row_number() OVER (ORDER BY sha256('3:' || subject_id), subject_id) - 1) % 4 AS INTEGER) AS fold FROM su")
def group_kfold_hash(spark, sf_dir):
    return splits.group_folds(sources(spark, sf_dir), 4, 3)


@query(f"WITH {SUBJECTS} SELECT subject_id, CASE WHEN row_number() OVER (ORDER BY sha256('5:' || subject_id), subject_id) <= round_even(0.3 * (SELECT count(*) FROM su), 0) THEN 'test' ELSE 'train' END AS role FROM su")
def held_out_cohort(spark, sf_dir):
    return splits.held_out_cohort(sources(spark, sf_dir), 0.3, 5)


@query(f"WITH {SUBJECTS} SELECT subject_id, CASE WHEN starts_with(subject_id, 'src1') THEN 'train' ELSE 'test' END AS role FROM su WHERE starts_with(subject_id, 'src1') OR starts_with(subject_id, 'src2')")
def cohort_split(spark, sf_dir):
    return splits.cohort_split(sources(spark, sf_dir), "src1", "src2")


@query(f"""WITH {SUBJECTS}, a AS (SELECT subject_id FROM su WHERE starts_with(subject_id, 'src1')), i AS (SELECT subject_id, CASE WHEN row_number() OVER (ORDER BY sha256('5:' || subject_id), subject_id) <= greatest(round_even(0.3 * (SELECT count(*) FROM a), 0), 1) THEN 'test' ELSE 'train' END AS role FROM a)
SELECT 'in_domain' AS split, subject_id, role FROM i UNION ALL SELECT 'cross_cohort', subject_id, role FROM i WHERE role = 'train' UNION ALL SELECT 'cross_cohort', subject_id, 'test' FROM su WHERE starts_with(subject_id, 'src2')""")
def cross_cohort(spark, sf_dir):
    return splits.cross_cohort(sources(spark, sf_dir), "src1", "src2", 0.3, 5)


@query(f"WITH {SUBJECTS} SELECT doc_id FROM documents WHERE starts_with(source, 'src1')")
def split_rows(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return splits.rows_of(docs, cohort_split(spark, sf_dir), "source", "train").select("doc_id")


# ---------------------------------------------------------------- metrics


@query(f"WITH {PREDICTIONS} SELECT fold, truth, predicted, count(*) AS n FROM pr GROUP BY ALL")
def confusion(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir), ["fold"])


@query(f"WITH {PREDICTIONS} SELECT truth, count(*) FILTER (WHERE predicted = 0) AS pred_0, count(*) FILTER (WHERE predicted = 1) AS pred_1 FROM pr GROUP BY truth")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(predictions(spark, sf_dir), [], [0, 1])


CLASSES = f"""{PREDICTIONS}, c AS (SELECT fold, label, sum(t) AS support, sum(p) AS predicted_n, sum(h) AS hits FROM (
  SELECT fold, truth AS label, 1 AS t, 0 AS p, CASE WHEN truth = predicted THEN 1 ELSE 0 END AS h FROM pr UNION ALL SELECT fold, predicted, 0, 1, 0 FROM pr) GROUP BY ALL),
k AS (SELECT *, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall, 2 * hits / (support + predicted_n) AS f1 FROM c)"""


@query(f"WITH {CLASSES} SELECT fold, label, CAST(support AS BIGINT) AS support, round(recall, 6) AS recall, round(CASE WHEN predicted_n > 0 THEN hits / predicted_n ELSE 0 END, 6) AS precision, round(f1, 6) AS f1 FROM k")
def recall_by_class(spark, sf_dir):
    return rounded(metrics.by_class(predictions(spark, sf_dir), ["fold"]).select("fold", "label", "support", "recall", "precision", "f1"), "recall", "precision", "f1")


@query(f"""WITH {CLASSES} SELECT fold, CAST(sum(support) AS BIGINT) AS n, round(sum(hits) / sum(support), 6) AS accuracy, round(avg(recall) FILTER (WHERE support > 0), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1,
  round((sum(hits) / sum(support) - sum(support * predicted_n) / (sum(support) * sum(support))) / (1 - sum(support * predicted_n) / (sum(support) * sum(support))), 6) AS kappa FROM k GROUP BY fold""")
def accuracy_f1_kappa(spark, sf_dir):
    return rounded(metrics.classification(predictions(spark, sf_dir), ["fold"]), "accuracy", "balanced_accuracy", "macro_f1", "kappa")


def _auc_sql(keys: str) -> str:
    part, group = (f"PARTITION BY {keys} ", f"GROUP BY {keys}") if keys else ("", "")
    lead = f"{keys}, " if keys else ""
    return f"""WITH {PREDICTIONS}, rk AS (SELECT *, rank() OVER ({part}ORDER BY probability) + (count(*) OVER (PARTITION BY {lead}probability) - 1) / 2.0 AS r FROM pr)
SELECT {lead}CAST(sum(truth) AS BIGINT) AS positives, CAST(sum(1 - truth) AS BIGINT) AS negatives, round(CASE WHEN sum(truth) > 0 AND sum(1 - truth) > 0 THEN (sum(r * truth) - sum(truth) * (sum(truth) + 1) / 2.0) / (sum(truth) * sum(1 - truth)) END, 6) AS roc_auc FROM rk {group}"""


@query(_auc_sql(""))
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(predictions(spark, sf_dir), []), "roc_auc")


@query(_auc_sql("subject_id"))
def roc_auc_by_subject(spark, sf_dir):
    return rounded(metrics.roc_auc(predictions(spark, sf_dir), ["subject_id"]), "roc_auc")


AP = """ap AS (SELECT fold, probability, sum(truth) AS pos, count(*) AS n FROM pr GROUP BY ALL), apc AS (SELECT *, sum(pos) OVER w / sum(n) OVER w AS pc FROM ap WINDOW w AS (PARTITION BY fold ORDER BY probability DESC)),
ape AS (SELECT fold, CASE WHEN sum(pos) > 0 THEN sum(pos * pc) / sum(pos) END AS average_precision FROM apc GROUP BY fold)"""


@query(f"WITH {PREDICTIONS}, {AP} SELECT fold, round(average_precision, 6) AS average_precision FROM ape")
def average_precision(spark, sf_dir):
    return rounded(metrics.average_precision(predictions(spark, sf_dir), ["fold"]), "average_precision")


@query(f"WITH {PREDICTIONS} SELECT fold, round(avg((probability - truth) * (probability - truth)), 6) AS brier FROM pr GROUP BY fold")
def brier(spark, sf_dir):
    return rounded(metrics.brier(predictions(spark, sf_dir), ["fold"]), "brier")


BIN = "CAST(" + " + ".join(f"CASE WHEN probability > {i / 10} THEN 1 ELSE 0 END" for i in range(1, 10)) + " AS INTEGER)"
ECE = f"eb AS (SELECT fold, {BIN} AS bin, count(*) AS n, avg(truth) AS mt, avg(probability) AS mp FROM pr GROUP BY ALL)"


@query(f"WITH {PREDICTIONS}, {ECE} SELECT fold, round(sum(n * abs(mt - mp)) / sum(n), 6) AS ece FROM eb GROUP BY fold")
def ece10(spark, sf_dir):
    return rounded(metrics.calibration(predictions(spark, sf_dir), ["fold"]), "ece")


@query(f"WITH {PREDICTIONS}, {ECE} SELECT fold, bin, n, round(mt, 6) AS mean_truth, round(mp, 6) AS mean_probability FROM eb")
def reliability_table(spark, sf_dir):
    return rounded(metrics.calibration_bins(predictions(spark, sf_dir), ["fold"]), "mean_truth", "mean_probability")


@query(f"""WITH {CLASSES}, {AP}, {ECE}, cl AS (SELECT fold, sum(hits) / sum(support) AS accuracy, avg(recall) FILTER (WHERE support > 0) AS balanced_accuracy FROM k GROUP BY fold),
e AS (SELECT fold, sum(n * abs(mt - mp)) / sum(n) AS ece FROM eb GROUP BY fold), br AS (SELECT fold, avg((probability - truth) * (probability - truth)) AS brier FROM pr GROUP BY fold)
SELECT fold, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(average_precision, 6) AS average_precision, round(ece, 6) AS ece, round(brier, 6) AS brier FROM cl JOIN ape USING (fold) JOIN e USING (fold) JOIN br USING (fold)""")
def score_all(spark, sf_dir):
    names = ("accuracy", "balanced_accuracy", "average_precision", "ece", "brier")
    return rounded(metrics.score(predictions(spark, sf_dir), ["fold"]).select("fold", *names), *names)


@query(f"WITH {PREDICTIONS} SELECT fold, round(avg(truth), 6) AS constant_rate FROM pr GROUP BY fold")
def constant_rate(spark, sf_dir):
    return rounded(metrics.constant_rate(predictions(spark, sf_dir), ["fold"], "truth"), "constant_rate")


SUBJECT_SCORES = CLASSES.replace("fold", "subject_id").replace("lang AS subject_id", "lang AS fold") + """, two AS (SELECT subject_id FROM pr GROUP BY subject_id HAVING count(DISTINCT truth) >= 2),
ss AS (SELECT subject_id, CAST(sum(support) AS BIGINT) AS n, avg(recall) FILTER (WHERE support > 0) AS balanced_accuracy FROM k WHERE subject_id IN (SELECT subject_id FROM two) GROUP BY subject_id)"""


@query(f"WITH {SUBJECT_SCORES} SELECT subject_id, n, round(balanced_accuracy, 6) AS balanced_accuracy FROM ss")
def per_subject_scores(spark, sf_dir):
    return rounded(metrics.per_subject(predictions(spark, sf_dir), []).select("subject_id", "n", "balanced_accuracy"), "balanced_accuracy")


@query(f"WITH {SUBJECT_SCORES} SELECT arg_min(subject_id, (round(balanced_accuracy, 6), subject_id)) AS worst_subject, min(round(balanced_accuracy, 6)) AS worst_balanced_accuracy FROM ss")
def worst_subject(spark, sf_dir):
    return metrics.worst_subject(rounded(metrics.per_subject(predictions(spark, sf_dir), []), "balanced_accuracy"), [])


@query(f"""WITH {CLASSES}, cl AS (SELECT fold, sum(hits) / sum(support) AS accuracy, avg(f1) AS macro_f1 FROM k GROUP BY fold)
SELECT count(*) AS folds, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_sd, round(min(accuracy), 6) AS accuracy_min, round(avg(macro_f1), 6) AS macro_f1_mean, round(stddev_pop(macro_f1), 6) AS macro_f1_sd, round(min(macro_f1), 6) AS macro_f1_min FROM cl""")
def fold_aggregate(spark, sf_dir):
    out = metrics.over_folds(metrics.classification(predictions(spark, sf_dir), ["fold"]), [], ["accuracy", "macro_f1"])
    return rounded(out, *[c for c in out.columns if c != "folds"])


# ---------------------------------------------------------------- coverage and comparison


@query("SELECT coalesce(events.user_id, -1) AS user_id, coalesce(events.event_type, 'all') AS event_type, CAST(grouping(events.user_id) AS TINYINT) AS all_subjects, CAST(grouping(events.event_type) AS TINYINT) AS all_labels, count(*) AS n FROM events GROUP BY GROUPING SETS ((events.user_id, events.event_type), (events.user_id), (events.event_type), ())")
def coverage_grouping_sets(spark, sf_dir):
    return compare.coverage(read(spark, sf_dir, "events"), "user_id", "event_type").na.fill({"user_id": -1, "event_type": "all"})


@query("SELECT user_id, count(*) AS rows, count(*) FILTER (WHERE event_type = 'error') AS positives, count(*) FILTER (WHERE event_type = 'error') BETWEEN 1 AND count(*) - 1 AS scorable FROM events GROUP BY user_id")
def scorable(spark, sf_dir):
    return compare.scorable(read(spark, sf_dir, "events"), "user_id", "event_type", "error")


@query("SELECT event_type, count(*) AS rows, count(*) FILTER (WHERE value > 50) AS kept, round(count(*) FILTER (WHERE value > 50) / count(*), 6) AS share FROM events GROUP BY event_type")
def retention(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    return rounded(compare.retention(ev, ev.where("value > 50"), "event_type"), "share")


PAIRED = f"""{PREDICTIONS}, l AS (SELECT subject_id, avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END) AS "left" FROM pr GROUP BY 1), r AS (SELECT subject_id, avg(CASE WHEN truth = 1 THEN 1.0 ELSE 0.0 END) AS "right" FROM pr GROUP BY 1),
pd AS (SELECT subject_id, round("left", 6) AS "left", round("right", 6) AS "right", round("right" - "left", 6) AS difference FROM l JOIN r USING (subject_id))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    left = p.groupBy("subject_id").agg(F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("accuracy"))
    right = p.groupBy("subject_id").agg(F.avg((F.col("truth") == 1).cast("double")).alias("accuracy"))
    return rounded(compare.paired(left, right, "subject_id", "accuracy"), "left", "right", "difference")


@query(f"WITH {PAIRED} SELECT * FROM pd")
def paired_difference(spark, sf_dir):
    return pairs(spark, sf_dir)


@query(f"WITH {PAIRED} SELECT count(*) AS subjects, round(avg(difference), 6) AS mean, count(*) FILTER (WHERE difference > 0) AS better, count(*) FILTER (WHERE difference < 0) AS worse, count(*) FILTER (WHERE difference = 0) AS tied FROM pd")
def paired_summary(spark, sf_dir):
    return rounded(compare.paired_summary(pairs(spark, sf_dir)), "mean")


@query()
def paired_bootstrap(spark, sf_dir):
    """Interval of the mean paired difference: one number per subject goes to the driver."""
    got = compare.bootstrap([r["difference"] for r in pairs(spark, sf_dir).collect()], seed=1)
    return spark.createDataFrame([(got["mean"], got["low"], got["high"], got["crosses_zero"], compare.verdict(got))], "mean double, low double, high double, crosses_zero boolean, verdict string")


@query("""WITH sc AS (SELECT CASE WHEN event_type = 'view' THEN 'full' WHEN event_type IN ('click', 'error') THEN 'alone' ELSE 'without' END AS kind, CASE event_type WHEN 'view' THEN 'all' WHEN 'click' THEN 'g1' WHEN 'purchase' THEN 'g1' ELSE 'g2' END AS "group", avg(value) AS score FROM events GROUP BY event_type),
f AS (SELECT max(score) AS full_score FROM sc WHERE kind = 'full')
SELECT "group", round(max(CASE WHEN kind = 'alone' THEN score END), 6) AS alone, round(max(CASE WHEN kind = 'without' THEN score END), 6) AS without, round(any_value(full_score), 6) AS "full", round(any_value(full_score) - max(CASE WHEN kind = 'without' THEN score END), 6) AS contribution FROM sc, f WHERE kind <> 'full' GROUP BY 1""")
def ablation_contribution(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "full").when(F.col("event_type").isin("click", "error"), "alone").otherwise("without")
    group = F.when(F.col("event_type") == "view", "all").when(F.col("event_type").isin("click", "purchase"), "g1").otherwise("g2")
    scores = read(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("score")).select(kind.alias("kind"), group.alias("group"), "score")
    out = compare.contributions(scores, "score")
    return rounded(out, "alone", "without", "full", "contribution")


# ---------------------------------------------------------------- enrolment


def enrolled(spark: SparkSession, sf_dir: str, strategy: str, **more) -> DataFrame:
    return enrolment.enrol(events(spark, sf_dir), "user_id", "t", "event_type", 0.1, strategy, length=HOUR, gap=6 * HOUR, tie=["event_id"], **more)


def parts(df: DataFrame) -> DataFrame:
    return df.where("part is not null").select("event_id", "part")


SPAN = f"{EV}, sp AS (SELECT user_id, min(t) AS f, max(t) AS l, max(t) - min(t) AS d FROM ev GROUP BY user_id)"


@query(f"""WITH {SPAN}, sn AS (SELECT user_id, max(m) AS complete FROM (SELECT user_id, event_type, min(t) AS m FROM ev GROUP BY ALL) GROUP BY user_id), c AS (SELECT ev.*, d, greatest(complete, f + d * 0.1) AS cut FROM ev JOIN sp USING (user_id) JOIN sn USING (user_id))
SELECT event_id, part FROM (SELECT event_id, CASE WHEN d <= 0 THEN 'evaluate' WHEN t <= cut THEN 'enrol' WHEN t > cut + 3600 THEN 'evaluate' END AS part FROM c) WHERE part IS NOT NULL""")
def enrol_prospective(spark, sf_dir):
    return parts(enrolled(spark, sf_dir, "prospective"))


@query(f"WITH {SESSIONS} SELECT event_id, CASE WHEN session = 0 THEN 'enrol' ELSE 'evaluate' END AS part FROM (SELECT *, max(session) OVER (PARTITION BY user_id) AS m FROM ses) WHERE m > 0")
def enrol_cross_session(spark, sf_dir):
    return parts(enrolled(spark, sf_dir, "cross_session"))


def _spans_sql(spans: str, single: bool) -> str:
    lone = "WHEN d <= 0 THEN 'evaluate' " if single else ""
    return f"""{spans}, k AS (SELECT ev.event_id, max(d) AS d, bool_or(t >= b AND t <= e) AS inside, bool_or(t > b - 3600 AND t < e + 3600) AS near FROM ev JOIN blk USING (user_id) GROUP BY ev.event_id)
SELECT event_id, part FROM (SELECT event_id, CASE {lone}WHEN inside THEN 'enrol' WHEN NOT near THEN 'evaluate' END AS part FROM k) WHERE part IS NOT NULL"""


@query(_spans_sql(f"WITH {SPAN}, blk AS (SELECT user_id, d, f + i * (d / 4) AS b, f + i * (d / 4) + d * 0.025 AS e FROM sp, unnest(range(0, 4)) AS u(i))", True))
def enrol_blocks(spark, sf_dir):
    return parts(enrolled(spark, sf_dir, "blocks"))


@query(_spans_sql(f"WITH {SPAN}, blk AS (SELECT user_id, d, f AS b, f + d * 0.1 AS e FROM sp)", True))
def enrol_prefix(spark, sf_dir):
    return parts(enrolled(spark, sf_dir, "prefix"))


PER_CONDITION = f"WITH {LABEL_RUNS}, blk AS (SELECT user_id, 1 AS d, min(t) AS b, min(t) + (max(t) - min(t)) * 0.1 AS e FROM lr GROUP BY user_id, run)"


@query(_spans_sql(PER_CONDITION, False))
def enrol_per_condition(spark, sf_dir):
    return parts(enrolled(spark, sf_dir, "per_condition"))


@query(f"""WITH {SPAN}, blk AS (SELECT user_id, d, f + i * (d / 4) AS b, f + i * (d / 4) + d * 0.025 AS e FROM sp, unnest(range(0, 4)) AS u(i)), k AS (SELECT ev.event_id, user_id, event_type, bool_or(t >= b AND t <= e) AS inside FROM ev JOIN blk USING (user_id) GROUP BY ALL)
SELECT user_id, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS prevalence FROM k WHERE inside GROUP BY user_id""")
def prevalence_baseline(spark, sf_dir):
    rows = enrolled(spark, sf_dir, "blocks").withColumn("y", table.binary("event_type", "error"))
    return rounded(enrolment.prevalence(rows, "user_id", "y"), "prevalence")


@query(f"""WITH {SPAN}, blk AS (SELECT user_id, d, f + i * (d / 4) AS b, f + i * (d / 4) + d * 0.025 AS e FROM sp, unnest(range(0, 4)) AS u(i)), k AS (SELECT ev.event_id, user_id, event_type, bool_or(t >= b AND t <= e) AS inside, bool_or(t > b - 3600 AND t < e + 3600) AS near FROM ev JOIN blk USING (user_id) GROUP BY ALL),
c AS (SELECT user_id, inside, count(DISTINCT event_type = 'error') AS n FROM k WHERE inside OR NOT near GROUP BY ALL) SELECT user_id FROM c WHERE n >= 2 GROUP BY user_id HAVING count(*) = 2""")
def usable_subjects(spark, sf_dir):
    rows = enrolled(spark, sf_dir, "blocks").withColumn("y", table.binary("event_type", "error"))
    return enrolment.usable_subjects(rows, "user_id", "y")


@query(f"WITH {PREDICTIONS}, c AS (SELECT subject_id, truth, count(*) AS n FROM pr GROUP BY ALL) SELECT subject_id, arg_max(truth, (n, -truth)) AS majority, round(max(n) / sum(n), 6) AS share FROM c GROUP BY subject_id")
def majority_model(spark, sf_dir):
    counts = predictions(spark, sf_dir).groupBy("subject_id", "truth").agg(F.count("*").alias("n"))
    out = counts.groupBy("subject_id").agg(F.max_by("truth", F.struct("n", -F.col("truth"))).alias("majority"), (F.max("n") / F.sum("n")).alias("share"))
    return rounded(out, "share")


# ---------------------------------------------------------------- identity and lineage


@query("SELECT event_id, 'win-' || substr(sha256('recording_id=rec' || CAST(user_id AS VARCHAR) || '|start_sample=' || CAST(event_id AS VARCHAR) || '|end_sample=' || CAST(event_id + 10 AS VARCHAR) || '|channels=' || event_type || '|preprocessing_run_id='), 1, 32) AS window_id FROM events")
def content_ids(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    columns = {"recording_id": F.concat(F.lit("rec"), F.col("user_id")), "start_sample": F.col("event_id"), "end_sample": F.col("event_id") + 10, "channels": F.col("event_type")}
    return rows.select("event_id", ids.id_of("win", columns).alias("window_id"))


@query("""SELECT user_id, 'fvec-' || substr(sha256('subject_id=' || CAST(user_id AS VARCHAR) || '|feature_ids=' || string_agg(CAST(event_id AS VARCHAR), ';' ORDER BY CAST(event_id AS VARCHAR)) || '|feature_set_version=1'), 1, 32) AS vector_id FROM events GROUP BY user_id""")
def vector_ids(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.col("event_id").cast("string")).alias("f"))
    return rows.select("user_id", ids.content_id("fvec", subject_id=ids.text_of(F.col("user_id")), feature_ids=ids.list_of(F.col("f"), ordered=False), feature_set_version=F.lit("1")).alias("vector_id"))


def scored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scored windows: lines are features, the order is the window, the customer the subject."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.concat(F.lit("f"), "l_orderkey", F.lit("-"), "l_linenumber"))).alias("feature_ids"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("C"), "o_custkey").alias("subject_id"), F.col("o_orderdate").cast("timestamp").alias("start_time"), F.lit(0.0).alias("start_s"), F.col("o_orderstatus").alias("predicted"), ((F.col("o_orderkey") % 100) / 100).alias("probability"))
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).select("subject_id", "start_time", "start_s", "predicted", "probability", F.lit("v").alias("vector_id"), F.array(F.concat(F.lit("w"), "o_orderkey")).alias("window_ids"), "feature_ids", F.array(F.concat(F.lit("fact"), F.col("o_orderkey") % 50)).alias("fact_ids"))


PRED_ID = """p AS (SELECT 'C' || o_custkey AS subject_id, epoch_us(o_orderdate) AS s, o_orderstatus AS predicted_class, o_orderkey, (o_orderkey % 100) / 100 AS probability, f FROM orders JOIN (SELECT l_orderkey, string_agg('f' || l_orderkey || '-' || l_linenumber, ';' ORDER BY 'f' || l_orderkey || '-' || l_linenumber) AS f FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
pid AS (SELECT *, 'pred-' || substr(sha256('study_id=S|subject_id=' || subject_id || '|task=stress|start_time=' || s || '|end_time=' || (s + 60000000) || '|predicted_class=' || predicted_class || '|predicted_value=|probability=' || printf('%.9f', CAST(probability AS DOUBLE)) || '|model_id=model-1|training_run_id=trun-1|feature_set_version=1.3|feature_ids=' || f || '|source_fact_ids=fact' || (o_orderkey % 50)), 1, 32) AS prediction_id FROM p)"""


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.export_predictions(scored_windows(spark, sf_dir), "S", "stress", "model-1", "trun-1", "1.3", 60.0)


@query(f"WITH {PRED_ID} SELECT prediction_id, subject_id, predicted_class, CAST(probability AS DOUBLE) AS probability, s AS start_us, s + 60000000 AS end_us FROM pid")
def export_predictions(spark, sf_dir):
    out = exported(spark, sf_dir)
    return out.select("prediction_id", "subject_id", "predicted_class", "probability", F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"))


@query(f"WITH {PRED_ID} SELECT subject_id, count(*) AS n FROM pid GROUP BY subject_id")
def export_bundle(spark, sf_dir):
    return lineage.bundle(exported(spark, sf_dir), ["subject_id"]).select("subject_id", "n")


@query("""SELECT 'customer' AS kind, CAST(o_custkey AS VARCHAR) AS id FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)
UNION ALL SELECT 'order', CAST(l_orderkey AS VARCHAR) FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 <> 0)""")
def unresolved_refs(spark, sf_dir):
    orders, lines, customer = (read(spark, sf_dir, n) for n in ("orders", "lineitem", "customer"))
    return lineage.unresolved({"customer": (orders, "o_custkey", customer.where("c_custkey % 10 <> 0"), "c_custkey"), "order": (lines, "l_orderkey", orders.where("o_orderkey % 97 <> 0"), "o_orderkey")})


@query("""WITH bad AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 37 = 0), ft AS (SELECT DISTINCT 'f' || l_orderkey || '-' || l_linenumber AS id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM bad)),
st AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM bad))
SELECT 'window' AS layer, 'w' || o_orderkey AS id FROM bad UNION ALL SELECT 'feature', id FROM ft UNION ALL SELECT 'prediction', 'p' || o_custkey FROM st UNION ALL SELECT DISTINCT 'fact', 'fact' || (o_custkey % 50) FROM st""")
def invalidation_cascade(spark, sf_dir):
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    window = F.concat(F.lit("w"), "o_orderkey")
    feats = lines.select(F.concat(F.lit("f"), "l_orderkey", F.lit("-"), "l_linenumber").alias("feature_id"), F.array(F.concat(F.lit("w"), "l_orderkey")).alias("source_window_ids"))
    preds = orders.groupBy("o_custkey").agg(F.collect_set(window).alias("source_window_ids")).select(F.concat(F.lit("p"), "o_custkey").alias("prediction_id"), F.array().cast("array<string>").alias("feature_ids"), "source_window_ids", F.array(F.concat(F.lit("fact"), F.col("o_custkey") % 50)).alias("source_fact_ids"))
    return lineage.invalidated(orders.where("o_orderkey % 37 = 0").select(window.alias("window_id")), feats, preds)


FACTS = """fa AS (SELECT 'F' || o_orderkey AS fact_id, CAST(o_custkey AS VARCHAR) AS subject_id, 'balance' AS field, o_orderstatus AS value, 'F' || lag(o_orderkey) OVER w AS supersedes, o_custkey, row_number() OVER w AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order corrects the customer's order before it; every third customer has a model value that rests on the first one."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    base = read(spark, sf_dir, "orders").select(F.concat(F.lit("F"), "o_orderkey").alias("fact_id"), F.col("o_custkey").cast("string").alias("subject_id"), F.lit("balance").alias("field"), F.col("o_orderstatus").alias("value"), F.concat(F.lit("F"), F.lag("o_orderkey").over(w)).alias("supersedes"), F.lit(None).cast("array<string>").alias("derived_from"), "o_custkey", F.row_number().over(w).alias("r"))
    model = base.where("r = 1 and o_custkey % 3 = 0").select(F.concat(F.lit("M"), "o_custkey").alias("fact_id"), "subject_id", F.lit("stress").alias("field"), F.lit("1").alias("value"), F.lit(None).cast("string").alias("supersedes"), F.array("fact_id").alias("derived_from"), "o_custkey", "r")
    return base.union(model)


@query(f"WITH {FACTS} SELECT fact_id, last_value(fact_id) OVER (PARTITION BY o_custkey ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest_id FROM fa")
def supersession_latest(spark, sf_dir):
    return lineage.latest(facts(spark, sf_dir).where("field = 'balance'"))


@query(f"WITH {FACTS} SELECT fact_id, value FROM (SELECT *, max(r) OVER (PARTITION BY o_custkey) AS m FROM fa) WHERE r = m")
def facts_in_force(spark, sf_dir):
    return lineage.in_force(facts(spark, sf_dir).where("field = 'balance'")).select("fact_id", "value")


@query(f"""WITH {FACTS}, e AS (SELECT o_custkey, subject_id, arg_min(value, r) AS was, arg_max(value, r) AS now, arg_max(fact_id, r) AS latest FROM fa GROUP BY ALL HAVING max(r) > 1)
SELECT 'M' || o_custkey AS fact_id, subject_id, latest AS current_inputs, 'inputs were corrected: balance ' || was || ' to ' || now AS reason FROM e WHERE o_custkey % 3 = 0""")
def stale_predictions(spark, sf_dir):
    all_facts = facts(spark, sf_dir)
    latest = lineage.latest(all_facts)
    return lineage.stale_predictions(all_facts, ["stress"], latest).select("fact_id", "subject_id", F.array_join("current_inputs", ",").alias("current_inputs"), "reason")


@query(f"WITH {PRED_ID} SELECT subject_id, 'stress' AS field, predicted_class AS value, count(*) AS n FROM pid GROUP BY ALL")
def derived_facts(spark, sf_dir):
    out = lineage.derived_facts(exported(spark, sf_dir), "stress", confidence=False)
    return out.groupBy("subject_id", "field", "value").agg(F.count("*").alias("n"))
