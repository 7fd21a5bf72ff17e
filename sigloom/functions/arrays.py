"""Statistics of sample arrays as column expressions: no shuffle, no Python, one row in and one out.

Arrays are array<double> without nulls.  Every expression walks an array once or a few
times; moments use Welford's update, so they don't cancel.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def doubles(x: Column) -> Column:
    """``x`` as array<double>; NaN and infinities stay for the quality rules to see."""
    return x.cast("array<double>")


def missing(x: Column) -> Column:
    """Whether an array is null, empty or holds a sample that is no finite number.

    Tested before any comparison: Spark orders NaN above every number.
    """
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(x) == 0) | bad, F.lit(True))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def variance(x: Column, ddof: int = 0) -> Column:
    return F.aggregate(x, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")), _welford, lambda a: a["m2"] / (a["n"] - ddof))


def _welford(a: Column, v: Column) -> Column:
    n = a["n"] + 1
    delta = v - a["mean"]
    new = a["mean"] + delta / n
    return F.struct(n.alias("n"), new.alias("mean"), (a["m2"] + delta * (v - new)).alias("m2"))


def sd(x: Column, ddof: int = 0) -> Column:
    return F.sqrt(variance(x, ddof))


def first(x: Column) -> Column:
    return F.element_at(x, 1)


def last(x: Column) -> Column:
    return F.element_at(x, -1)


def diff(x: Column) -> Column:
    """Differences of neighbours; one shorter than ``x`` (empty for one sample)."""
    n = F.size(x)
    return F.zip_with(F.slice(x, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(x, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)


def slope_per_minute(x: Column, rate: float) -> Column:
    """Last sample minus first, over the length of the array in minutes."""
    return (last(x) - first(x)) / (F.size(x) / F.lit(rate * 60.0))


def percentile(x: Column, share: float) -> Column:
    """Linear interpolation between the two nearest ranks."""
    ordered = F.array_sort(x)
    at = (F.size(x) - 1) * F.lit(share)
    low = F.floor(at).cast("int")
    a = F.element_at(ordered, low + 1)
    b = F.element_at(ordered, F.least(low + 2, F.size(x)))
    return a + (b - a) * (at - low)


def trapezium(x: Column, rate: float) -> Column:
    """Area under the samples, seconds times units."""
    return (total(x) - (first(x) + last(x)) / 2) / F.lit(rate)


def sign_changes(x: Column) -> Column:
    """Times that neighbours differ in being negative."""
    n = F.size(x)
    pairs = F.zip_with(F.slice(x, F.lit(2), n - 1), F.slice(x, F.lit(1), n - 1), lambda b, a: F.when((b < 0) != (a < 0), 1).otherwise(0))
    return F.aggregate(pairs, F.lit(0), lambda a, v: a + v)


def rising_crossings(x: Column, level: float) -> Column:
    """Times that a sample above ``level`` follows one that is not above."""
    n = F.size(x)
    pairs = F.zip_with(F.slice(x, F.lit(2), n - 1), F.slice(x, F.lit(1), n - 1), lambda b, a: F.when((b > level) & (a <= level), 1).otherwise(0))
    return F.aggregate(pairs, F.lit(0), lambda a, v: a + v)


def moving_average(x: Column, width: int) -> Column:
    """Centred mean of ``width`` samples; past either end the end sample repeats.

    Arrays shorter than ``width`` give their mean everywhere.
    """
    before, after = width // 2, width - 1 - width // 2
    padded = F.concat(F.array_repeat(first(x), before), x, F.array_repeat(last(x), after))
    inside = let(padded, lambda p: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: total(F.slice(p, i, F.lit(width))) / width))
    flat = let(mean(x), lambda m: F.transform(x, lambda _: m))
    return F.when(F.size(x) < width, flat).otherwise(inside)


def hjorth(x: Column) -> Column:
    """struct(activity, mobility, complexity); zeros where a variance vanishes or fewer than three samples are."""
    d1 = diff(x)
    v = F.array(variance(x), variance(d1), variance(diff(d1)))

    def shape(v: Column) -> Column:
        v0, v1, v2 = (F.element_at(v, k) for k in (1, 2, 3))
        moves = (v0 > 0) & (v1 > 0)
        mobility = F.when(moves, F.sqrt(v1 / v0)).otherwise(0.0)
        complexity = F.when(moves, F.sqrt(v2 / v1) / F.sqrt(v1 / v0)).otherwise(0.0)
        return F.struct(v0.alias("activity"), mobility.alias("mobility"), complexity.alias("complexity"))

    none = F.struct(F.lit(0.0).alias("activity"), F.lit(0.0).alias("mobility"), F.lit(0.0).alias("complexity"))
    return F.when(F.size(x) >= 3, let(v, shape)).otherwise(none)


def power_spectrum(x: Column, n: int) -> Column:
    """Squared magnitude of the discrete Fourier transform of ``n`` samples, bins 0 to n // 2."""

    def bin_power(k: int) -> Column:
        turn = [2 * math.pi * k * i / n for i in range(n)]
        re = F.array(*[F.lit(math.cos(t)) for t in turn])
        im = F.array(*[F.lit(math.sin(t)) for t in turn])
        return F.pow(total(F.zip_with(x, re, lambda a, b: a * b)), 2) + F.pow(total(F.zip_with(x, im, lambda a, b: a * b)), 2)

    return F.array(*[bin_power(k) for k in range(n // 2 + 1)])


def band(power: Column, lo: int, hi: int) -> Column:
    """Sum of the bins lo to hi."""
    return total(F.slice(power, lo + 1, hi - lo + 1))


def argmax(x: Column) -> Column:
    """Place of the first largest element, from 0."""
    return F.array_position(x, F.array_max(x)) - 1


def entropy(power: Column) -> Column:
    """Shannon entropy of the power's shares over the logarithm of the number of bins, 0 to 1."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("plogp"))
    # with s the sum, the entropy of p / s is ln(s) - sum(p ln p) / s: one walk
    walk = lambda a, p: F.struct((a["sum"] + p).alias("sum"), (a["plogp"] + F.when(p > 0, p * F.ln(p)).otherwise(0.0)).alias("plogp"))
    done = F.aggregate(power, start, walk, lambda a: F.when(a["sum"] > 0, F.ln(a["sum"]) - a["plogp"] / a["sum"]))
    return F.when(F.size(power) > 1, F.coalesce(done / F.ln(F.size(power).cast("double")), F.lit(0.0))).otherwise(0.0)


def edge(power: Column, share: float) -> Column:
    """First bin at which the cumulative power reaches ``share`` of the whole."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"))
    goal = total(power) * share
    walked = F.aggregate(power, start, lambda a, p: F.struct((a["sum"] + p).alias("sum"), F.when(a["sum"] + p < goal, a["at"] + 1).otherwise(a["at"]).alias("at")))
    return walked["at"]


def kept_intervals(x: Column, tolerance: float) -> Column:
    """Malik's rule: an interval stays if it differs by at most ``tolerance`` of the last one that stayed.

    Array of booleans, as long as ``x``; the first interval stays.
    """
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<boolean>").alias("keep"))

    def step(a: Column, v: Column) -> Column:
        stays = a["last"].isNull() | (F.abs(v - a["last"]) <= F.lit(tolerance) * a["last"])
        return F.struct(F.when(stays, v).otherwise(a["last"]).alias("last"), F.concat(a["keep"], F.array(stays)).alias("keep"))

    return F.aggregate(x, start, step, lambda a: a["keep"])
