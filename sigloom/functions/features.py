"""Named scalar features of sample windows.

Statistics are column expressions (``*_columns``).  Pulse, electrocardiogram, respiration
and EEG need filters or spectra: ``measure`` judges and measures them in one Arrow stage, so
a window is filtered once for both, and all windows of one rate and length in a batch go
through the filter together.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as a
from . import dsp, quality

#: Feature sets and the bands that sleep is scored in, in Hz.
VERSIONS = {"wrist": "1.3", "chest": "chest-1.0", "sleep": "sleep-1.0"}
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 12.0), "sigma": (12.0, 16.0), "beta": (16.0, 30.0)}
WHOLE_BAND = (0.5, 30.0)
SCR_LEVEL = 0.01
TONIC_SECONDS = 4.0
PULSE_BAND = (0.5, 8.0)
BREATH_BAND = (0.1, 0.6)
BREATH_RATE = (6.0, 36.0)
#: Signals whose windows ``measure`` handles; the rest are column expressions.
KERNEL_SIGNALS = ("BVP", "ECG", "Resp", "EEG Fpz-Cz", "EEG Pz-Oz", "EOG horizontal")
PREFIX = {"EEG Fpz-Cz": "fpz", "EEG Pz-Oz": "pz"}

_STATS = ("mean", "sd", "min", "max")
FEATURES_BY_SIGNAL = {
    "BVP": ("pulse_rate_mean", "pulse_rate_median", "ppi_mean", "pulse_amplitude_mean", "pulse_amplitude_sd", "beat_count"),
    "EDA": (*(f"eda_{s}" for s in _STATS), "eda_slope_per_min", "scl_mean", "scr_count_per_min", "scr_amplitude_mean", "eda_auc"),
    "TEMP": (*(f"temp_{s}" for s in _STATS), "temp_slope_per_min"),
    "ACC": ("acc_magnitude_mean", "acc_magnitude_sd", "acc_magnitude_max", "acc_jerk_mean", "acc_activity_count", "acc_x_sd", "acc_y_sd", "acc_z_sd"),
}
CHEST_FEATURES_BY_SIGNAL = {
    "ECG": tuple(f"chest_{n}" for n in ("hr_mean", "hr_median", "rr_mean", "sdnn", "rmssd", "pnn50", "beat_count")),
    "Resp": ("chest_resp_amplitude_sd", "chest_resp_range", "chest_resp_rate_bpm"),
    "EMG": ("chest_emg_rms", "chest_emg_mav", "chest_emg_p95"),
    **{new: tuple(f"chest_{n}" for n in FEATURES_BY_SIGNAL[old]) for new, old in (("EDA", "EDA"), ("Temp", "TEMP"), ("ACC", "ACC"))},
}
SLEEP_FEATURES_BY_CHANNEL = {
    **{
        channel: tuple(f"{p}_{n}" for n in (*(x for b in BANDS for x in (b, f"{b}_rel")), "delta_theta_ratio", "alpha_beta_ratio", "hjorth_activity", "hjorth_mobility", "hjorth_complexity", "entropy", "edge95", "total_power", "amplitude_p95", "zero_crossings"))
        for channel, p in PREFIX.items()
    },
    "EOG horizontal": ("eog_slow_power", "eog_slow_rel", "eog_amplitude_sd", "eog_amplitude_p95", "eog_range"),
    "EMG submental": ("chin_emg_rms", "chin_emg_p95", "chin_emg_range"),
}
UNITS = {"bpm": ("rate_mean", "rate_median", "hr_mean", "hr_median", "rate_bpm"), "ms": ("ppi_mean", "rr_mean", "sdnn", "rmssd"), "uS": ("eda_mean", "eda_sd", "eda_min", "eda_max", "scl_mean", "scr_amplitude_mean"), "degC": ("temp_mean", "temp_sd", "temp_min", "temp_max"), "g": ("magnitude_mean", "magnitude_sd", "magnitude_max", "x_sd", "y_sd", "z_sd")}


def fused_version(*devices: str) -> str:
    """The version of a table over several feature sets: their versions, joined by a plus."""
    return "+".join(VERSIONS[d] for d in devices)


def unit_of(feature: str) -> str:
    return next((u for u, ends in UNITS.items() if feature.endswith(ends)), "")


def signal_of(feature: str, table: dict[str, tuple[str, ...]] | None = None) -> str:
    """The signal that a feature is measured from; declared, not guessed from its name."""
    for signal, names in (table or FEATURES_BY_SIGNAL | {f"chest:{k}": v for k, v in CHEST_FEATURES_BY_SIGNAL.items()} | SLEEP_FEATURES_BY_CHANNEL).items():
        if feature in names:
            return signal
    raise KeyError(feature)


# ---------------------------------------------------------------- as columns
# Each gives one struct: select it first and its fields after, and it is computed once.


def spread(df: DataFrame, keep: list, struct: Column) -> DataFrame:
    """``keep`` and the fields of ``struct`` as columns."""
    rows = df.select(*keep, struct.alias("_measured"))
    return rows.select(*[c for c in rows.columns if c != "_measured"], "_measured.*")


def eda_columns(x: Column, rate: float) -> Column:
    """Nine features of at least four samples of skin conductance; null below."""
    width = max(int(rate * TONIC_SECONDS), 1)

    def measured(tonic: Column, phasic: Column) -> Column:
        high = F.filter(phasic, lambda v: v > SCR_LEVEL)
        minutes = F.size(x) / F.lit(rate * 60.0)
        found = {
            "eda_mean": a.mean(x),
            "eda_sd": a.sd(x),
            "eda_min": F.array_min(x),
            "eda_max": F.array_max(x),
            "eda_slope_per_min": a.slope_per_minute(x, rate),
            "scl_mean": a.mean(tonic),
            "scr_count_per_min": a.rising_crossings(phasic, SCR_LEVEL) / minutes,
            "scr_amplitude_mean": a.let(high, lambda h: F.when(F.size(h) > 0, a.mean(h)).otherwise(0.0)),
            "eda_auc": a.trapezium(x, rate),
        }
        return F.struct(*[v.alias(k) for k, v in found.items()])

    split = a.let(a.moving_average(x, width), lambda t: a.let(F.zip_with(x, t, lambda v, m: v - m), lambda p: measured(t, p)))
    return F.when(F.size(x) >= 4, split)


def temp_columns(x: Column, rate: float) -> Column:
    found = {"temp_mean": a.mean(x), "temp_sd": a.sd(x), "temp_min": F.array_min(x), "temp_max": F.array_max(x), "temp_slope_per_min": a.slope_per_minute(x, rate)}
    return F.when(F.size(x) >= 2, F.struct(*[v.alias(k) for k, v in found.items()]))


def acc_columns(x: Column, y: Column, z: Column, rate: float, scale: float) -> Column:
    def measured(m: Column, centre: Column) -> Column:
        found = {
            "acc_magnitude_mean": centre,
            "acc_magnitude_sd": a.sd(m),
            "acc_magnitude_max": F.array_max(m),
            "acc_jerk_mean": a.mean(F.transform(a.diff(m), lambda v: F.abs(v * rate))),
            "acc_activity_count": a.total(F.transform(m, lambda v: F.abs(v - centre))),
            "acc_x_sd": a.sd(x) / scale,
            "acc_y_sd": a.sd(y) / scale,
            "acc_z_sd": a.sd(z) / scale,
        }
        return F.when(F.size(m) >= 2, F.struct(*[v.alias(k) for k, v in found.items()]))

    return a.let(quality.magnitude(x, y, z, scale), lambda m: a.let(a.mean(m), lambda c: measured(m, c)))


def centred(x: Column) -> Column:
    return a.let(a.mean(x), lambda c: F.transform(x, lambda v: v - c))


def emg_columns(x: Column, prefix: str = "chest_emg") -> Column:
    """Amplitude of muscle activity about its mean: rms, mean and 95th percentile of the absolute value, range."""
    names, least = (("rms", "mav", "p95"), 16) if prefix == "chest_emg" else (("rms", "p95", "range"), 4)

    def measured(c: Column, size: Column) -> Column:
        found = {"rms": F.sqrt(a.mean(F.transform(c, lambda v: v * v))), "mav": a.mean(size), "p95": a.percentile(size, 0.95), "range": F.array_max(c) - F.array_min(c)}
        return F.struct(*[found[n].alias(f"{prefix}_{n}") for n in names])

    split = a.let(centred(x), lambda c: a.let(F.transform(c, F.abs), lambda s: measured(c, s)))
    return F.when(F.size(x) >= least, split)


# ---------------------------------------------------------------- on matrices


def _pulse(x: np.ndarray, rate: float, policy: quality.Policy) -> Iterator[tuple[list[str], dict[str, float]]]:
    try:
        filtered = dsp.bandpass(x, rate, *PULSE_BAND)
    except ValueError:
        filtered = x
    for raw, f in zip(x, filtered, strict=True):
        if quality.lacks(raw):
            yield ["missing"], {}
            continue
        found = dsp.beats(f, rate, policy["pulse_low_bpm"], policy["pulse_search_bpm"])
        codes = quality.pulse_codes(raw, f, found, rate, policy)
        values = {}
        if len(found) >= 3:
            gaps = np.diff(found) * 1000 / rate
            values = dict(zip(FEATURES_BY_SIGNAL["BVP"], (60_000 / gaps.mean(), 60_000 / np.median(gaps), gaps.mean(), f[found].mean(), f[found].std(), len(found)), strict=True))
        yield codes, values


def _heart(x: np.ndarray, rate: float, policy: quality.Policy) -> Iterator[tuple[list[str], dict[str, float]]]:
    band, envelope = dsp.qrs_envelope(np.nan_to_num(x), rate)
    for raw, b, e in zip(x, band, envelope, strict=True):
        found = dsp.r_peaks(b, e, rate)
        gaps = np.diff(found) * 1000 / rate
        gaps = gaps[(gaps >= policy["rr_low"]) & (gaps <= policy["rr_high"])]
        codes = quality.heart_codes(raw, e, found, gaps, rate, policy)
        keep = dsp.malik(gaps, policy["malik"])
        good = gaps[keep]
        steps = np.diff(gaps)[keep[1:] & keep[:-1]]  # only between neighbours that both stay
        values = {}
        if len(good) >= policy["beats"] - 1 and len(steps):
            measured = (60_000 / good.mean(), 60_000 / np.median(good), good.mean(), good.std(ddof=1), np.sqrt((steps**2).mean()), (np.abs(steps) > 50).mean(), len(good) + 1)
            values = dict(zip(CHEST_FEATURES_BY_SIGNAL["ECG"], measured, strict=True))
        yield codes, values


def breathing_rate(x: np.ndarray, rate: float) -> float | None:
    """Breaths per minute with most power, from the detrended signal; None where there is none."""
    if len(x) < int(rate * 20):
        return None
    f, power = dsp.welch(dsp.detrended(x), rate, max(int(rate * 30), 256))
    inside = np.flatnonzero((f >= BREATH_RATE[0] / 60) & (f <= BREATH_RATE[1] / 60))
    if not len(inside) or not (power[inside] > 0).any():
        return None
    return float(f[inside[np.argmax(power[inside])]] * 60) or None


def _breath(x: np.ndarray, rate: float, policy: quality.Policy) -> Iterator[tuple[list[str], dict[str, float]]]:
    filtered = dsp.bandpass(np.nan_to_num(x), rate, *BREATH_BAND)
    for raw, f in zip(x, filtered, strict=True):
        breaths = None if quality.lacks(raw) else breathing_rate(raw, rate)
        values = {}
        if len(raw) >= int(rate * 10) and not quality.lacks(raw):
            values = {"chest_resp_amplitude_sd": f.std(), "chest_resp_range": np.ptp(f)} | ({"chest_resp_rate_bpm": breaths} if breaths else {})
        yield quality.breath_codes(raw, breaths, rate), values


def spectrum(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Welch density of four-second segments; None for fewer than 8 samples."""
    segment = min(int(rate * 4), len(x))
    return dsp.welch(x, rate, segment) if segment >= 8 else None


def _ratio(p: float, q: float) -> float:
    return p / q if q > 0 else 0.0


def _shape(x: np.ndarray) -> tuple[float, float, float]:
    v = [np.diff(x, k).var() if len(x) > k else 0.0 for k in range(3)] if len(x) >= 3 else [0.0] * 3
    mobility = np.sqrt(_ratio(v[1], v[0]))
    return v[0], mobility, _ratio(np.sqrt(_ratio(v[2], v[1])), mobility)


def eeg_values(x: np.ndarray, s: tuple[np.ndarray, np.ndarray], rate: float) -> list[float]:
    """Twenty measures, in the order of ``SLEEP_FEATURES_BY_CHANNEL``."""
    f, power = s
    whole = dsp.band_power(f, power, *WHOLE_BAND)
    bands = {k: dsp.band_power(f, power, *edges) for k, edges in BANDS.items()}
    share = power / power.sum() if power.sum() > 0 else power
    some = share[share > 0]
    entropy = float(-(some * np.log(some)).sum() / np.log(len(power))) if len(some) and len(power) > 1 else 0.0
    edge = float(f[min(np.searchsorted(np.cumsum(share), 0.95), len(f) - 1)]) if len(some) else 0.0
    crossings = np.count_nonzero(np.diff(np.signbit(x - x.mean()))) / (len(x) / rate)
    return [
        *(v for b in bands.values() for v in (b, _ratio(b, whole))),
        _ratio(bands["delta"], bands["theta"]),
        _ratio(bands["alpha"], bands["beta"]),
        *_shape(x),
        entropy,
        edge,
        whole,
        float(np.percentile(np.abs(x), 95)),
        crossings,
    ]


def _eeg(channel: str):
    def run(x: np.ndarray, rate: float, policy: quality.Policy) -> Iterator[tuple[list[str], dict[str, float]]]:
        for raw in x:
            if quality.lacks(raw):
                yield ["missing"], {}
                continue
            s = spectrum(raw, rate)
            values = dict(zip(SLEEP_FEATURES_BY_CHANNEL[channel], eeg_values(raw, s, rate), strict=True)) if s else {}
            yield quality.eeg_codes(raw, s, rate, policy), values

    return run


def _eog(x: np.ndarray, rate: float, policy: quality.Policy) -> Iterator[tuple[list[str], dict[str, float]]]:
    for raw in x:
        if quality.lacks(raw):
            yield ["missing"], {}
            continue
        codes = ["too_short"] if len(raw) < int(rate) else ["flatline"] if raw.std() < policy["flat_sd"] else []
        s = spectrum(raw, rate)
        values = {}
        if s:
            slow = dsp.band_power(*s, 0.3, 2.0)
            measured = (slow, _ratio(slow, dsp.band_power(*s, 0.3, 15.0)), raw.std(), np.percentile(np.abs(raw), 95), np.ptp(raw))
            values = dict(zip(SLEEP_FEATURES_BY_CHANNEL["EOG horizontal"], measured, strict=True))
        yield codes, values


KERNELS = {"BVP": (_pulse, quality.WRIST), "ECG": (_heart, quality.CHEST), "Resp": (_breath, quality.CHEST), "EOG horizontal": (_eog, quality.SLEEP), **{k: (_eeg(k), quality.SLEEP) for k in PREFIX}}
MEASURED = pa.schema([("codes", pa.list_(pa.string())), ("values", pa.map_(pa.string(), pa.float64()))])


def measure(windows: DataFrame, policies: dict[str, quality.Policy] | None = None) -> DataFrame:
    """``windows`` (signal, rate, samples and any other columns) with codes and values instead of samples.

    Rows of signals that no kernel knows come back without codes and values.  Rows without
    samples are missing.  One batch is in memory at a time.
    """
    kept = [c for c in windows.columns if c != "samples"]
    table = {k: (f, (policies or {}).get(k, p)) for k, (f, p) in KERNELS.items()}
    schema = ", ".join([*(f"`{c}` {t}" for c, t in windows.dtypes if c != "samples"), "codes array<string>", "values map<string,double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signals, rates = b.column("signal").to_pylist(), b.column("rate").to_pylist()
            samples = b.column("samples")
            groups: dict[tuple[str, float, int], list[int]] = defaultdict(list)
            codes: list[list[str] | None] = [None] * b.num_rows
            values: list[list[tuple[str, float]]] = [[] for _ in range(b.num_rows)]
            for i, (s, r) in enumerate(zip(signals, rates, strict=True)):
                if s in table:
                    n = len(samples[i]) if samples[i].is_valid else 0
                    if n and r:
                        groups[s, r, n].append(i)
                    else:
                        codes[i] = ["missing"]
            for (s, r, n), rows in groups.items():
                x = samples.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), n)
                kernel, policy = table[s]
                for i, (found, measured) in zip(rows, kernel(x, r, policy), strict=True):
                    codes[i] = found
                    values[i] = [(k, float(v)) for k, v in measured.items() if np.isfinite(v)]
            out = [b.column(c) for c in kept] + [pa.array(codes, MEASURED.field(0).type), pa.array(values, MEASURED.field(1).type)]
            yield pa.record_batch(out, names=[*kept, "codes", "values"])

    return windows.mapInArrow(run, schema)
