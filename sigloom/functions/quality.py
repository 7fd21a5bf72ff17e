"""Quality rules: they label windows, they never drop them.

Rules that need only statistics are column expressions; rules that need a filter or a
spectrum (pulse, electrocardiogram, respiration, EEG) work on numpy matrices inside the
Arrow stage of ``features``, which measures from the same filtered signal.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays as a
from . import dsp


@dataclass(frozen=True)
class Policy:
    """Thresholds and the version that they form.  The numbers are fixed values."""

    version: str
    warn_only: frozenset[str] = frozenset()
    limits: dict[str, float] = field(default_factory=dict)

    def __getitem__(self, name: str) -> float:
        return self.limits[name]

    def changed(self, version: str, **limits: float) -> Policy:
        """A revision; a different rule is a different version."""
        return Policy(version, self.warn_only, self.limits | limits)


#: Fixed values of the wrist band's rules: pulse in device units, conductance in microsiemens,
#: temperature in Celsius, acceleration in counts (64 are 1 g).
WRIST = Policy(
    "wrist-e4-1.0",
    frozenset({"motion", "discontinuity"}),
    {
        "pulse_flat_sd": 1e-6,
        "pulse_clip_share": 0.02,
        "pulse_low_bpm": 35.0,
        "pulse_high_bpm": 180.0,
        "pulse_search_bpm": 300.0,
        "pulse_beats": 20,
        "pulse_concentration": 0.25,
        "eda_flat_sd": 1e-4,
        "eda_low": 0.01,
        "eda_high": 60.0,
        "eda_jump": 1.0,
        "temp_low": 25.0,
        "temp_high": 40.0,
        "temp_slope": 2.0,
        "g_scale": 64.0,
        "rail": 128.0,
        "rail_share": 0.01,
        "motion_g": 0.08,
    },
)
#: Fixed values of the chest band's rules: acceleration in g, intervals in milliseconds.
CHEST = Policy(
    "chest-respiban-1.0",
    WRIST.warn_only | {"unstable_intervals", "beat_count_disagrees"},
    WRIST.limits | {"g_scale": 1.0, "rail": 16.0, "rr_low": 300.0, "rr_high": 2000.0, "malik": 0.2, "dropped": 0.2, "beat_gap": 0.1, "beats": 20, "heart_low": 40.0, "heart_high": 180.0, "heart_search": 200.0, "kept": 0.8},
)
#: Fixed values of the sleep rules, in microvolts and shares.
SLEEP = Policy("sleep-eeg-1.0", frozenset({"muscle_dominant"}), {"flat_sd": 0.1, "clip_share": 0.02, "amplitude": 500.0, "muscle": 0.5})


# ---------------------------------------------------------------- as columns


def _codes(*rules: tuple[Column, str]) -> Column:
    """Codes of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(code)) for rule, code in rules]))


def _only(code: str) -> Column:
    return F.array(F.lit(code))


def eda_codes(x: Column, policy: Policy = WRIST) -> Column:
    jump = F.coalesce(F.array_max(F.transform(a.diff(x), F.abs)) > policy["eda_jump"], F.lit(False))
    low, high = F.array_min(x), F.array_max(x)
    found = _codes((low < 0, "negative"), (a.sd(x) <= policy["eda_flat_sd"], "flatline"), ((low < policy["eda_low"]) | (high > policy["eda_high"]), "out_of_range"), (jump, "discontinuity"))
    return F.when(F.size(x) == 0, _only("flatline")).when(a.missing(x), _only("missing")).otherwise(found)


def temp_codes(x: Column, rate: float, policy: Policy = WRIST) -> Column:
    outside = (F.array_min(x) < policy["temp_low"]) | (F.array_max(x) > policy["temp_high"])
    steep = (F.size(x) > 1) & (F.abs(a.slope_per_minute(x, rate)) > policy["temp_slope"])
    return F.when(a.missing(x), _only("missing")).otherwise(_codes((outside, "out_of_range"), (steep, "discontinuity")))


def magnitude(x: Column, y: Column, z: Column, scale: float) -> Column:
    squares = F.zip_with(F.zip_with(x, y, lambda p, q: p * p + q * q), z, lambda s, r: F.sqrt(s + r * r) / F.lit(scale))
    return squares


def acc_codes(x: Column, y: Column, z: Column, policy: Policy = WRIST) -> Column:
    axes = F.concat(x, y, z)
    rail = policy["rail"]
    at_rail = F.size(F.filter(axes, lambda v: F.abs(F.abs(v) - rail) <= 0.5 + 1e-5 * rail))
    still = a.sd(magnitude(x, y, z, policy["g_scale"])) <= 1e-9
    found = _codes((at_rail / F.size(axes) > policy["rail_share"], "saturated"), (still, "flatline"))
    lacking = x.isNull() | y.isNull() | z.isNull() | (F.size(x) != F.size(y)) | (F.size(y) != F.size(z))
    return F.when(lacking, _only("missing_axes")).when(F.size(axes) == 0, _only("flatline")).when(a.missing(axes), _only("missing")).otherwise(found)


def in_motion(x: Column, y: Column, z: Column, policy: Policy = WRIST) -> Column:
    return F.coalesce(a.sd(magnitude(x, y, z, policy["g_scale"])) > policy["motion_g"], F.lit(False))


def emg_codes(x: Column, least: int = 16, flat_sd: float = 1e-9) -> Column:
    return F.when(F.size(x) < least, _only("too_short")).when(a.missing(x), _only("missing")).otherwise(_codes((a.sd(x) < flat_sd, "flatline")))


def flat_codes(x: Column, rate: float, flat_sd: float) -> Column:
    """Eye movement and chin muscle of a sleep recording."""
    return F.when(F.size(x) < int(rate), _only("too_short")).otherwise(_codes((a.sd(x) < flat_sd, "flatline")))


def status(codes: Column, policy: Policy) -> Column:
    """rejected if a code is more than a warning, warning if there is any, else valid."""
    warnings = F.array(*[F.lit(w) for w in sorted(policy.warn_only)]).cast("array<string>")
    return F.when(F.size(F.array_except(codes, warnings)) > 0, "rejected").when(F.size(codes) > 0, "warning").otherwise("valid")


def with_motion(codes: Column, moved: Column) -> Column:
    """The pulse is charged for movement that accelerometry saw."""
    return F.when(F.coalesce(moved, F.lit(False)), F.concat(codes, _only("motion"))).otherwise(codes)


# ---------------------------------------------------------------- on matrices


def lacks(x: np.ndarray) -> bool:
    return x.size == 0 or not np.isfinite(x).all()


def pulse_codes(raw: np.ndarray, filtered: np.ndarray, beats: np.ndarray, rate: float, policy: Policy = WRIST) -> list[str]:
    """Flatness and clipping of what was recorded, the rest of what is measured."""
    if lacks(raw):
        return ["missing"]
    if raw.std() <= policy["pulse_flat_sd"]:
        return ["flatline"]
    rails = (raw.max(), raw.min())
    out = ["clipped"] if any(np.isclose(raw, r, rtol=1e-9).mean() > policy["pulse_clip_share"] for r in rails) else []
    if dsp.concentration(filtered, rate, policy["pulse_low_bpm"], policy["pulse_search_bpm"]) < policy["pulse_concentration"] or len(beats) < policy["pulse_beats"]:
        return [*out, "no_pulse"]
    bpm = 60 / (np.median(np.diff(beats)) / rate)
    return out if policy["pulse_low_bpm"] <= bpm <= policy["pulse_high_bpm"] else [*out, "implausible_rate"]


def heart_codes(raw: np.ndarray, envelope: np.ndarray, found: np.ndarray, intervals: np.ndarray, rate: float, policy: Policy = CHEST) -> list[str]:
    if len(raw) < int(rate):
        return ["too_short"]
    if lacks(raw):
        return ["missing"]
    if raw.std() < 1e-6:
        return ["flatline"]
    top = np.abs(raw).max()
    out = ["clipped"] if top > 0 and (np.abs(raw) >= 0.999 * top).mean() > 0.02 else []
    if len(intervals) < policy["beats"] - 1:
        return [*out, "too_few_beats"]
    expected = dsp.dominant_rate(envelope, rate, policy["heart_low"], policy["heart_search"])
    rules = (
        ("implausible_rate", not policy["heart_low"] <= 60_000 / intervals.mean() <= policy["heart_high"]),
        ("no_cardiac_rhythm", expected is None),
        ("beat_count_disagrees", expected is not None and abs(len(found) - expected) / expected > policy["beat_gap"]),
        ("unstable_detection", len(intervals) / max(len(found) - 1, 1) < policy["kept"]),
        ("unstable_intervals", 1 - dsp.malik(intervals, policy["malik"]).mean() > policy["dropped"]),
    )
    return out + [code for code, holds in rules if holds]


def breath_codes(raw: np.ndarray, breaths: float | None, rate: float) -> list[str]:
    if len(raw) < int(rate * 10):
        return ["too_short"]
    if lacks(raw):
        return ["missing"]
    return ["flatline"] if raw.std() < 1e-6 else ["no_breathing_rhythm"] if breaths is None else []


def eeg_codes(raw: np.ndarray, spectrum: tuple[np.ndarray, np.ndarray] | None, rate: float, policy: Policy = SLEEP) -> list[str]:
    if len(raw) < int(rate):
        return ["too_short"]
    if raw.std() < policy["flat_sd"]:
        return ["flatline"]
    top = np.abs(raw).max()
    out = ["clipped"] if top > 0 and (np.abs(raw) >= 0.999 * top).mean() > policy["clip_share"] else []
    out += ["high_amplitude"] if top > policy["amplitude"] else []
    if spectrum:
        whole = dsp.band_power(*spectrum, 0.5, 45.0)
        out += ["muscle_dominant"] if whole > 0 and dsp.band_power(*spectrum, 30.0, 45.0) / whole > policy["muscle"] else []
    return out
