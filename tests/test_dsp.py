import numpy as np
import pytest

from sigloom.functions import dsp, features, quality
from sigloom.plans import synthetic


def sine(hz, seconds, rate, amplitude=1.0):
    return amplitude * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


def gain(hz, rate=64.0):
    x = sine(hz, 60, rate)
    y = dsp.bandpass(x[None], rate, 0.5, 8.0)[0]
    return np.abs(y[640:-640]).max()


def test_bandpass_keeps_the_band_and_stops_the_rest():
    assert gain(2.0) == pytest.approx(1.0, abs=0.01)
    assert gain(0.05) < 0.01
    assert gain(25.0) < 0.01
    # zero phase means the squared response: half power becomes a quarter
    assert gain(8.0) == pytest.approx(0.5, abs=0.02)


def test_butterworth_matches_the_analogue_design_at_its_edges():
    b, a = dsp.butterworth(3, (1.0,), 64.0)
    z = np.exp(-2j * np.pi * 1.0 / 64.0)
    assert abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z)) == pytest.approx(np.sqrt(0.5), rel=1e-9)
    assert b.sum() / a.sum() == pytest.approx(1.0)


def test_zero_phase_moves_no_peak():
    x = sine(1.2, 30, 64.0)
    y = dsp.bandpass(x[None], 64.0, 0.5, 8.0)[0]
    assert np.abs(dsp.peaks(x, 20)[2:-2] - dsp.peaks(y, 20)[2:-2]).max() <= 1


def test_rows_filter_independently():
    x = np.random.default_rng(0).normal(size=(3, 400))
    together = dsp.bandpass(x, 64.0, 0.5, 8.0)
    for k in range(3):
        assert np.allclose(together[k], dsp.bandpass(x[k : k + 1], 64.0, 0.5, 8.0)[0])


def test_short_and_impossible_bands():
    x = np.ones((1, 18))
    assert dsp.bandpass(x, 64.0, 0.5, 8.0) is x
    with pytest.raises(ValueError):
        dsp.bandpass(np.ones((1, 100)), 64.0, 9.0, 8.0)
    with pytest.raises(ValueError):
        dsp.bandpass(np.ones((1, 20)), 64.0, 0.5, 8.0)  # too few samples for the padding


def test_peaks_plateau_distance_and_prominence():
    x = np.array([0, 1, 1, 1, 0, 3, 0, 2.9, 0, 1, 0.9, 1.05, 0])
    assert dsp.local_maxima(x).tolist() == [2, 5, 7, 9, 11]
    assert dsp.peaks(x, 3).tolist() == [2, 5, 11]
    assert dsp.prominences(x, np.array([5, 9, 11])) == pytest.approx([3.0, 0.1, 1.05])
    assert dsp.peaks(x, 1, prominence=0.5).tolist() == [2, 5, 7, 11]


@pytest.mark.parametrize("bpm", [48, 72, 110, 150])
def test_pulse_rate_is_recovered(bpm):
    x = synthetic.pulse(bpm, 60)
    found = dsp.beats(dsp.bandpass(x[None], 64.0, 0.5, 8.0)[0], 64.0, 35, 300)
    assert 60 / np.median(np.diff(found) / 64.0) == pytest.approx(bpm, rel=0.03)


def test_concentration_tells_pulse_from_noise():
    rng = np.random.default_rng(1)
    pulse = dsp.bandpass(synthetic.pulse(72, 60)[None], 64.0, 0.5, 8.0)[0]
    noise = dsp.bandpass(rng.normal(size=(1, 3840)), 64.0, 0.5, 8.0)[0]
    assert dsp.concentration(pulse, 64.0, 35, 300) > 0.9
    assert dsp.concentration(noise, 64.0, 35, 300) < 0.25


def test_beat_train_gives_its_variability_back():
    x, rr = synthetic.beat_train(850, 40, 60, np.random.default_rng(2))
    (codes, values), = features._heart(x[None], 700.0, quality.CHEST)
    assert codes == []
    assert values["chest_hr_mean"] == pytest.approx(60_000 / rr.mean(), rel=0.01)
    assert values["chest_sdnn"] == pytest.approx(rr.std(ddof=1), abs=3)
    assert abs(values["chest_beat_count"] - len(rr) - 1) <= 2


@pytest.mark.parametrize("rate", [8, 14, 22])
def test_breathing_rate_despite_drift(rate):
    assert features.breathing_rate(synthetic.breathing(rate, 60), 700.0) == pytest.approx(rate, abs=2)
    assert features.breathing_rate(np.zeros(42_000), 700.0) is None


def test_welch_integrates_to_the_variance():
    x = np.random.default_rng(3).normal(size=20_000)
    f, p = dsp.welch(x, 100.0, 400)
    assert p.sum() * f[1] == pytest.approx(1.0, rel=0.03)


def test_a_rhythm_lands_in_its_band_whatever_the_gain():
    for stage, band in (("N3", "delta"), ("N1", "theta"), ("W", "alpha"), ("N2", "sigma")):
        x = synthetic.sleep_wave(stage, 30, np.random.default_rng(4))
        one, two = (dict(zip(features.SLEEP_FEATURES_BY_CHANNEL["EEG Fpz-Cz"], features.eeg_values(g * x, features.spectrum(g * x, 100.0), 100.0), strict=True)) for g in (1, 10))
        assert max(features.BANDS, key=lambda b: one[f"fpz_{b}_rel"]) == band
        assert one[f"fpz_{band}_rel"] == pytest.approx(two[f"fpz_{band}_rel"])
        assert two["fpz_hjorth_activity"] == pytest.approx(100 * one["fpz_hjorth_activity"])


def test_malik_compares_with_the_last_one_kept():
    assert dsp.malik(np.array([800, 1600, 820, 400, 830.0])).tolist() == [True, False, True, False, True]


@pytest.mark.parametrize(
    ("x", "code"),
    [(np.zeros(3840), "flatline"), (np.full(3840, np.nan), "missing"), (np.clip(synthetic.pulse(70, 60), -30, 30), "clipped"), (np.random.default_rng(5).normal(size=3840), "no_pulse")],
)
def test_pulse_faults(x, code):
    (codes, _), = features._pulse(x[None], 64.0, quality.WRIST)
    assert code in codes


def test_eeg_faults():
    f = features._eeg("EEG Fpz-Cz")
    t = np.arange(3000) / 100
    for x, code in ((np.zeros(3000), "flatline"), (900 * np.sin(t), "high_amplitude"), (30 * np.sin(2 * np.pi * 40 * t), "muscle_dominant"), (np.full(3000, np.nan), "missing")):
        assert code in next(f(x[None], 100.0, quality.SLEEP))[0]
