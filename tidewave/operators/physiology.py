"""Analyses of pulse, breath and stride waveforms: filtering by quality, peaks, intervals, rates and variability.

A series is one recording; recordings are spread over the cluster and each is one group of its samples.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.functions.compat import NAN
from tidewave.operators import signal
from tidewave.operators.grouped import summary, table
from tidewave.operators.series import ID, over

#: Least gap in seconds, prominence and height of a peak, without filtering.
PEAKS = {"pulse": (0.4, 0.12, 0.3), "breath": (2.0, 0.05, 0.05), "stride": (0.5, 0.08, 0.0)}
#: The pass band in Hz, its quality factor and how often it is passed.
BANDS = {"pulse": (0.5, 5.0), "breath": (0.1, 0.5), "stride": (0.2, 6.0)}
Q, STAGES = 0.707, 2
#: What replaces the gap, prominence or height (None: kept) in a filtered signal of a quality.
QUALITIES = {
    "pulse": {"reference": (None, None, 0.05), "high": (None, None, 0.05), "moderate": (None, 0.15, None), "poor": (0.45, 0.20, 0.35)},
    "breath": {"reference": (None, None, 0.02), "high": (None, None, 0.02), "moderate": (None, 0.08, None), "poor": (2.5, 0.12, 0.08)},
    "stride": {"reference": (None, None, 0.05), "high": (None, None, 0.05), "moderate": (None, 0.10, None), "poor": (0.6, 0.15, 0.20)},
}
#: Fixed value: metres a second where a walking speed isn't known.
WALKING = 1.3


def infer_fs(times: np.ndarray, fs: float) -> float:
    """One over the first time step; fs where there is none above 0."""
    return 1.0 / (times[1] - times[0]) if len(times) > 1 and times[1] > times[0] else fs


def filtered(x: np.ndarray, fs: float, kind: str) -> np.ndarray:
    """The pass band of the kind, in STAGES; its bounds must lie below half of fs."""
    for _ in range(STAGES):
        x = signal.bandpass(x, fs, *BANDS[kind], Q)
    return x


def detect(x: np.ndarray, fs: float, kind: str, quality: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(the signal the peaks are of, their places); with a quality the signal is filtered first."""
    x = np.asarray(x, float)
    gap, prominence, height = PEAKS[kind]
    if quality is not None:
        x = filtered(x, fs, kind)
        gap, prominence, height = (new if new is not None else old for new, old in zip(QUALITIES[kind][quality], (gap, prominence, height), strict=True))
    return x, signal.find_peaks(x, height, prominence, max(int(np.floor(gap * fs + 0.5)), 1))[0]


def _spread(v: np.ndarray) -> float:
    return float(v.std()) if len(v) > 1 else NAN


def analyze(x: np.ndarray, fs: float, kind: str, quality: str | None = None) -> dict:
    """mean, std and duration_s of the signal, peaks, mean_rate a minute, and sdnn and rmssd of the intervals in seconds.

    The rate is the mean of 60 / interval; NaN without an interval, as are deviations of fewer than two (rmssd: three).
    """
    y, at = detect(x, fs, kind, quality)
    gaps = np.diff(at) / fs
    d = np.diff(gaps)
    return {
        "mean": float(y.mean()) if len(y) else NAN,
        "std": float(y.std()) if len(y) else NAN,
        "duration_s": len(y) / fs,
        "peaks": len(at),
        "mean_rate": float((60.0 / gaps).mean()) if len(gaps) else NAN,
        "sdnn": _spread(gaps),
        "rmssd": float(np.sqrt((d * d).mean())) if len(gaps) > 2 else NAN,
    }


def phase_peaks(flow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of maxima above 0, of all other maxima): breathing in and out."""
    at = np.flatnonzero((flow[1:-1] > flow[:-2]) & (flow[1:-1] > flow[2:])) + 1 if len(flow) > 2 else np.zeros(0, int)
    return at[flow[at] > 0], at[flow[at] <= 0]


def analyze_breath(x: np.ndarray, fs: float, quality: str | None = None) -> dict:
    """analyze() with the mean of every other interval (in, out), and the maxima of each phase with their mean intervals."""
    y, at = detect(x, fs, "breath", quality)
    gaps = np.diff(at) / fs
    up, down = phase_peaks(y)
    mean = lambda v: float(v.mean()) if len(v) else NAN
    return analyze(x, fs, "breath", quality) | {"interval_in": mean(gaps[::2]), "interval_out": mean(gaps[1::2]), "peaks_in": len(up), "peaks_out": len(down), "between_in": mean(np.diff(up) / fs), "between_out": mean(np.diff(down) / fs)}


def stride_stats(times: np.ndarray, speed: float = WALKING) -> dict:
    """Strides from their times: n_strides, mean_stride, std_stride, cadence, mean_length, std_length, mean_step and speed."""
    gaps = np.diff(np.asarray(times, float))
    some = len(gaps) > 0
    return {
        "n_strides": len(gaps),
        "mean_stride": float(gaps.mean()) if some else NAN,
        "std_stride": float(gaps.std()) if len(gaps) > 1 else 0.0,
        "cadence": 120.0 / float(gaps.mean()) if some and gaps.mean() > 0 else NAN,
        "mean_length": speed * float(gaps.mean()) if some else NAN,
        "std_length": speed * float(gaps.std()) if len(gaps) > 1 else (0.0 if some else NAN),
        "mean_step": speed * float(gaps.mean()) / 2 if some else NAN,
        "speed": speed,
    }


def analyze_strides(x: np.ndarray, fs: float, quality: str | None = None, speed: float = WALKING) -> dict:
    return stride_stats(detect(x, fs, "stride", quality)[1] / fs, speed)


def vertical_oscillation(position: np.ndarray, times: np.ndarray, fs: float) -> float:
    """Mean height between the least and the greatest position of each stride; NaN without one."""
    cuts = np.minimum(np.floor(np.asarray(times) * fs + 0.5).astype(int), len(position))
    spans = [np.ptp(position[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
    return float(np.mean(spans)) if spans else NAN


_BASE = "mean double, std double, duration_s double, peaks long, mean_rate double, sdnn double, rmssd double"


def analyses(df: DataFrame, fs: float, kind: str, quality: str | None = None) -> DataFrame:
    """One row a series: analyze() of pulse or breath, with the phases of breath; the strides of stride."""
    if kind == "breath":
        return summary(df, lambda x: analyze_breath(x, fs, quality), f"{_BASE}, interval_in double, interval_out double, peaks_in long, peaks_out long, between_in double, between_out double")
    if kind == "stride":
        return summary(df, lambda x: analyze_strides(x, fs, quality), "n_strides long, mean_stride double, std_stride double, cadence double, mean_length double, std_length double, mean_step double, speed double")
    return summary(df, lambda x: analyze(x, fs, kind, quality), _BASE)


def intervals(df: DataFrame, fs: float, kind: str, quality: str | None = None) -> DataFrame:
    """(series_id, k, t, interval, rate) of the peaks of each series, the first without an interval."""
    d = table(df, lambda x: {"t": detect(x, fs, kind, quality)[1] / fs}, "t double")
    w = over(at="t")
    d = d.withColumns({"k": F.row_number().over(w) - 1, "interval": F.col("t") - F.lag("t").over(w)})
    return d.select(ID, "k", "t", "interval", F.when(F.col("interval") > 0, 60.0 / F.col("interval")).alias("rate"))
