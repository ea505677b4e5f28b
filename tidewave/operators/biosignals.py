"""Intervals between events, heart-rate variability, event windows, pulse, breath and gait signals, and their generators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.compat import NAN, nan_unless
from tidewave.operators import dynamics, signal
from tidewave.operators.grouped import table
from tidewave.operators.series import ID, over

#: Fixed values of the event window: seconds of a window, of a step and of a fast step, and the least probabilities.
WINDOW_S, STEP_S, FAST_STEP_S, POINT_MIN, MEAN_MIN = 180.0, 30.0, 15.0, 0.6, 0.8


def intervals(df: DataFrame, t: str = "t") -> DataFrame:
    """(series_id, k, t, interval, rate) of each event but the first, in order of t; rate is 60 / interval, null for 0."""
    w = over(at=t)
    d = df.select(ID, F.col(t).alias("t"), (F.row_number().over(w) - 1).cast("long").alias("k"), (F.col(t) - F.lag(t).over(w)).alias("interval"))
    return d.where("k > 0").withColumn("rate", F.try_divide(F.lit(60.0), "interval")).select(ID, "k", "t", "interval", "rate")


def hrv(df: DataFrame, interval: str = "interval", at: str = "k") -> DataFrame:
    """One row per series of intervals in seconds: n, mean_rate, sdnn_ms, rmssd_ms (divisor n - 1, NaN below 3), pnn50 in percent."""
    d = F.abs(F.col(interval) - F.lag(interval).over(over(at=at)))
    s = df.select(ID, interval, d.alias("_d"))
    return s.groupBy(ID).agg(
        F.count(interval).alias("n"),
        F.try_divide(F.lit(60.0), F.avg(interval)).alias("mean_rate"),
        nan_unless(F.count(interval) >= 2, F.stddev_pop(interval) * 1000).alias("sdnn_ms"),
        nan_unless(F.count(interval) >= 3, F.sqrt(F.avg(F.col("_d") * F.col("_d"))) * 1000).alias("rmssd_ms"),
        F.coalesce(F.avg(F.when(F.col("_d").isNotNull(), (F.col("_d") > 0.05).cast("double"))) * 100, F.lit(0.0)).alias("pnn50"),
    )


def clean_intervals(df: DataFrame, lo: float, hi: float, interval: str = "interval") -> DataFrame:
    """Intervals within [lo, hi]."""
    return df.where((F.col(interval) >= lo) & (F.col(interval) <= hi))


def peer_fit(df: DataFrame, x: str, by: str = ID, name: str = "fit") -> DataFrame:
    """exp(-z^2 / 8) of each value against the mean and sample deviation of its group's other values.

    Where the others hardly vary (1e-12), 1 for their mean and else 0. A value with fewer than two others fits.
    """
    w = Window.partitionBy(by)
    n, s, q = F.count(x).over(w) - 1, F.sum(x).over(w) - F.col(x), F.sum(F.col(x) * F.col(x)).over(w) - F.col(x) * F.col(x)
    d = df.withColumns({"_n": n, "_m": F.try_divide(s, n), "_v": F.try_divide(q - F.try_divide(s * s, n), n - 1)})
    sd = F.sqrt(F.greatest(F.col("_v"), F.lit(0.0)))
    z = F.try_divide(F.col(x) - F.col("_m"), sd)
    fit = F.when(F.col("_n") < 2, 1.0).when(sd <= 1e-12, F.when(F.abs(F.col(x) - F.col("_m")) <= 1e-12, 1.0).otherwise(0.0)).otherwise(F.exp(-z * z / 8))
    return d.withColumn(name, fit).drop("_n", "_m", "_v")


def event_gate(df: DataFrame, t: str = "t", probability: str = "p") -> DataFrame:
    """(series_id, span, mean_p, admitted): whether events span WINDOW_S or more and their probabilities' mean is over MEAN_MIN."""
    g = df.groupBy(ID).agg((F.max(t) - F.min(t)).alias("span"), F.avg(probability).alias("mean_p"))
    return g.withColumn("admitted", (F.col("span") >= WINDOW_S) & (F.col("mean_p") > MEAN_MIN))


def rolling_event_grid(df: DataFrame, t: str = "t", x: str = "interval", length: float = WINDOW_S, step: float = STEP_S) -> DataFrame:
    """(series_id, end, n, mean, std) of the events in (end - length, end], ends from the first event + length on, step apart.

    Each event is sent to the windows it lies in, of which there are at most length / step + 1; no pairs of events are made.
    """
    w = Window.partitionBy(ID)
    d = df.select(ID, F.col(t).alias("t"), F.col(x).alias("x"), F.min(t).over(w).alias("t0"), F.max(t).over(w).alias("t1"))
    lo = F.greatest(F.ceil((F.col("t") - F.col("t0") - length - 1e-9) / step), F.lit(0)).cast("long")
    hi = F.least(F.ceil((F.col("t") - F.col("t0") + 1e-9) / step) - 1, F.floor((F.col("t1") - F.col("t0") - length + 1e-9) / step)).cast("long")
    e = d.withColumns({"lo": lo, "hi": hi}).where("lo <= hi").withColumn("k", F.explode(F.sequence("lo", "hi")))
    return e.groupBy(ID, (F.col("t0") + length + F.col("k") * step).alias("end")).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), nan_unless(F.count("x") >= 2, F.stddev_pop("x")).alias("std"))


def event_measures(x: np.ndarray) -> dict:
    """Mean, deviation, rmssd and sample entropy (m 2, r 0.2 deviations) of the intervals of a window."""
    d = np.diff(x)
    return {
        "mean": float(x.mean()) if len(x) else NAN,
        "sd": float(x.std()) if len(x) > 1 else NAN,
        "rmssd": float(np.sqrt((d * d).mean())) if len(x) > 2 else NAN,
        "sampen": dynamics.sample_entropy(x, 2, 0.2 * x.std()) if len(x) else 0.0,
    }


def repair(t: np.ndarray, p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x with the values of probability under POINT_MIN on lines over t between the others."""
    good = p >= POINT_MIN
    return np.where(good, x, np.interp(t, t[good], x[good])) if good.any() else x


def detect_events(df: DataFrame, fs: float, lo: float, hi: float, least_gap: float, prominence: float) -> DataFrame:
    """(series_id, t, prominence) of the peaks of the band-passed, z-scored waveform."""

    def run(x: np.ndarray) -> dict:
        y = signal.bandpass(x - x.mean(), fs, lo, hi) if lo > 0 else x
        y = (y - y.mean()) / (y.std() or 1)
        at, prom = signal.find_peaks(y, prominence=prominence, distance=max(int(least_gap * fs), 1))
        return {"t": at / fs, "prominence": prom}

    return table(df, run, "t double, prominence double")


def detect_pulse(df: DataFrame, fs: float) -> DataFrame:
    return detect_events(df, fs, 0.5, min(8.0, fs * 0.45), 0.4, 0.5)


def detect_breaths(df: DataFrame, fs: float) -> DataFrame:
    return detect_events(df, fs, 0.05, min(1.0, fs * 0.45), 1.5, 0.5)


def detect_strides(df: DataFrame, fs: float) -> DataFrame:
    return detect_events(df, fs, 0.3, min(5.0, fs * 0.45), 0.5, 0.5)


def gait_measures(df: DataFrame, t: str = "t") -> DataFrame:
    """(series_id, mean_stride, cv_stride, cadence, symmetry) from contacts of alternating feet in order.

    A stride is the time between contacts of one foot; cadence is 120 over its mean; symmetry is 2 |L - R| / (L + R) of the
    mean step times of the two feet.
    """
    w = over(at=t)
    d = df.select(ID, (F.row_number().over(w) % 2).alias("foot"), (F.col(t) - F.lag(t, 2).over(w)).alias("stride"), (F.col(t) - F.lag(t).over(w)).alias("step"))
    left, right = F.avg(F.when(F.col("foot") == 1, F.col("step"))), F.avg(F.when(F.col("foot") == 0, F.col("step")))
    return d.groupBy(ID).agg(
        F.avg("stride").alias("mean_stride"),
        F.try_divide(F.stddev_pop("stride"), F.avg("stride")).alias("cv_stride"),
        F.try_divide(F.lit(120.0), F.avg("stride")).alias("cadence"),
        F.try_divide(2 * F.abs(left - right), left + right).alias("symmetry"),
    )


def generate_pulse(seconds: float, fs: float, rate: float = 70.0, sd: float = 0.03, seed: int = 0) -> np.ndarray:
    """A pulse wave: each beat the sum of two Gaussian humps, intervals about 60 / rate, at least 0.3 s."""
    rng, n = np.random.default_rng(seed), int(seconds * fs)
    t, x, beat = np.arange(n) / fs, np.zeros(n), 0.0
    while beat < seconds:
        rr = max(0.3, 60 / rate + rng.normal(0, sd))
        u = (t - beat) / rr
        x += np.exp(-(((u - 0.25) / 0.09) ** 2) / 2) + 0.4 * np.exp(-(((u - 0.55) / 0.12) ** 2) / 2)
        beat += rr
    return x


def generate_breath(seconds: float, fs: float, rate: float = 15.0, ratio: float = 0.4, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(volume, flow): closed cycles with a share ratio of breathing in; flow is the central difference."""
    rng, n = np.random.default_rng(seed), int(seconds * fs)
    v, t, begin = np.zeros(n), np.arange(n) / fs, 0.0
    while begin < seconds:
        period = max(1.0, 60 / rate * (1 + rng.normal(0, 0.05)))
        u = (t - begin) / period
        on = (u >= 0) & (u < 1)
        up = on & (u < ratio)
        v[up] = (1 - np.cos(np.pi * u[up] / ratio)) / 2
        down = on & ~up
        v[down] = (1 + np.cos(np.pi * (u[down] - ratio) / (1 - ratio))) / 2
        begin += period
    return v, np.gradient(v) * fs if n > 1 else np.zeros(n)


def generate_gait(seconds: float, fs: float, stride: float = 1.1, seed: int = 0) -> np.ndarray:
    """One Gaussian hump for each stride."""
    rng, n = np.random.default_rng(seed), int(seconds * fs)
    t, x, at = np.arange(n) / fs, np.zeros(n), stride / 2
    while at < seconds:
        x += np.exp(-(((t - at) / (0.12 * stride)) ** 2) / 2)
        at += max(0.3, stride * (1 + rng.normal(0, 0.02)))
    return x


def cpg(seconds: float, dt: float, mu: float = 1.0, coupling: float = 0.2, omega: float = 2 * np.pi, tau: float = 1.0, step_at: float = 10.0, target: tuple[float, float] = (1.0, 1.5)) -> tuple[np.ndarray, np.ndarray]:
    """(times, states): four coupled Van der Pol oscillators whose time scale moves to a target that steps at step_at."""
    from tidewave.operators.series import rk4

    def f(t, y):
        x, v, s = y[:4], y[4:8], y[8]
        ring = np.roll(x, 1) + np.roll(x, -1) - 2 * x
        return np.r_[v / s, (mu * (1 - x * x) * v - omega**2 * x + coupling * ring) / s, ((target[0] if t < step_at else target[1]) - s) / tau]

    return rk4(f, 0.0, seconds, np.r_[0.1, -0.1, 0.1, -0.1, np.zeros(4), target[0]], dt)
