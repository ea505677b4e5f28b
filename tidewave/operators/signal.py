"""Signal processing on series: normalising, outliers, interpolation, peaks, spectra, filters and deconvolution.

Pointwise and framed operators are window expressions; recursions and transforms are NumPy kernels run per series.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions.compat import NAN, ratio
from tidewave.operators.series import AT, ID, X, over

def whole():
    return Window.partitionBy(ID)



def normalize(df: DataFrame, name: str = "y") -> DataFrame:
    """(x - min) / (max - min) of the series, NaN for a constant."""
    lo, hi = F.min(X).over(whole()), F.max(X).over(whole())
    return df.withColumn(name, F.coalesce(F.try_divide(F.col(X) - lo, hi - lo), F.lit(NAN)))


def scale_to_percent(df: DataFrame, name: str = "y") -> DataFrame:
    """100 (x - min) / (max - min), 0 for a constant."""
    lo, hi = F.min(X).over(whole()), F.max(X).over(whole())
    return df.withColumn(name, ratio(100 * (F.col(X) - lo), hi - lo, 0.0))


def zscore(df: DataFrame, name: str = "y") -> DataFrame:
    """(x - mean) / population deviation; NaN for a constant."""
    return df.withColumn(name, F.coalesce(F.try_divide(F.col(X) - F.avg(X).over(whole()), F.stddev_pop(X).over(whole())), F.lit(NAN)))


def percent_change_outliers(df: DataFrame, threshold: float, name: str = "outlier") -> DataFrame:
    """|x - last x| > threshold |last x|; after a zero, |x| > 100 threshold. The first sample is none."""
    last = F.lag(X).over(over())
    jump = F.when(last == 0, F.abs(X) > 100 * threshold).otherwise(F.abs(F.col(X) - last) > threshold * F.abs(last))
    return df.withColumn(name, F.coalesce(jump, F.lit(False)))


def local_mad_outliers(df: DataFrame, half: int, k: float, name: str = "outlier") -> DataFrame:
    """|x - median| > k MAD within half samples to each side, where the MAD is above 0."""
    frame = F.array_sort(F.collect_list(X).over(over((-half, half))))
    mid = lambda a: (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2
    d = df.withColumn("_f", frame).withColumn("_m", mid(F.col("_f")))
    d = d.withColumn("_mad", mid(F.array_sort(F.transform("_f", lambda v: F.abs(v - F.col("_m"))))))
    return d.withColumn(name, (F.col("_mad") > 0) & (F.abs(F.col(X) - F.col("_m")) > k * F.col("_mad"))).drop("_f", "_m", "_mad")


def linear_fill(df: DataFrame, bad: str, name: str = "filled") -> DataFrame:
    """x where bad is false; else on the line between the nearest good samples, or the nearest one at the ends; null if none is good."""
    good = F.when(~F.col(bad), F.struct(F.col(AT).alias("i"), F.col(X).alias("x")))
    before, after = F.last(good, True).over(over((Window.unboundedPreceding, 0))), F.first(good, True).over(over((0, Window.unboundedFollowing)))
    d = df.withColumns({"_b": before, "_a": after})
    at = ratio((F.col(AT) - F.col("_b.i")).cast("double"), (F.col("_a.i") - F.col("_b.i")).cast("double"), 0.0)
    line = F.col("_b.x") + (F.col("_a.x") - F.col("_b.x")) * at
    return d.withColumn(name, F.when(~F.col(bad), F.col(X)).otherwise(F.coalesce(line, F.col("_b.x"), F.col("_a.x")))).drop("_b", "_a")


def local_maxima(df: DataFrame, height: float | None = None) -> DataFrame:
    """Samples above the one before and not below the one after (the first of a flat top that falls later is not sought)."""
    w = over()
    d = df.withColumns({"_p": F.lag(X).over(w), "_n": F.lead(X).over(w)}).where((F.col(X) > F.col("_p")) & (F.col(X) > F.col("_n")))
    return (d.where(F.col(X) >= height) if height is not None else d).drop("_p", "_n")


def find_peaks(x: np.ndarray, height: float | None = None, prominence: float | None = None, distance: int = 0, threshold: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, prominences) of samples above both neighbours; a flat top is no peak.

    height: the least value; threshold: the least drop to the higher neighbour; prominence: the least height over the lower
    of the two bases, a base being the least value up to the next higher sample; distance: from left to right, a peak nearer
    than this to the last one kept is left out.
    """
    x = np.asarray(x, float)
    at = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:])) + 1 if len(x) > 2 else np.zeros(0, int)
    if height is not None:
        at = at[x[at] >= height]
    if threshold is not None:
        at = at[x[at] - np.maximum(x[at - 1], x[at + 1]) >= threshold]
    prom = np.empty(len(at))
    for i, p in enumerate(at.tolist()):
        higher = np.flatnonzero(x[:p] > x[p])
        left = x[(higher[-1] + 1 if len(higher) else 0) : p + 1].min()
        higher = np.flatnonzero(x[p + 1 :] > x[p])
        right = x[p : (p + 1 + higher[0] if len(higher) else len(x))].min()
        prom[i] = x[p] - min(left, right)
    if prominence is not None:
        at, prom = at[prom >= prominence], prom[prom >= prominence]
    if distance > 1 and len(at):
        stays, last = np.zeros(len(at), bool), None
        for i, p in enumerate(at.tolist()):
            if last is None or p >= last + distance:
                stays[i], last = True, p
        at, prom = at[stays], prom[stays]
    return at, prom


def min_max_decimate(df: DataFrame, bucket: int) -> DataFrame:
    """Of every bucket samples the least and the greatest (the first of each), in order."""
    d = df.withColumn("_b", F.floor((F.row_number().over(over()) - 1) / bucket))
    g = d.groupBy(ID, "_b").agg(F.min(F.struct(F.col(X).alias("x"), F.col(AT).alias("i"))).alias("lo"), F.max(F.struct(F.col(X).alias("x"), (-F.col(AT)).alias("i"))).alias("hi"))
    return g.select(ID, F.explode(F.array_distinct(F.array(F.struct(F.col("lo.i").alias("i"), F.col("lo.x").alias("x")), F.struct((-F.col("hi.i")).alias("i"), F.col("hi.x").alias("x"))))).alias("s")).select(ID, F.col("s.i").alias(AT), F.col("s.x").alias(X))


def interp_linear(t: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """On the lines between samples; beyond the last sample its value, before the first the first line goes on."""
    y = np.interp(at, t, x)
    if len(t) > 1:
        early = at < t[0]
        y[early] = x[0] + (x[1] - x[0]) / (t[1] - t[0]) * (at[early] - t[0])
    return y


def interp_spline(t: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline, held constant beyond both ends."""
    n = len(t)
    if n < 3:
        return np.interp(at, t, x)
    h = np.diff(t)
    a = np.zeros((n, n))
    b = np.zeros(n)
    a[0, 0] = a[-1, -1] = 1
    for k in range(1, n - 1):
        a[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        b[k] = 3 * ((x[k + 1] - x[k]) / h[k] - (x[k] - x[k - 1]) / h[k - 1])
    c = np.linalg.solve(a, b)
    at = np.clip(at, t[0], t[-1])
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, n - 2)
    d = (c[k + 1] - c[k]) / (3 * h[k])
    slope = (x[k + 1] - x[k]) / h[k] - h[k] * (2 * c[k] + c[k + 1]) / 3
    u = at - t[k]
    return x[k] + u * (slope + u * (c[k] + u * d))


def resample(x: np.ndarray, n: int, spline: bool = False) -> np.ndarray:
    """x at n evenly spaced places from the first to the last sample."""
    at = np.linspace(0, len(x) - 1, n) if n > 1 else np.zeros(n)
    return (interp_spline if spline else interp_linear)(np.arange(len(x), dtype=float), x, at)


def tachogram(times: np.ndarray, intervals: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Intervals as an even series at fs samples a second, on lines between them."""
    t = np.arange(times[0], times[-1] + 1e-12, 1 / fs)
    return t, np.interp(t, times, intervals)


def window_samples(kind: str, n: int) -> np.ndarray:
    """Symmetric hann, hamming, blackman or rectangular window."""
    k = np.arange(n) / max(n - 1, 1)
    # fixed values: the windows' cosine terms
    terms = {"hann": (0.5, 0.5), "hamming": (0.54, 0.46), "blackman": (0.42, 0.5, 0.08), "rectangular": (1.0,)}[kind]
    return sum((-1) ** j * a * np.cos(2 * np.pi * j * k) for j, a in enumerate(terms)) if n > 1 else np.ones(n)


def welch(x: np.ndarray, fs: float, nperseg: int = 256, overlap: int | None = None, window: str = "hann") -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, density): averaged periodograms of overlapping segments, no detrending, scale 1 / (fs sum w^2), inner bins doubled."""
    nperseg = min(nperseg, len(x))
    if nperseg < 1:
        return np.zeros(0), np.zeros(0)
    hop = max(nperseg - (nperseg // 2 if overlap is None else overlap), 1)
    w = window_samples(window, nperseg)
    p = np.mean([np.abs(np.fft.rfft(x[a : a + nperseg] * w)) ** 2 for a in range(0, len(x) - nperseg + 1, hop)], axis=0) / (fs * (w * w).sum())
    p[1:-1] *= 2
    return np.linspace(0, fs / 2, len(p)), p


def stft(x: np.ndarray, fs: float, nperseg: int, hop: int, window: str = "hann") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(times, frequencies, magnitudes[frequency, time])."""
    w = window_samples(window, nperseg)
    cols = [np.abs(np.fft.rfft(x[a : a + nperseg] * w)) for a in range(0, len(x) - nperseg + 1, hop)]
    m = np.array(cols).T if cols else np.zeros((nperseg // 2 + 1, 0))
    return np.linspace(0, len(x) / fs, m.shape[1]), np.linspace(0, fs / 2, m.shape[0]), m


def cwt(x: np.ndarray, scales: np.ndarray, wavelet: str = "morlet", w0: float = 5.0) -> np.ndarray:
    """Magnitudes[scale, sample] of the direct sum with Morlet or Mexican-hat wavelets, divided by the scale's root."""
    n = len(x)
    k = np.arange(n)
    out = np.empty((len(scales), n))
    for i, s in enumerate(scales):
        u = (k[None, :] - k[:, None]) / s
        psi = np.exp(1j * w0 * u) * np.exp(-u * u / 2) * np.pi**-0.25 if wavelet == "morlet" else (1 - u * u) * np.exp(-u * u / 2) * 2 / (np.sqrt(3) * np.pi**0.25)
        out[i] = np.abs(np.conj(psi) @ x) / np.sqrt(s)
    return out


def hilbert(x: np.ndarray, reference_odd: bool = False) -> np.ndarray:
    """The analytic signal. reference_odd leaves the last positive bin of an odd length undoubled and drops it."""
    n = len(x)
    h = np.zeros(n)
    if n:
        h[0] = 1
        h[1 : (n // 2 if reference_odd or n % 2 == 0 else (n + 1) // 2)] = 2
        if n % 2 == 0:
            h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * h)


def analytic(x: np.ndarray, fs: float) -> dict:
    """Amplitude, unwrapped phase and instantaneous frequency."""
    z = hilbert(x)
    phase = np.unwrap(np.angle(z))
    return {"amplitude": np.abs(z), "phase": phase, "frequency": np.gradient(phase) * fs / (2 * np.pi) if len(x) > 1 else np.zeros(len(x))}


def biquad(x: np.ndarray, b, a) -> np.ndarray:
    """Second-order section in transposed direct form II; a[0] is 1."""
    y, s1, s2 = np.empty(len(x)), 0.0, 0.0
    for k, v in enumerate(x):
        y[k] = b[0] * v + s1
        s1, s2 = b[1] * v - a[1] * y[k] + s2, b[2] * v - a[2] * y[k]
    return y


def bandpass(x: np.ndarray, fs: float, lo: float, hi: float, q: float = 0.707) -> np.ndarray:
    if not 0 < lo < hi < fs / 2:
        raise ValueError("0 < lo < hi < fs / 2 is needed")
    w0, al = np.pi * (lo + hi) / fs, np.sin(np.pi * (hi - lo) / fs / 2) / (2 * q)
    return biquad(x, np.array([al, 0, -al]) / (1 + al), np.array([1, -2 * np.cos(w0) / (1 + al), (1 - al) / (1 + al)]))


def chebyshev_lowpass(x: np.ndarray, fs: float, cutoff: float, ripple_db: float) -> np.ndarray:
    """Second-order type-I low-pass by the bilinear transform."""
    if not 0 < cutoff < fs / 2 or ripple_db <= 0:
        raise ValueError("a cutoff below fs / 2 and a positive ripple are needed")
    eps = np.sqrt(10 ** (ripple_db / 10) - 1)
    mu, k = np.arcsinh(1 / eps) / 2, 2 * fs * np.tan(np.pi * cutoff / fs)
    pole = k * complex(-np.sinh(mu) * np.sin(np.pi / 4), np.cosh(mu) * np.cos(np.pi / 4))
    z = (2 * fs + pole) / (2 * fs - pole)
    a = np.array([1, -2 * z.real, abs(z) ** 2])
    b = np.array([1, 2, 1.0])
    return biquad(x, b * a.sum() / b.sum() / np.sqrt(1 + eps * eps), a)


def adaptive_mean(x: np.ndarray, k: float) -> np.ndarray:
    """Samples farther than k population deviations from the mean become the mean."""
    return np.where(np.abs(x - x.mean()) > k * x.std(), x.mean(), x) if len(x) else x


def adaptive_median(x: np.ndarray, k: float) -> np.ndarray:
    """Samples farther than k MADs from the median become the median."""
    m = np.median(x) if len(x) else 0
    return np.where(np.abs(x - m) > k * np.median(np.abs(x - m)), m, x) if len(x) else x


def lms(x: np.ndarray, wanted: np.ndarray, taps: int, mu: float, normalized: bool = False, reference_taps: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(output, error) of the LMS or NLMS filter with a delay line of past inputs; reference_taps puts past weights there."""
    w, line, y, e = np.zeros(taps), np.zeros(taps), np.empty(len(x)), np.empty(len(x))
    for k, v in enumerate(x):
        line = np.r_[v, (w if reference_taps else line)[:-1]]
        y[k] = w @ line
        e[k] = wanted[k] - y[k]
        w = w + mu * e[k] * line / (1e-8 + line @ line if normalized else 1.0)
    return y, e


def rls(x: np.ndarray, wanted: np.ndarray, taps: int, forget: float = 0.99, delta: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(output, error) of recursive least squares."""
    w, line, p = np.zeros(taps), np.zeros(taps), np.eye(taps) / delta
    y, e = np.empty(len(x)), np.empty(len(x))
    for k, v in enumerate(x):
        line = np.r_[v, line[:-1]]
        g = p @ line / (forget + line @ p @ line)
        y[k] = w @ line
        e[k] = wanted[k] - y[k]
        w = w + g * e[k]
        p = (p - np.outer(g, line @ p)) / forget
    return y, e


def kalman(z: np.ndarray, f: np.ndarray, h: np.ndarray, q: np.ndarray, r: np.ndarray, x0: np.ndarray, p0: np.ndarray) -> dict:
    """Forward pass over measurements (rows of z; a NaN row is skipped): states, covariances and the predicted ones."""
    x, p = np.asarray(x0, float), np.asarray(p0, float)
    out = {"x": [], "p": [], "xp": [], "pp": []}
    for m in np.atleast_2d(z.T).T:
        xp, pp = f @ x, f @ p @ f.T + q
        x, p = xp, pp
        if np.isfinite(m).all():
            k = pp @ h.T @ np.linalg.inv(h @ pp @ h.T + r)
            x, p = xp + k @ (m - h @ xp), (np.eye(len(xp)) - k @ h) @ pp
        for n, v in (("x", x), ("p", p), ("xp", xp), ("pp", pp)):
            out[n].append(v)
    return {n: np.array(v) for n, v in out.items()}


def constant_velocity(z: np.ndarray, dt: float, q: float, r: float) -> dict:
    """Position and velocity from positions, from 0 with variance 1000."""
    return kalman(z, np.array([[1, dt], [0, 1]]), np.array([[1.0, 0]]), q * np.array([[dt**4 / 4, dt**3 / 2], [dt**3 / 2, dt**2]]), np.array([[r]]), np.zeros(2), 1000 * np.eye(2))


def random_walk(z: np.ndarray, q: float, r: float) -> np.ndarray:
    return kalman(z, np.eye(1), np.eye(1), np.array([[q]]), np.array([[r]]), z[:1], np.eye(1))["x"][:, 0] if len(z) else z


def rts_smooth(run: dict, f: np.ndarray, reference_sign: bool = False) -> np.ndarray:
    """Smoothed states of a forward pass. reference_sign turns the correction round."""
    x, p = run["x"].copy(), run["p"].copy()
    for k in range(len(x) - 2, -1, -1):
        c = run["p"][k] @ f.T @ np.linalg.inv(run["pp"][k + 1])
        x[k] = run["x"][k] + (-1 if reference_sign else 1) * c @ (x[k + 1] - run["xp"][k + 1])
        p[k] = run["p"][k] + c @ (p[k + 1] - run["pp"][k + 1]) @ c.T
    return x


def jacobian(g, x: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    return np.stack([(np.asarray(g(x + d)) - np.asarray(g(x - d))) / (2 * eps) for d in np.eye(len(x)) * eps], axis=1)


def extended_kalman(z: np.ndarray, f, h, q, r, x0, p0) -> np.ndarray:
    """States of the extended filter for functions f and h, with numerical Jacobians."""
    x, p, out = np.asarray(x0, float), np.asarray(p0, float), []
    for m in np.atleast_2d(z.T).T:
        a = jacobian(f, x)
        x, p = np.asarray(f(x), float), a @ p @ a.T + q
        c = jacobian(h, x)
        k = p @ c.T @ np.linalg.inv(c @ p @ c.T + r)
        x, p = x + k @ (m - np.asarray(h(x))), (np.eye(len(x)) - k @ c) @ p
        out.append(x)
    return np.array(out)


def unscented_kalman(z: np.ndarray, f, h, q, r, x0, p0, alpha: float = 1e-3, beta: float = 2.0, kappa: float = 0.0) -> np.ndarray:
    """States of the unscented filter, with scaled sigma points."""
    x, p, out = np.asarray(x0, float), np.asarray(p0, float), []
    n = len(x)
    lam = alpha**2 * (n + kappa) - n
    wm = np.r_[lam / (n + lam), np.full(2 * n, 0.5 / (n + lam))]
    wc = wm.copy()
    wc[0] += 1 - alpha**2 + beta

    def points(x, p):
        s = np.linalg.cholesky((n + lam) * (p + p.T) / 2)
        return np.vstack([x, x + s.T, x - s.T])

    for m in np.atleast_2d(z.T).T:
        y = np.array([f(v) for v in points(x, p)])
        x = wm @ y
        p = (wc[:, None] * (y - x)).T @ (y - x) + q
        s = points(x, p)
        v = np.array([h(u) for u in s])
        mu = wm @ v
        k = (wc[:, None] * (s - x)).T @ (v - mu) @ np.linalg.inv((wc[:, None] * (v - mu)).T @ (v - mu) + r)
        x = x + k @ (m - mu)
        p = p - k @ ((wc[:, None] * (v - mu)).T @ (v - mu) + r) @ k.T
        out.append(x)
    return np.array(out)


def ista(a: np.ndarray, y: np.ndarray, lam: float, most: int = 500, tol: float = 1e-8, nonnegative: bool = False) -> np.ndarray:
    """Iterated soft thresholding of |ax - y|^2 / 2 + lam |x|, with step 1 / L."""
    step, x = 1 / max(np.linalg.norm(a, 2) ** 2, 1e-12), np.zeros(a.shape[1])
    for _ in range(most):
        z = x - step * a.T @ (a @ x - y)
        new = np.maximum(z - lam * step, 0) if nonnegative else np.sign(z) * np.maximum(np.abs(z) - lam * step, 0)
        if np.linalg.norm(new - x) < tol:
            return new
        x = new
    return x


def omp(a: np.ndarray, y: np.ndarray, k: int, tol: float = 1e-10) -> np.ndarray:
    """Orthogonal matching pursuit with k columns at most."""
    x, chosen, rest = np.zeros(a.shape[1]), [], y.astype(float)
    for _ in range(k):
        chosen.append(int(np.abs(a.T @ rest).argmax()))
        w = np.linalg.lstsq(a[:, chosen], y, rcond=None)[0]
        rest = y - a[:, chosen] @ w
        if np.linalg.norm(rest) < tol:
            break
    x[chosen] = w
    return x


def dct_basis(n: int) -> np.ndarray:
    """Orthonormal DCT-II basis, a column for each frequency."""
    k = np.arange(n)
    b = np.cos(np.pi * (k[:, None] + 0.5) * k[None, :] / n) * np.sqrt(2 / n)
    b[:, 0] /= np.sqrt(2)
    return b


def exponential_kernel(n: int, tau: float, dt: float) -> np.ndarray:
    k = np.exp(-np.arange(n) * dt / tau)
    return k / k.sum()


def convolution_matrix(kernel: np.ndarray, n: int) -> np.ndarray:
    m = np.zeros((n, n))
    for j, v in enumerate(kernel[:n]):
        m += v * np.eye(n, k=-j)
    return m


def nonnegative_deconvolution(y: np.ndarray, kernel: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Ridge solution of y = kernel * u, cut at 0."""
    a = convolution_matrix(kernel, len(y))
    return np.maximum(np.linalg.solve(a.T @ a + ridge * np.eye(len(y)), a.T @ y), 0)


def sparse_deconvolution(y: np.ndarray, kernel: np.ndarray, lam: float) -> np.ndarray:
    return ista(convolution_matrix(kernel, len(y)), y, lam, nonnegative=True)


def burst_deconvolution(y: np.ndarray, kernel: np.ndarray, lam: float, floor: float) -> np.ndarray:
    """Sparse solution, its local maxima of floor or more, and their heights fitted anew."""
    u = sparse_deconvolution(y, kernel, lam)
    padded = np.r_[-np.inf, u, -np.inf]
    at = np.flatnonzero((u >= floor) & (padded[1:-1] > padded[:-2]) & (padded[1:-1] >= padded[2:]))
    out = np.zeros(len(y))
    if len(at):
        a = convolution_matrix(kernel, len(y))[:, at]
        out[at] = np.maximum(np.linalg.lstsq(a, y, rcond=None)[0], 0)
    return out


def wiener_deconvolution(y: np.ndarray, kernel: np.ndarray, snr: float) -> np.ndarray:
    k = np.fft.fft(kernel, len(y))
    return np.fft.ifft(np.fft.fft(y) * np.conj(k) / (np.abs(k) ** 2 + 1 / snr)).real
