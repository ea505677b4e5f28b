"""Windows of events against a plain reading, window by window."""

import numpy as np
import pytest

from tidewave.operators import dynamics
from tidewave.operators import event_windows as ew


def plain_fit(v):
    out = []
    for k, x in enumerate(v):
        o = np.delete(v, k)
        sd = o.std(ddof=1)
        out.append(float(abs(x - o.mean()) <= 1e-12) if sd <= 1e-12 else np.exp(-(((x - o.mean()) / sd) ** 2) / 8))
    return np.array(out)


def plain_repair(t, p):
    if len(t) < 4:
        return None
    iv = np.diff(t)
    pr = np.minimum(plain_fit(iv), plain_fit(p)[1:])
    good = pr >= ew.POINT_MIN
    if t[-1] - t[0] < 180 or pr.mean() <= ew.MEAN_MIN or not (good[0] and good[-1]):
        return None
    return np.where(good, iv, np.interp(t[1:], t[1:][good], iv[good])), pr.mean()


def window(t, p, end):
    k = (t >= end - 180 - 1e-9) & (t <= end + 1e-9)
    return t[k], p[k]


def stream(rng, n, gap, odd):
    """A beat of whole seconds, so that windows begin and end with events; some come early, some are of another strength."""
    k = np.arange(n)
    t = gap * k - (rng.random(n) < odd) * (k > 0)
    return t.astype(float), np.where(rng.random(n) < odd, 3.0, 1 + 0.1 * np.cos(k / 5) + rng.normal(0, 0.01, n))


@pytest.fixture(scope="module")
def streams():
    rng = np.random.default_rng(4)
    return {k: (stream(rng, 220, 2, 0.02), stream(rng, 150, 3, 0.02)) for k in range(4)} | {8: ((np.arange(4) * 60.0, np.ones(4)), (np.arange(5) * 50.0, np.ones(5))), 9: (stream(rng, 20, 1, 0), stream(rng, 300, 1, 0))}


def frame(spark, series, more=()):
    rows = [(k, float(t), float(p)) for k, (ts, ps) in series.items() for t, p in zip(ts, ps, strict=True)]
    return spark.createDataFrame([*rows, *more], "series_id long, t double, prominence double").repartition(5)


ODD = [(50, 1.0, 1.0), (50, 2.0, 1.0), (50, 3.0, 1.0), (51, 1.0, 1.0), (51, 1.0, 2.0), (51, 200.0, 1.0), (51, 300.0, 1.0), (52, 1.0, None), (52, 2.0, 1.0), (52, 300.0, 1.0), (52, 400.0, 1.0)]


def test_measures_and_repairs(spark, streams):
    one = {k: v[0] for k, v in streams.items()}
    got = {(r.series_id, round(r.end, 6)): r for r in ew.rolling_measures(frame(spark, one, ODD), 30.0).collect()}
    seen = admitted = 0
    for k, (t, p) in one.items():
        for end in t[0] + 180 + 30 * np.arange(max(0, int(np.floor((t[-1] - t[0] - 180 + 1e-9) / 30)) + 1)):
            r, seen = got[k, round(end, 6)], seen + 1
            want = plain_repair(*window(t, p, end))
            assert (r.n is None) == (want is None)
            if want:
                v, mean = want
                admitted += 1
                assert (r.n, r.cv, r.mean_probability) == pytest.approx((len(v), v.std() / v.mean(), mean))
                assert r.sample_entropy == pytest.approx(dynamics.sample_entropy(v, 2, 0.2 * v.std())) and r.rmssd == pytest.approx(np.sqrt((np.diff(v) ** 2).mean()))
            wt, _ = window(t, p, end)
            late = np.diff(wt)[wt[1:] > end - 30 + 1e-9]
            assert (r.n_step or 0) == len(late) and (not len(late) or r.mean_interval == pytest.approx(late.mean()))
    assert seen == len(got) and 4 < admitted < seen  # series that can't be scored have no rows
    assert ew.rolling_measures(frame(spark, {}), 30.0).count() == 0


def test_coupling_of_two_streams(spark, streams):
    left, right = {k: v[0] for k, v in streams.items()}, {k: v[1] for k, v in streams.items()}
    got = {(r.series_id, round(r.end, 6)): r for r in ew.rolling_joint_coupling(frame(spark, left, ODD), frame(spark, right), 15.0).collect()}
    seen = coupled = 0
    for k in left:
        (t, p), (u, q) = left[k], right[k]
        start, last = max(t[0], u[0]), min(t[-1], u[-1])
        for end in start + 180 + 15 * np.arange(max(0, int(np.floor((last - start - 180 + 1e-9) / 15)) + 1)):
            r, seen = got[k, round(end, 6)], seen + 1
            a, b = plain_repair(*window(t, p, end)), plain_repair(*window(u, q, end))
            assert (r.n_intervals is None) == (a is None or b is None)
            if a and b:
                n = min(len(a[0]), len(b[0]))
                x, y = a[0][-n:], b[0][-n:]
                coupled += 1
                radius = 0.2 * np.r_[x, y].std()
                want = dynamics.rqa(dynamics.recurrence(dynamics.embed(x, 2, 1), dynamics.embed(y, 2, 1), radius=radius))
                assert r.n_intervals == n and r.cross_sample_entropy == pytest.approx(dynamics.cross_sample_entropy(x, y, 2, radius))
                assert (r.rr, r.det, r.lam, r.mean_diag, r.diag_entropy) == pytest.approx(tuple(want[c] for c in ("rr", "det", "lam", "lmean", "entropy")))
    assert seen == len(got) and coupled > 4


def test_trimming_keeps_the_newest(spark):
    d = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [8.0, 9.0]), ([], [1.0]), ([5.0], [6.0])], "x array<double>, y array<double>")
    x, y = ew.trim_to_same_end(d["x"], d["y"])
    assert [tuple(r) for r in d.select(x, y).collect()] == [([3.0, 4.0], [8.0, 9.0]), ([], []), ([5.0], [6.0])]


def test_entropy_across_short_series():
    assert dynamics.cross_sample_entropy(np.array([1.0, 2, 3]), np.array([1.0, 2, 3.05]), 2, 0.1) == 0.0
    assert dynamics.cross_sample_entropy(np.array([1.0, 2]), np.array([1.0, 2]), 2, 0.1) == 0.0
