"""Exact neighbours and cross recurrence against whole distance matrices."""

import time

import numpy as np
import pytest

from tidewave.operators import dynamics


def dense_nearest(a, theiler):
    d = np.sqrt(((a[:, None] - a[None]) ** 2).sum(2))
    i = np.arange(len(a))
    d[np.abs(i[:, None] - i[None]) <= theiler] = np.inf
    return np.where(np.isfinite(d.min(axis=1)), d.argmin(axis=1), -1) if len(a) else np.zeros(0, int)


@pytest.mark.parametrize("theiler", [0, 1, 5, 100])
@pytest.mark.parametrize("m", [1, 2, 3, 4])
def test_nearest_equals_the_matrix(m, theiler):
    rng = np.random.default_rng(10 * m + theiler)
    for x in (rng.normal(size=300), rng.integers(0, 3, 200).astype(float), np.ones(50), np.sin(np.arange(250) / 7), np.repeat(rng.normal(size=20), 10), np.r_[np.zeros(30), rng.normal(size=30)], np.arange(5.0), np.zeros(0)):
        a = dynamics.embed(x, m, 2)
        assert dynamics.nearest(a, theiler).tolist() == dense_nearest(a, theiler).tolist()


def test_false_neighbours_of_a_long_series():
    t = np.arange(60_000)
    x = np.sin(t / 17.0) + 0.3 * np.sin(t / 5.3) + 1e-3 * np.random.default_rng(1).normal(size=len(t))
    began = time.time()
    one, two, three = (dynamics.fnn(x, m, 8, theiler=20) for m in (1, 2, 3))
    assert one > 0.5 > two >= three and time.time() - began < 120
    assert np.isnan(dynamics.fnn(np.ones(2), 2, 1)) and dynamics.fnn(np.ones(30_000), 1, 1) == 0


@pytest.mark.parametrize(("dim", "radius"), [(1, 0.4), (2, 0.6), (3, 1.0)])
def test_cross_recurrence_equals_the_matrix(spark, dim, radius):
    rng = np.random.default_rng(dim)
    series = {1: (rng.normal(size=60), rng.normal(size=45)), 2: (np.sin(np.arange(50) / 4), np.cos(np.arange(50) / 4)), 3: (np.zeros(9), np.zeros(9)), 4: (np.zeros(9), np.ones(9) * 99), 5: (np.round(rng.normal(size=40)), np.round(rng.normal(size=70)))}
    frames = []
    for side in (0, 1):
        rows = [(s, i, float(v)) for s, both in series.items() for i, v in enumerate(both[side])] + ([(9, 0, 1.0), (9, 1, 1.0), (9, 2, 1.0)] if side else [])
        frames.append(dynamics.embedded(spark.createDataFrame(rows, "series_id long, i long, x double").repartition(3), dim, 1))
    got = {r.series_id: r for r in dynamics.crqa(*frames, radius).collect()}
    assert set(got) == set(series)
    for s, both in series.items():
        want = dynamics.rqa(dynamics.recurrence(*[dynamics.embed(v, dim, 1) for v in both], radius=radius))
        assert {k: got[s][k] for k in want} == pytest.approx(want, abs=1e-12)
