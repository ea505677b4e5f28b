"""Golden cases and degenerate inputs of the operators."""

import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewave.functions import special
from tidewave.operators import biosignals, classification, dynamics, load, series, signal, spatial, statistics
from tidewave.plans import joins
from tidewave.sources import readers
from tidewave.streaming import vitals


def frame(spark, *xs, id_="a"):
    return spark.createDataFrame([(id_, i, None if x is None else float(x)) for i, x in enumerate(xs)], "series_id string, i long, x double")


def column(df, c, order="i"):
    return [r[c] for r in df.orderBy(order).collect()]


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert (x is None and y is None) or (math.isnan(x) and math.isnan(y)) or x == pytest.approx(y)


def test_rolling(spark):
    same(column(series.rolling_mean(frame(spark, 1, 2, 3, 4), 3), "mean"), [math.nan, math.nan, 2, 3])
    same(column(series.rolling_mean(frame(spark, 1, 2), 1), "mean"), [1, 2])
    same(column(series.rolling_mean(frame(spark, 1, 2), 5), "mean"), [math.nan] * 2)
    same(column(series.rolling_std(frame(spark, 1, 2), 1), "std"), [math.nan] * 2)


def test_ewma_and_differences(spark):
    same(column(series.ewma(frame(spark, 1, 2, 3), 3), "ewma"), [1, 1.5, 2.25])
    same(column(series.successive_differences(frame(spark, 1, 4, 2), True), "diff"), [3, 2])
    assert series.successive_differences(frame(spark, 1)).count() == 0


def test_discretize(spark):
    d = frame(spark, 0.5, 1, 1.5, 2, math.nan).withColumn("b", series.discretize(F.col("x"), [1.0, 2.0]))
    assert column(d, "b") == [0, 1, 1, 2, 0]


def test_windows(spark):
    got = series.sliding_windows(frame(spark, 1, 2, 3, 4, 5), 3, 2).orderBy("start").collect()
    assert [r.window for r in got] == [[1, 2, 3], [3, 4, 5]]
    d = frame(spark, 0, 0, 0).withColumn("t", F.col("i") * 1.5)
    assert [(r.lo, r.hi) for r in series.time_windows(d, 2.0, 1.0).orderBy("lo", "hi").collect()] == [(0, 2), (1, 2), (2, 3), (2, 3)]


def test_special():
    assert special.gamma(5.0) == pytest.approx(24)
    assert special.beta(2.0, 3.0) == pytest.approx(1 / 12)
    assert special.erf_np(1.0) == pytest.approx(0.8427008, abs=2e-7)
    assert special.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert special.chi2_sf(0.5, 4) == pytest.approx(0.9735, abs=1e-4)


def test_statistics(spark):
    d = frame(spark, 2, 4, 4, 4, 5, 5, 7, 9).agg(statistics.std_sample(F.col("x")).alias("s"), statistics.median(F.col("x")).alias("m")).first()
    assert d.s == pytest.approx(math.sqrt(32 / 7)) and d.m == 4.5
    one = frame(spark, 3).agg(statistics.std_sample(F.col("x")).alias("s"), statistics.mean(F.when(F.lit(False), F.col("x"))).alias("m")).first()
    assert math.isnan(one.s) and math.isnan(one.m)
    c = frame(spark, 1, 1, 1).withColumn("y", F.col("i") * 1.0)
    assert c.agg(statistics.pearson(F.col("x"), F.col("y")).alias("r")).first().r == 0


def test_variability(spark):
    r = statistics.variability(frame(spark, 1, 2, 4)).first()
    assert r.rmssd == pytest.approx(math.sqrt(5 / 2))
    assert math.isnan(statistics.variability(frame(spark, 1, 2)).first().rmssd)


@pytest.mark.parametrize("rows,want", [([(1, 1), (3, 3)], 1), ([(1, 3), (1, 3)], -1), ([(4, 4), (4, 4)], 1), ([(1, 3), (2, 4), (3, 5)], 0)])
def test_icc_11(spark, rows, want):
    d = spark.createDataFrame([(s, k, float(y)) for s, r in enumerate(rows) for k, y in enumerate(r)], "subject int, rater int, y double")
    assert statistics.icc(d).first().icc_11 == pytest.approx(want)


def test_icc_forms(spark):
    d = spark.createDataFrame([(s, k, float(s + k)) for s in range(1, 4) for k in range(3)], "subject int, rater int, y double")
    assert list(statistics.icc(d).first()) == pytest.approx([0.4, 2 / 3, 0.5, 0.75, 1, 1])


def test_information():
    assert dynamics.mutual_information_discrete(np.array([1, 2]), np.array([1])) == 0
    assert dynamics.first_local_minimum([1, 0.5, 0.2, 0.4, 0.3]) == 2
    assert dynamics.first_local_minimum([1, 0.5, 0.2]) is None
    x = np.random.default_rng(0).normal(size=600)
    assert dynamics.cross_ami(x, np.r_[np.zeros(3), x[:-3]], 6).argmax() == 3
    s = np.random.default_rng(1).integers(0, 2, 2000)
    assert dynamics.transfer_entropy_discrete(s, np.r_[0, s[:-1]]) > 0.6 > 0.01 > dynamics.transfer_entropy_discrete(np.r_[0, s[:-1]], s)


def test_entropy_and_recurrence():
    x = np.sin(np.arange(200) / 5)
    assert 0 < dynamics.sample_entropy(x, 2, 0.2 * x.std()) < 0.5
    assert dynamics.sample_entropy(np.ones(50), 2, 0.1) == 0 == dynamics.sample_entropy(x[:3], 2, 0.1)
    r = dynamics.rqa(dynamics.recurrence(dynamics.embed(x, 2, 3), radius=0.2, theiler=1))
    assert r["det"] > 0.9 and 0 < r["rr"] < 1
    assert dynamics.rqa(np.zeros((0, 0), bool))["rr"] == 0


def test_modes_and_sparse_regression():
    a = np.array([[0.9, 0.2], [-0.2, 0.9]])
    x = [np.array([1.0, 0.0])]
    for _ in range(30):
        x.append(a @ x[-1])
    x = np.array(x).T
    fit = dynamics.dmd(x)
    assert sorted(abs(fit["values"])) == pytest.approx(sorted(abs(np.linalg.eigvals(a))))
    assert dynamics.dmd_predict(fit, 31) == pytest.approx(x, abs=1e-8)
    t = np.arange(0, 5, 0.001)
    c = dynamics.sindy(np.exp(-2 * t)[:, None], 0.001, degree=2, threshold=0.1)
    assert c[:, 0] == pytest.approx([0, -2, 0], abs=0.01)
    assert dynamics.pid(np.array([1.0, 1.0]), 1.0, 1, 1, 1) == pytest.approx([2, 3])


def test_outliers_and_fill(spark):
    d = frame(spark, 1, 1.1, 9, 1, 1.05)
    assert column(signal.percent_change_outliers(d, 0.5), "outlier") == [False, False, True, True, False]
    f = signal.linear_fill(frame(spark, 5, 0, 0, 8).withColumn("bad", F.col("i").isin(1, 2)), "bad")
    same(column(f, "filled"), [5, 6, 7, 8])


def test_peaks():
    x = np.zeros(20)
    x[[5, 7, 12]] = 3, 2, 2.5
    assert signal.find_peaks(x, distance=5)[0].tolist() == [5, 12]
    assert signal.find_peaks(np.array([0, 1, 1, 0.0]))[0].tolist() == []
    assert signal.find_peaks(np.zeros(0))[0].tolist() == []


def test_spectra_and_filters():
    fs, t = 100.0, np.arange(1000) / 100
    x = np.sin(2 * np.pi * 5 * t) + np.sin(2 * np.pi * 30 * t)
    f, p = signal.welch(np.sin(2 * np.pi * 5 * t), fs)
    assert f[p.argmax()] == pytest.approx(5, abs=0.4)
    assert statistics.bandpower(f, p, 3, 7) == pytest.approx(0.5, rel=0.05)
    y = signal.bandpass(x, fs, 3, 8)
    assert signal.welch(y, fs)[1][np.abs(f - 30).argmin()] < 0.1 * signal.welch(y, fs)[1][np.abs(f - 5).argmin()]
    assert signal.analytic(np.sin(2 * np.pi * 5 * t), fs)["frequency"][100:900].mean() == pytest.approx(5, rel=0.01)
    assert np.allclose(signal.dct_basis(8).T @ signal.dct_basis(8), np.eye(8))
    with pytest.raises(ValueError):
        signal.bandpass(x, fs, 8, 3)


def test_recovery_and_kalman():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(30, 60))
    a /= np.linalg.norm(a, axis=0)
    x = np.zeros(60)
    x[[3, 40]] = 1, -2
    assert signal.omp(a, a @ x, 2) == pytest.approx(x, abs=1e-8)
    assert np.abs(signal.ista(a, a @ x, 0.01) - x).max() < 0.2
    z = 0.5 * np.arange(200) + rng.normal(0, 0.5, 200)
    run = signal.constant_velocity(z, 1.0, 1e-5, 0.25)
    assert run["x"][-1, 1] == pytest.approx(0.5, abs=0.05)
    one = np.eye(1)
    ekf = signal.extended_kalman(z, lambda v: v, lambda v: v, one, one, np.zeros(1), one)
    ukf = signal.unscented_kalman(z, lambda v: v, lambda v: v, one, one, np.zeros(1), one, alpha=1.0)
    lin = signal.kalman(z, one, one, one, one, np.zeros(1), one)["x"]
    assert np.allclose(ekf, lin, atol=1e-4) and np.allclose(ukf, lin, atol=1e-6)
    smooth = signal.rts_smooth(run, np.array([[1, 1.0], [0, 1]]))
    assert np.abs(smooth[:, 0] - 0.5 * np.arange(200)).mean() <= np.abs(run["x"][:, 0] - 0.5 * np.arange(200)).mean()


def test_load_rules(spark):
    d = spark.createDataFrame([(v,) for v in (0.79, 0.8, 1.3, 1.5, 1.51)], "r double")
    assert [r.c for r in d.select(load.acwr_class(F.col("r")).alias("c")).collect()] == ["Low", "Moderate", "Moderate", "High", "Very High"]
    days = frame(spark, 0, 0, 0).select("series_id", F.col("i").alias("day"), F.col("x").alias("load"))
    assert [r.acwr for r in load.acwr(days).collect()] == [0, 0, 0]
    assert [r.monotony for r in load.monotony_strain(days).collect()] == [1, 1, 1]
    assert load.simulate([42.0])["fitness"][0] == pytest.approx(1)
    assert load.recovery_days((0.0, 0.0), 5.0, 0.0, 3) is None
    steps = load.weight_loss(90, 80, 1.8, 40, True, "moderate", "moderate")
    assert steps.weight.iloc[-1] <= 80 and len(steps) <= 79


def demo_loads(days, base, variation):
    return [max(base + np.sin(k * 0.5) * variation, 50.0) for k in range(days)]


def test_plans_keep_to_their_goals():
    recovery = load.plan([120.0 if k >= 21 else w for k, w in enumerate(demo_loads(28, 60.0, 15.0))], "recovery", 3)
    assert recovery["success"] and 0.20 <= recovery["load_share"] <= 0.55 and max(recovery["loads"]) > 1.0 and recovery["acwr"] is not None
    keep = load.plan(demo_loads(28, 70.0, 10.0), "maintenance", 3)
    c = keep["chronic"]
    assert keep["success"] and 0.85 <= keep["load_share"] <= 1.15 and np.ptp(keep["loads"]) > 0.05 * c
    assert all(0.15 * c - 1 <= w <= 1.5 * c + 1 for w in keep["loads"])
    more = load.plan(demo_loads(28, 55.0, 8.0), "overload", 3)
    assert more["success"] and more["mean_load"] > more["chronic"] and more["load_share"] >= 1.15 and np.ptp(more["loads"]) > 1.0
    assert load.plan(demo_loads(23, 80.0, 5.0) + [150.0] * 7, "recovery", 3)["success"]
    assert all(len(load.plan(demo_loads(28, 60.0, 10.0), g, 10)["loads"]) == 10 and load.plan(demo_loads(28, 60.0, 10.0), g, 10)["success"] for g in load.GOALS)
    for bad in (lambda: load.plan([10.0, 20.0], "maintenance"), lambda: load.plan([50.0] * 28, "recovery", 11), lambda: load.plan([50.0] * 28, "recovery", 0)):
        with pytest.raises(ValueError):
            bad()
    days = np.array([[70.0, 84.0, 98.0], [84.0, 84.0, 84.0]])
    ok, cost = load.rate_plans(days, "overload", 70.0, (60.0, 60.0))
    assert ok.tolist() == [True, True] and cost[1] == pytest.approx(1.1 * 0.05 + 0.45 * 3.5 / 87.5 + 0.2 * 1)


def test_goals_are_suggested_from_readiness(spark):
    rows = [("recovery", 80.0, 115.0, 1.40), ("overload", 70.0, 50.0, 0.90), ("maintenance", 75.0, 80.0, 1.00), ("not overload", 90.0, 70.0, 1.50), ("recovery", 60.0, 95.0, None)]
    d = spark.createDataFrame(rows, "want string, fitness double, fatigue double, acwr double").withColumn("form", F.col("fitness") - F.col("fatigue"))
    for r in load.suggest_goals(d).collect():
        assert r.goal == r.want or (r.want == "not overload" and r.goal != "overload")
        assert 0.15 <= r.confidence <= 1 and min(r.recovery, r.maintenance, r.overload) >= 0


def test_false_neighbors():
    assert np.isnan(dynamics.fnn(np.arange(3.0), 3, 1))
    t = np.arange(400) * 0.2
    assert dynamics.fnn(np.sin(t), 2, 8, 10.0, 1.0, 8) < dynamics.fnn(np.sin(t), 1, 8, 10.0, 1.0, 8)
    rng = np.random.default_rng(1)
    x = rng.normal(size=80)
    for m, tau, theiler in ((1, 1, 0), (2, 2, 3), (3, 1, 1)):
        e, bad = dynamics.embed(x, m + 1, tau), 0
        for i in range(len(e)):
            d = [np.linalg.norm(e[i, :m] - e[j, :m]) if abs(i - j) > theiler else np.inf for j in range(len(e))]
            j = int(np.argmin(d))
            bad += abs(np.linalg.norm(e[i] - e[j]) - d[j]) / d[j] > 1.5 or abs(e[i, m] - e[j, m]) > 1.2
        assert dynamics.fnn(x, m, tau, 1.5, 1.2, theiler) == pytest.approx(bad / len(e))


def test_sparse_measures_equal_dense_ones():
    rng = np.random.default_rng(2)
    for n, theiler in ((0, 0), (1, 1), (2, 0), (60, 0), (60, 1), (90, 3)):
        x = np.round(np.cumsum(rng.normal(size=n)), 1)
        e = dynamics.embed(x, 2, 1)
        if len(e):
            dense = dynamics.rqa(dynamics.recurrence(e, radius=0.9, theiler=theiler))
            assert dynamics.rqa_sparse(e, 0.9, theiler) == pytest.approx(dense)
    x, y = rng.normal(size=120).round(2), rng.normal(size=100).round(2)
    for m, r in ((1, 0.3), (2, 0.5), (3, 1.0)):
        u, v = dynamics.embed(x, m + 1, 1), dynamics.embed(y, m + 1, 1)
        near = lambda a, b, w: (np.abs(a[:, None, :w] - b[None, :, :w]).max(2) <= r)
        pairs = lambda w: np.triu(near(u, u, w), 1).sum()
        assert dynamics.sample_entropy(x, m, r) == pytest.approx(-np.log(pairs(m + 1) / pairs(m)))
        u = u[: len(v)]
        assert dynamics.cross_sample_entropy(x, y, m, r) == pytest.approx(-np.log(near(u, v, m + 1).sum() / near(u, v, m).sum()))


def test_highest_rolling(spark):
    assert load.highest_rolling(frame(spark, 1, 2, 9), 2).first().best == 9
    assert load.highest_rolling(frame(spark, 1, 2, 9), 3).first().best == 4


def test_asof_and_periods(spark):
    left = spark.createDataFrame([("k", 1), ("k", 5), ("k", 9), ("z", 3)], "k string, t int")
    hist = spark.createDataFrame([("k", 2, 5, 200.0), ("k", 6, None, 250.0)], "k string, s int, e int, w double")
    got = {(r.k, r.t): (r.v, r.origin) for r in joins.valid_at(left, hist, "k", "t", "s", "e", "w", 50.0, "v").collect()}
    assert got == {("k", 1): (50, "fallback"), ("k", 5): (50, "fallback"), ("k", 9): (250, "history"), ("z", 3): (50, "fallback")}


def test_sessions(spark):
    rows = [("o", 1, "cycling", 0.0, "2024-01-01", "polar", None, None, 3600.0), ("o", 2, "Cycling", 300.0, "2024-01-01", "srm", None, 200.0, 3600.0), ("o", 3, "running", 100.0, "2024-01-01", "x", None, None, 3600.0)]
    a = spark.createDataFrame(rows, "owner string, id long, sport string, start double, date string, pipeline string, manufacturer string, power double, duration double").withColumn("date", F.to_date("date"))
    got = {r.id: (r.session, r.is_primary) for r in joins.link_sessions(a).collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (3, True)}


def test_upsert(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k int, s string, v double")
    n = spark.createDataFrame([(2, "c", 5.0), (3, "d", None)], "k int, s string, v double")
    assert sorted(map(tuple, joins.upsert(t, n, ["k"], ["s"]).collect())) == [(1, "a", 1.0), (2, "b", 5.0), (3, "d", None)]


def test_vitals(spark):
    d = spark.createDataFrame([(121.0, None), (101.0, None), (None, 93.9), (None, None), (130.0, 99.0), (60.0, 85.0)], "h double, o double")
    assert [r.s for r in d.select(vitals.status(F.col("h"), F.col("o")).alias("s")).collect()] == ["Critical", "Warning", "Warning", "Normal", "Critical", "Critical"]


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("x,y,label\n1,2,a\n3,,b\n")
    d = readers.numeric_table(spark, str(tmp_path / "t.csv"))
    assert d.columns == ["x", "y"] and sorted(map(tuple, d.collect())) == [(1, 2), (3, 0)]
    (tmp_path / "w.txt").write_text("0.5 800\n1.3  810\n")
    assert sorted(map(tuple, readers.numeric_table(spark, str(tmp_path / "w.txt"), None, ["t_s", "rr"]).collect())) == [(0.5, 800), (1.3, 810)]
    (tmp_path / "a.ibi").write_bytes(struct.pack(readers.IBI, 7, 801) + struct.pack(readers.IBI, 9, 802) + b"x")
    assert [(r.timestamp, r.rr_ms) for r in readers.ibi(spark, str(tmp_path / "a.ibi")).orderBy("k").collect()] == [(7, 801), (9, 802)]
    (tmp_path / "tr.csv").write_text("Time,AGENT_ID,x,y,z\n0,1,0,0,9\n1,1,3,4,9\n")
    assert spatial.path(readers.trajectories(spark, str(tmp_path / "tr.csv"))).first().length == 5


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [f'{{"heart_rate": {70 + k}, "spo2": 97, "ts": {k * 50}, "patient_id": "p{k % 2}"}}' for k in range(40)]
    (tmp_path / "in/a.json").write_text("\n".join(lines))
    s = vitals.with_status(vitals.read_lines(spark, str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("vit").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("vit").count() == 40 and spark.table("vit").where("sid = 'p1' and bpm is not null").count() == 20
    q = vitals.smoothed(vitals.read_lines(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("ema").trigger(availableNow=True).start()
    q.awaitTermination(60)
    rows = spark.table("ema").where("sid = 'p0'").orderBy("ts").collect()
    assert rows[0].ema == 70 and rows[1].ema == pytest.approx(70.4)


def test_geometry():
    h = spatial.convex_hull([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5)])
    assert len(h) == 4 and spatial.polygon_area(h) == 1
    assert spatial.markings()["bounds"] == (-52.5, 52.5, -34, 34)
    with pytest.raises(ValueError):
        spatial.markings(80, 60)


def test_degenerate_tracks(spark):
    d = spark.createDataFrame([("s", 0.0, 1, 0.0, 0.0), ("s", 0.0, 1, 1.0, 1.0)], "series_id string, t double, agent_id int, x double, y double")
    assert [r.speed for r in spatial.velocities(d).orderBy("x").collect()] == [None, 0]
    assert spatial.pair_distances(d).count() == 0


def test_models(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": 1 + 2 * x[:, 0] - x[:, 1], "c": (x[:, 0] > 0).astype(int)})
    d = spark.createDataFrame(pdf)
    assert classification.ols(d, ["a", "b"], "y") == pytest.approx([1, 2, -1])
    assert classification.elastic_net(d, ["a", "b"], "y", 10.0)[1:] == pytest.approx([0, 0])
    s = classification.decision_stump(d, ["b", "a"], "c")
    assert s["column"] == "a" and abs(s["threshold"]) < 0.1 and s["left"] == 0
    w = classification.logistic(d, ["a"], "c", rate=1.0, most=30)
    assert w[1] > 1
    assert classification.pca(d, ["a", "b"], 2)["ratio"].sum() == pytest.approx(1)


def test_generators():
    p = biosignals.generate_pulse(20, 50, 60, 0.0)
    assert len(signal.find_peaks(p, height=0.8)[0]) == pytest.approx(20, abs=1)
    v, flow = biosignals.generate_breath(60, 20)
    assert v.min() >= 0 and v.max() <= 1 and len(flow) == len(v)
    t, y = biosignals.cpg(2.0, 0.01)
    assert y.shape[1] == 9 and np.isfinite(y).all()
    t, y = series.rk4(lambda t, y: -y, 0, 1, [1.0], 0.1)
    assert y[-1, 0] == pytest.approx(math.exp(-1), rel=1e-5)
    assert series.golden_section(lambda v: (v - 2) ** 2, 0, 5)["x"] == pytest.approx(2, abs=1e-6)
    assert series.gradient_descent(lambda v: ((v - 1) ** 2).sum(), [0.0, 0.0])["x"] == pytest.approx([1, 1], abs=1e-3)


def test_gait(spark):
    t = np.cumsum([0] + [0.5, 0.6] * 10)
    d = spark.createDataFrame([("a", float(v)) for v in t], "series_id string, t double")
    r = biosignals.gait_measures(d).first()
    assert r.mean_stride == pytest.approx(1.1) and r.cadence == pytest.approx(120 / 1.1) and r.symmetry == pytest.approx(2 * 0.1 / 1.1)


@pytest.mark.parametrize("inclusive", [True, False])
def test_asof_in_ranges_equals_one_window(spark, inclusive):
    rng = np.random.default_rng(5)
    left = [(int(k), "a" if k % 3 else "b", None if k == 7 else int(rng.integers(0, 400))) for k in range(300)]
    right = [("a" if k % 2 else "b", int(rng.integers(0, 400)), int(k)) for k in range(40)] + [("c", 1, 99)]
    l, r = spark.createDataFrame(left, "id long, key string, t long"), spark.createDataFrame(right, "key string, s long, v long")
    got = {x.id: x.v for x in joins.asof(l, r, "key", "t", "s", ["v"], inclusive, merged=20).collect()}
    for i, key, t in left:
        fits = [(s, v) for k, s, v in right if k == key and t is not None and (s <= t if inclusive else s < t)]
        assert got[i] == (max(fits)[1] if fits else None)


def test_sessions_equal_comparing_all_rows(spark):
    import datetime

    rng = np.random.default_rng(6)
    day, rows = datetime.date(2024, 1, 1), []
    for k in range(250):
        d = int(rng.integers(0, 12))
        start = None if d in (3, 4, 9) and rng.random() < 0.3 else float(1704067200 + d * 86400 + rng.integers(0, 86400) // 400 * 400)
        rows.append(("o" if k % 2 else "p", k, rng.choice(["run", "RUN", "ride"]).item(), start, day + datetime.timedelta(days=d), rng.choice(["x", "y"]).item(), None, float(rng.integers(0, 2)), float(rng.integers(1, 5) * 600)))
    a = spark.createDataFrame(rows, "owner string, id long, sport string, start double, date date, pipeline string, manufacturer string, power double, duration double")
    got = {(r.owner, r.id): (r.session, r.is_primary) for r in joins.link_sessions(a).collect()}
    names = ["owner", "id", "sport", "start", "date", "pipeline", "manufacturer", "power", "duration"]
    for owner in "op":
        own = sorted((dict(zip(names, r, strict=True)) for r in rows if r[0] == owner), key=lambda r: (r["start"] or 0, r["date"], r["id"]))
        taken = set()
        for i, seed in enumerate(own):
            if i not in taken:
                group = [i] + [j for j in range(i + 1, len(own)) if j not in taken and joins.sessions_match(seed, own[j])]
                taken.update(group)
                best = max(group, key=lambda j: (joins.primary_score(own[j]), -j))
                for j in group:
                    assert got[owner, own[j]["id"]] == (seed["id"], j == best)


def test_physiology():
    from tidewave.operators import physiology

    t = np.arange(1000) / 100
    x = np.sin(2 * np.pi * t) + 0.5 * np.sin(4 * np.pi * t)
    got = physiology.analyze(x, 100.0, "pulse")
    assert got["duration_s"] == 10 and got["peaks"] == 10 and got["mean_rate"] == pytest.approx(60) and got["sdnn"] == pytest.approx(0, abs=1e-9)
    assert np.diff(physiology.detect(5 * np.sin(2 * np.pi * t), 100.0, "pulse", "high")[1])[-4:].tolist() == [100] * 4
    up, down = physiology.phase_peaks(np.array([0.0, 1, 0, -1, -0.5, -1, 0]))
    assert up.tolist() == [1] and down.tolist() == [4]
    s = physiology.stride_stats([0.0, 1.0, 2.0])
    assert (s["n_strides"], s["mean_length"], s["mean_step"], s["cadence"]) == (2, 1.3, 0.65, 120)
    assert np.isnan(physiology.stride_stats([])["mean_stride"]) and physiology.analyze(np.zeros(0), 10.0, "breath")["peaks"] == 0
    assert physiology.vertical_oscillation(np.array([0.0, 1, 0, 3, 1, 0]), [0.0, 0.3, 0.6], 10.0) == pytest.approx(2.0)
    assert physiology.infer_fs(np.array([0.0, 0.02]), 50.0) == 50 and physiology.infer_fs(np.array([0.0]), 7.0) == 7
    with pytest.raises(ValueError):
        physiology.analyze(x, 4.0, "pulse", "poor")


def test_control_and_sensing():
    from tidewave.operators import control

    rng = np.random.default_rng(3)
    u = rng.normal(size=(400, 1))
    x = [np.array([1.0])]
    for v in u[:-1]:
        x.append(x[-1] + 0.01 * (-2 * x[-1] + 3 * v + 0.5 * x[-1] * v))
    x = np.array(x)
    fit = control.sindyc(x, u, 0.01)
    assert fit["xi"].ravel() == pytest.approx([0, -2, 0, 3, 0.5, 0], abs=1e-6) and control.sparsity(fit) == 3 and fit["error"] < 1e-9
    assert control.sindyc_run(fit, x[0], u[:20], 0.01) == pytest.approx(x[:21])
    a, b, c = control.double_integrator(0.5)
    assert np.allclose(control.closed_loop(a, b, np.array([[1.0, 2.0]])), a - b @ np.array([[1.0, 2.0]]))
    t = np.arange(40) * 0.1
    s = np.stack([np.exp(-t) * np.cos(2 * t), np.exp(-t) * np.sin(2 * t)])
    d = dynamics.dmd(s)
    assert control.dmd_error(d, s) < 1e-9 and control.dmd_at(d, 1.0, 0.1) == pytest.approx(s[:, 10], abs=1e-9)
    with pytest.raises(ValueError):
        control.snapshots([[1.0], [1.0, 2.0]])
    z = 3 + 0.5 * np.arange(100)
    assert control.local_linear_trend(z, 1.0, 1e-6, 1e-6, 0.1)["x"][-1] == pytest.approx([z[-1], 0.5], abs=0.01)
    f, h, one = np.eye(1), np.eye(1), np.eye(1)
    moved = control.kalman_with_inputs(np.full(5, np.nan), np.ones(5), f, h, one, one, one, np.zeros(1), one)
    assert moved.ravel().tolist() == [1, 2, 3, 4, 5]
    phi = control.gaussian_sensing(20, 40, 7)
    assert np.linalg.norm(phi, axis=0) == pytest.approx(np.ones(40)) and (phi == control.gaussian_sensing(20, 40, 7)).all()
    y, m = control.sensed(control.row_selection(4, [2, 0]), np.array([1.0, 2, 3, 4]), signal.dct_basis(4))
    assert y.tolist() == [3, 1] and m.shape == (2, 4) and control.restored(np.eye(4)[0], signal.dct_basis(4)) == pytest.approx(signal.dct_basis(4)[:, 0])
    assert control.decibels(np.array([1.0, 10, 0])).tolist() == [0, 20, -120]


def test_equal_steps_are_no_acceleration(spark):
    v = [9.53, 13.48, 49.44, 53.39]
    rows = [("a", float(k), 1, v[k], v[k + 1]) for k in range(3)] + [("a", float(k), 2, x, 0.0) for k, x in enumerate((0.0, 1.0, 3.0))]
    d = spark.createDataFrame(rows, "series_id string, t double, agent_id long, x double, y double")
    assert spatial.accelerations(d).where("agent_id = 1 and t = 2").first().accel == 0
    assert [(r.together, r.against) for r in spatial.effort_phase(d).collect()] == [(0, 0)]
    assert {(r.together, r.against) for r in spatial.effort_phase(d, 3.0).collect()} == {(0, 0)}


def test_bearing_of_a_mean_at_the_same_height(spark):
    d = spark.createDataFrame([("a", 0.0, 1, 3.0, 0.2), ("a", 0.0, 2, 3.0, 0.1)], "series_id string, t double, agent_id long, x double, y double")
    focal = spark.createDataFrame([("a", 0.0, 2.0, 0.6 / 3 * (1 - 2**-53))], "series_id string, t double, fx double, fy double")
    b = {r.agent_id: r.bearing for r in spatial.focal_context(d, focal).collect()}
    assert b[1] == math.pi and b[2] == pytest.approx(math.pi - math.atan(0.1))
