import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewave.functions import timezones
from tidewave.operators import control, models, statistics


def test_splits(spark):
    assert sorted(models.shuffled(50, 42)) == list(range(50)) and models.shuffled(50, 42) == models.shuffled(50, 42)
    d = spark.range(103)
    s = models.train_test_split(d, ["id"], 0.2, folds=4).groupBy("part", "fold").count().collect()
    assert sorted((r.part, r.fold, r["count"]) for r in s) == [("test", None, 21), ("train", 0, 21), ("train", 1, 21), ("train", 2, 20), ("train", 3, 20)]
    with pytest.raises(ValueError):
        models.split_sizes(30, 0.05)
    g = models.grouped_split(d.withColumn("g", F.col("id") % 7), "g", 0.3).groupBy("g").agg(F.countDistinct("part").alias("n")).collect()
    assert {r.n for r in g} == {1}


def test_splits_of_many_rows_are_exact_and_hang_on_the_seed(spark):
    n = 250_010
    rows = spark.range(n).withColumn("same", F.lit(1))
    split = lambda seed, parts: models.train_test_split(rows.repartition(parts), ["id"], 0.2, seed, folds=3)
    sizes = {(r.part, r.fold): r["count"] for r in split(42, 3).groupBy("part", "fold").count().collect()}
    assert sizes == {("test", None): 50_002, ("train", 0): 66_670, ("train", 1): 66_669, ("train", 2): 66_669}
    tested = lambda seed, parts: split(seed, parts).where("part = 'test'").agg(F.sum("id")).first()[0]
    assert tested(42, 3) == tested(42, 5) != tested(43, 3)
    tied = models.train_test_split(rows.limit(100), ["same"], 0.2)
    assert sorted(r["count"] for r in tied.groupBy("part").count().collect()) == [20, 80]
    twice = models.repeated_train_test_split(rows.limit(100), ["id"], 0.2, 2).groupBy("repeat", "part").count().collect()
    assert sorted(r["count"] for r in twice) == [20, 20, 80, 80]


def test_polynomials(spark):
    x = np.linspace(3, 9, 80)
    d = spark.createDataFrame(pd.DataFrame({"x": x, "y": 2 - x + 0.5 * x**2 + np.random.default_rng(0).normal(0, 0.1, 80)}))
    fits = models.polynomial_search(d, "x", "y", 4)
    assert min(fits, key=lambda f: f["bic"])["degree"] == 2
    assert fits[2]["coefficients"] == pytest.approx([2, -1, 0.5], abs=0.5)
    t = models.nested_test(80, fits[1]["rss"], 2, fits[2]["rss"], 3)
    assert t["p"] < 1e-6 and t["f"] > 100


def test_nonlinear_and_svd():
    x = np.linspace(0, 4, 60)
    fit = models.nonlinear_least_squares(lambda x, p: p[0] * np.exp(-p[1] * x), x, 3 * np.exp(-0.7 * x), [1.0, 1.0])
    assert fit["p"] == pytest.approx([3, 0.7], abs=1e-4)
    a = np.outer([1, 2, 3.0], [1, 1.0])
    assert models.svd(a)["rank"] == 1


def test_policies(spark):
    d = spark.createDataFrame([(1.0, 5, 0.9), (3.0, 5, 0.9), (9.0, 5, 0.9), (9.0, 2, 0.9), (9.0, 5, None), (None, 5, 1.0)], "score double, n int, q double")
    p = {"warning": 2.0, "critical": 5.0, "mean": 1.0, "sd": 1.0, "window_n": 3, "min_quality": 0.5}
    got = models.evaluate(d, p, n="n", quality="q").collect()
    assert [r.flag for r in got] == ["normal", "warning", "critical", None, None, None]
    assert got[0].percentile == pytest.approx(50, abs=1e-4)


def test_discretizer_and_multiclass(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": np.repeat([0, 1], 300), "x": np.r_[rng.choice([0, 5, 10], 300), rng.choice([100, 150, 200], 300)] * 1.0})
    assert models.relative_discretizer(spark.createDataFrame(pdf), "g", "x", 3) == pytest.approx([0.25, 0.75], abs=0.02)
    pdf = pd.DataFrame({"a": np.r_[rng.normal(-3, 1, 60), rng.normal(0, 1, 60), rng.normal(3, 1, 60)], "c": np.repeat(["x", "y", "z"], 60)})
    d = spark.createDataFrame(pdf)
    fit = models.one_vs_rest(d, ["a"], "c", rate=1.0, most=15)
    assert models.one_vs_rest_predict(d, fit, ["a"]).where("predicted = c").count() > 100


def test_time_zones(spark):
    d = spark.sql("select timestamp_ntz'2017-08-14 08:20:00' as l union all select timestamp_ntz'2017-01-14 08:20:00' union all select timestamp_ntz'2017-03-12 02:00:00' union all select timestamp_ntz'2017-03-12 01:59:59'")
    got = d.select("l", timezones.offset_hours(F.col("l"), "US/Eastern").alias("e"), timezones.offset_hours(F.col("l"), "EST").alias("s"), timezones.local_to_unix(F.col("l"), "US/Eastern").alias("u")).collect()
    assert [r.e for r in got] == [-4, -5, -4, -5] and {r.s for r in got} == {-5}
    utc = datetime.datetime(2017, 8, 14, 12, 20, tzinfo=datetime.UTC).timestamp()
    assert got[0].u == utc
    back = spark.createDataFrame([(int(utc),)], "u long").select(timezones.unix_to_local(F.col("u"), "US/Eastern").alias("l")).first().l
    assert str(back) == "2017-08-14 08:20:00"


def test_linear_systems(spark):
    s = control.LinearSystem(np.array([[0.5, 0.0], [0.0, 0.8]]), np.eye(2))
    x, y = s.step(np.array([2.0, 1.0]))
    assert x.tolist() == [1.0, 0.8] and y.tolist() == [2.0, 1.0]
    a, b, c = control.double_integrator(0.1)
    plant = control.LinearSystem(a, c, b, np.array([[2.0]]))
    xs, ys = plant.simulate(np.zeros(2), [1.0, 1.0, None])
    assert xs[2] == pytest.approx([0.02, 0.2]) and ys[:, 0] == pytest.approx([2.0, 2.005, 0.02]) and len(xs) == 4
    xs, _ = plant.feedback(np.array([[10.0, 5.0]])).simulate(np.array([1.0, 0.0]), [0.0] * 200)
    assert np.abs(xs[-1]).max() < 1e-3
    assert plant.simulate(np.zeros(2), [])[1].shape == (0, 1)
    for bad in (lambda: control.LinearSystem(a, np.eye(3)), lambda: control.LinearSystem(a, c, None, np.eye(1)), lambda: s.feedback(np.eye(2))):
        with pytest.raises(ValueError):
            bad()


def test_density_on_the_count_scale(spark):
    rng = np.random.default_rng(0)
    d = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(rng.normal(size=500))] + [(2, 0, 3.0), (2, 1, 3.0), (3, 0, None)], "series_id long, i long, x double")
    got = statistics.kde_counts(d, 10).toPandas()
    one = got[got.series_id == 1].sort_values("at")
    assert np.trapezoid(one["count"], one["at"]) == pytest.approx(500 * (one["at"].max() - one["at"].min()) / 1.1 / 10, rel=0.08)
    assert (got[got.series_id == 2]["count"] == got[got.series_id == 2].density).all() and set(got.series_id) == {1, 2}
