"""As-of joins in very many ranges, and percentiles by selection, against plain readings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import statistics
from tidewave.plans import joins, selection


def plain_asof(left, right, inclusive=True):
    out = {}
    for k, t, i in left:
        best = [(h, v) for kk, h, v in right if kk == k and (h <= t if inclusive else h < t)]
        out[i] = max(best)[1] if best else None
    return out


@pytest.mark.parametrize("merged", [100, 300, 750])
def test_asof_in_the_first_frames_of_a_session(spark, merged):
    r = random.Random(merged)
    left = [(r.choice("ab"), r.randrange(4000), i) for i in range(1500)]
    right = [(r.choice("ab"), r.randrange(4000), r.random()) for _ in range(60)]
    for columns, order in (("k string, t int, id int", (0, 1, 2)), ("t int, id int, k string", (1, 2, 0)), ("id int, k string, t int", (2, 0, 1))):
        l = spark.createDataFrame([tuple(x[c] for c in order) for x in left], columns)
        h = spark.createDataFrame(right, "k string, ht int, v double")
        got = {x.id: x.v for x in joins.asof(l, h, "k", "t", "ht", ["v"], merged=merged).collect()}
        assert got == plain_asof(left, right)


@pytest.mark.parametrize("inclusive", [True, False])
def test_asof_in_ten_thousand_ranges_with_stray_times(spark, inclusive):
    r = random.Random(4)
    left = [(r.choice("ab"), r.choice([-(10**12), 10**12, *[r.randrange(10**6)] * 200]), i) for i in range(10_000)]
    right = [(r.choice("abc"), r.randrange(-5, 10**6), float(j)) for j in range(200)] + [("a", -(10**13), -1.0)]
    l, h = spark.createDataFrame(left, "k string, t long, id int"), spark.createDataFrame(right, "k string, ht long, v double")
    got = {x.id: x.v for x in joins.asof(l, h, "k", "t", "ht", ["v"], inclusive, merged=1).collect()}
    assert got == plain_asof(left, right, inclusive)


def test_asof_of_one_time_and_of_dates(spark):
    l = spark.createDataFrame([("a", "2024-01-05", i) for i in range(50)] + [("a", None, 99)], "k string, d string, id int").withColumn("d", F.col("d").cast("date"))
    h = spark.createDataFrame([("a", "2024-01-05", 1.0), ("a", "2024-01-05", 2.0), ("a", None, 9.0)], "k string, s string, v double").withColumn("s", F.col("s").cast("date"))
    got = {x.id: x.v for x in joins.asof(l, h, "k", "d", "s", ["v"], merged=5).collect()}
    assert got == {i: 2.0 for i in range(50)} | {99: None}


def test_percentiles_equal_numpy_in_small_and_large_groups(spark, monkeypatch):
    rng = np.random.default_rng(2)
    groups = {"one": [3.5], "two": [1.0, 2.0], "ties": [5.0] * 400 + [7.0] * 3, "few": rng.normal(size=11).tolist(), "many": np.round(rng.normal(size=30_000) ** 3, 3).tolist(), "skew": [0.0] * 14_000 + rng.exponential(size=12_345).tolist(), None: [1.0, 4.0, 9.0]}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    shares = {"lo": 0.0, "p1": 0.01, "p25": 0.25, "mid": 0.5, "p90": 0.9, "hi": 1.0}
    got = {r.g: r for r in selection.percentiles(df, ["g"], "x", shares).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert [got[g][n] for n in shares] == pytest.approx([np.quantile(v, p) for p in shares.values()], rel=1e-12, abs=1e-12)
    # with a rough sketch bands are wide, and the result is the same
    monkeypatch.setattr(selection, "ACCURACY", 50)
    again = {r.g: r for r in selection.percentiles(df, ["g"], "x", shares).collect()}
    assert again == got
    mad = {r.g: r.mad for r in statistics.mad(df.where("g is not null"), "g", "x").collect()}
    assert mad == pytest.approx({g: np.median(np.abs(np.array(v) - np.median(v))) for g, v in groups.items() if g})


def test_no_task_holds_a_group(spark):
    """What reaches the sorted window of a large group is a small share of its values."""
    df = spark.range(400_000).select(F.lit("g").alias("g"), F.rand(3).alias("x")).cache()
    plan = selection.percentiles(df, ["g"], "x", {"m": 0.5})
    assert plan.first().m == df.agg(F.percentile("x", 0.5)).first()[0]
    edges = df.agg(F.percentile_approx("x", [0.5 - selection.MARGIN / selection.ACCURACY, 0.5 + selection.MARGIN / selection.ACCURACY], selection.ACCURACY)).first()[0]
    assert df.where((F.col("x") >= edges[0]) & (F.col("x") <= edges[1])).count() < 400_000 * 12 / selection.ACCURACY
