"""Every registered query of the library runs, and equals its SQL where it has one."""

import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidewave import registry, registry_spatial
from tidewave.operators import classification

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype(str)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: v if v is None or isinstance(v, (bool, int, float, str)) else str(v)[:10] if "00:00:00" in str(v) else str(v))
        elif df[c].dtype.kind in "iuf":
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, data, duck):
    got = registry.QUERIES[name](spark, data).toPandas()
    assert len(got)
    if name in registry.SQL:
        want = duck.execute(registry.SQL[name]).df()
        for c in want.columns:
            if str(want[c].dtype).startswith("datetime"):
                want[c] = want[c].dt.strftime("%Y-%m-%d")
                got[c] = got[c].astype(str)
        pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False, rtol=1e-6, atol=1e-6)
    else:
        for c in got.columns:
            if got[c].dtype.kind == "f":
                assert np.isfinite(got[c].dropna()).any() or got[c].isna().all()


def test_space_actions_take_all_events(spark, data):
    e = spark.read.parquet(f"{data}/events.parquet")
    got = registry.QUERIES["space_actions"](spark, data)
    assert got.count() == e.count() - e.select("user_id").distinct().count()
    assert got.agg({"agent_id": "max"}).first() == e.agg({"user_id": "max"}).first()


def test_space_actions_take_users_and_frames_without_bound(spark):
    rows = [(100 * u + k, u, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=k), float((7 * u + 3 * k) % 11)) for u in (3, 59, 60, 61, 200) for k in range(60)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double")
    got = registry_spatial.space_actions(lambda name: {"events": e}[name]).collect()
    assert sorted((r.agent_id, r.t) for r in got) == [(u, float(k)) for u in (3, 59, 60, 61, 200) for k in range(59)]


def test_logistic_regression_goes_on_to_the_tolerance(spark):
    # x = 2 or -2 after scaling, so the optimum is known; at step 20 a fifth of the way is left
    labels = spark.createDataFrame([(k, int(k % 10 < (6 if k < 10 else 4))) for k in range(20)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(k, 6000 if k < 10 else -2000) for k in range(20)], "doc_id long, n_chars int")
    a, b = registry.logistic_regression(lambda name: {"labels": labels, "documents": docs}[name]).first()
    assert abs(a) < 1e-9 and b == pytest.approx(np.log(1.5) / 2, abs=2e-5)


def test_kmeans_clusters_go_on_to_the_tolerance(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (900, 4))
    d = spark.createDataFrame([(v.tolist(),) for v in x], "embedding array<double>")
    c, sizes = classification.kmeans(d, "embedding", 4, most=0), []
    while len(sizes) < 100:
        at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        sizes.append(sorted(np.bincount(at, minlength=4).tolist()))
        new = np.stack([x[at == k].mean(0) for k in range(4)])
        if np.sqrt(((new - c) ** 2).sum(1)).max() < 1e-6:
            break
        c = new
    assert 11 < len(sizes) < 100 and sizes[10] != sizes[-1]
    got = registry.kmeans_clusters(lambda name: {"embeddings": d}[name]).collect()
    assert sorted(r.n for r in got) == sizes[-1]
