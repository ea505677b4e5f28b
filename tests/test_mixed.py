"""Mixed models against dense matrices."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewave.operators import mixed, models


def dense(pdf, x, z, y, gamma, reml):
    """(deviance, beta, sigma2, effects by group) with the whole covariance matrix of all rows."""
    n, g = len(pdf), pdf.grp.to_numpy()
    one = np.ones((n, 1))
    big_x, big_z = np.hstack([one, pdf[x].to_numpy()]), np.hstack([one, pdf[z].to_numpy()])
    v = np.eye(n) + (big_z @ gamma @ big_z.T) * (g[:, None] == g[None, :])
    vi = np.linalg.inv(v)
    a, t = big_x.T @ vi @ big_x, pdf[y].to_numpy()
    beta = np.linalg.solve(a, big_x.T @ vi @ t)
    r = t - big_x @ beta
    free = n - len(beta) if reml else n
    s2 = r @ vi @ r / free
    effects = {k: gamma @ big_z[g == k].T @ (vi @ r)[g == k] for k in np.unique(g)}
    return np.linalg.slogdet(v)[1] + free * np.log(s2) + (np.linalg.slogdet(a)[1] if reml else 0), beta, s2, effects


@pytest.mark.parametrize(("structure", "z", "reml"), [("unstructured", ["t"], True), ("diagonal", ["t"], False), ("diagonal", [], True)])
def test_equals_the_dense_solver_at_its_optimum(spark, structure, z, reml):
    pdf = models.growth_data(25, 7, seed=5)
    rng = np.random.default_rng(1)
    pdf = pdf.drop(index=rng.choice(len(pdf), 40, replace=False)).assign(u=lambda d: rng.normal(size=len(d)))
    d = spark.createDataFrame(pdf).repartition(3)
    fit = mixed.lmer(d, "grp", ["t", "u"], z, "y", reml, structure)
    assert fit["converged"] and fit["n"] == len(pdf) and fit["n_groups"] == pdf.grp.nunique()
    gamma = fit["covariance"] / fit["sigma2"]
    if structure == "diagonal":
        assert (gamma == np.diag(np.diag(gamma))).all()
    deviance, beta, s2, effects = dense(pdf, ["t", "u"], z, "y", gamma, reml)
    assert fit["deviance"] == pytest.approx(deviance, rel=1e-9) and fit["sigma2"] == pytest.approx(s2) and fit["beta"] == pytest.approx(beta)
    got = {r.grp: r.effects for r in fit["ranef"].collect()}
    assert set(got) == set(effects) and all(got[k] == pytest.approx(e, abs=1e-8) for k, e in effects.items())
    # no covariance nearby or at the other starts is better
    l = mixed.factor(fit["theta"], len(z) + 1, structure)
    assert np.allclose(l @ l.T, gamma)
    for _ in range(60):
        other = mixed.factor(fit["theta"] + rng.normal(size=len(fit["theta"])) * rng.choice([0.01, 0.3, 2]), len(z) + 1, structure)
        assert dense(pdf, ["t", "u"], z, "y", other @ other.T, reml)[0] >= deviance - 1e-7


def test_no_random_effects_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    x -= x.mean()
    # all groups have the same mean: less than by chance, so the variance between is none
    y = np.tile([1.0, -1.0], 100)
    pdf = pd.DataFrame({"grp": np.repeat(np.arange(100), 2), "t": x, "y": y})
    fit = mixed.lmer(spark.createDataFrame(pdf), "grp", ["t"], [], "y")
    assert fit["covariance"][0, 0] < 1e-5 and fit["sigma2"] == pytest.approx(np.sum((y - np.poly1d(np.polyfit(x, y, 1))(x)) ** 2) / 198, rel=1e-4)
    d = spark.createDataFrame([(1, 1.0, 2.0), (1, None, 3.0), (None, 1.0, 1.0), (2, 2.0, 5.0), (2, 3.0, 6.5), (1, 0.0, 1.0), (7, 1.0, 2.5)], "grp long, t double, y double")
    fit = mixed.lmer(d, "grp", ["t"], [], "y")
    assert fit["n"] == 5 and fit["n_groups"] == 3
    p = mixed.lmer_predict(spark.createDataFrame([(1, 1.0), (99, 1.0), (None, 1.0)], "grp long, t double"), fit, "grp", ["t"], []).collect()
    assert len(p) == 3 and {r.grp: r.predicted for r in p}[99] == pytest.approx(fit["beta"].sum())
    with pytest.raises(ValueError):
        mixed.lmer(d.where("t is null"), "grp", ["t"], [], "y")


def test_recovers_growth_and_predicts(spark):
    d = spark.createDataFrame(models.growth_data(60, 8, seed=3))
    fit = mixed.lmer(d, "grp", ["t"], ["t"], "y")
    assert fit["beta"] == pytest.approx([1, 0.5], abs=0.35)
    assert fit["sigma2"] == pytest.approx(0.25, rel=0.25) and fit["covariance"][0, 0] == pytest.approx(1, rel=0.5)
    both = mixed.lmer_predict(mixed.lmer_predict(d, fit, "grp", ["t"], ["t"]), fit, "grp", ["t"], ["t"], "population", conditional=False)
    e = both.agg(F.avg(F.pow(F.col("y") - F.col("predicted"), 2)).alias("m"), F.avg(F.pow(F.col("y") - F.col("population"), 2)).alias("p")).first()
    assert e.m < 0.3 < e.p
