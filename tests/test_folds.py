"""Folds against fitting each split by itself."""

import numpy as np
import pandas as pd
import pytest

from tidewave.operators import folds, models


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    n = 240
    pdf = pd.DataFrame({"a": rng.normal(5, 3, n), "b": rng.normal(0, 0.1, n), "c": np.ones(n)})
    pdf["y"] = 2 * pdf.a - 30 * pdf.b + rng.normal(size=n)
    pdf["u"] = (pdf.a + rng.normal(0, 2, n) > 5).astype(int)
    pdf["part"] = np.where(np.arange(n) % 4 == 3, "test", "train")
    pdf["fold"] = np.where(pdf.part == "train", rng.integers(0, 3, n), np.nan)
    return pdf


def sets(pdf):
    train, test = pdf[pdf.part == "train"], pdf[pdf.part == "test"]
    yield "full", None, pdf, pdf
    yield "train", None, train, train
    yield "test", None, train, test
    for f in range(3):
        yield "fold", f, train[train.fold != f], train[train.fold == f]


def frame(spark, pdf, y):
    rows = [(*r[:-1], None if np.isnan(r[-1]) else int(r[-1])) for r in pdf[["a", "b", "c", y, "part", "fold"]].itertuples(index=False)]
    return spark.createDataFrame([(float(a), float(b), float(c), float(v), p, f) for a, b, c, v, p, f in rows], f"a double, b double, c double, {y} double, part string, fold int").repartition(3)


@pytest.mark.parametrize("alpha", [0.0, 25.0])
def test_linear_folds(spark, rows, alpha):
    extra = spark.createDataFrame([(None, 1.0, 1.0, 1.0, "train", 0), (1.0, 1.0, 1.0, 1.0, None, 0)], "a double, b double, c double, y double, part string, fold int")
    got = {(r.split, r.fold): r for r in folds.linear_folds(frame(spark, rows, "y").union(extra), ["a", "b", "c"], "y", alpha).collect()}
    assert len(got) == 6
    for name, f, fit, val in sets(rows):
        x = fit[["a", "b"]].to_numpy()
        m, s = x.mean(0), x.std(0)
        z = (x - m) / s
        w = np.linalg.solve(z.T @ z + alpha * np.eye(2), z.T @ (fit.y - fit.y.mean()))
        e = val.y - fit.y.mean() - (val[["a", "b"]].to_numpy() - m) / s @ w
        r = got[name, f]
        assert (r.n_fit, r.n) == (len(fit), len(val)) and r.coefficients[1:3] == pytest.approx(w / s, rel=1e-6) and r.coefficients[3] == pytest.approx(0, abs=1e-6)
        assert (r.mse, r.bias, r.r2) == pytest.approx(((e**2).mean(), e.mean(), 1 - (e**2).sum() / ((val.y - val.y.mean()) ** 2).sum()), abs=1e-9)
    assert folds.linear_folds(extra.where("false"), ["a"], "y").count() == 0
    one = folds.linear_folds(frame(spark, rows.assign(fold=rows.fold * 0), "y"), ["a"], "y").collect()
    assert [r.split for r in one] == ["full", "train", "test"]


def test_logistic_folds(spark, rows):
    got = {(r.split, r.fold): r for r in folds.logistic_folds(frame(spark, rows, "u"), ["a", "b", "c"], "u", rate=0.5, most=25, tol=1e-3, l2=0.01).collect()}
    assert len(got) == 6
    for name, f, fit, val in sets(rows):
        x = fit[["a", "b"]].to_numpy()
        m, s = x.mean(0), x.std(0)
        z, w = np.c_[np.ones(len(x)), (x - m) / s], np.zeros(3)
        for _ in range(25):
            g = z.T @ (1 / (1 + np.exp(-z @ w)) - fit.u) / len(z) + 0.01 * np.r_[0, w[1:]]
            w = w - 0.5 * g
            if np.abs(0.5 * g).max() < 1e-3:
                break
        p = 1 / (1 + np.exp(-(w[0] + (val[["a", "b"]].to_numpy() - m) / s @ w[1:])))
        r = got[name, f]
        assert r.coefficients[1:3] == pytest.approx(w[1:] / s, abs=1e-9)
        assert (r.accuracy, r.log_loss) == pytest.approx((((p >= 0.5) == val.u).mean(), -np.where(val.u == 1, np.log(p), np.log(1 - p)).mean()))
    assert folds.logistic_folds(frame(spark, rows, "u").where("false"), ["a"], "u").count() == 0


def test_folds_of_the_splitter(spark, rows):
    d = spark.createDataFrame(rows[["a", "b", "y"]])
    got = folds.linear_folds(models.train_test_split(d, ["a"], 0.3, folds=4), ["a", "b"], "y").collect()
    assert [r.split for r in got].count("fold") == 4 and all(r.r2 > 0.9 for r in got)
