"""Elastic-net paths against their optimality conditions and a loop over folds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstat.operators.penalized import descend, deviances, penalized_path


def sample(rng, family, n=220):
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in range(5)]
        x[4] = 3.0  # no spread
        eta = 0.4 + 0.9 * x[0] - 0.5 * x[1]
        if family == "gaussian":
            y = eta + rng.gauss(0, 1)
        elif family == "poisson":
            y = float(np.random.default_rng(rng.randrange(10**9)).poisson(math.exp(eta)))
        else:
            y = float(rng.random() < 1 / (1 + math.exp(-eta)))
        rows.append((i, y, *x))
    return rows


COLUMNS = "id long, y double, a double, b double, c double, d double, e double"
X = ["a", "b", "c", "d", "e"]


def test_descent_is_optimal():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(40, 6))
    h, g = a.T @ a / 40, rng.normal(size=6)
    b = descend(h, g, np.zeros(6), 0.3, 0.1)
    slope = g - h @ b
    assert abs(slope[0]) < 1e-6
    for j in range(1, 6):
        assert abs(slope[j] - 0.1 * b[j] - 0.3 * np.sign(b[j])) < 1e-5 if b[j] else abs(slope[j]) <= 0.3 + 1e-6


@pytest.mark.parametrize(("family", "alpha"), [("gaussian", 1.0), ("binomial", 0.6), ("poisson", 1.0)])
def test_path_and_folds(spark, family, alpha):
    rows = sample(random.Random(3), family)
    df = spark.createDataFrame([*rows, (999, None, *[0.0] * 5)], COLUMNS).repartition(3)
    fit = penalized_path(df, "y", X, "id", family=family, alpha=alpha, n_lambda=6, ratio=0.01, folds=3, seed=4)
    x, y = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows])
    sd = x.std(0)
    link = {"gaussian": lambda e: e, "poisson": np.exp, "binomial": lambda e: 1 / (1 + np.exp(-e))}[family]

    def slopes(beta, keep):
        r = (y - link(beta[0] + x @ beta[1:]))[keep]
        return r.mean(), (x[keep] - x.mean(0)).T @ r / keep.sum() / np.where(sd > 0, sd, 1)

    every = np.ones(len(y), bool)
    assert np.abs(fit.coefficients[0, 1:]).max() < 1e-6
    for lam, beta in zip(fit.lambdas, fit.coefficients, strict=True):
        mean, g = slopes(beta, every)
        assert abs(mean) < 1e-5 and beta[5] == 0
        for j in range(4):
            b = beta[1 + j] * sd[j]
            assert abs(g[j] - lam * (1 - alpha) * b - lam * alpha * np.sign(b)) < 1e-4 if b else abs(g[j]) <= lam * alpha + 1e-4
    assert fit.deviance == pytest.approx([deviances(family, y, link(b[0] + x @ b[1:])).mean() for b in fit.coefficients])
    assert (np.diff(fit.deviance) < 1e-9).all() and 0 <= fit.best("1se") <= fit.best() < 6
    # each fold left out by hand
    fold = np.array([r["f"] for r in df.where("y is not null").orderBy("id").select(F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(3)).alias("f")).collect()])
    z = np.column_stack([np.ones(len(y)), (x - x.mean(0)) / np.where(sd > 0, sd, 1)])
    total = np.zeros(6)
    for k in range(3):
        kept = fold != k
        for i, lam in enumerate(fit.lambdas):
            beta = np.zeros(6)
            for _ in range(60):
                mu = link(z[kept] @ beta)
                w = {"gaussian": np.ones(len(mu)), "poisson": mu, "binomial": mu * (1 - mu)}[family]
                beta = descend((z[kept] * w[:, None]).T @ z[kept] / kept.sum() + 1e-12 * np.eye(6), z[kept].T @ (y[kept] - mu) / kept.sum(), beta, lam * alpha, lam * (1 - alpha))
            total[i] += deviances(family, y[~kept], link(z[~kept] @ beta)).sum()
    assert fit.cv_mean == pytest.approx(total / len(y), rel=1e-4)
    seen = {r["id"]: r["fit"] for r in fit.predict(df, 5).where("y is not null").collect()}
    assert [seen[i] for i in range(len(y))] == pytest.approx(list(link(fit.coefficients[5, 0] + x @ fit.coefficients[5, 1:])))


def test_wrong_calls(spark):
    df = spark.createDataFrame(sample(random.Random(1), "gaussian", 20), COLUMNS)
    for wrong in ({"family": "gamma"}, {"alpha": 0.0}, {"folds": 1}):
        with pytest.raises(ValueError):
            penalized_path(df, "y", X, "id", **wrong)
    with pytest.raises(ValueError):
        penalized_path(df.where("false"), "y", X, "id")
    with pytest.raises(ValueError):
        penalized_path(df, "y", X, "id", folds=0, n_lambda=2).best()
