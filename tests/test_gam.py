"""Additive models against dense algebra."""

import math
import random

import numpy as np
import pytest

from quillstat.operators.gam import fit_gam, roughness
from quillstat.operators.splines import Spline


def sample(rng, n=400, family="gaussian"):
    rows = []
    for _ in range(n):
        x, z, v = rng.random(), rng.gauss(0, 1), rng.random()
        eta = math.sin(6 * x) + 0.5 * z + 0.2 * v
        if family == "gaussian":
            y = eta + rng.gauss(0, 0.4)
        elif family == "poisson":
            y = float(np.random.default_rng(rng.randrange(10**9)).poisson(math.exp(eta)))
        else:
            y = float(rng.random() < 1 / (1 + math.exp(-eta)))
        rows.append((y, x, z, v))
    return rows


def matrix(fit, rows):
    m = np.array(rows)
    return np.column_stack([np.ones(len(m)), m[:, 2], fit.smooths[0].matrix(m[:, 1]), fit.smooths[1].matrix(m[:, 3])])


def penalty(fit, p, rho):
    s = np.zeros((p, p))
    for r, t, at in zip(rho, fit.smooths, fit.places, strict=True):
        s[at, at] = math.exp(r) * t.penalty
    return s


def test_roughness():
    s = Spline("bs", (1.0, 2.0, 2.5), (0.0, 4.0), intercept=True)
    x = np.linspace(0, 4, 400_001)
    second = np.gradient(np.gradient(s.evaluate(x), x, axis=0), x, axis=0)
    want = (second[:-1, :, None] * second[:-1, None, :]).sum(0) * (x[1] - x[0])
    assert np.abs(roughness(s) - want).max() < 2e-3 * np.abs(want).max()


def test_gaussian_fit_is_that_of_dense_algebra(spark):
    rows = sample(random.Random(1))
    df = spark.createDataFrame([*rows, (None, 0.1, 0.1, 0.1)], "y double, x double, z double, v double").repartition(3)
    fit = fit_gam(df, "y", {"x": 10, "v": 6}, ["z"])
    m, y = matrix(fit, rows), np.array(rows)[:, 0]
    p, n = m.shape[1], len(rows)
    assert np.abs(m[:, 2:].sum(0)).max() < 1e-8 and fit.n == n

    def reml(rho):
        s = penalty(fit, p, rho)
        a = m.T @ m + s
        beta = np.linalg.solve(a, m.T @ y)
        rest = ((y - m @ beta) ** 2).sum() + beta @ s @ beta
        ranks = [np.linalg.matrix_rank(t.penalty, tol=1e-9 * np.abs(t.penalty).max()) for t in fit.smooths]
        free = n - (p - sum(ranks))
        return (free * math.log(rest / free) + np.linalg.slogdet(a)[1] - sum(r * k for r, k in zip(rho, ranks, strict=True))) / 2, beta, a

    value, beta, a = reml(fit.log_lambda)
    assert fit.coefficients == pytest.approx(beta, abs=1e-7) and fit.reml == pytest.approx(value, abs=1e-6)
    share = np.diag(np.linalg.solve(a, m.T @ m))
    assert [fit.edf["x"], fit.edf["v"], fit.total_edf] == pytest.approx([share[fit.places[0]].sum(), share[fit.places[1]].sum(), share.sum()])
    assert fit.scale == pytest.approx(((y - m @ beta) ** 2).sum() / (n - share.sum())) and fit.covariance == pytest.approx(np.linalg.inv(a) * fit.scale, abs=1e-8)
    for k in range(2):  # no smoothing parameter does better
        for step in (-0.05, 0.05, -1, 1):
            rho = fit.log_lambda.copy()
            rho[k] += step
            assert reml(rho)[0] >= value - 1e-6
    assert 3 < fit.edf["x"] < 9 and fit.edf["v"] < 3
    seen = {r["x"]: r["fit"] for r in fit.predict(df).where("y is not null").collect()}
    assert [seen[r[1]] for r in rows] == pytest.approx(list(m @ beta), abs=1e-9)
    effect, error = fit.smooth_at("x", np.array([0.25, 0.8]))
    assert effect[0] > 0.5 > effect[1] and (error > 0).all()
    tests = fit.tests()
    assert tests[0]["p_value"] < 1e-6


@pytest.mark.parametrize("family", ["poisson", "binomial"])
def test_other_families_solve_the_penalised_score(spark, family):
    rows = sample(random.Random(2), family=family)
    fit = fit_gam(spark.createDataFrame(rows, "y double, x double, z double, v double"), "y", {"x": 8, "v": 5}, ["z"], family=family)
    m, y = matrix(fit, rows), np.array(rows)[:, 0]
    eta = m @ fit.coefficients
    mu = np.exp(eta) if family == "poisson" else 1 / (1 + np.exp(-eta))
    score = m.T @ (y - mu) - penalty(fit, m.shape[1], fit.log_lambda) @ fit.coefficients
    assert np.abs(score).max() < 1e-2 and fit.coefficients[1] == pytest.approx(0.5, abs=0.3) and fit.scale == 1.0


def test_wrong_calls(spark):
    df = spark.createDataFrame(sample(random.Random(1), 20), "y double, x double, z double, v double")
    for wrong in ({"smooths": {"x": 3}}, {"smooths": {"x": 8}, "family": "gamma"}, {"smooths": {}}):
        with pytest.raises(ValueError):
            fit_gam(df, "y", **wrong)
