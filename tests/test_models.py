"""Iterated models against direct computation in numpy."""

import math

import numpy as np
import pytest

from quillstat.operators import models


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 300
    x, g = rng.normal(size=n), rng.integers(0, 12, n)
    y = 1 + x + rng.normal(size=12)[g] + 0.7 * rng.normal(size=n)
    k = (y > 1).astype(int) + (y > 2.2)
    t, e = np.exp(1 + 0.5 * x + 0.6 * np.log(rng.exponential(size=n))), (rng.random(n) < 0.8).astype(int)
    rows = [(float(a), float(b), int(c), "abc"[d], float(u), int(v), int(a > 1)) for a, b, c, d, u, v in zip(y, x, g, k, t, e)]
    return spark.createDataFrame(rows, "y double, x double, g int, k string, t double, e int, z int"), x, g, y, k, t, e


def slope(f, b):
    h = 1e-5
    return np.array([(f(b + h * u) - f(b - h * u)) / (2 * h) for u in np.eye(len(b))])


def test_multinomial(data):
    df, x, _, _, k, _, _ = data
    fit = models.multinomial_regression(df, "k ~ x")
    m = np.c_[np.ones_like(x), x]

    def ll(b):
        z = np.c_[np.zeros(len(x)), m @ b.reshape(2, 2).T]
        return (z[np.arange(len(x)), k] - np.log(np.exp(z).sum(1))).sum()

    assert fit.loglik == pytest.approx(ll(fit.coef)) and np.abs(slope(ll, fit.coef)).max() < 1e-3


def test_ordinal(data):
    df, x, _, _, k, _, _ = data
    fit = models.ordinal_regression(df, "k ~ x")

    def ll(b):
        cuts, f = np.r_[-np.inf, b[1:], np.inf], lambda z: 1 / (1 + np.exp(-z))
        return np.log(f(cuts[k + 1] - b[0] * x) - f(cuts[k] - b[0] * x)).sum()

    assert fit.names == ["x", "a|b", "b|c"] and fit.loglik == pytest.approx(ll(fit.coef)) and np.abs(slope(ll, fit.coef)).max() < 1e-3


@pytest.mark.parametrize("dist", ["weibull", "exponential", "lognormal"])
def test_survival_times(data, dist):
    df, x, _, _, _, t, e = data
    fit = models.accelerated_failure(df, "t", "e", "x", dist)

    def ll(b):
        s = b[2] if dist != "exponential" else 0.0
        z = (np.log(t) - b[0] - b[1] * x) / math.exp(s)
        if dist == "lognormal":
            f, surv = -z * z / 2 - 0.5 * math.log(2 * math.pi), np.log([0.5 * math.erfc(v / math.sqrt(2)) for v in z])
        else:
            f, surv = z - np.exp(z), -np.exp(z)
        return (e * (f - s - np.log(t)) + (1 - e) * surv).sum()

    assert fit.loglik == pytest.approx(ll(fit.coef)) and np.abs(slope(ll, fit.coef)).max() < 1e-2


def test_firth_under_separation(spark):
    df = spark.createDataFrame([(0, -2.0), (0, -1.0), (0, -0.5), (1, 0.5), (1, 1.0), (1, 2.0)], "y int, x double")
    fit = models.fit_firth(df, "y ~ x")
    m, y = np.array([[1, v] for v in (-2, -1, -0.5, 0.5, 1, 2)]), np.array([0, 0, 0, 1, 1, 1])

    def ll(b):
        p = 1 / (1 + np.exp(-m @ b))
        return (y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + 0.5 * np.linalg.slogdet((m.T * p * (1 - p)) @ m)[1]

    assert np.isfinite(fit.coef).all() and np.abs(slope(ll, fit.coef)).max() < 1e-4


def test_elastic_net(data):
    df, x, g, y, _, _, _ = data
    fit = models.elastic_net(df, "y ~ x + g", [0.5, 0.05], alpha=0.7)
    z = np.c_[x, g].astype(float)
    sd = z.std(0)
    for lam, b in fit.items():
        r = y - b[0] - z @ b[1:]
        for j in range(2):  # the optimality conditions on the standardised scale
            beta = b[1 + j] * sd[j]
            score = ((z[:, j] - z[:, j].mean()) / sd[j] * r).mean() - lam * 0.3 * beta
            assert abs(score - lam * 0.7 * np.sign(beta)) < 1e-6 if beta else abs(score) <= lam * 0.7 + 1e-6


def test_random_intercept(data):
    df, x, g, y, _, _, _ = data
    fit = models.random_intercept(df, "y ~ x", "g")
    m, n = np.c_[np.ones_like(x), x], len(x)
    same = (g[:, None] == g[None, :]).astype(float)

    def ll(b):
        v = math.exp(b[0]) * np.eye(n) + math.exp(b[1]) * same
        i = np.linalg.inv(v)
        beta = np.linalg.solve(m.T @ i @ m, m.T @ i @ y)
        r = y - m @ beta
        return -0.5 * (np.linalg.slogdet(v)[1] + np.linalg.slogdet(m.T @ i @ m)[1] + r @ i @ r + (n - 2) * math.log(2 * math.pi))

    at = np.log([fit["sigma2"], fit["tau2"]])
    assert fit["loglik"] == pytest.approx(ll(at), rel=1e-8) and np.abs(slope(ll, at)).max() < 1e-2


def test_risk_ratio(data):
    df = data[0]
    fit, cov = models.fit_risk_ratio(df, "z ~ x")
    assert fit.coef[1] > 0 and 0 < cov[1, 1] < fit.cov[1, 1]
