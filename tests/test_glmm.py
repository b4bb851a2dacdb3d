"""Random-intercept models against dense integration."""

import math
import random

import numpy as np
import pytest

from quillstat.operators.glmm import fit_glmm, nodes


def sample(rng, family, groups=25):
    rows = []
    for g in range(groups):
        u = rng.gauss(0, 0.8)
        for _ in range(rng.randrange(2, 14)):
            x, o = rng.gauss(0, 1), rng.choice([0.0, 0.5])
            eta = 0.3 + 0.7 * x + o + u
            if family == "poisson":
                y = int(np.random.default_rng(rng.randrange(10**9)).poisson(math.exp(eta - 0.5)))
                rows.append((f"g{g}", float(y), x, o, 1))
            else:
                n = rng.choice([1, 1, 3])
                rows.append((f"g{g}", float(sum(rng.random() < 1 / (1 + math.exp(-eta)) for _ in range(n))), x, o, n))
    return rows


COLUMNS = "g string, y double, x double, o double, n int"


def loglik(rows, family, y, n, eta):
    if family == "poisson":
        return y * eta - np.exp(eta) - np.array([math.lgamma(v + 1) for v in y])
    return y * eta - n * np.logaddexp(0, eta) + np.array([math.lgamma(b + 1) - math.lgamma(a + 1) - math.lgamma(b - a + 1) for a, b in zip(y, n, strict=True)])


def dense(rows, family, point, agq):
    """Laplace (agq 1) or quadrature of every group by loops."""
    beta, var, total = point[:-1], math.exp(2 * point[-1]), 0.0
    z, lw = nodes(max(agq, 2))
    for g in {r[0] for r in rows}:
        y, x, o, n = (np.array([r[k] for r in rows if r[0] == g]) for k in (1, 2, 3, 4))
        base = beta[0] + beta[1] * x + o
        u = 0.0
        for _ in range(100):
            mu = np.exp(base + u) if family == "poisson" else n / (1 + np.exp(-base - u))
            w = mu.sum() if family == "poisson" else (mu * (1 - mu / n)).sum()
            u += max(-1.0, min(1.0, ((y - mu).sum() - u / var) / (w + 1 / var)))
        h = w + 1 / var
        f = lambda v: loglik(rows, family, y, n, base + v).sum() - v * v / (2 * var) - 0.5 * math.log(2 * math.pi * var)  # noqa: B023, E731
        if agq == 1:
            total += f(u) + 0.5 * math.log(2 * math.pi) - 0.5 * math.log(h)
        else:
            s = math.sqrt(2 / h)
            t = np.array([f(u + s * a) for a in z]) + lw
            total += t.max() + math.log(np.exp(t - t.max()).sum()) + math.log(s)
    return total


@pytest.mark.parametrize(("family", "agq"), [("binomial", 1), ("poisson", 1), ("binomial", 9)])
def test_the_fit_is_the_maximum_of_the_integral(spark, family, agq):
    rows = sample(random.Random(agq), family)
    df = spark.createDataFrame([*rows, (None, 1.0, 0.0, 0.0, 1)], COLUMNS).repartition(3)
    fit = fit_glmm(df, "y", ["x"], "g", family=family, n_agq=agq, offset="o", trials="n" if family == "binomial" else None)
    assert fit.n == len(rows) and fit.n_groups == 25
    point = np.append(fit.coefficients, math.log(fit.sd))
    assert fit.loglik == pytest.approx(dense(rows, family, point, agq), abs=1e-6)
    steps = np.eye(3) * 1e-4
    slopes = [(dense(rows, family, point + s, agq) - dense(rows, family, point - s, agq)) / 2e-4 for s in steps]
    info = np.array([[-(dense(rows, family, point + a + b, agq) - dense(rows, family, point + a - b, agq) - dense(rows, family, point - a + b, agq) + dense(rows, family, point - a - b, agq)) / 4e-8 for a in steps] for b in steps])
    v = np.linalg.inv(info)
    # within a thousandth of a standard error of where the slope is 0
    assert np.abs(v @ slopes / np.sqrt(np.diag(v))).max() < 5e-3
    assert np.sqrt(np.diag(fit.covariance)) == pytest.approx(np.sqrt(np.diag(v))[:2], rel=0.02) and fit.sd_error == pytest.approx(math.sqrt(v[2, 2]), rel=0.05)
    assert fit.modes.count() == 25 and fit.median_odds_ratio() > 1 and fit.aic() == pytest.approx(6 - 2 * fit.loglik)


def test_wrong_calls(spark):
    df = spark.createDataFrame(sample(random.Random(1), "binomial", 3), COLUMNS)
    for wrong in ({"family": "gamma"}, {"n_agq": 0}):
        with pytest.raises(ValueError):
            fit_glmm(df, "y", ["x"], "g", **wrong)
    with pytest.raises(ValueError):
        fit_glmm(df.where("false"), "y", ["x"], "g")
