"""Bootstrap covariance and optimism against loops in numpy."""

import random

import numpy as np
import pytest

from quillstat.operators.validation import bootstrap, replicate_weights, validate


def sample(rng, n=250):
    rows = []
    for i in range(n):
        x, g = rng.gauss(0, 1), rng.choice("ab")
        y = 1 + 0.8 * x + (g == "b") + rng.gauss(0, 1)
        rows.append((i, y, int(y > 1.3), x, g, i % 20))
    return rows


COLUMNS = "id long, y double, b int, x double, g string, c int"


def weights_of(df, unit, b, seed):
    from pyspark.sql import functions as F

    keys = {r["id"]: r["k"] for r in df.select("id", F.xxhash64(F.lit(seed), F.col(unit)).alias("k")).collect()}
    order = sorted(keys)
    return np.array([replicate_weights(np.array([keys[i] for i in order], np.int64), k) for k in range(b)])


def logistic(x, y, w):
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        mu = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (w * mu * (1 - mu))[:, None]).T @ x, x.T @ (w * (y - mu)))
    return beta


def test_weights():
    w = np.array([replicate_weights(np.arange(5000, dtype=np.int64), k) for k in range(20)])
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.03)
    assert np.abs(np.corrcoef(w) - np.eye(20)).max() < 0.08


@pytest.mark.parametrize("family", ["gaussian", "binomial"])
def test_replicates_are_weighted_fits(spark, family):
    rows = sample(random.Random(1))
    df = spark.createDataFrame([*rows, (999, None, None, 1.0, "a", 1)], COLUMNS)
    out = "y" if family == "gaussian" else "b"
    one, seven = (bootstrap(df.repartition(n), f"{out} ~ x + g", "id", family=family, b=12, seed=3) for n in (1, 7))
    assert one.replicates == pytest.approx(seven.replicates, abs=1e-7) and one.names == ["(Intercept)", "x", "gb"]
    x = np.column_stack([np.ones(len(rows)), [r[3] for r in rows], [r[4] == "b" for r in rows]]).astype(float)
    y = np.array([r[1 if family == "gaussian" else 2] for r in rows], float)
    for k, w in enumerate(weights_of(df.where("id < 999"), "id", 12, 3)):
        want = np.linalg.solve((x * w[:, None]).T @ x, x.T @ (w * y)) if family == "gaussian" else logistic(x, y, w)
        assert one.replicates[k] == pytest.approx(want, abs=1e-6)
    assert one.covariance.shape == (3, 3) and (one.limits()[:, 0] < one.limits()[:, 1]).all()
    clusters = bootstrap(df, f"{out} ~ x", "c", family=family, b=5, seed=3)
    w = weights_of(df.where("id < 999"), "c", 5, 3)
    assert all(len({w[0][i] for i, r in enumerate(rows) if r[5] == c}) == 1 for c in range(20)) and clusters.replicates.shape == (5, 2)


@pytest.mark.parametrize("family", ["gaussian", "binomial"])
def test_optimism_is_that_of_a_loop(spark, family):
    rows = sample(random.Random(2), 120)
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    got = {r["index"]: r for r in validate(df, f"{'y' if family == 'gaussian' else 'b'} ~ x + g", "id", family=family, b=10, seed=5)}
    x = np.column_stack([np.ones(120), [r[3] for r in rows], [r[4] == "b" for r in rows]]).astype(float)
    y = np.array([r[1 if family == "gaussian" else 2] for r in rows], float)
    fit = (lambda x, y, w: np.linalg.solve((x * w[:, None]).T @ x, x.T @ (w * y))) if family == "gaussian" else logistic
    link = (lambda e: e) if family == "gaussian" else (lambda e: 1 / (1 + np.exp(-e)))
    error, slopes, training = [], [], []
    for w in weights_of(df, "id", 10, 5):
        beta = fit(x, y, w)
        rest = (y - link(x @ beta)) ** 2
        training.append(w @ rest / w.sum())
        error.append(rest.mean())
        slopes.append(fit(np.column_stack([np.ones(120), x @ beta]), y, np.ones(120))[1])
    name = "mse" if family == "gaussian" else "brier"
    assert got[name]["training"] == pytest.approx(np.mean(training)) and got[name]["test"] == pytest.approx(np.mean(error))
    assert got["slope"]["test"] == pytest.approx(np.mean(slopes)) and got["slope"]["corrected"] == pytest.approx(np.mean(slopes))
    original = ((y - link(x @ fit(x, y, np.ones(120)))) ** 2).mean()
    assert got[name]["corrected"] == pytest.approx(original - np.mean(training) + np.mean(error))


def test_wrong_calls(spark):
    df = spark.createDataFrame(sample(random.Random(1), 20), COLUMNS)
    for wrong in ({"b": 1}, {"family": "poisson"}):
        with pytest.raises(ValueError):
            bootstrap(df, "y ~ x", "id", **wrong)
