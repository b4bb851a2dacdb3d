"""Conditional trees and exact conditional logistic regression against brute force."""

import itertools
import math
import random

import numpy as np
import pytest

from quillstat.functions.dist import chi2_sf
from quillstat.operators import tree as tree_module
from quillstat.operators.clogit import choices, conditional_logit
from quillstat.operators.tree import conditional_tree


def sample(rng, n=260):
    rows = []
    for _ in range(n):
        x, z, g, b = float(rng.randrange(12)), rng.random(), rng.choice("abcd"), rng.random() < 0.5
        rows.append((2.0 * (x > 5) + (1.5 if g in "bd" else 0) * (x <= 5) + rng.gauss(0, 0.7), x, z, g, b))
    return rows


def grow(rows, depth=0):
    """(n, mean, column, split, left, right) by loops over rows and breaks."""
    y = np.array([r[0] for r in rows])
    n, out = len(rows), {"n": len(rows), "mean": y.mean(), "split": None}
    if n < 20:
        return out
    ss, found = ((y - y.mean()) ** 2).sum(), []
    for k, name in ((1, "x"), (2, "z"), (3, "g"), (4, "b")):
        v = [str(r[k]).lower() if k > 2 else r[k] for r in rows]
        if len(set(v)) > 1:
            if k > 2:
                stat, df = (n - 1) * sum(sum(v_ == q for v_ in v) * (y[[v_ == q for v_ in v]].mean() - y.mean()) ** 2 for q in set(v)) / ss, len(set(v)) - 1
            else:
                a = np.array(v) - np.mean(v)
                stat, df = (n - 1) * (a @ (y - y.mean())) ** 2 / ((a @ a) * ss), 1
            found.append((name, v, stat, df))
    ranked = sorted(((1 - (1 - chi2_sf(s, df)) ** len(found), name, v) for name, v, s, df in found), key=lambda t: t[0])
    out["tests"] = {name: (s, 1 - (1 - chi2_sf(s, df)) ** len(found)) for name, v, s, df in found}
    for p, name, v in [r for r in ranked if r[0] < 0.05][:2]:
        best = None
        if name in "gb":
            levels = sorted(set(v))
            options = [(c, [q in c for q in v]) for m in range(1, len(levels)) for c in itertools.combinations(levels, m) if levels[0] in c]
        else:
            options = [(c, [q <= c for q in v]) for c in sorted(set(v))[:-1]]
        for c, left in options:
            m = sum(left)
            if min(m, n - m) >= max(7, math.ceil(0.01 * n)):
                stat = (y[left].sum() - m * y.mean()) ** 2 / (m * (n - m))
                if best is None or stat > best[0] * (1 + 1e-9):
                    best = (stat, c, left)
        if best:
            out |= {"split": (name, best[1]), "left": grow([r for r, s in zip(rows, best[2], strict=True) if s]), "right": grow([r for r, s in zip(rows, best[2], strict=True) if not s])}
            return out
    return out


def same(node, want):
    assert (node.n, node.mean) == (want["n"], pytest.approx(want["mean"]))
    for name, (stat, p) in want.get("tests", {}).items():
        assert node.tests[name] == (pytest.approx(stat), pytest.approx(p, abs=1e-12))
    if want["split"] is None:
        assert node.column is None
        return
    name, at = want["split"]
    assert node.column == name and (node.levels[0] == tuple(at) if name in "gb" else node.at == at)
    same(node.left, want["left"])
    same(node.right, want["right"])


@pytest.mark.parametrize("partitions", [12, 2])
def test_tree_is_that_of_brute_force(spark, monkeypatch, partitions):
    monkeypatch.setattr(tree_module, "ALL_PARTITIONS", partitions)
    rows = sample(random.Random(3))
    df = spark.createDataFrame([*rows, (None, 1.0, 0.1, "a", True), (1.0, math.nan, 0.1, "a", True)], "y double, x double, z double, g string, b boolean").repartition(3)
    tree = conditional_tree(df, "y", ["x", "z", "g", "b"])
    same(tree.root, grow(rows))
    assert tree.n_terminal() >= 3 and tree.format().count("n = ") == tree.n_terminal() and {r["term"] for r in tree.tests()} == {"x", "z", "g", "b"}
    means = {round(r["fit"], 9) if r["fit"] is not None else None for r in tree.predict(df).collect()}
    assert None in means and len(means) == tree.n_terminal() + 1


def test_a_tree_without_splits(spark):
    df = spark.createDataFrame([(1.0, float(i % 3)) for i in range(40)], "y double, x double")
    assert conditional_tree(df, "y", ["x"]).n_terminal() == 1
    with pytest.raises(ValueError):
        conditional_tree(df, "y", [])


def test_choices_are_sums_over_subsets():
    rng = np.random.default_rng(1)
    sizes = np.array([5, 3, 7])
    x, eta = rng.normal(size=(15, 2)), rng.normal(size=15) * 3
    log, mean, var = choices(x, eta, sizes, 2)
    at = 0
    for s, n in enumerate(sizes):
        sums = np.array([[eta[at + a] + eta[at + b], *(x[at + a] + x[at + b])] for a, b in itertools.combinations(range(n), 2)])
        w = np.exp(sums[:, 0])
        m = w @ sums[:, 1:] / w.sum()
        assert log[s] == pytest.approx(np.log(w.sum())) and mean[s] == pytest.approx(m)
        assert var[s] == pytest.approx((sums[:, 1:] - m).T @ ((sums[:, 1:] - m) * w[:, None]) / w.sum())
        at += n
    big = choices(np.zeros((3000, 1)), np.zeros(3000), np.array([3000]), 1500)[0][0]
    assert big == pytest.approx(math.lgamma(3001) - 2 * math.lgamma(1501))


def test_exact_conditional_logit(spark):
    rng = random.Random(2)
    rows = [(f"s{k}", int(rng.random() < 0.4), rng.gauss(0, 1), float(rng.randrange(2)), rng.uniform(-0.2, 0.2)) for k in range(40) for _ in range(rng.randrange(1, 7))]
    df = spark.createDataFrame([*rows, (None, 1, 0.0, 0.0, 0.0), ("s1", None, 0.0, 0.0, 0.0)], "g string, y int, x double, z double, o double").repartition(3)
    fit = conditional_logit(df, "y", ["x", "z"], "g", offset="o")

    def at(beta):
        ll, u = 0.0, np.zeros(2)
        for g in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == g]
            k = sum(r[1] for r in own)
            x = np.array([r[2:4] for r in own])
            eta = x @ beta + np.array([r[4] for r in own])
            picks = [list(c) for c in itertools.combinations(range(len(own)), k)]
            w = np.array([math.exp(eta[c].sum()) for c in picks])
            seen = [i for i, r in enumerate(own) if r[1]]
            ll += eta[seen].sum() - math.log(w.sum())
            u += x[seen].sum(0) - w @ np.array([x[c].sum(0) for c in picks]) / w.sum()
        return ll, u

    ll, u = at(fit.coefficients)
    assert np.abs(u).max() < 1e-6 and fit.loglik == pytest.approx((at(np.zeros(2))[0], ll))
    h = 1e-5
    info = -np.array([(at(fit.coefficients + h * e)[1] - at(fit.coefficients - h * e)[1]) / (2 * h) for e in np.eye(2)])
    assert fit.covariance == pytest.approx(np.linalg.inv(info), rel=1e-4) and len(fit.tidy()) == 2
    with pytest.raises(ValueError):
        conditional_logit(df.where("y = 0"), "y", ["x"], "g")
