"""Fine-Gray regression and Gray's test against known answers and brute force."""

import math
import random

import numpy as np
import pytest

from quillstat.operators.competing import fine_gray_regression, fine_gray_rows, gray_test
from quillstat.operators.cox import fit_cox

CR = [(1.0, 1, "a", 0.3), (2.0, 1, "a", -0.6), (2.0, 2, "a", 1.2), (2.0, 0, "a", 0.0), (3.0, 2, "a", -1.1), (4.0, 1, "a", 0.8), (4.0, 2, "a", 0.5), (4.0, 0, "a", -0.3), (5.0, 1, "a", 1.4), (6.0, 0, "a", -0.9), (1.5, 1, "b", 0.6), (2.0, 1, "b", -0.2), (2.0, 0, "b", 1.0), (3.5, 1, "b", -1.4), (4.0, 1, "b", 0.2), (4.0, 0, "b", 0.7), (5.5, 0, "b", -0.5), (7.0, 1, "b", 0.1)]


def test_known_regression(spark):
    df = spark.createDataFrame([(*r, int(r[2] == "b")) for r in CR] + [(None, 1, "a", 0.0, 0)], "time double, cause int, arm string, x double, armb int")
    fit = fine_gray_regression(df, "time", "cause", ["x", "armb"])
    assert fit.coefficients == pytest.approx([0.0936697507645626, 0.545268213121164], rel=1e-5)
    assert np.sqrt(np.diag(fit.covariance)) == pytest.approx([0.371626661779351, 0.619864897568598], rel=1e-5)
    assert fit.loglik[1] == pytest.approx(-20.5742855514419, rel=1e-7)
    assert fit.n == 18 and fit.n_events == 9 and 0 < fit.tidy()[0]["p_value"] < 1 and fit.glance()["df"] == 2
    seen = {(r["x"], r["at"]): r["cif"] for r in fit.predict(df.limit(1), [0.5, 3.0, 9.0]).collect()}
    cif = [seen[0.3, t] for t in (0.5, 3.0, 9.0)]
    assert cif[0] == 0.0 < cif[1] < cif[2] < 1


def test_known_gray(spark):
    got = gray_test(spark.createDataFrame(CR, "time double, cause int, arm string, x double"), "time", "cause", "arm")
    assert [r["statistic"] for r in got] == pytest.approx([0.271769388111328, 2.64868859140566], rel=1e-8)
    assert [r["p_value"] for r in got] == pytest.approx([0.602147314003575, 0.103635359760754], rel=1e-8) and [r["df"] for r in got] == [1, 1]


def sample(rng, n=80):
    return [(i, float(rng.randrange(1, 13)), rng.choice([0, 1, 1, 2, 3]), rng.choice("abc"), rng.choice("pq"), rng.gauss(0, 1), float(rng.randrange(2))) for i in range(n)]


COLUMNS = "id long, time double, cause int, arm string, site string, x double, z double"


def before(rows, u):
    """The censoring curve just before u."""
    g = 1.0
    for c in sorted({r[1] for r in rows if r[2] == 0 and r[1] < u}):
        g *= 1 - sum(r[1] == c and r[2] == 0 for r in rows) / sum(r[1] >= c for r in rows)
    return g


def test_regression_is_the_maximum_of_weighted_risk_sets(spark):
    rows = sample(random.Random(2))
    fit = fine_gray_regression(spark.createDataFrame(rows, COLUMNS).repartition(3), "time", "cause", ["x", "z"], censor_group="site")
    x = np.array([r[5:7] for r in rows])
    own = {s: [r for r in rows if r[4] == s] for s in "pq"}
    last = {s: max(r[1] for r in v) for s, v in own.items()}

    def at(beta):
        ll, u = 0.0, np.zeros(2)
        for i, r in enumerate(rows):
            if r[2] == 1:
                w = np.array([1.0 if q[1] >= r[1] else before(own[q[4]], r[1]) / before(own[q[4]], q[1]) * (r[1] <= last[q[4]]) if q[2] > 1 else 0.0 for q in rows])
                risk = w * np.exp(x @ beta)
                ll += x[i] @ beta - math.log(risk.sum())
                u += x[i] - risk @ x / risk.sum()
        return ll, u

    ll, u = at(fit.coefficients)
    assert np.abs(u).max() < 1e-6 and fit.loglik == pytest.approx((at(np.zeros(2))[0], ll))


def test_expanded_rows(spark):
    rows = sample(random.Random(4))
    df = spark.createDataFrame(rows, COLUMNS)
    got = {}
    for r in fine_gray_rows(df, "time", "cause").collect():
        got.setdefault(r["id"], []).append((r["fgstart"], r["fgstop"], r["fgstatus"], r["fgwt"]))
    falls, hits, end = sorted({r[1] for r in rows if r[2] == 0}), {r[1] for r in rows if r[2] == 1}, max(r[1] for r in rows)
    edges = falls + ([end] if falls[-1] < end else [])

    def curve(u, after):
        g = 1.0
        for c in falls:
            if c < u or (after and c == u):
                n = sum(r[1] > c or (r[1] == c and r[2] == 0) for r in rows)
                g *= 1 - sum(r[1] == c and r[2] == 0 for r in rows) / n
        return g

    for i, t, c, *_ in rows:
        if c < 2:
            assert got[i] == [(0.0, t, float(c), 1.0)]
            continue
        k = next(k for k, e in enumerate(edges) if e >= t)
        want = [(0.0, edges[k], 0.0, 1.0)] + [(lo, hi, 0.0, curve(lo, True) / curve(t, False)) for lo, hi in zip(edges[k:], edges[k + 1 :], strict=False) if any(lo < h <= hi for h in hits)]
        assert sorted(got[i]) == [pytest.approx(w) for w in want]
    # the weighted rows give a Cox model near the regression, whose curve has failures at risk at ties
    fit = fit_cox(fine_gray_rows(df, "time", "cause"), "fgstop", "fgstatus", ["x", "z"], entry="fgstart", weight="fgwt", ties="breslow")
    direct = fine_gray_regression(df, "time", "cause", ["x", "z"])
    assert fit.coefficients == pytest.approx(direct.coefficients, abs=0.1)


def test_gray_in_strata_adds_scores(spark):
    rows = sample(random.Random(6))
    df = spark.createDataFrame(rows, COLUMNS)
    whole = gray_test(df, "time", "cause", "arm", strata="site", causes=[1])[0]
    doubled = gray_test(df.unionByName(df.replace({"p": "p2", "q": "q2"}, subset=["site"])), "time", "cause", "arm", strata="site", causes=[1])[0]
    assert whole["df"] == 2 and doubled["statistic"] == pytest.approx(2 * whole["statistic"])
    flipped = gray_test(df.replace({"a": "z"}, subset=["arm"]), "time", "cause", "arm", strata="site", causes=[1])[0]
    assert flipped["statistic"] == pytest.approx(whole["statistic"])
    assert gray_test(df.where("arm = 'a'"), "time", "cause", "arm", causes=[1])[0]["p_value"] == 1.0


def test_no_events(spark):
    with pytest.raises(ValueError):
        fine_gray_regression(spark.createDataFrame(CR, "time double, cause int, arm string, x double").where("cause = 0"), "time", "cause", ["x"])
