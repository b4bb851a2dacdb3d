"""Cox regression, its residuals and concordance against known answers and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstat.operators.cox import concordance, fit_cox
from quillstat.plans import dominance as dominance_module
from quillstat.plans.dominance import after_below, dominance

TIES = [(3.0, 1, 0.5, 1), (3.0, 1, -1.2, 0), (3.0, 1, 1.8, 1), (3.0, 1, 0.3, 1), (3.0, 0, -0.4, 0), (3.0, 0, 0.9, 0), (5.0, 0, -1.5, 1), (1.0, 0, 0.1, 0), (3.0, 1, 1.1, 1), (4.0, 0, -0.7, 0)]
ENTRY = [(0.0, 2.0, 1, 0.2, 0), (0.0, 3.0, 1, -0.5, 1), (1.0, 3.0, 0, 1.1, 0), (2.0, 4.0, 1, 0.7, 1), (2.0, 6.0, 1, -1.3, 0), (3.0, 5.0, 1, 0.4, 1), (0.0, 1.0, 1, 0.9, 0), (4.0, 7.0, 0, -0.2, 1), (1.5, 4.0, 1, 1.6, 0), (9.0, 10.0, 0, 0.0, 1), (0.0, 8.0, 1, -0.8, 1), (2.5, 3.0, 1, 0.3, 0)]


@pytest.mark.parametrize(
    ("ties", "coefficients", "errors", "loglik", "score"),
    [
        ("efron", [0.3686173532464, 1.36397569018746], [0.431515783795201, 1.16018288103898], [-9.62377364973352, -8.06731498613876], 3.11820393981791),
        ("breslow", [0.214176138350146, 0.981940166820503], [0.46092099817412, 1.19135391576461], [-10.9861228866811, -10.2122232325114], 1.46213157274228),
    ],
)
def test_ties(spark, ties, coefficients, errors, loglik, score):
    fit = fit_cox(spark.createDataFrame(TIES, "time double, status int, x double, g int"), "time", "status", ["x", "g"], ties=ties)
    assert fit.coefficients == pytest.approx(coefficients, rel=1e-6) and np.sqrt(np.diag(fit.covariance)) == pytest.approx(errors, rel=1e-5)
    assert fit.loglik == pytest.approx(loglik, rel=1e-8) and fit.score_test == pytest.approx(score, rel=1e-7) and fit.n_events == 5
    assert fit.tests()["score"][0] == pytest.approx(score, rel=1e-7)


@pytest.mark.parametrize(
    ("ties", "coefficients", "errors", "loglik"),
    [("efron", [0.417515809861381, -0.648826364008705], [0.420424525127823, 0.808239600392519], [-12.2140408151794, -11.1643373428695]), ("breslow", [0.377057002849066, -0.629586885382754], [0.423451260908676, 0.80517407043761], [-12.5913350463208, -11.658048443902])],
)
def test_delayed_entry(spark, ties, coefficients, errors, loglik):
    fit = fit_cox(spark.createDataFrame(ENTRY, "entry double, time double, status int, x double, armb int"), "time", "status", ["x", "armb"], ties=ties, entry="entry")
    assert fit.coefficients == pytest.approx(coefficients, rel=1e-6) and np.sqrt(np.diag(fit.covariance)) == pytest.approx(errors, rel=1e-5) and fit.loglik == pytest.approx(loglik, rel=1e-8)


def sample(rng, n=60):
    """(id, stratum, entry, time, status, weight, offset, cluster, x, z)"""
    out = []
    for i in range(n):
        entry = rng.choice([0.0, 0.0, 1.0, 2.0])
        out.append((i, rng.choice("ab"), entry, entry + rng.randrange(1, 9), int(rng.random() < 0.6), rng.choice([1.0, 2.0, 0.5]), rng.uniform(-0.3, 0.3), i % 11, rng.gauss(0, 1), float(rng.randrange(3))))
    return out


COLUMNS = "id long, s string, entry double, time double, status int, w double, o double, c int, x double, z double"


def dense(rows, beta, ties):
    """Log-likelihood, score of each row, hazards and Schoenfeld residuals by loops over rows."""
    x = np.array([r[8:10] for r in rows])
    eta = x @ beta + np.array([r[6] for r in rows])
    risk = np.array([r[5] for r in rows]) * np.exp(eta)
    ll, score, martingale, schoenfeld = 0.0, np.zeros((len(rows), 2)), np.array([float(r[4]) for r in rows]), {}
    for s in {r[1] for r in rows}:
        for t in {r[3] for r in rows if r[1] == s and r[4]}:
            at = [i for i, r in enumerate(rows) if r[1] == s and r[2] < t <= r[3]]
            dead = [i for i in at if rows[i][3] == t and rows[i][4]]
            d, dw = len(dead), sum(rows[i][5] for i in dead)
            means = []
            for k in range(d if ties == "efron" else 1):
                f = k / d if ties == "efron" else 0.0
                share = dw / d if ties == "efron" else dw
                own = {i: risk[i] * (1 - f if i in dead else 1) for i in at}
                den = sum(own.values())
                mean = sum(own[i] * x[i] for i in at) / den
                means.append(mean)
                ll -= share * math.log(den)
                for i in at:
                    h = share * np.exp(eta[i]) * (1 - f if i in dead else 1) / den
                    martingale[i] -= h
                    score[i] -= (x[i] - mean) * h
            for i in dead:
                ll += rows[i][5] * eta[i]
                schoenfeld[i] = x[i] - sum(means) / len(means)
                score[i] += schoenfeld[i]
    return ll, score, martingale, schoenfeld


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_residuals_and_robust_errors(spark, ties):
    rows = sample(random.Random(3))
    df = spark.createDataFrame([*rows, (99, "a", 3.0, 2.0, 1, 1.0, 0.0, 1, 0.0, 0.0), (98, "a", 0.0, 2.0, 1, None, 0.0, 1, 0.0, 0.0)], COLUMNS).repartition(3)
    fit = fit_cox(df, "time", "status", ["x", "z"], ties=ties, entry="entry", weight="w", stratum="s", cluster="c", offset="o", unit="id")
    assert fit.n == len(rows)
    ll, score, martingale, schoenfeld = dense(rows, fit.coefficients, ties)
    assert fit.loglik[1] == pytest.approx(ll)
    w = np.array([r[5] for r in rows])
    assert np.abs((w[:, None] * score).sum(0)).max() < 1e-6
    got = {k: {r["id"]: r for r in fit.residuals(k).collect()} for k in ("martingale", "deviance", "score", "dfbeta", "dfbetas", "schoenfeld", "scaled_schoenfeld")}
    moves = w[:, None] * score @ fit.model_covariance
    errors = np.sqrt(np.diag(fit.model_covariance))
    for i, r in enumerate(rows):
        m = martingale[i]
        assert got["martingale"][i]["residual"] == pytest.approx(m, abs=1e-9)
        assert got["deviance"][i]["residual"] == pytest.approx(math.copysign(math.sqrt(max(0, -2 * (m + (math.log(1 - m) if r[4] else 0)))), m), abs=1e-6)
        for j, n in enumerate(["x", "z"]):
            assert got["score"][i][n] == pytest.approx(score[i, j], abs=1e-9)
            assert got["dfbeta"][i][n] == pytest.approx(moves[i, j], abs=1e-9) and got["dfbetas"][i][n] == pytest.approx(moves[i, j] / errors[j], abs=1e-9)
        if r[4]:
            assert [got["schoenfeld"][i][n] for n in ("x", "z")] == pytest.approx(list(schoenfeld[i]), abs=1e-9)
            assert [got["scaled_schoenfeld"][i][n] for n in ("x", "z")] == pytest.approx(list(schoenfeld[i] @ fit.model_covariance * fit.n_events + fit.coefficients))
    assert len(got["schoenfeld"]) == fit.n_events == sum(r[4] for r in rows)
    clusters = np.array([sum(moves[i] for i, r in enumerate(rows) if r[7] == c) for c in range(11)])
    assert fit.covariance == pytest.approx(clusters.T @ clusters)
    base = {(r["stratum"], r["t"]): r["cumhaz"] for r in fit.baseline().collect()}
    late = max(t for s, t in base if s == "a")
    shown = {(r["id"], r["at"]): r["surv"] for r in fit.predict_survival(df, [0.5, late], stratum="s").collect()}
    i = next(i for i, r in enumerate(rows) if r[1] == "a")
    assert shown[i, 0.5] == 1.0 or (("a", 0.5) in base)
    assert shown[i, late] == pytest.approx(math.exp(-base["a", late] * math.exp(fit.coefficients @ np.array(rows[i][8:10]))))


def test_proportional_hazards_is_the_score_test_of_a_changing_coefficient(spark):
    rows = [(i, "a", 0.0, *r[3:5], 1.0, 0.0, 0, *r[8:]) for i, r in enumerate(sample(random.Random(8), 50))]
    fit = fit_cox(spark.createDataFrame(rows, COLUMNS), "time", "status", ["x", "z"])
    x, beta = np.array([r[8:10] for r in rows]), fit.coefficients
    u, info = np.zeros(2), np.zeros((4, 4))
    for t in sorted({r[3] for r in rows if r[4]}):
        at = [i for i, r in enumerate(rows) if r[3] >= t]
        dead = [i for i in at if rows[i][3] == t and rows[i][4]]
        for k in range(len(dead)):
            own = np.array([np.exp(x[i] @ beta) * (1 - k / len(dead) if i in dead else 1) for i in at])
            mean = own @ x[at] / own.sum()
            v = (own[:, None] * (x[at] - mean)).T @ (x[at] - mean) / own.sum()
            g = np.array([1.0, t])
            info += np.kron(np.outer(g, g), v)
            u += t * (x[dead].mean(0) - mean)
    got = fit.proportional_hazards("identity")
    rest = info[2:, 2:] - info[2:, :2] @ np.linalg.solve(info[:2, :2], info[:2, 2:])
    assert [r["statistic"] for r in got] == pytest.approx([u[0] ** 2 / rest[0, 0], u[1] ** 2 / rest[1, 1], u @ np.linalg.solve(rest, u)], rel=1e-5)
    assert got[-1]["df"] == 2 and 0 <= fit.proportional_hazards("km")[0]["p_value"] <= 1


def pairs(rows):
    """(id, stratum, entry, time, status, weight, score): sums over all pairs, and each row's part."""
    sums, part = np.zeros(3), np.zeros((len(rows), 3))
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if a[4] and a[1] == b[1] and (b[3] > a[3] or (b[3] == a[3] and not b[4])) and b[2] < a[3]:
                k = 0 if a[6] > b[6] else 1 if a[6] < b[6] else 2
                sums[k] += a[5] * b[5]
                part[i, k] += b[5]
                part[j, k] += a[5]
    usable = sums.sum()
    influence = np.array([r[5] for r in rows]) * ((part[:, 0] - part[:, 1]) - part.sum(1) * (sums[0] - sums[1]) / usable) / (2 * usable)
    return sums, influence


@pytest.mark.parametrize("strip", [7, 1 << 18])
def test_concordance_is_that_of_all_pairs(spark, monkeypatch, strip):
    monkeypatch.setattr(dominance_module, "STRIP", strip)
    rng = random.Random(5)
    rows = [(*r[:6], float(rng.randrange(6))) for r in sample(rng, 90)]
    df = spark.createDataFrame([(*r, i % 9) for i, r in enumerate(rows)] + [(None, "a", 0.0, None, 1, 1.0, 1.0, 1)], "id long, s string, entry double, time double, status int, w double, y double, c int").repartition(3)
    sums, influence = pairs(rows)
    got = concordance(df, "time", "status", "y", weight="w", entry="entry", stratum="s")
    assert [got[k] for k in ("concordant", "discordant", "tied")] == pytest.approx(list(sums))
    assert got["concordance"] == pytest.approx((sums[0] + sums[2] / 2) / sums.sum()) and got["std_error"] == pytest.approx(math.sqrt((influence**2).sum()))
    clustered = concordance(df, "time", "status", "y", weight="w", entry="entry", stratum="s", cluster="c")
    assert clustered["std_error"] == pytest.approx(math.sqrt(sum(influence[k::9].sum() ** 2 for k in range(9))))
    plain = concordance(df, "time", "status", "y")
    assert [plain[k] for k in ("concordant", "discordant", "tied")] == pytest.approx(list(pairs([(r[0], "", -1.0, *r[3:5], 1.0, r[6]) for r in rows])[0]))
    assert math.isnan(concordance(df.where("status = 0"), "time", "status", "y")["concordance"])


def test_after_below():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 64, 101):
        h, w = rng.permutation(n), rng.random((n, 2))
        want = np.array([sum((w[j] for j in range(i + 1, n) if h[j] < h[i]), np.zeros(2)) for i in range(n)])
        assert after_below(h, w) == pytest.approx(want)


def test_dominance_in_many_strips(spark, monkeypatch):
    monkeypatch.setattr(dominance_module, "STRIP", 9)
    rng = random.Random(6)
    cells = sorted({(rng.randrange(2), rng.randrange(12), rng.randrange(12)) for _ in range(150)})
    rows = [(*c, rng.randrange(5), rng.randrange(5)) for c in cells]
    got = dominance(spark.createDataFrame(rows, "g int, t int, y int, w int, v int").withColumns({c: F.col(c).cast("double") for c in ("w", "v")}), ["t"], "y", "w", "v", ("g",)).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [x for x in rows if x[0] == r["g"]]
        for name, test in (("less", lambda a, b: a < b), ("equal", lambda a, b: a == b), ("more", lambda a, b: a > b)):
            assert r[f"after_{name}"] == sum(x[3] for x in own if x[1] > r["t"] and test(x[2], r["y"]))
            assert r[f"before_{name}"] == sum(x[4] for x in own if x[1] < r["t"] and test(x[2], r["y"]))
