"""Operators on small inputs with known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstat.functions import columns as C
from quillstat.functions import dist
from quillstat.operators import causal, economics, prediction, regression, survival, tableone
from quillstat.operators import hypothesis as tests
from quillstat.plans import ordered


def test_distributions():
    assert dist.norm_cdf(1.959963984540054) == pytest.approx(0.975)
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.2281388519649385)
    assert dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert dist.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05)
    assert dist.beta_ppf(0.5, 2, 3) == pytest.approx(0.38572756813238945)
    assert dist.chi2_sf(1000, 1) > 0


def test_fixed(spark):
    rows = spark.createDataFrame([(1.015,), (0.25,), (-0.05,), (11.0,), (float("nan"),), (None,)], "x double").select(C.fixed(F.col("x"), 2).alias("t")).collect()
    assert [r["t"] for r in rows] == ["1.01", "0.25", "-0.05", "11.00", None, None]


def test_aggregates_of_nulls_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", None, False), ("b", None, None)], "g string, x double, b boolean")
    out = {r["g"]: r for r in df.groupBy("g").agg(C.agg_mean_sd("x").alias("m"), C.agg_bool_np("b").alias("p"), C.agg_nunique("x").alias("u")).collect()}
    assert out["a"]["p"] == "1 (50.0%)" and out["b"]["p"].startswith("0 (NaN") and out["a"]["u"] == 2 and out["b"]["m"] is None


def test_e_value():
    point, limit = C.e_value(3.9, 1.8, 8.7)
    assert point == pytest.approx(7.26, abs=0.01) and limit == pytest.approx(3.0, abs=0.01)
    assert C.e_value(1.2, 0.9, 1.6)[1] == 1.0


def test_tableone(spark):
    df = spark.createDataFrame([(1.0, "x", "A"), (3.0, "y", "A"), (5.0, "x", "B"), (9.0, "x", "B"), (2.0, "y", None)], "v double, c string, g string")
    rows = {r["name"]: r for r in tableone.tableone_raw(df, [("v", C.agg_mean_sd), ("c", "category")], "g", add_all=True, add_smd=True).collect()}
    assert rows["v"]["A"] == "2.0 (1.4)" and rows["v"]["All"] == "4.0 (3.2)"
    assert rows["  y"]["B"] == "0 (0.0%)" and rows["  x"]["A"] == "1 (50.0%)"
    with pytest.raises(tableone.ColumnNotFoundError):
        tableone.tableone_raw(df, [("none", C.agg_mean)])


def test_exact_wilcoxon(spark):
    df = spark.createDataFrame([(0.80, "x"), (0.83, "x"), (1.89, "x"), (1.04, "x"), (1.45, "x"), (1.38, "x"), (1.91, "x"), (1.64, "x"), (0.73, "x"), (1.46, "x"), (1.15, "y"), (0.88, "y"), (0.90, "y"), (0.74, "y"), (1.21, "y")], "v double, g string")
    r = tests.wilcox_test(df, "v", "g", alternative="greater")
    assert r.statistic == 35 and r.p_value == pytest.approx(0.1272, abs=1e-4)


def test_counts_tests():
    assert tests.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857, abs=1e-4)
    b = tests.binom_test(682, 925, p=0.75)
    assert b.p_value == pytest.approx(0.3825, abs=1e-4) and (b.conf_low, b.conf_high) == pytest.approx((0.7076683, 0.7654066), abs=1e-6)
    p = tests.prop_test([(83, 86), (90, 93), (129, 136), (70, 82)])
    assert p.statistic == pytest.approx(12.6004, abs=1e-4) and p.p_value == pytest.approx(0.005585, abs=1e-6)


def test_log_rank_and_cox(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, 300)
    t = np.ceil(rng.exponential(10 / np.exp(0.7 * x)))
    e = (rng.random(300) < 0.8).astype(int)
    df = spark.createDataFrame([(float(a), int(b), int(c)) for a, b, c in zip(t, e, x)], "t double, e int, x int")
    _, beta, cov, (l0, l1) = survival.cox_ph(df, "t", "e", ["x"], ties="efron")
    grid = np.linspace(beta[0] - 0.2, beta[0] + 0.2, 81)
    best = grid[np.argmax([_efron(t, e, x, b) for b in grid])]
    assert beta[0] == pytest.approx(best, abs=0.006) and l1 == pytest.approx(_efron(t, e, x - x.mean(), beta[0]), rel=1e-9)
    stat, k, p = survival.log_rank(df, "t", "e", "x")
    assert k == 1 and 0 < p < 0.05 and stat > 3.8


def _efron(t, e, x, b):
    out = 0.0
    for u in np.unique(t[e == 1]):
        risk, dead = np.exp(b * x[t >= u]).sum(), np.exp(b * x[(t == u) & (e == 1)])
        out += b * x[(t == u) & (e == 1)].sum() - sum(math.log(risk - i / len(dead) * dead.sum()) for i in range(len(dead)))
    return out


def test_regression_against_numpy(spark):
    rng = np.random.default_rng(2)
    x, g = rng.normal(size=200), rng.integers(0, 3, 200)
    y = 1 + 2 * x + (g == 1) - 0.5 * x * (g == 2) + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), "abc"[c]) for a, b, c in zip(y, x, g)], "y double, x double, g string")
    fit = regression.fit_ols(df, "y ~ x * g")
    m = np.c_[np.ones(200), x, g == 1, g == 2, x * (g == 1), x * (g == 2)].astype(float)
    want, *_ = np.linalg.lstsq(m, y, rcond=None)
    assert fit.names == ["(Intercept)", "x", "gb", "gc", "x:gb", "x:gc"] and np.allclose(fit.coef, want)
    e, inv = y - m @ want, np.linalg.inv(m.T @ m)
    h = np.einsum("ij,jk,ik->i", m, inv, m)
    assert np.allclose(regression.hc_covariance(fit, "HC3"), inv @ (m.T * (e / (1 - h)) ** 2) @ m @ inv)
    z = (y > 1).astype(int)
    glm = regression.fit_glm(spark.createDataFrame([(int(a), float(b)) for a, b in zip(z, x)], "z int, x double"), "z ~ x", "binomial")
    w, m = np.zeros(2), np.c_[np.ones(200), x]
    for _ in range(30):
        p = 1 / (1 + np.exp(-m @ w))
        w += np.linalg.solve((m.T * p * (1 - p)) @ m, m.T @ (z - p))
    assert np.allclose(glm.coef, w, atol=1e-6)


def test_formula_errors(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "y double, x double")
    with pytest.raises(KeyError):
        regression.design("y ~ nothing", df)
    assert regression.design("y ~ x - 1", df).names == ["x"]
    assert regression.design("y ~ I(x^2) + log(x)", df).names == ["(Intercept)", "I(x^2)", "log(x)"]


def test_running_sums_are_the_same_in_ranges(spark):
    df = spark.createDataFrame([(i * 37 % 101, 1) for i in range(101)], "k int, n int")
    one = {r["k"]: r["c"] for r in ordered.running_sums(df, "k", {"c": "n"}).collect()}
    many = {r["k"]: r["c"] for r in ordered.running_sums(df, "k", {"c": "n"}, one_task=10).collect()}
    assert one == many == {k: k + 1 for k in range(101)}


def test_lagged(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "k int").repartition(7)
    rows = ordered.lagged(df, ["k"], ["k"], 3).collect()
    assert all((r["k_1"], r["k_3"]) == (r["k"] - 1 if r["k"] > 0 else None, r["k"] - 3 if r["k"] > 2 else None) for r in rows) and len(rows) == 50


def test_roc_test_and_frontier(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 150)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(y, y + rng.normal(size=150), rng.normal(size=150))], "y int, a double, b double")
    r = prediction.roc_test(df, "y", "a", "b")
    assert r["auc1"] > r["auc2"] and r["p_value"] < 0.05
    rows = economics.frontier([("a", 0, 0), ("b", 10, 1), ("c", 30, 2), ("d", 25, 0.5), ("e", 25, 1.2)])
    assert [x[0] for x in rows] == ["a", "b", "c"]


def test_no_strategy_dominates_itself(spark):
    # each evaluation of the means differs in its last digits, as sums merged in another order do
    again = F.udf(lambda c: c * (1 + random.random() * 1e-12), "double").asNondeterministic()
    rows = [(f"s{i}", 100.0 + i, float(i)) for i in range(30)] + [("worse", 200.0, 29.0)]
    means = spark.createDataFrame(rows, "strategy string, c double, effect double").select("strategy", again("c").alias("cost"), "effect")
    assert [r["strategy"] for r in economics.strongly_dominated(means, "strategy", "cost", "effect").collect()] == ["worse"]


@pytest.mark.parametrize("one_task", [10**6, 0])
@pytest.mark.parametrize("before", [False, True])
def test_running_aggregates_of_groups(spark, one_task, before):
    rng = np.random.default_rng(3)
    rows = [(g, k, float(rng.normal()), float(rng.random())) for g in "abc" for k in range({"a": 300, "b": 1, "c": 40}[g])]
    df = spark.createDataFrame(rows, "g string, k long, v double, p double").repartition(5)
    for descending in (False, True):
        out = ordered.running(df, "k", {"s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v"), "pr": ("product", "p")}, ("g",), descending=descending, before=before, one_task=one_task).collect()
        assert len(out) == len(rows)
        for r in out:
            own = [x for x in rows if x[0] == r["g"] and ((x[1] > r["k"] if descending else x[1] < r["k"]) or (not before and x[1] == r["k"]))]
            if not own:
                assert r["s"] is None and r["hi"] is None and r["pr"] is None
                continue
            v = [x[2] for x in own]
            assert (r["s"], r["hi"], r["lo"], r["pr"]) == pytest.approx((sum(v), max(v), min(v), math.prod(x[3] for x in own)))
    whole = ordered.running(df.groupBy("k").agg(F.sum("v").alias("v")), "k", {"s": ("sum", "v")}, before=before, one_task=one_task)
    assert whole.count() == 300


def test_exact_tails_by_brute_force():
    for n, p in ((1, 0.5), (7, 0.2), (40, 0.5), (41, 0.73)):
        pmf = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
        for x in range(n + 1):
            assert tests.binom_test(x, n, p).p_value == pytest.approx(min(1, sum(v for v in pmf if v <= pmf[x] * (1 + 1e-7))))
            assert tests.binom_test(x, n, p, alternative="less").p_value == pytest.approx(sum(pmf[: x + 1]))
            assert tests.binom_test(x, n, p, alternative="greater").p_value == pytest.approx(sum(pmf[x:]))
    for a, b, c, d in ((3, 1, 1, 3), (0, 5, 4, 1), (10, 2, 3, 15), (0, 0, 2, 3), (8, 8, 8, 8)):
        ways = {x: math.comb(a + b, x) * math.comb(c + d, a + c - x) for x in range(max(0, a - d), min(a + b, a + c) + 1)}
        want = sum(v for v in ways.values() if v <= ways[a] * (1 + 1e-7)) / math.comb(a + b + c + d, a + c)
        assert tests.fisher_exact(a, b, c, d) == pytest.approx(want)
    # as many terms as the spread, not as the counts
    assert tests.binom_test(500_010_000, 10**9, 0.5).p_value == pytest.approx(math.erfc(10_000 / math.sqrt(10**9 / 4) / math.sqrt(2)), rel=1e-3)
    assert tests._harmonic(101) == pytest.approx(sum(1 / i for i in range(1, 102)), rel=1e-15)


def test_nearest_match_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.random() < 0.3), float(rng.integers(0, 40)) / 10, "ab"[int(rng.random() < 0.5)]) for i in range(120)] + [(500, 1, None, "a"), (501, 0, 1.0, None), (None, 1, 2.0, "a")]
    df = spark.createDataFrame(rows, "u long, t int, s double, e string")
    spread = np.std([x[2] for x in rows[:120]], ddof=1)
    for exact, caliper in ((None, None), (["e"], None), (["e"], 0.05)):
        have = [x for x in rows if None not in (x[:3] if exact is None else x)]
        sd = np.std([x[2] for x in have], ddof=1)
        got = {r["treated"]: (r["control"], r["distance"]) for r in causal.nearest_match(df, "u", "t", "s", exact, caliper).collect()}
        want = {}
        for u, t, s, e in have:
            near = sorted((abs(s - c[2]), c[2], c[0]) for c in have if not c[1] and (exact is None or c[3] == e))
            if t and near and (caliper is None or near[0][0] <= caliper * sd):
                want[u] = (near[0][2], pytest.approx(near[0][0]))
        assert got == want and spread > 0
    w = {r["unit"]: r["weight"] for r in causal.match_weights(causal.nearest_match(df, "u", "t", "s")).collect()}
    controls = [v for u, v in w.items() if u is not None and rows[u][1] == 0]
    assert sum(controls) == pytest.approx(len(controls))


def test_predictions_of_missing_and_unknown_levels(spark):
    df = spark.createDataFrame([(1.0, "a", 1.0), (2.0, "b", 2.0), (3.0, "a", 1.0), (5.0, "b", 3.0)], "y double, f string, w double")
    fit = regression.fit_ols(df, "y ~ f", "w")
    new = fit.predict(spark.createDataFrame([("a",), (None,), ("b",)], "f string")).collect()
    assert new[0]["fitted"] == pytest.approx(2.0) and new[1]["fitted"] is None and new[2]["fitted"] == pytest.approx(3.8)
    with pytest.raises(Exception, match="new level"):
        fit.predict(spark.createDataFrame([("c",)], "f string")).collect()


def test_weights_count_in_clustered_covariance(spark):
    rng = np.random.default_rng(5)
    rows = [(float(rng.normal()), float(rng.normal()), float(rng.integers(1, 4)), int(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "y double, x double, w double, g int")
    fit = regression.fit_ols(df, "y ~ x", "w")
    a = np.array(rows)
    x, w = np.c_[np.ones(60), a[:, 1]], a[:, 2]
    bread = np.linalg.inv((x.T * w) @ x)
    score = (x.T * (w * (a[:, 0] - x @ (bread @ (x.T * w) @ a[:, 0])))).T
    u = np.array([score[a[:, 3] == g].sum(0) for g in range(7)])
    want = bread @ (u.T @ u) @ bread * 7 / 6 * 59 / 58
    assert np.allclose(regression.cluster_covariance(fit, df, "y ~ x", ["g"]), want)


def test_lags_skip_rows_that_are_not_in_the_fit(spark):
    rows = [(1, 1.0, 0.1), (2, None, 5.0), (3, 2.5, 0.7), (4, 2.0, 1.1), (5, 4.5, 2.0)]
    df = spark.createDataFrame(rows, "o int, y double, x double")
    got = regression.durbin_watson(df, "y ~ x", ["o"]).first()["dw"]
    assert got == pytest.approx(regression.durbin_watson(df.where("y is not null"), "y ~ x", ["o"]).first()["dw"])


def test_restricted_mean_and_median_at_the_edges(spark):
    df = spark.createDataFrame([("late", 50.0, 1), ("late", 60.0, 0), ("flat", 1.0, 1), ("flat", 3.0, 1)], "g string, t double, e int")
    r = {x["grp"]: (x["rmst"], x["variance"]) for x in survival.rmst(df, "t", "e", 10.0, "g").collect()}
    assert r["late"] == (10.0, 0.0) and r["flat"][0] == pytest.approx(1 + 2 * 0.5)
    q = {x["grp"]: x["time"] for x in survival.curve_quantile(survival.survival_curve(df, "t", "e", "g")).collect()}
    assert q["flat"] == 2.0  # the middle of the stretch at one half


def test_proportions_against_a_given_one():
    r = tests.prop_test([(15, 25), (20, 30)], p=0.1)
    want = sum((x - n * 0.1) ** 2 / (n * 0.1 * 0.9) for x, n in ((15, 25), (20, 30)))
    assert r.statistic == pytest.approx(want) and r.df == 2 and r.p_value == pytest.approx(dist.chi2_sf(want, 2))


def test_dots_in_tests_of_models(spark):
    rng = random.Random(4)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(80)]
    df = spark.createDataFrame([(i, x + z * z + rng.gauss(0, 0.3), x, z) for i, x, z in rows], "i int, y double, x double, z double")
    assert regression.ramsey_reset(df.drop("i"), "y ~ .") == pytest.approx(regression.ramsey_reset(df, "y ~ x + z"))
    assert regression.breusch_godfrey(df, "y ~ . - i", ["i"]) == pytest.approx(regression.breusch_godfrey(df, "y ~ x + z", ["i"]))
    assert regression.design("y ~ . + x:z", df.drop("i")).names == ["(Intercept)", "x", "z", "x:z"]


def test_exact_ranks_refuse_ties_and_clusters_refuse_nulls(spark):
    df = spark.createDataFrame([(1.0, "a", 1), (1.0, "b", None), (2.0, "a", 2), (4.0, "b", 1), (3.0, "a", 2)], "x double, g string, c int")
    with pytest.raises(ValueError):
        tests.wilcox_test(df, "x", "g", exact=True)
    fit = regression.fit_ols(df, "x ~ 1")
    with pytest.raises(ValueError):
        regression.cluster_covariance(fit, df, "x ~ 1", ["c"])


def test_quantiles_without_a_task_of_all_values(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(g, None if i % 11 == 0 else float(rng.integers(-40, 40)) / 4) for g in ("a", "b", "c") for i in range({"a": 1, "b": 300, "c": 77}[g])] + [("a", 2.5), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    values = {g: [v for h, v in rows if v is not None and (g == "All" and h is not None or g == h)] for g in ("a", "b", "c", "All")}
    for one_task in (10**6, 5):  # in windows, and through range partitions
        got = {r["g"]: [r["q0"], r["q1"], r["q2"]] for r in ordered.quantiles(df, "v", [0.1, 0.5, 0.75], ("g",), one_task=one_task).where("g is not null").collect()}
        assert got == {g: pytest.approx(np.quantile(values[g], [0.1, 0.5, 0.75])) for g in "abc"}
    table = tableone.numeric_summary(df, "v", "g")
    assert {r["group"]: [r["q1"], r["median"], r["q3"]] for r in table.collect()} == {g: pytest.approx(np.quantile(v, [0.25, 0.5, 0.75])) for g, v in values.items()}
    assert "percentile" not in table._jdf.queryExecution().executedPlan().toString()


def test_tableone_of_known_quantiles(spark, monkeypatch):
    """Tables show the same quantiles as the aggregates do, and leave out the aggregates that hold all values."""
    df = spark.createDataFrame([("x", 1.0), ("x", 2.5), ("x", 7.0), ("y", 4.0), ("y", None), ("z", None), (None, 9.0)], "g string, v double")
    shown = [C.agg_median, C.agg_median_range, C.agg_median_iqr]
    want = [[str(x) if x is not None else None for x in (df.agg(f("v")).first()[0], *(r[1] for r in df.where("g is not null").groupBy("g").agg(f("v")).orderBy("g").collect()))] for f in shown]
    monkeypatch.setattr(F, "percentile", None)
    got = [list(tableone.tableone_raw(df, [("v", f)], "g", add_all=True).first())[1:] for f in shown]
    assert got == want


def test_evpi_does_not_multiply_draws(spark):
    rng = random.Random(8)
    rows = [(d, s, rng.uniform(0, 900), rng.uniform(0, 3)) for d in range(40) for s in "abc"]
    psa, wtp = spark.createDataFrame(rows, "d long, s string, cost double, effect double"), [0.0, 150.0, 700.0]
    value = {(w, d, s): w * e - c for d, s, c, e in rows for w in wtp}
    best = {w: [max("abc", key=lambda s: (value[w, d, s], s)) for d in range(40)] for w in wtp}
    want = {w: np.mean([value[w, d, best[w][d]] for d in range(40)]) - max(np.mean([value[w, d, s] for d in range(40)]) for s in "abc") for w in wtp}
    shares = {(w, s): best[w].count(s) / 40 for w in wtp for s in set(best[w])}
    for f, name, answer in ((economics.evpi, "evpi", want), (economics.ceac, "probability", shares)):
        out = f(psa, "d", "s", "cost", "effect", wtp)
        assert {(r["wtp"], r["strategy"]) if name == "probability" else r["wtp"]: r[name] for r in out.collect()} == pytest.approx(answer)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(" not in plan  # rows of draws by willingness to pay
        assert f(psa.limit(0), "d", "s", "cost", "effect", wtp).count() == 0
