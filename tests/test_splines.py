"""Spline bases against direct recursions, and their knots against sorted values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstat.operators.regression import design
from quillstat.operators.splines import Spline, quantiles, resolve, spline_test


def boor(knots, j, order, x, last):
    """One B-spline by its recursion; the last interval takes its right end."""
    if order == 1:
        return float(knots[j] <= x < knots[j + 1] or (x == last and knots[j] < x == knots[j + 1]))
    out = 0.0
    if knots[j + order - 1] > knots[j]:
        out += (x - knots[j]) / (knots[j + order - 1] - knots[j]) * boor(knots, j, order - 1, x, last)
    if knots[j + order] > knots[j + 1]:
        out += (knots[j + order] - x) / (knots[j + order] - knots[j + 1]) * boor(knots, j + 1, order - 1, x, last)
    return out


@pytest.mark.parametrize(("degree", "inner"), [(1, (2.0,)), (2, (1.0, 4.5)), (3, ()), (3, (1.0, 2.0, 4.5)), (3, (2.0, 2.0)), (4, (3.0,))])
def test_b_splines(degree, inner):
    s = Spline("bs", inner, (0.0, 6.0), degree, intercept=True)
    knots = [0.0] * (degree + 1) + sorted(inner) + [6.0] * (degree + 1)
    for x in (0.0, 0.3, 1.0, 2.0, 3.7, 4.5, 5.999, 6.0):
        assert list(s.evaluate(np.array([x]))[0]) == pytest.approx([boor(knots, j, degree + 1, x, 6.0) for j in range(len(inner) + degree + 1)], abs=1e-12)
    beyond = s.evaluate(np.array([-0.5, 7.0]))
    assert beyond.sum(1) == pytest.approx([1, 1])  # polynomials that sum to 1 go on to do so
    assert len(s.suffixes()) == beyond.shape[1] == Spline("bs", inner, (0.0, 6.0), degree).evaluate(np.array([1.0])).shape[1] + 1


def test_natural_splines_are_straight_outside_and_smooth_inside():
    s = Spline("ns", (1.0, 2.0, 4.5), (0.0, 6.0))
    h = 1e-3
    second = lambda x: (s.evaluate(np.array([x + h])) - 2 * s.evaluate(np.array([x])) + s.evaluate(np.array([x - h])))[0] / h**2
    assert np.abs([second(x) for x in (-3.0, -0.01, 6.01, 9.0)]).max() < 1e-6
    assert np.abs([s.evaluate(np.array([k + 1e-9])) - s.evaluate(np.array([k - 1e-9])) for k in (0.0, 1.0, 2.0, 4.5, 6.0)]).max() < 1e-7
    assert s.evaluate(np.array([1.3])).shape == (1, 4) and s.suffixes() == ["1", "2", "3", "4"]
    # the span holds every natural cubic spline: the restricted cubic one with the same knots, and a constant
    x = np.linspace(-1, 7, 60)
    with_constant = Spline("ns", (1.0, 2.0, 4.5), (0.0, 6.0), intercept=True).evaluate(x)
    target = Spline("rcs", (0.0, 1.0, 2.0, 4.5, 6.0), (0.0, 0.0)).evaluate(x)
    assert np.abs(with_constant @ np.linalg.lstsq(with_constant, target, rcond=None)[0] - target).max() < 1e-9


@pytest.mark.parametrize(("kind", "knots"), [("bs", (1.0, 2.0)), ("ns", (1.0, 2.0)), ("rcs", (0.0, 1.0, 2.0, 4.0))])
def test_columns_are_the_functions_of_arrays(spark, kind, knots):
    s = Spline(kind, knots, (0.0, 3.0))
    x = [-1.0, 0.0, 0.5, 1.0, 1.7, 2.0, 3.0, 5.0]
    df = spark.createDataFrame([(v,) for v in x] + [(None,), (math.nan,)], "x double")
    rows = df.select("x", *(c.alias(f"c{i}") for i, c in enumerate(s.columns(F.col("x"))))).collect()
    for r in rows:
        if r["x"] is None or math.isnan(r["x"]):
            assert all(v is None for v in r[1:])
        else:
            assert list(r[1:]) == pytest.approx(list(s.evaluate(np.array([r["x"]]))[0]), abs=1e-12)


def test_quantiles(spark):
    rng = random.Random(1)
    values = [float(rng.randrange(50)) for _ in range(333)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (math.nan,)], "x double")
    probs = [0.0, 0.05, 1 / 3, 0.5, 0.9, 1.0]
    assert quantiles(df, "x", probs) == pytest.approx(list(np.quantile(values, probs)))
    with pytest.raises(ValueError):
        quantiles(df.where("x is null"), "x", [0.5])


def test_knots(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 1) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    s = resolve(df, "x", "ns", df_columns=4)
    assert s.knots == pytest.approx(tuple(np.quantile(values, [0.25, 0.5, 0.75]))) and s.boundary == (min(values), max(values))
    assert len(resolve(df, "x", "bs", df_columns=5).knots) == 2
    assert resolve(df, "x", "rcs", n_knots=4).knots == pytest.approx(tuple(np.quantile(values, np.linspace(0.05, 0.95, 4))))
    few = sorted(values)[:60]
    small = resolve(spark.createDataFrame([(v,) for v in few], "x double"), "x", "rcs", n_knots=3).knots
    assert (small[0], small[-1]) == (few[4], few[-5]) and small[1] == pytest.approx(np.median(few))
    piled = sorted([0.0] * 40 + [abs(v) + 0.1 for v in values])
    knots = resolve(spark.createDataFrame([(v,) for v in piled], "x double"), "x", "rcs", n_knots=5).knots
    inside = [v for v in piled if v > piled[40]]
    assert knots == pytest.approx((piled[40], *np.quantile(inside, np.linspace(0.05, 0.95, 4))))
    with pytest.raises(ValueError):
        resolve(df, "x", "bs", knots=[99.0])
    with pytest.raises(ValueError):
        resolve(df, "x", "cubic")


def test_in_formulas_and_for_new_rows(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.gauss(0, 1), rng.gauss(0, 1), rng.choice("ab")) for _ in range(120)], "y double, x double, g string")
    made = design("y ~ ns(x, df=3) + g + rcs(x, 3)", df)
    assert made.names == ["(Intercept)", "ns(x,df=3)1", "ns(x,df=3)2", "ns(x,df=3)3", "gb", "rcs(x,3)", "rcs(x,3)'"]
    # knots stay those of the first table
    new = spark.createDataFrame([(0.0, 0.4, "a")], "y double, x double, g string")
    again = design("y ~ ns(x, df=3) + g + rcs(x, 3)", new, made.levels)
    want = made.levels["ns(x,df=3)"].evaluate(np.array([0.4]))[0]
    assert list(new.select(*again.columns[1:4]).first()) == pytest.approx(list(want))
    got = spline_test(made.names, np.arange(7.0), np.eye(7), "rcs(x,3)", "rcs")
    assert [(r["part"], r["statistic"], r["df"]) for r in got] == [("overall", 61.0, 2), ("nonlinear", 36.0, 1)]
