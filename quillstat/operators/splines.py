"""Regression splines as Columns: B-splines, natural cubic splines and restricted cubic splines.

Knots are found once, as exact quantiles of a distributed column, and kept in a
``Spline``; its columns are expressions of the JVM for any table.  On each interval
between knots a basis function is one polynomial, whose coefficients the driver works
out from the recursion of Cox and de Boor; a column looks up the interval of its row and
sums the powers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.functions.dist import chi2_sf
from quillstat.plans.ordered import running


def quantiles(df: DataFrame, column: str, probs: list[float]) -> list[float]:
    """Exact quantiles of the values that are not missing, interpolated between the two nearest ranks.

    Values are counted, and running sums of the counts find the ranks, so no task
    holds all values and nothing is approximated.
    """
    cells, n = _ranked(df, column)
    if not n:
        raise ValueError(f"{column} has no values")
    places = [(n - 1) * p for p in probs]
    lows = [min(max(int(np.floor(h + 1e-15 * n)), 0), n - 1) for h in places]
    ranks = sorted({r for low in lows for r in (low, min(low + 1, n - 1))})
    found = _at_ranks(cells, ranks)
    out = []
    for h, low in zip(places, lows, strict=True):
        part = h - low if abs(h - low) > 1e-15 * n else 0.0
        a, b = found[low], found[min(low + 1, n - 1)]
        out.append(a + part * (b - a))
    return out


def _ranked(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(v, k, upto) of each distinct value, and the number of values."""
    v = F.col(column).cast("double")
    cells = df.select(v.alias("v")).where("v is not null and not isnan(v)").groupBy("v").agg(F.count("*").alias("k"))
    cells = running(cells, "v", {"upto": ("sum", "k")})
    return cells, cells.agg(F.max("upto")).first()[0] or 0


def _at_ranks(cells: DataFrame, ranks: list[int]) -> dict[int, float]:
    aggs = [F.min(F.when(F.col("upto") > r, F.col("v"))).alias(f"r{i}") for i, r in enumerate(ranks)]
    row = cells.agg(*aggs).first()
    return {r: row[f"r{i}"] for i, r in enumerate(ranks)}


def _pieces(knots: np.ndarray, order: int) -> np.ndarray:
    """Coefficients (interval, function, power) of the B-splines on each interval of positive width, by powers of the distance from its left knot."""
    n = len(knots) - order
    spans = [k for k in range(len(knots) - 1) if knots[k + 1] > knots[k]]
    out = np.zeros((len(spans), n, order))
    for row, k in enumerate(spans):
        now = {k: np.eye(1, order)[0]}  # of order 1: the function of this interval is 1
        for m in range(2, order + 1):
            new: dict[int, np.ndarray] = {}
            for j in range(k - m + 1, k + 1):
                total = np.zeros(order)
                for i, at, sign in ((j, j, 1.0), (j + 1, j + m, -1.0)):
                    if i in now and 0 <= i and (wide := knots[i + m - 1] - knots[i]) > 0:
                        # (x - t) / wide or (t - x) / wide, with x = left knot + s
                        total += sign * (now[i] * (knots[k] - knots[at]) + np.append(0.0, now[i][:-1])) / wide
                if 0 <= j < n + order - m:
                    new[j] = total
            now = new
        for j, c in now.items():
            if 0 <= j < n:
                out[row, j] = c
    return out


@dataclass(frozen=True)
class Spline:
    """A basis with its knots: ``columns`` gives the same functions for any table."""

    kind: str  # bs, ns or rcs
    knots: tuple[float, ...]  # inner ones; of rcs all
    boundary: tuple[float, float]
    degree: int = 3
    intercept: bool = False

    def suffixes(self) -> list[str]:
        if self.kind == "rcs":
            return ["'" * j for j in range(len(self.knots) - 1)]
        n = len(self.knots) + (1 if self.kind == "ns" else self.degree) + self.intercept
        return [str(k) for k in range(1, n + 1)]

    def _polynomials(self) -> tuple[np.ndarray, np.ndarray]:
        """(left ends, coefficients by interval, function and power); the first interval is below the lower boundary and the last above the upper."""
        order = self.degree + 1
        low, high = self.boundary
        knots = np.sort(np.concatenate([[low] * order, self.knots, [high] * order]))
        inner = _pieces(knots, order)
        left = np.unique(knots)[:-1]
        width = high - left[-1]
        powers = np.array([[_choose(q, r) * width ** (q - r) if q >= r else 0.0 for q in range(order)] for r in range(order)])
        top = inner[-1] @ powers.T  # the last piece by powers of the distance from the upper boundary
        below, above = inner[0].copy(), top.copy()
        if self.kind == "ns":  # straight beyond the boundaries
            below[:, 2:] = above[:, 2:] = 0.0
        whole = np.concatenate([below[None], inner, above[None]])
        curved = 2 * np.stack([inner[0][:, 2], top[:, 2]], 1) if self.kind == "ns" else None
        if not self.intercept:
            whole = whole[:, 1:]
            curved = None if curved is None else curved[1:]
        if curved is not None:  # the complement of the second derivatives at both boundaries
            q, _ = np.linalg.qr(curved, mode="complete")
            whole = np.einsum("ifp,fg->igp", whole, q[:, 2:])
        return np.concatenate([[low], left, [high]]), whole

    def columns(self, x: Column) -> list[Column]:
        """The basis at ``x``; null where it is null or not a number."""
        x = F.when(~F.isnan(x.cast("double")), x.cast("double"))
        if self.kind == "rcs":
            return self._restricted(x)
        left, whole = self._polynomials()
        inner = left[2:-1]
        place = F.when(x < self.boundary[0], 0).when(x > self.boundary[1], len(left) - 1).when(x.isNotNull(), sum(((x >= float(k)).cast("int") for k in inner), F.lit(1)))
        s = x - F.get(F.array(*(F.lit(float(v)) for v in left)), place)
        out = []
        for f in range(whole.shape[1]):
            total = None
            for power in range(whole.shape[2] - 1, -1, -1):
                c = F.get(F.array(*(F.lit(float(v)) for v in whole[:, f, power])), place)
                total = c if total is None else total * s + c
            out.append(total)
        return out

    def _restricted(self, x: Column) -> list[Column]:
        t = self.knots
        span = (t[-1] - t[0]) ** (2 / 3)
        cube = lambda k: F.pow(F.greatest((x - float(k)) / span, F.lit(0.0)), 3)
        above = F.when(x.isNotNull(), F.lit(0.0))  # greatest passes over nulls
        last, before = t[-1], t[-2]
        return [x] + [above + cube(k) - cube(before) * ((last - k) / (last - before)) + cube(last) * ((before - k) / (last - before)) for k in t[:-2]]

    def evaluate(self, x: np.ndarray) -> np.ndarray:
        """The same functions of an array."""
        x = np.asarray(x, float)
        if self.kind == "rcs":
            t = self.knots
            span = (t[-1] - t[0]) ** (2 / 3)
            cube = lambda k: np.maximum((x - k) / span, 0) ** 3
            return np.column_stack([x] + [cube(k) - cube(t[-2]) * (t[-1] - k) / (t[-1] - t[-2]) + cube(t[-1]) * (t[-2] - k) / (t[-1] - t[-2]) for k in t[:-2]])
        left, whole = self._polynomials()
        place = np.where(x < self.boundary[0], 0, np.where(x > self.boundary[1], len(left) - 1, np.searchsorted(left[2:-1], x, "right") + 1))
        s = x - left[place]
        return np.einsum("nfp,np->nf", whole[place], s[:, None] ** np.arange(whole.shape[2]))


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def resolve(df: DataFrame, column: str, kind: str = "ns", *, df_columns: int | None = None, knots: list[float] | None = None, boundary: tuple[float, float] | None = None, degree: int = 3, intercept: bool = False, n_knots: int = 5) -> Spline:
    """The spline whose knots are quantiles of ``column``.

    ``df_columns`` asks bs and ns for so many columns; without it and ``knots`` there are no
    inner knots.  rcs takes ``n_knots`` at equally spaced quantiles between a tail and one
    minus it; with fewer than 100 values its outer knots are the fifth from each end.
    """
    if kind not in ("bs", "ns", "rcs"):
        raise ValueError(f"unknown spline {kind}")
    if kind == "rcs":
        return Spline("rcs", tuple(_restricted_knots(df, column, n_knots) if knots is None else sorted(set(knots))), (0.0, 0.0))
    if degree < 1 or (kind == "ns" and degree != 3):
        raise ValueError("degree must be at least 1, and 3 of ns")
    x = F.col(column).cast("double")
    if boundary is None:
        low, high = df.where(~F.isnan(x)).agg(F.min(x), F.max(x)).first()
        if low is None:
            raise ValueError(f"{column} has no values")
        boundary = (low, high)
    low, high = sorted(map(float, boundary))
    inner: list[float] = sorted(knots or [])
    if knots is None and df_columns is not None:
        n = df_columns - (1 if kind == "ns" else degree) - int(intercept)
        if n > 0:
            inner = quantiles(df.where((x >= low) & (x <= high)), column, [k / (n + 1) for k in range(1, n + 1)])
    if any(not low < k < high for k in inner):
        raise ValueError("inner knots must lie between the boundaries")
    return Spline(kind, tuple(map(float, inner)), (low, high), degree, intercept)


def _restricted_knots(df: DataFrame, column: str, k: int) -> list[float]:
    """Default knots; where the least or greatest value alone is 5 % of all, that end's knot is the next one inward and the others lie inside it."""
    if k < 3:
        raise ValueError("rcs needs at least 3 knots")
    cells, n = _ranked(df, column)
    if n < 6:
        raise ValueError("rcs needs at least 6 values")
    distinct = cells.count()
    ends = cells.orderBy("v").limit(max(k + 4, 8)).collect()
    tops = cells.orderBy(F.desc("v")).limit(max(k + 4, 8)).collect()
    if distinct - 2 <= k:
        inner = [r["v"] for r in ends[: distinct]][1 : distinct - 1]
        if len(inner) < 3:
            raise ValueError("rcs needs at least 3 distinct knots")
        return inner
    low, high = ends[0]["v"], tops[0]["v"]
    most = cells.where((F.col("v") > low) & (F.col("v") < high)).agg(F.max("k")).first()[0] or 0
    heavy = most / n >= 0.05
    at_low, at_high = not heavy and ends[0]["k"] / n >= 0.05, not heavy and tops[0]["k"] / n >= 0.05
    first, last = [ends[1]["v"]] if at_low else [], [tops[1]["v"]] if at_high else []
    rest = df
    if at_low:
        rest = rest.where(F.col(column).cast("double") > first[0])
    if at_high:
        rest = rest.where(F.col(column).cast("double") < last[0])
    m = k - len(first) - len(last)
    tail = 0.10 if k <= 3 else 0.05 if k <= 6 else 0.025
    probs = [0.5] if m == 1 else [float(p) for p in np.linspace(tail, 1 - tail, m)]
    middle = quantiles(rest, column, probs)
    if n < 100 and m > 1:
        five = _at_ranks(cells, [4, n - 5])
        middle[0] = middle[0] if at_low else five[4]
        middle[-1] = middle[-1] if at_high else five[n - 5]
    knots = sorted({*first, *middle, *last})
    if len(knots) < 3:
        raise ValueError("rcs could not place 3 distinct knots; pass them")
    return knots


def spline_test(names: list[str], coefficients: np.ndarray, covariance: np.ndarray, term: str, kind: str) -> list[dict]:
    """Wald tests (part, statistic, df, p_value) of all columns of a spline ``term`` and, of rcs, of all but the first."""
    index = [i for i, n in enumerate(names) if n.startswith(term) and ":" not in n]
    if not index:
        raise ValueError(f"no columns of {term}")
    out = []
    for part, own in (("overall", index), *((("nonlinear", index[1:]),) if kind == "rcs" else ())):
        stat = float(coefficients[own] @ np.linalg.solve(covariance[np.ix_(own, own)], coefficients[own]))
        out.append({"term": term, "part": part, "statistic": stat, "df": len(own), "p_value": chi2_sf(stat, len(own))})
    return out
