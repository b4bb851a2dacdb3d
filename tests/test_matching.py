"""Matching without replacement and full matching against brute force."""

import itertools
import random

import numpy as np
import pytest

from quillstat.operators import matching
from quillstat.operators.matching import Line, full_match, full_match_weights, greedy_match, matched_weights, sweep


def greedy(rows, limit, ratio=1, order="largest"):
    """One treated unit after the other over all controls."""
    out, left = [], [r for r in rows if not r[1]]
    for u, _, s, k in sorted((r for r in rows if r[1]), key=lambda r: (-r[2] if order == "largest" else r[2], r[0])):
        for _ in range(ratio):
            near = min((c for c in left if c[3] == k), key=lambda c: (abs(c[2] - s), c[2], c[0]), default=None)
            if near is None or abs(near[2] - s) > limit + 1e-12:
                break
            left.remove(near)
            out.append((u, near[0], abs(near[2] - s)))
    return sorted(out)


def units(rng, n, scores, strata=1):
    return [(i, rng.random() < 0.4, scores(rng), rng.randrange(strata)) for i in range(n)]


@pytest.mark.parametrize("chunk", [3, 1 << 19])
@pytest.mark.parametrize(("scores", "caliper", "ratio", "order"), [(lambda r: r.randrange(12), None, 1, "largest"), (lambda r: r.random(), 0.02, 1, "smallest"), (lambda r: r.randrange(40), 2.0, 2, "largest"), (lambda r: r.randrange(25), None, 3, "smallest")])
def test_greedy_is_that_of_one_after_the_other(spark, monkeypatch, chunk, scores, caliper, ratio, order):
    monkeypatch.setattr(matching, "CHUNK", chunk)
    rng = random.Random(ratio * 7 + chunk % 5)
    rows = units(rng, 60, lambda r: float(scores(r)), 2)
    df = spark.createDataFrame([(*r, 1) for r in rows] + [(None, True, 1.0, 0, 1), (1000, None, 1.0, 0, 1), (1001, True, None, 0, 1), (1002, False, float("nan"), 0, 1), (1003, True, 1.0, None, 1)], "id long, treat boolean, score double, k int, s int")
    got = greedy_match(df, "id", "treat", "score", ["k"], caliper=caliper, std_caliper=False, ratio=ratio, order=order)
    assert sorted((r["treated"], r["control"], r["distance"]) for r in got.collect()) == greedy(rows, np.inf if caliper is None else caliper, ratio, order)


def test_sweeps_in_chunks_are_one_sweep():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = 30
        s = np.sort(rng.choice(200, n, replace=False))[::-1].astype(float)
        demand, supply = rng.integers(0, 3, n), rng.integers(0, 3, n)
        whole, *_ = sweep(s, demand, supply, 15.0, None, True)
        parts, d, c, at = [], demand.copy(), supply.copy(), 0
        for end in (7, 16, 30):
            flows, stop, d2, c2 = sweep(s[:end], np.where(np.arange(end) >= at, d[:end], 0), c[:end], 15.0, s[end] if end < n else None, True)
            parts += flows
            d[:end], c[:end], at = d2, c2, stop
        assert parts == whole


def test_no_pairs(spark):
    df = spark.createDataFrame([(1, True, 0.5)], "id long, treat boolean, score double")
    assert greedy_match(df, "id", "treat", "score").count() == 0
    assert full_match(df, "id", "treat", "score").count() == 0
    assert greedy_match(df.where("false"), "id", "treat", "score").count() == 0
    with pytest.raises(ValueError):
        greedy_match(df, "id", "treat", "score", order="data")


def least_cover(t, c):
    """Least sum of edges that touch all units, over all choices of a partner for every unit."""
    cost = np.abs(np.array(t)[:, None] - np.array(c)[None, :])
    best = np.inf
    for choice in itertools.product(range(len(c)), repeat=len(t)):
        free = [j for j in range(len(c)) if j not in choice]
        best = min(best, sum(cost[i, j] for i, j in enumerate(choice)) + sum(cost[:, j].min() for j in free))
    return best


@pytest.mark.parametrize("chunk", [2, 5, 1 << 19])
def test_full_matching_has_the_least_total_distance(spark, monkeypatch, chunk):
    monkeypatch.setattr(matching, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows, want = [], {}
    for k in range(14):
        wide = rng.choice([4, 12, 1000])
        t, c = ([float(rng.randrange(wide)) for _ in range(rng.randrange(1, 6))] for _ in range(2))
        if k == 0:
            t, c = [float(x) for x in range(5)], [float(x) for x in range(90, 95)]
        want[k] = least_cover(t, c)
        rows += [(len(rows) + i, 1, x, k) for i, x in enumerate(t)]
        rows += [(len(rows) + i, 0, x, k) for i, x in enumerate(c)]
    df = spark.createDataFrame(rows + [(5000, 1, 1.0, 99)], "id long, treat int, score double, k int")
    pairs = full_match(df, "id", "treat", "score", ["k"]).collect()
    for k, cost in want.items():
        own = [r for r in pairs if r["k"] == k]
        assert sum(r["distance"] for r in own) == pytest.approx(cost)
        for name, arm in (("treated", 1), ("control", 0)):
            assert {r[name] for r in own} == {r[0] for r in rows if r[3] == k and r[1] == arm}
        degree = {}
        for r in own:
            for n in ("treated", "control"):
                degree[r[n]] = degree.get(r[n], 0) + 1
        assert all(degree[r["treated"]] == 1 or degree[r["control"]] == 1 for r in own)


def test_a_line_of_many_units_in_chunks(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, int(rng.random() < 0.5), rng.gauss(0, 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, treat int, score double")
    total = lambda: full_match(df, "id", "treat", "score").agg({"distance": "sum"}).first()[0]
    whole = total()
    monkeypatch.setattr(matching, "CHUNK", 100)
    assert total() == pytest.approx(whole)


def test_states_at_the_ends_of_a_chunk():
    s = np.array([0.0, 1.0, 5.0, 6.0])
    line = Line(s, np.array([1, 1, 0, 0]), np.array([0, 0, 1, 1]), np.array([1, 1, 2, 2]), True, True)
    assert line.states(0) == line.states(-1) == 3
    costs = np.array([line.final(line.solve(q)[0]) for q in range(3)])
    # all treated covered from the left: nothing, or one or two controls at the nearest treated unit
    assert list(costs[2]) == [0.0, 4.0, 9.0] and costs[0][0] == np.inf and costs[0][2] == 10.0


def test_weights(spark):
    pairs = spark.createDataFrame([(1, 11, 0.1), (1, 12, 0.1), (2, 13, 0.1), (3, 13, 0.2), (4, 14, 0.0)], "treated long, control long, distance double")
    got = {(r["unit"], r["treated"]): (r["subclass"]["unit"], r["weight"]) for r in full_match_weights(pairs).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, True): 1, (11, False): 1, (12, False): 1, (2, True): 13, (3, True): 13, (13, False): 13, (4, True): 4, (14, False): 4}
    raw = {11: 0.5, 12: 0.5, 13: 2.0, 14: 1.0}
    assert all(got[u, False][1] == pytest.approx(w * 4 / 4) for u, w in raw.items())
    ate = {(r["unit"], r["treated"]): r["weight"] for r in full_match_weights(pairs, "ATE").collect()}
    assert ate[13, False] / ate[11, False] == pytest.approx(2.0)
    one = {r["unit"]: r["weight"] for r in matched_weights(spark.createDataFrame([(1, 11), (1, 12), (2, 13)], "treated long, control long")).collect()}
    assert one[1] == 1.0 and one[13] == pytest.approx(2 * one[11]) and one[11] + one[12] + one[13] == pytest.approx(3)
