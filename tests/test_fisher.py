"""The exact test of R x C tables against enumeration."""

import math
import random

import numpy as np
import pytest

from quillstat.operators.fisher import exact_p, fisher_test


def tables(rows, columns):
    """All tables with these margins."""
    if len(columns) == 1:
        if all(r >= 0 for r in rows) and sum(rows) == columns[0]:
            yield [list(rows)]
        return
    def fills(left, total):
        if len(left) == 1:
            if 0 <= total <= left[0]:
                yield [total]
            return
        for k in range(min(left[0], total) + 1):
            for more in fills(left[1:], total - k):
                yield [k, *more]
    for fill in fills(rows, columns[0]):
        for rest in tables([r - k for r, k in zip(rows, fill, strict=True)], columns[1:]):
            yield [fill, *rest]


def brute(table):
    m = np.array(table)
    weight = lambda t: math.exp(-sum(math.lgamma(v + 1) for c in t for v in c))
    own = weight(m.T.tolist())
    every = [weight(t) for t in tables(m.sum(1).tolist(), m.sum(0).tolist())]
    return sum(w for w in every if w <= own * (1 + 1e-7)) / sum(every)


@pytest.mark.parametrize("shape", [(2, 2), (3, 3), (3, 4), (4, 3), (2, 5)])
def test_p_is_that_of_all_tables(shape):
    rng = random.Random(sum(shape))
    for _ in range(6):
        table = [[rng.randrange(4) for _ in range(shape[1])] for _ in range(shape[0])]
        if sum(map(sum, table)):
            assert exact_p(table) == pytest.approx(brute(table), rel=1e-6)


def test_known_and_degenerate_tables():
    # job satisfaction by income, a textbook table
    assert exact_p([[1, 2, 1, 0], [3, 3, 6, 1], [10, 10, 14, 9], [6, 7, 12, 11]]) == pytest.approx(0.7827, abs=5e-5)
    assert exact_p([[3, 0], [5, 0]]) == 1.0
    with pytest.raises(ValueError):
        exact_p([[0, 0], [0, 0]])


def test_of_a_table(spark):
    rows = [("a", "x")] * 5 + [("a", "y")] * 1 + [("b", "x")] * 2 + [("b", "z")] * 6 + [("c", "y")] * 3 + [(None, "x")]
    got = fisher_test(spark.createDataFrame(rows, "r string, c string"), "r", "c")
    assert got["n"] == 17 and got["p_value"] == pytest.approx(brute([[5, 1, 0], [2, 0, 6], [0, 3, 0]]))
    with pytest.raises(ValueError):
        fisher_test(spark.createDataFrame([], "r string, c string"), "r", "c")
