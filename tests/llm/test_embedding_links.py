"""Cover trees and embedding near-duplicates against all pairs."""

import math

import numpy as np
import pytest

from quillstat.llm import embedding_links
from quillstat.llm.cover_tree import CoverTree, distance, dual, joined, spread_points, unit
from quillstat.llm.embedding_links import exact, link


def mixed(rng, n, d):
    """Unit vectors: noise, near copies at many distances, tight families, exact copies."""
    x = rng.normal(size=(n, d))
    for k in range(0, n, 3):
        x[k] = x[rng.integers(n)] + rng.choice([0.01, 0.1, 0.25, 0.45, 0.5]) * rng.normal(size=d)
    x[: n // 8] = x[0] + 0.01 * rng.normal(size=(n // 8, d))
    x[n // 2 : n // 2 + 5] = x[n // 2]
    return unit(x[rng.permutation(n)])


@pytest.mark.parametrize("d", [2, 3, 16, 64])
def test_levels_are_nested_and_cover(d):
    rng = np.random.default_rng(d)
    x = mixed(rng, 400, d)
    tree = CoverTree(x, rng.integers(0, 3, 400), x[:3])
    assert (tree.x == x[tree.order]).all() and sorted(tree.order) == list(range(400))
    for k in range(len(tree.starts) - 1):
        assert set(tree.starts[k]) <= set(tree.starts[k + 1])
        node = np.repeat(np.arange(len(tree.centres[k])), np.diff(tree.starts[k]))
        away = np.linalg.norm(tree.x - tree.centres[k][node], axis=1)
        assert (away <= tree.radius[k][node] + 1e-7).all()
        if 1 <= k < len(tree.starts) - 1:
            assert (tree.radius[k] <= 0.5 ** (k - 1) + 1e-7).all()
            assert set(tree.rows[k - 1]) <= (set(tree.rows[k]) if k < len(tree.rows) else set(range(400)))
    again = CoverTree.from_bytes(tree.to_bytes(), tree.x, x[:3])
    assert all((p == q).all() for name in ("starts", "centres", "radius") for p, q in zip(getattr(tree, name), getattr(again, name), strict=True))


@pytest.mark.parametrize("d", [2, 5, 64])
def test_dual_traversal_finds_exactly_the_near_pairs(d):
    rng = np.random.default_rng(d)
    x, y = mixed(rng, 500, d), mixed(rng, 300, d)
    y[:100] = unit(x[:100] + 0.2 / math.sqrt(d) * rng.normal(size=(100, d)))
    reach = float(distance(np.float64(0.9)))
    a, b = CoverTree(x, np.zeros(500, int), x[:1]), CoverTree(y, np.zeros(300, int), y[:1])
    got = np.zeros((500, 300), int)

    def inside(level, i, j):
        for p, q in zip(i, j, strict=True):
            got[a.starts[level][p] : a.starts[level][p + 1], b.starts[level][q] : b.starts[level][q + 1]] += 1

    def undecided(i, j):
        np.add.at(got, (i, j), exact(a.x[i], b.x[j], 0.9))

    dual(a, b, reach, np.array([0]), np.array([0]), inside, undecided)
    assert (got == (a.x @ b.x.T >= 0.9)).all()


def test_exact_decides_ties_in_double_precision():
    # 9 / 10 exactly, and a little less and more
    a = np.array([[1.0, 0, 0], [9, 3, 3], [1, 0, 0], [1, 0, 0]])
    b = np.array([[9.0, math.sqrt(19) * 0, 0], [9, 3, -3], [0.9, math.sqrt(0.19), 0], [0.9, math.sqrt(0.19) + 1e-9, 0]])
    assert list(exact(a, b, 0.9)) == [True, 81 / 99 >= 0.9, True, False]


def test_spread_points_and_components():
    x = unit(np.random.default_rng(1).normal(size=(50, 3)))
    chosen = spread_points(np.concatenate([x, x]), 80)
    assert len(set(chosen)) == 50
    assert list(joined(6, np.array([4, 1]), np.array([2, 4]))) == [0, 1, 1, 3, 1, 5]


def brute(rows, cosine=0.9):
    ok = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in rows]
    n = len(rows)
    links = np.zeros((n, n), bool)
    for size in {len(v) for (_, v), k in zip(rows, ok, strict=True) if k}:
        own = [i for i in range(n) if ok[i] and len(rows[i][1]) == size]
        x = unit(np.array([rows[i][1] for i in own]))
        links[np.ix_(own, own)] = x @ x.T >= cosine
    np.fill_diagonal(links, False)
    label = joined(n, *np.nonzero(links))
    ids = {}
    for i, k in enumerate(label):
        ids.setdefault(k, []).extend([rows[i][0]] if rows[i][0] is not None else [])
    least = [min(ids[k], default=None) for k in label]
    return sorted(((rows[i][0], int(links[i].sum()), least[i], rows[i][0] == least[i]) for i in range(n)), key=repr)


def rows_of(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("kind", "block", "cosine"), [("float", 4096, 0.9), ("double", 40, 0.9), ("float", 64, 0.5)])
def test_links_are_those_of_all_pairs(spark, kind, block, cosine):
    rng = np.random.default_rng(block)
    x = mixed(rng, 600, 8).astype(np.float32) * rng.uniform(0.1, 9, (600, 1)).astype(np.float32)
    rows = [(i + 10, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(5000 + i, rows[7][1]) for i in range(30)] + [(4, rows[7][1]), (4, rows[300][1]), (None, rows[7][1]), (None, [9.0] + [0.0] * 7)]
    rows += [(7000, None), (7001, []), (7002, [0.0] * 8), (7003, [1.0, None] + [0.0] * 6), (7004, [math.nan] * 8), (7005, [math.inf] + [1.0] * 7), (7006, [1.0, 2.0]), (7007, [1.0, 2.1]), (7008, [3.0])]
    vectors = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, n_links int, node string").repartition(3)
    assert rows_of(link(vectors, cosine, block_rows=block)) == brute(rows, cosine)


def test_extreme_lengths_and_empty_tables(spark):
    rows = [(1, [1e-200, 0.0]), (2, [1e-200, 1e-201]), (3, [1e200, 1e199]), (4, [-1e200, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(link(vectors)) == brute(rows)
    assert link(vectors.where("false")).count() == 0
    with pytest.raises(ValueError):
        link(vectors, cosine=0.0)


def test_hot_keys_are_spread(spark, monkeypatch):
    left = spark.createDataFrame([(k % 3 if k < 100 else 0, k) for k in range(500)], "key long, k long")
    right = spark.createDataFrame([(k, k * 10) for k in range(4)], "key long, v long")
    got = embedding_links.spread_join(left, right, ["key"], together=50)
    assert sorted(map(tuple, got.select("k", "v").collect())) == [(k, 10 * (k % 3 if k < 100 else 0)) for k in range(500)]
