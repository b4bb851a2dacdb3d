"""Chained imputation against brute force, across partitionings, and pooling."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstat.operators import impute
from quillstat.operators.impute import DONORS, impute_chained, nearest_donors, pool, posterior, softmax_sums


def sample(rng, n=300):
    rows = []
    for i in range(n):
        x = rng.gauss(0, 1)
        y = 2 + 1.5 * x + rng.gauss(0, 0.5)
        g = "abc"[min(2, max(0, round(1 + x + rng.gauss(0, 0.5))))]
        b = rng.random() < 1 / (1 + math.exp(-2 * x))
        rows.append((i, x, None if rng.random() < 0.25 else y, None if rng.random() < 0.2 else g, None if rng.random() < 0.2 else b, rng.choice([1, 2, 3, None])))
    return rows


COLUMNS = "id long, x double, y double, g string, b boolean, k int"


def test_the_same_table_however_partitioned(spark):
    df = spark.createDataFrame(sample(random.Random(1)), COLUMNS)
    got = [impute_chained(df.repartition(n), "id", m=2, n_iter=1, seed=7) for n in (1, 7)]
    rows = [sorted(map(tuple, r.data.collect())) for r in got]
    assert rows[0] == rows[1] and len(rows[0]) == 600
    assert got[0].data.columns == ["imputation", *df.columns] and got[0].data.dtypes[1:] == df.dtypes
    assert got[0].methods == {"y": "pmm", "g": "polyreg", "b": "logreg", "k": "pmm"}
    first = {r["id"]: r for r in df.collect()}
    seen = {c: {r[c] for r in first.values()} - {None} for c in ("y", "g", "b", "k")}
    for r in got[0].data.collect():
        for c in df.columns:
            assert r[c] == first[r["id"]][c] if first[r["id"]][c] is not None else r[c] in seen[c]
    other = impute_chained(df, "id", columns=["x", "y"], m=1, n_iter=1, seed=8)
    assert {r["id"]: r["y"] for r in other.data.collect()} != {r["id"]: r["y"] for r in got[0].complete(1).collect()}
    assert got[0].complete(2).count() == 300 and got[0].means["y"].shape == (2, 1)


def test_donors_are_among_the_nearest(spark):
    rng = random.Random(2)
    rows = [(c, i, float(rng.randrange(10)), None if (gone := rng.random() < 0.3) else float(i * 10 + c), gone) for c in range(2) for i in range(80)]
    df = spark.createDataFrame([(c, u, 1.0, x, v, m) for c, u, x, v, m in rows], "chain int, u long, x0 double, x1 double, v double, m boolean").repartition(3)
    fits, draws = np.array([[0.0, 1.0], [1.0, -2.0]]), np.array([[0.3, 1.1], [0.8, -1.9]])
    keys = (F.lit(1), F.col("chain"), F.col("u"))
    got = {(r["chain"], r["u"]): r["v"] for r in nearest_donors(df, "v", "m", ["x0", "x1"], fits, draws, keys).collect()}
    assert set(got) == {(c, u) for c, u, _, _, m in rows if m}
    for c, u, x, _, m in rows:
        if m:
            mine = draws[c] @ [1.0, x]
            gaps = {v: abs(fits[c] @ [1.0, xd] - mine) for cc, _, xd, v, md in rows if cc == c and not md}
            limit = sorted(gaps.values())[DONORS - 1]
            assert gaps[got[c, u]] <= limit + 1e-9
    few = df.where("m or u < 3")
    assert nearest_donors(few, "v", "m", ["x0", "x1"], fits, draws, keys).count() == len(got)


def test_estimates_are_near_the_truth(spark):
    df = spark.createDataFrame(sample(random.Random(3), 1500), COLUMNS).select("id", "x", F.when((F.col("x") < 0.3) | (F.col("id") % 3 > 0), F.col("y")).alias("y"))
    done = impute_chained(df, "id", m=3, n_iter=1, seed=1)

    def slope(d):
        r = d.agg(F.regr_slope("y", "x").alias("b"), F.regr_r2("y", "x").alias("r"), F.var_samp("y").alias("v"), F.var_samp("x").alias("w"), F.count("*").alias("n")).first()
        return [{"term": "x", "estimate": r["b"], "std_error": math.sqrt((1 - r["r"]) * r["v"] / r["w"] / (r["n"] - 2))}]

    row = done.pool(slope, df_complete=1498)[0]
    assert row["estimate"] == pytest.approx(1.5, abs=0.1) and row["lower"] < 1.5 < row["upper"] and 0 < row["fmi"] < 1 and row["df"] < 1498


def test_pooling():
    fits = [[{"term": "a", "estimate": e, "std_error": s}] for e, s in ((1.0, 0.5), (1.2, 0.4), (0.7, 0.6))]
    r = pool(fits, df_complete=50)[0]
    w, b = (0.25 + 0.16 + 0.36) / 3, np.var([1.0, 1.2, 0.7], ddof=1)
    total = w + 4 / 3 * b
    lam = 4 / 3 * b / total
    old, seen = 2 / lam**2, 51 / 53 * 50 * (1 - lam)
    assert r["std_error"] == pytest.approx(math.sqrt(total)) and r["df"] == pytest.approx(old * seen / (old + seen)) and r["lambda"] == pytest.approx(lam)
    assert pool(fits)[0]["df"] == pytest.approx(old)
    same = pool([fits[0]] * 3)[0]
    assert math.isinf(same["df"]) and same["std_error"] == pytest.approx(0.5)


def test_posterior_and_softmax():
    rng = np.random.default_rng(5)
    x = np.column_stack([np.ones(4000), rng.normal(size=4000)])
    y = x @ [1.0, 2.0] + rng.normal(size=4000)
    a = np.column_stack([x, y, np.ones(4000)])
    draws = np.array([posterior(a.T @ a, np.random.default_rng(k))[1] for k in range(400)])
    assert posterior(a.T @ a, rng)[0] == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0], rel=1e-3)
    assert draws.std(0) == pytest.approx(np.sqrt(np.diag(np.linalg.inv(x.T @ x))), rel=0.15)
    v, coef = np.column_stack([x[:50], rng.integers(0, 3, 50)]), rng.normal(size=(2, 2))
    out = softmax_sums(v, coef)
    for k in range(4):
        step = np.zeros(4)
        step[k] = 1e-6
        up, down = (softmax_sums(v, coef + s * step.reshape(2, 2)) for s in (1, -1))
        assert (up[0] - down[0]) / 2e-6 == pytest.approx(out[1 + k], rel=1e-5, abs=1e-5)
        assert -(up[1:5] - down[1:5]) / 2e-6 == pytest.approx(out[5 + 4 * k : 9 + 4 * k], rel=1e-5, abs=1e-5)


def test_wrong_calls(spark):
    df = spark.createDataFrame(sample(random.Random(1), 20), COLUMNS)
    for wrong in ({"m": 0}, {"columns": ["nope"]}, {"methods": {"g": "pmm"}}, {"methods": {"y": "logreg"}}, {"methods": {"y": "magic"}}):
        with pytest.raises(ValueError):
            impute_chained(df, "id", **wrong)
    with pytest.raises(ValueError):
        impute_chained(df.withColumn("y", F.lit(None).cast("double")), "id")
    left = impute_chained(df, "id", methods={"g": "none"}, m=1, n_iter=1)
    assert left.data.where("g is null").count() == df.where("g is null").count() and "g" not in left.methods


def test_donors_need_no_join_and_cross_partitions(spark):
    rng = random.Random(4)
    rows = [(c, i, 1.0, float(rng.randrange(12)), None if (gone := rng.random() < 0.4) else float(i * 10 + c), gone) for c in range(2) for i in range(90)]
    df = spark.createDataFrame(rows, "chain int, u long, x0 double, x1 double, v double, m boolean").repartition(5)
    fits, draws = np.array([[0.0, 1.0], [1.0, -2.0]]), np.array([[0.3, 1.1], [0.8, -1.9]])
    names, keys = ["x0", "x1"], (F.lit(1), F.col("chain"), F.col("u"))
    predicted = lambda coef, x: float(coef[0]) + x * float(coef[1])
    # the same by all pairs
    mine = {(r["chain"], r["u"]): (r["h"], r["r"]) for r in df.select("chain", "u", F.xxhash64(*keys).alias("h"), impute.uniform(*keys, F.lit("donor")).alias("r")).collect()}
    want = {}
    for c, u, _, x, _, m in rows:
        if m:
            y = predicted(draws[c], x)
            line = sorted((predicted(fits[c], xd), mine[cc, ud][0], ud, v) for cc, ud, _, xd, v, md in rows if cc == c and not md)
            at = sum(d[0] < y for d in line)
            around = sorted((abs(line[i][0] - y), i) for i in range(max(0, at - DONORS), min(len(line), at + DONORS)))
            want[c, u] = line[around[int(mine[c, u][1] * min(len(around), DONORS))][1]][3]
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for parts in ("1", "70"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = nearest_donors(df, "v", "m", names, fits, draws, keys)
            assert "Join" not in got._jdf.queryExecution().toString()
            assert {(r["chain"], r["u"]): r["v"] for r in got.collect()} == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_partition_in_pieces(monkeypatch):
    pa = pytest.importorskip("pyarrow")
    rng = np.random.default_rng(6)
    for share in (0.7, 0.05):
        n = 200
        kind = (rng.random(n) < share).astype(np.int32)
        kind[:3] = kind[-3:] = [0, 1, 0]
        cols = {"part": np.full(n, 2, np.int32), "chain": np.zeros(n, np.int32), "k": kind, "y": np.sort(rng.integers(0, 40, n)).astype(float), "v": np.arange(n) * 1.0, "r": rng.random(n)}
        batch = pa.RecordBatch.from_arrays([*map(pa.array, cols.values()), pa.StructArray.from_arrays([pa.array(np.arange(n))], ["u"])], [*cols, "row"])
        edges = np.array([(p, y, 1000 + p) for p, y in ((0, -9.0), (1, -2.0), (1, -1.0), (2, 7.0), (3, 41.0), (5, 44.0))])
        got = []
        for piece in (1000, 7, 1):
            monkeypatch.setattr(impute, "PIECE", piece)
            line = impute._Line(edges, 2, ["chain", "v", "u"])
            out = [o for at in range(0, n, 9) for o in line.add(batch.slice(at, 9))] + list(line.match(last=True))
            got.append(sorted(zip(*(c.to_pylist() for c in pa.Table.from_batches(out).select(["u", "v"]).columns), strict=True)))
        assert got[0] == got[1] == got[2] and [u for u, _ in got[0]] == np.flatnonzero(kind == 0).tolist()


def test_partitions_do_not_add_up(spark):
    df = spark.createDataFrame(sample(random.Random(1), 60), COLUMNS).select("id", "x", "g", "b", "k").repartition(3)
    n = [impute_chained(df, "id", m=1, n_iter=i, seed=1).data.rdd.getNumPartitions() for i in (1, 3)]
    assert n[0] >= n[1]
