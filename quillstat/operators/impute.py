"""Multiple imputation by chained equations.

All chains are one table (a row for each chain and unit), so a step for one column is one
set of jobs whatever the number of chains: sums of products by chain, of which the
driver solves and draws a few numbers, and a pass that fills the missing rows.  Random
choices are hashes of seed, chain, sweep, column and unit, so they do not depend on how rows
are partitioned; coefficients are rounded to ten digits before they are used, as sums of
floats do.

Predictive mean matching finds the nearest donors by position: donors and missing
rows are put in one order of their predictions by range partitions, each of which is read
once in that order, a missing row taking the donors around it; those beyond the ends of a
partition are known from a few donors at the ends of the others.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstat.functions.dist import t_ppf, t_sf
from quillstat.plans.ordered import cut, running

#: Nearest donors of which one is drawn; most levels of a factor.
DONORS, MOST_LEVELS = 5, 1000
#: Rows of a partition that are matched at a time.
PIECE = 1 << 16
#: Types whose values a double holds exactly, or an index of levels.
_EXACT = ("boolean", "string", "tinyint", "smallint", "int", "float", "double")
_RIDGE = 1e-5


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) by a hash of ``keys``."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 53)) / float(1 << 53)


def _digits(x: np.ndarray, n: int = 10) -> np.ndarray:
    with np.errstate(divide="ignore"):
        size = np.where(x == 0, 0.0, np.floor(np.log10(np.abs(np.where(x == 0, 1.0, x)))))
    unit = 10.0 ** (size - n + 1)
    return np.round(x / unit) * unit


@dataclass
class Imputed:
    """``data``: the completed rows of every chain, with ``imputation`` from 1; ``means``: chain means of imputed numbers by column, chain and sweep."""

    data: DataFrame
    methods: dict[str, str]
    missing: dict[str, int]
    m: int
    means: dict[str, np.ndarray] = field(default_factory=dict)

    def complete(self, k: int) -> DataFrame:
        """The data set of chain ``k``, from 1."""
        if not 1 <= k <= self.m:
            raise ValueError(f"there are {self.m} imputations")
        return self.data.where(F.col("imputation") == k).drop("imputation")

    def pool(self, fit: Callable[[DataFrame], list[dict]], df_complete: float | None = None) -> list[dict]:
        """``fit`` of every data set (rows of term, estimate, std_error), pooled."""
        return pool([fit(self.complete(k)) for k in range(1, self.m + 1)], df_complete)


def pool(fits: list[list[dict]], df_complete: float | None = None, level: float = 0.95) -> list[dict]:
    """Rubin's rules with the degrees of freedom of Barnard and Rubin: term, estimate, std_error, df, statistic, p_value, lower, upper, riv, lambda, fmi."""
    out = []
    m = len(fits)
    for k, row in enumerate(fits[0]):
        q = np.array([f[k]["estimate"] for f in fits], float)
        within, between = float(np.mean([f[k]["std_error"] ** 2 for f in fits])), float(q.var(ddof=1)) if m > 1 else 0.0
        total = within + (1 + 1 / m) * between
        share = (1 + 1 / m) * between / total if total else 0.0
        old = (m - 1) / share**2 if share else math.inf
        df = old
        if df_complete is not None and math.isfinite(df_complete):
            seen = (df_complete + 1) / (df_complete + 3) * df_complete * (1 - share)
            df = seen if math.isinf(old) else old * seen / (old + seen)
        riv = (1 + 1 / m) * between / within if within else math.inf
        fmi = (riv + 2 / (df + 3)) / (riv + 1) if math.isfinite(df) else share
        estimate, se = float(q.mean()), math.sqrt(total)
        wide = min(df, 1e9)
        half = t_ppf(1 - (1 - level) / 2, wide) * se
        stat = estimate / se if se else math.nan
        out.append({"term": row["term"], "estimate": estimate, "std_error": se, "df": df, "statistic": stat, "p_value": 2 * t_sf(abs(stat), wide) if se else math.nan, "lower": estimate - half, "upper": estimate + half, "riv": riv, "lambda": share, "fmi": fmi})
    return out


class _Column:
    """What is known of a column of the model."""

    def __init__(self, name: str, kind: str, levels: list[str], missing: int, observed: int, method: str | None) -> None:
        self.name, self.kind, self.levels, self.missing, self.observed, self.method = name, kind, levels, missing, observed, method

    def coded(self) -> Column:
        c = F.col(f"`{self.name}`")
        if self.kind == "factor":
            return F.array_position(F.array(*(F.lit(x) for x in self.levels)), c.cast("string")).cast("double") - 1
        return c.cast("double")

    def design(self, value: Column) -> list[Column]:
        """The value itself, or indicators of all levels but the first."""
        if self.kind == "factor" and len(self.levels) > 2:
            return [(value == k).cast("double") for k in range(1, len(self.levels))]
        return [value]

    def decoded(self, value: Column, of: str) -> Column:
        if self.kind == "factor":
            return F.get(F.array(*(F.lit(x) for x in self.levels)), value.cast("int")).cast(of)
        return (F.round(value) if of in ("tinyint", "smallint", "int", "bigint") else value).cast(of) if self.kind == "number" else value > 0.5


def _columns(df: DataFrame, names: list[str], methods: dict[str, str]) -> list[_Column]:
    kinds = {n: "boolean" if (k := df.schema[n].dataType.simpleString()) == "boolean" else "factor" if k == "string" else "number" for n in names}
    counts = df.agg(F.count("*").alias("rows"), *(F.count_if(F.col(f"`{n}`").isNull()).alias(f"n{i}") for i, n in enumerate(names))).first()
    rows = counts["rows"]
    out = []
    for i, n in enumerate(names):
        if counts[f"n{i}"] == rows:
            raise ValueError(f"column {n} has no observed values")
        levels: list[str] = []
        if kinds[n] == "factor":
            levels = sorted(r[0] for r in df.select(F.col(f"`{n}`")).where(F.col(f"`{n}`").isNotNull()).distinct().limit(MOST_LEVELS + 1).collect())
            if len(levels) > MOST_LEVELS:
                raise ValueError(f"column {n} has more than {MOST_LEVELS} levels")
        method = None
        if counts[f"n{i}"]:
            method = methods.get(n, "pmm" if kinds[n] == "number" else "logreg" if kinds[n] == "boolean" or len(levels) == 2 else "polyreg")
            if method not in ("pmm", "logreg", "polyreg", "none"):
                raise ValueError(f"unknown method {method!r} for {n}")
            if method == "pmm" and kinds[n] != "number":
                raise ValueError(f"pmm needs a numeric column: {n}")
            if method != "pmm" and method != "none" and kinds[n] == "number":
                raise ValueError(f"{method} needs a factor or boolean column: {n}")
        out.append(_Column(n, kinds[n], levels, counts[f"n{i}"], rows - counts[f"n{i}"], method))
    return out


def chain_sums(df: DataFrame, chains: int, f: Callable[[np.ndarray, int], np.ndarray], size: int) -> np.ndarray:
    """For each chain the sum over batches of ``f(values, chain)``; ``df`` has ``chain`` and doubles."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((chains, size))
        for b in batches:
            chain = b.column(0).to_numpy()
            m = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]])
            for k in np.unique(chain):
                total[k] += f(m[:, chain == k].T, int(k))
        yield pa.RecordBatch.from_pydict({"v": [total.ravel().tolist()]}, schema=pa.schema([("v", pa.list_(pa.float64()))]))

    each = df.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "v"))
    out = np.zeros(chains * size)
    for r in each.groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out.reshape(chains, size)


def impute_chained(df: DataFrame, unit: str, *, columns: list[str] | None = None, methods: dict[str, str] | None = None, m: int = 5, n_iter: int = 5, seed: int = 0) -> Imputed:
    """Completes ``df`` ``m`` times: numbers by predictive mean matching, booleans and factors by (multinomial) logistic draws.

    ``unit`` names rows, once each and never null; ``columns`` (all others by default) are in the model,
    those of method ``none`` are left as they are and do not predict.  Numbers that
    are not a number count as missing.
    """
    if m < 1 or n_iter < 1:
        raise ValueError("m and n_iter must be at least 1")
    names = [c for c in df.columns if c != unit] if columns is None else columns
    methods = dict(methods or {})
    if lost := [c for c in (*names, *methods) if c not in df.columns or c == unit]:
        raise ValueError(f"columns not in data: {lost}")
    of = {n: df.schema[n].dataType.simpleString() for n in names}
    clean = df.withColumns({n: F.when(~F.isnan(F.col(f"`{n}`")), F.col(f"`{n}`")) for n in names if of[n] in ("float", "double")})
    clean = cut(clean)
    every = _columns(clean, names, methods)
    active = [c for c in every if c.method != "none"]
    targets = [c for c in active if c.method]
    place = {c.name: f"v{i}" for i, c in enumerate(active)}
    lacks = {c.name: f"m{i}" for i, c in enumerate(active)}
    coded = clean.select(F.col(f"`{unit}`").alias("u"), *(c.coded().alias(place[c.name]) for c in active), *(F.col(f"`{c.name}`").isNull().alias(lacks[c.name]) for c in targets))
    state = coded.withColumn("chain", F.explode(F.array(*(F.lit(k) for k in range(m)))))
    # the first column is filled before any model reads it
    for k, c in list(enumerate(targets))[1:]:
        state = _start(coded, state, place[c.name], lacks[c.name], c.observed, seed, k)
    state = cut(state)
    means = {c.name: np.zeros((m, n_iter)) for c in targets if c.kind == "number"}
    for sweep in range(n_iter):
        for k, c in enumerate(targets):
            x = [F.lit(1.0)] + [d for o in active if o is not c for d in o.design(F.col(place[o.name]))]
            rng = [np.random.default_rng([seed, chain, sweep, k]) for chain in range(m)]
            keys = (F.lit(seed), F.lit(sweep), F.lit(k), F.col("chain"), F.col("u"))
            if c.method == "pmm":
                filled = cut(_matched(state, place[c.name], lacks[c.name], x, m, rng, keys))
                for r in filled.groupBy("chain").agg(F.avg(place[c.name]).alias("v")).collect():
                    means[c.name][r["chain"], sweep] = r["v"]
                # a union has the partitions of both; so they do not add up over the steps
                most = max(d.rdd.getNumPartitions() for d in (state, filled))
                state = state.where(~F.col(lacks[c.name])).unionByName(filled).coalesce(most)
            else:
                state = _drawn(state, place[c.name], lacks[c.name], x, max(2, len(c.levels)), m, rng, keys)
            if sweep < n_iter - 1 or c is not targets[-1]:
                state = cut(state)
    # columns that the chains hold exactly are read from them; only others are joined
    held = {c.name: c for c in active if c.method or of[c.name] in _EXACT}
    filled = state.select((F.col("chain") + 1).alias("imputation"), F.col("u").alias(unit), *(F.col(place[n]).alias(f"__{place[n]}") for n in held))
    data = filled.join(clean, unit) if set(df.columns) - {unit, *held} else filled
    kept = {n: c.decoded(F.col(f"__{place[n]}"), of[n]) for n, c in held.items()}
    data = data.select("imputation", *(kept[n].alias(n) if n in kept else F.col(f"`{n}`") for n in df.columns))
    return Imputed(cut(data), {c.name: c.method for c in targets}, {c.name: c.missing for c in targets}, m, means)


def _start(coded: DataFrame, state: DataFrame, value: str, lack: str, n: int, seed: int, k: int) -> DataFrame:
    """``state`` with missing ``value`` drawn from the ``n`` observed ones, by their positions in a hashed order."""
    seen = coded.where(~F.col(lack)).select("u", F.col(value).alias("__v"), F.struct(F.xxhash64(F.lit(seed), F.lit(k), "u").alias("h"), "u").alias("__o"), F.lit(1).cast("long").alias("__one"))
    seen = running(seen, "__o", {"__at": ("sum", "__one")}, rows=n, fixed=True).select((F.col("__at") - 1).alias("__at"), "__v")
    at = F.when(F.col(lack), F.floor(uniform(F.lit(seed), F.lit(-1), F.lit(k), F.col("chain"), F.col("u")) * n))
    lacking = state.where(lack).withColumn("__at", at).join(seen, "__at").withColumn(value, F.col("__v")).select(*state.columns)
    return state.where(~F.col(lack)).unionByName(lacking)


def _matched(state: DataFrame, value: str, lack: str, x: list[Column], m: int, rng: list, keys: tuple) -> DataFrame:
    """The rows of ``state`` that lack ``value``, filled."""
    p = len(x)
    rows = state.withColumns({f"x{i}": c for i, c in enumerate(x)})
    names = [f"x{i}" for i in range(p)]
    seen = rows.where(~F.col(lack)).select("chain", *names, F.col(value).alias("y"))

    def sums(v, _):
        a = np.column_stack([v, np.ones(len(v))])
        return (a.T @ a).ravel()

    gram = chain_sums(seen, m, sums, (p + 2) ** 2).reshape(m, p + 2, p + 2)
    fits, draws = [], []
    for g, r in zip(gram, rng, strict=True):
        beta, star = posterior(g, r)
        fits.append(beta)
        draws.append(star)
    return nearest_donors(rows, value, lack, names, np.array(fits), np.array(draws), keys).select(*state.columns)


def posterior(gram: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Least squares, and one draw of the coefficients under a flat prior, from the products of (x, y, 1)."""
    p, n = len(gram) - 2, gram[-1, -1]
    xx, xy, yy = gram[:p, :p], gram[:p, p], gram[p, p]
    xx = xx + np.diag(np.diag(xx)) * _RIDGE
    v = np.linalg.pinv(xx)
    beta = v @ xy
    rest = max(float(yy - 2 * beta @ xy + beta @ gram[:p, :p] @ beta), 0.0)
    sigma = math.sqrt(rest / rng.chisquare(max(n - p, 1)))
    size, axes = np.linalg.eigh((v + v.T) / 2)
    root = axes @ np.diag(np.sqrt(np.maximum(size, 0.0))) @ axes.T
    return _digits(beta), _digits(beta + sigma * root @ rng.standard_normal(p))


def _by_chain(values: np.ndarray, names: list[str]) -> Column:
    """The inner product of columns with the chain's row of ``values``."""
    table = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in values))
    own = F.get(table, F.col("chain"))
    return sum((F.col(n) * F.get(own, F.lit(i)) for i, n in enumerate(names)), F.lit(0.0))


def nearest_donors(rows: DataFrame, value: str, lack: str, names: list[str], fits: np.ndarray, draws: np.ndarray, keys: tuple) -> DataFrame:
    """The rows that lack ``value``, without ``names``, each with that of one of the DONORS observed rows whose prediction is nearest to its own.

    Missing rows are predicted by the drawn coefficients, observed ones by the fitted.
    Ties in the order of donors are broken by hash.
    """
    mine, rest = F.col(lack), [c for c in rows.columns if c not in (*names, "chain", value)]
    line = rows.select(
        "chain", F.when(mine, F.lit(0)).otherwise(F.lit(1)).alias("k"), F.when(mine, _by_chain(draws, names)).otherwise(_by_chain(fits, names)).alias("y"), F.xxhash64(*keys).alias("h"), F.col("u").alias("__u"),
        F.when(~mine, F.col(value).cast("double")).alias("v"), F.when(mine, uniform(*keys, F.lit("donor"))).alias("r"), F.when(mine, F.struct(*rest)).alias("row"),
    )
    # missing rows stand before donors of the same prediction
    order = ["y", "k", "h", "__u"]
    line = line.repartitionByRange("chain", *order).sortWithinPartitions(*order)
    line = cut(line.select(F.spark_partition_id().alias("part"), "chain", "k", "y", "v", "r", "row"))
    ends = line.where("k = 1").select("part", "chain", "y", "v").mapInArrow(_ends, "part int, chain int, i int, y double, v double")
    by_chain: dict[int, list] = {}
    for r in sorted(ends.collect()):  # at most 2 * DONORS for each partition and chain in it
        by_chain.setdefault(r["chain"], []).append((r["part"], r["y"], r["v"]))
    edges = {k: np.array(e) for k, e in by_chain.items()}
    out = ["chain", value, *rest]

    def run(batches):
        import pyarrow as pa

        lines: dict[int, _Line] = {}
        for b in batches:
            chain = b.column(1).to_numpy()
            for k in np.unique(chain).tolist():
                if k not in lines:
                    lines[k] = _Line(edges.get(k, np.zeros((0, 3))), b.column(0)[0].as_py(), out)
                yield from lines[k].add(b.filter(pa.array(chain == k)))
        for held in lines.values():
            yield from held.match(last=True)

    return line.mapInArrow(run, T.StructType([rows.schema[c] for c in out])).select(*(c for c in rows.columns if c not in names))


def _ends(batches):
    """The first and the last DONORS donors of each chain in a partition, by their number there."""
    import pyarrow as pa

    first: dict[int, list] = {}
    last: dict[int, list] = {}
    part, n = 0, {}
    for b in batches:
        if not b.num_rows:
            continue
        part = b.column(0)[0].as_py()
        chain, y, v = (c.to_numpy(zero_copy_only=False) for c in b.columns[1:])
        for k in np.unique(chain).tolist():
            at = np.flatnonzero(chain == k)
            number = n.get(k, 0) + np.arange(len(at))
            n[k] = n.get(k, 0) + len(at)
            some = lambda i: list(zip(number[i].tolist(), y[at[i]].tolist(), v[at[i]].tolist(), strict=True))  # noqa: B023, E731
            first[k] = (first.get(k, []) + some(slice(0, DONORS)))[:DONORS]
            last[k] = (last.get(k, []) + some(slice(-DONORS, None)))[-DONORS:]
    rows = [(part, k, *r) for k in first for r in sorted({*first[k], *last[k]})]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))], ["part", "chain", "i", "y", "v"])


class _Line:
    """A chain's rows of one partition in their order, of which those are held whose next donors are not yet known."""

    def __init__(self, edges: np.ndarray, part: int, out: list[str]) -> None:
        self.before, self.after = edges[edges[:, 0] < part][-DONORS:, 1:], edges[edges[:, 0] > part][:DONORS, 1:]
        self.out, self.held = out, []
        self.rows, self.enough = 0, PIECE

    def add(self, batch):
        self.held.append(batch)
        self.rows += batch.num_rows
        if self.rows >= self.enough:
            yield from self.match()

    def match(self, last: bool = False):
        """The missing rows that have all their donors, filled; the others stay."""
        import pyarrow as pa

        b = pa.Table.from_batches(self.held).combine_chunks()
        kind, y, v = (b.column(c).to_numpy() for c in ("k", "y", "v"))
        donors = np.flatnonzero(kind == 1)
        if not last and len(donors) <= DONORS:
            self.held, self.enough = b.to_batches(), 2 * self.rows
            return
        n = len(kind) if last else donors[-DONORS]
        near = np.concatenate([self.before, np.column_stack([y[donors], v[donors]]), self.after if last else np.zeros((0, 2))])
        lacking = np.flatnonzero(kind[:n] == 0)
        if len(lacking):
            place = len(self.before) + np.searchsorted(donors, lacking)[:, None] + np.arange(-DONORS, DONORS)
            there = (place >= 0) & (place < len(near))
            gap = np.where(there, np.abs(near[place.clip(0, len(near) - 1), 0] - y[lacking, None]), np.nan)
            pick = np.floor(b.column("r").to_numpy()[lacking] * np.minimum(there.sum(axis=1), DONORS)).astype(int)
            rank = np.argsort(gap, axis=1, kind="stable")  # of equal gaps the lower place
            chosen = np.take_along_axis(place, np.take_along_axis(rank, pick[:, None], 1), 1)[:, 0]
            own = b.take(pa.array(lacking))
            rest = own.column("row").combine_chunks()
            rest = rest.chunk(0) if isinstance(rest, pa.ChunkedArray) else rest
            columns = [own.column("chain").combine_chunks(), pa.array(near[chosen, 1]), *rest.flatten()]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays(columns, self.out)
        self.before = near[: len(self.before) + np.searchsorted(donors, n)][-DONORS:]
        self.held, self.rows, self.enough = b.slice(n).to_batches(), len(kind) - n, max(PIECE, 2 * (len(kind) - n))


def _drawn(state: DataFrame, value: str, lack: str, x: list[Column], levels: int, m: int, rng: list, keys: tuple) -> DataFrame:
    """Draws levels from a multinomial logistic model whose coefficients are drawn; nothing moves between tasks."""
    p, q = len(x), levels - 1
    names = [f"x{i}" for i in range(p)]
    rows = state.withColumns({f"x{i}": c for i, c in enumerate(x)})
    seen = rows.where(~F.col(lack)).select("chain", *names, F.col(value).alias("y")).persist(StorageLevel.MEMORY_AND_DISK)
    points = np.zeros((m, p * q))
    ridge = None
    for _ in range(50):
        out = chain_sums(seen, m, lambda v, k, points=points: softmax_sums(v, points[k].reshape(p, q)), p * q * (p * q + 1) + 1)
        g, h = out[:, 1 : 1 + p * q], out[:, 1 + p * q :].reshape(m, p * q, p * q)
        if ridge is None:
            ridge = _RIDGE * (1 + np.array([np.trace(a) for a in h]) / (p * q))
        h = h + ridge[:, None, None] * np.eye(p * q)
        move = np.array([np.linalg.solve(a, b) for a, b in zip(h, g - ridge[:, None] * points, strict=True)])
        size = np.abs(move).max(axis=1, keepdims=True)
        points = points + move * np.minimum(1.0, 5.0 / np.maximum(size, 1e-300))
        if size.max() < 1e-7:
            break
    seen.unpersist()
    drawn = np.array([_digits(b + np.linalg.cholesky(np.linalg.inv(a) + 1e-10 * np.eye(p * q)) @ r.standard_normal(p * q)) for a, b, r in zip(h, points, rng, strict=True)]).reshape(m, p, q)
    logits = [F.lit(0.0)] + [_by_chain(drawn[:, :, j], names) for j in range(q)]
    rows = rows.withColumns({f"l{j}": F.when(F.col(lack), c) for j, c in enumerate(logits)})
    top = F.greatest(*(f"l{j}" for j in range(levels)))
    rows = rows.withColumns({f"e{j}": F.exp(F.col(f"l{j}") - top) for j in range(levels)})
    # the first level whose share of the sum, with those before it, passes the draw
    mark = uniform(*keys) * sum((F.col(f"e{j}") for j in range(levels)), F.lit(0.0))
    upto, passed = F.lit(0.0), F.lit(0)
    for j in range(q):
        upto = upto + F.col(f"e{j}")
        passed = passed + (mark >= upto).cast("int")
    return rows.withColumn(value, F.when(F.col(lack), passed.cast("double")).otherwise(F.col(value))).select(*state.columns)


def softmax_sums(v: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """Log-likelihood, gradient and information of a multinomial logistic model, the first level being the base, over rows (x, y)."""
    x, y = np.ascontiguousarray(v[:, :-1].T), v[:, -1].astype(int)
    (p, q), n = coef.shape, len(y)
    logits = np.concatenate([np.zeros((1, n)), coef.T @ x])
    logits -= logits.max(axis=0)
    prob = np.exp(logits)
    prob /= prob.sum(axis=0)
    ll = np.log(prob[y, np.arange(n)]).sum()
    hit = (y == np.arange(1, q + 1)[:, None]) - prob[1:]
    # every variable times every level's share: the information is sums of products of these
    wx = (x[:, None, :] * prob[None, 1:, :]).reshape(p * q, n)
    h = -(wx @ wx.T).reshape(p, q, p, q)
    own = (wx @ x.T).reshape(p, q, p)
    for a in range(q):
        h[:, a, :, a] += own[:, a]
    return np.concatenate([[ll], (x @ hit.T).ravel(), h.ravel()])
