"""Conditional inference trees for a numeric outcome, grown level by level.

A level of the tree is a few jobs for all its open nodes: sums of products by node give
the permutation statistics of numeric predictors, counts and sums by node and level those of
factors, and running sums over the distinct values of the chosen predictors the best
breaks.  The driver holds the nodes and the sums of factor levels, nothing of a row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstat.functions.dist import chi2_sf
from quillstat.plans.ordered import cut, running

#: Most levels of a factor; up to so many all partitions are tried, beyond those along the means.
MOST_LEVELS, ALL_PARTITIONS = 1000, 12


@dataclass
class Node:
    """A node: its rows' number and mean, the tests made at it, and its split (``at`` of a number, ``left`` and ``right`` levels of a factor)."""

    n: int
    mean: float
    tests: dict[str, tuple[float, float]] = field(default_factory=dict)
    column: str | None = None
    at: float | None = None
    levels: tuple[tuple[str, ...], tuple[str, ...]] | None = None
    left: Node | None = None
    right: Node | None = None


@dataclass
class ConditionalTree:
    root: Node
    predictors: list[str]
    factors: set[str]

    def n_terminal(self) -> int:
        def count(node: Node) -> int:
            return 1 if node.column is None else count(node.left) + count(node.right)

        return count(self.root)

    def tests(self) -> list[dict]:
        """(term, statistic, p_value) of the root's predictors, p adjusted for their number."""
        return [{"term": k, "statistic": s, "p_value": p} for k, (s, p) in self.root.tests.items()]

    def format(self, digits: int = 3) -> str:
        """The tree as text, nodes numbered depth first."""
        lines: list[str] = []

        def visit(node: Node, depth: int, label: str) -> None:
            head = f"{'|   ' * depth}[{len(lines) + 1}] {label}"
            if node.column is None:
                lines.append(f"{head}: {node.mean:.{digits}f} (n = {node.n})")
                return
            lines.append(head)
            for k, child in enumerate((node.left, node.right)):
                said = f"{node.column} {('<=', '>')[k]} {node.at:.{digits}g}" if node.at is not None else f"{node.column} in {{{', '.join(node.levels[k])}}}"
                visit(child, depth + 1, said)

        visit(self.root, 0, "root")
        return "\n".join(lines) + "\n"

    def predict(self, df: DataFrame, name: str = "fit") -> DataFrame:
        """``df`` with the mean of each row's terminal node; null where a split's column is missing or has a level that the split has not seen."""

        def value(node: Node) -> Column:
            if node.column is None:
                return F.lit(float(node.mean))
            left, right = _sides(node, node.column in self.factors)
            return F.when(left, value(node.left)).when(right, value(node.right))

        return df.withColumn(name, value(self.root))


def _sides(node: Node, factor: bool, column: Column | None = None) -> tuple[Column, Column]:
    c = F.col(f"`{node.column}`") if column is None else column
    if factor:
        c = c.cast("string")
        return c.isin(*node.levels[0]), c.isin(*node.levels[1])
    c = c.cast("double")
    return ~F.isnan(c) & (c <= node.at), ~F.isnan(c) & (c > node.at)


def conditional_tree(df: DataFrame, outcome: str, predictors: list[str], *, alpha: float = 0.05, min_split: int = 20, min_bucket: int = 7, min_share: float = 0.01, tries: int = 2, max_depth: int = 30) -> ConditionalTree:
    """Grows the tree: the predictor of the least adjusted p below ``alpha`` splits, where its two-sample statistic is greatest.

    Strings and booleans are factors.  A side needs ``min_bucket`` rows and a share of
    ``min_share``; if the best predictor has no such break the next are tried, ``tries`` in all.
    Values equal to a break go left; of equal breaks the least counts.  Rows that lack
    the outcome or a predictor are left out.
    """
    if not predictors or not 0 < alpha < 1:
        raise ValueError("there must be predictors, and alpha between 0 and 1")
    factors = {c for c in predictors if isinstance(df.schema[c].dataType, (T.StringType, T.BooleanType))}
    rows = df.select(F.col(outcome).cast("double").alias("y"), *(F.col(f"`{c}`").cast("string" if c in factors else "double").alias(f"x{i}") for i, c in enumerate(predictors)))
    for c, kind in rows.dtypes:
        rows = rows.where(F.col(c).isNotNull() if kind == "string" else F.col(c).isNotNull() & ~F.isnan(c))
    one = rows.agg(F.count("*").alias("n"), F.avg("y").alias("m"), *(F.avg(f"x{i}").alias(f"m{i}") for i, c in enumerate(predictors) if c not in factors), *(F.approx_count_distinct(f"x{i}").alias(f"m{i}") for i, c in enumerate(predictors) if c in factors)).first()
    if one["n"] < 2:
        raise ValueError("the outcome needs at least two rows")
    for i, c in enumerate(predictors):
        if c in factors and one[f"m{i}"] > 1.1 * MOST_LEVELS:
            raise ValueError(f"{c} has more than {MOST_LEVELS} levels")
    # values near their means, so that sums of squares keep their digits
    rows = rows.withColumn("y", F.col("y") - F.lit(one["m"])).withColumns({f"c{i}": F.col(f"x{i}") - F.lit(one[f"m{i}"]) for i, c in enumerate(predictors) if c not in factors})
    rows = cut(rows.withColumn("node", F.lit(0).cast("long")))
    root = Node(one["n"], one["m"])
    open_nodes, number = {0: root}, 0
    for _ in range(max_depth):
        if not (open_nodes := {k: v for k, v in open_nodes.items() if v.n >= min_split}):
            break
        rows = rows.where(F.col("node").isin(*open_nodes))
        sums = _sums(rows, predictors, factors)
        levels = _level_sums(rows, [i for i, c in enumerate(predictors) if c in factors])
        wanted: dict[int, list[int]] = {}
        for k, node in open_nodes.items():
            stats = {i: s for i, c in enumerate(predictors) if (s := _statistic(sums[k], levels.get((k, i)), i, c in factors)) is not None}
            wanted[k] = _ranked(node, stats, predictors, alpha, tries)
        breaks = _breaks(rows, {k: [i for i in v if predictors[i] not in factors] for k, v in wanted.items()}, sums, {k: max(min_bucket, math.ceil(min_share * v.n)) for k, v in open_nodes.items()})
        children: dict[int, Node] = {}
        sides = []
        for k, node in open_nodes.items():
            least = max(min_bucket, math.ceil(min_share * node.n))
            for i in wanted[k]:
                c = predictors[i]
                if c in factors:
                    node.levels = _partition(levels[k, i], sums[k], least)
                    if node.levels is None:
                        continue
                elif (k, i) in breaks:
                    node.at = breaks[k, i]
                else:
                    continue
                node.column = c
                left, right = _sides(node, c in factors, F.col(f"x{i}"))
                sides.append((k, number + 1, number + 2, left, right))
                number += 2
                break
        if not sides:
            break
        to = F.lit(None).cast("long")
        for k, a, b, left, right in sides:
            to = F.when((F.col("node") == k) & left, a).when((F.col("node") == k) & right, b).otherwise(to)
        rows = cut(rows.withColumn("node", to).where("node is not null"))
        found = {r["node"]: r for r in rows.groupBy("node").agg(F.count("*").alias("n"), F.avg("y").alias("m")).collect()}
        for k, a, b, _, _ in sides:
            node = open_nodes[k]
            node.left, node.right = (Node(found[x]["n"], found[x]["m"] + one["m"]) for x in (a, b))
            children |= {a: node.left, b: node.right}
        open_nodes = children
    return ConditionalTree(root, predictors, factors)


def _sums(rows: DataFrame, predictors: list[str], factors: set[str]) -> dict[int, dict]:
    aggs = [F.count("*").alias("n"), F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("yy")]
    for i, c in enumerate(predictors):
        if c not in factors:
            x = F.col(f"c{i}")
            aggs += [F.sum(x).alias(f"s{i}"), F.sum(x * x).alias(f"q{i}"), F.sum(x * F.col("y")).alias(f"p{i}")]
    return {r["node"]: r.asDict() for r in rows.groupBy("node").agg(*aggs).collect()}


def _level_sums(rows: DataFrame, which: list[int]) -> dict[tuple[int, int], list[tuple[str, int, float]]]:
    out: dict[tuple[int, int], list[tuple[str, int, float]]] = {}
    for i in which:
        for r in rows.groupBy("node", f"x{i}").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect():
            out.setdefault((r["node"], i), []).append((r[f"x{i}"], r["n"], r["y"]))
    return {k: sorted(v) for k, v in out.items()}


def _statistic(s: dict, levels: list | None, i: int, factor: bool) -> tuple[float, int] | None:
    """The quadratic form of the centred linear statistic, and its rank."""
    n = s["n"]
    ss = s["yy"] - s["y"] ** 2 / n
    if ss <= 1e-12:
        return None
    if factor:
        if len(levels) < 2:
            return None
        between = sum(y * y / k for _, k, y in levels) - s["y"] ** 2 / n
        return (n - 1) * between / ss, len(levels) - 1
    xx = s[f"q{i}"] - s[f"s{i}"] ** 2 / n
    if xx <= 1e-12:
        return None
    xy = s[f"p{i}"] - s[f"s{i}"] * s["y"] / n
    return (n - 1) * xy * xy / (xx * ss), 1


def _ranked(node: Node, stats: dict[int, tuple[float, int]], predictors: list[str], alpha: float, tries: int) -> list[int]:
    """The predictors to split by, best first; ``node`` keeps their tests.  Ties in p go to the larger statistic."""
    p = {i: chi2_sf(s, df) for i, (s, df) in stats.items()}
    adjusted = {i: min(1.0, -math.expm1(len(p) * math.log1p(-min(x, 1 - 1e-16)))) for i, x in p.items()}
    node.tests = {predictors[i]: (stats[i][0], adjusted[i]) for i in stats}
    mark = {i: round(math.log(a), 9) if a > 0 else -math.inf for i, a in adjusted.items()}
    return [i for i in sorted(stats, key=lambda i: (mark[i], -stats[i][0])) if adjusted[i] < alpha][:tries]


def _breaks(rows: DataFrame, wanted: dict[int, list[int]], sums: dict[int, dict], least: dict[int, int]) -> dict[tuple[int, int], float]:
    """The break of the greatest two-sample statistic, of each node and predictor that is asked for."""
    out = {}
    for i in sorted({i for v in wanted.values() for i in v}):
        nodes = [k for k, v in wanted.items() if i in v]
        cells = rows.where(F.col("node").isin(*nodes)).groupBy("node", f"x{i}").agg(F.count("*").alias("k"), F.sum("y").alias("s"))
        cells = running(cells, f"x{i}", {"nl": ("sum", "k"), "yl": ("sum", "s")}, ("node",))
        known = rows.sparkSession.createDataFrame([(k, sums[k]["n"], float(sums[k]["y"]), least[k]) for k in nodes], "node long, n long, y double, least long")
        both = cells.join(F.broadcast(known), "node").where((F.col("nl") >= F.col("least")) & (F.col("n") - F.col("nl") >= F.col("least")))
        gap = F.col("yl") - F.col("nl") * F.col("y") / F.col("n")
        # rounded, so that equal statistics are equal and the least break counts
        stat = F.bround(F.log(F.greatest(gap * gap / (F.col("nl") * (F.col("n") - F.col("nl"))), F.lit(1e-300))), 9)
        for r in both.groupBy("node").agg(F.max(F.struct(stat.alias("stat"), (-F.col(f"x{i}")).alias("x"))).alias("best")).collect():
            out[r["node"], i] = -r["best"]["x"]
    return out


def _partition(levels: list[tuple[str, int, float]], s: dict, least: int) -> tuple[tuple[str, ...], tuple[str, ...]] | None:
    """The two sets of levels of the greatest statistic, the first level being on the left."""
    n, mean, k = s["n"], s["y"] / s["n"], len(levels)
    if k <= ALL_PARTITIONS:
        rights = ([levels[1 + b] for b in range(k - 1) if mask >> b & 1] for mask in range(1, 1 << (k - 1)))
    else:  # the best partition of an outcome's sums goes along the means, if the sides' sizes allow it
        order = sorted(levels, key=lambda v: v[2] / v[1])
        rights = (part if levels[0] not in part else [v for v in levels if v not in part] for part in (order[j:] for j in range(1, k)))
    best, chosen = -1.0, None
    for right in rights:
        m = sum(v[1] for v in right)
        if m < least or n - m < least:
            continue
        gap = sum(v[2] for v in right) - m * mean
        stat = gap * gap / (m * (n - m))
        if stat > best * (1 + 1e-12):
            best, chosen = stat, {v[0] for v in right}
    if chosen is None:
        return None
    return tuple(v[0] for v in levels if v[0] not in chosen), tuple(v[0] for v in levels if v[0] in chosen)
