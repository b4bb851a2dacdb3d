"""Sums over the rows that come after a row in one order and lie below it in another, without pairs.

Rows are numbered in both orders and cut into strips of equal numbers along each.  A
row's sum has three parts: rows of later strips of the first order in lower strips of the
second, from a table of strips by strips; rows of its own strip of the first order; and rows
of its own strip of the second order that are in later strips of the first.  The last two
are counted inside a task each, by merging.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.plans.ordered import ONE_TASK, cut, running

#: Rows of a strip.
STRIP = 1 << 18


def after_below(height: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each row the sums of ``weights`` (columns) of the rows after it whose height is less; heights are distinct numbers below their count."""
    n = len(height)
    out = np.zeros_like(weights)
    place = np.arange(n)
    size = 1
    while size < n:
        # of two neighbouring blocks the left one's rows look up the right one's, in one order by pair of blocks and height
        pair = place // (2 * size)
        order = np.lexsort([height, pair])
        right = (place[order] // size) % 2 == 1
        sums = np.cumsum(np.where(right[:, None], weights[order], 0.0), axis=0)
        first = np.flatnonzero(np.append(True, pair[order][1:] != pair[order][:-1]))
        base = np.where(first[:, None] > 0, sums[first - 1], 0.0)
        own = sums - np.repeat(base, np.diff(np.append(first, n)), axis=0)
        out[order[~right]] += own[~right]
        size *= 2
    return out


def dominance(cells: DataFrame, order: list[str], height: str, down: str, up: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``cells`` (one row for each ``by``, ``order`` and ``height``) with sums over other cells of their group.

    after_less, after_equal and after_more sum ``down`` over cells that are later in ``order``
    and have less, equal or more ``height``; before_less, before_equal and before_more
    sum ``up`` over cells that are earlier.
    """
    one = F.lit(1).cast("long")
    cells = cut(cells.withColumns({"__p": F.struct(*order), "__one": one}))
    rows = cells.count()
    # positions in the order with ties by height, and in the height with ties by order: no tie counts as after and below
    cells = running(cells.withColumn("__ph", F.struct("__p", height)), "__ph", {"__i": ("sum", "__one")}, by, rows=rows)
    cells = running(cells.withColumn("__hp", F.struct(height, "__p")), "__hp", {"__j": ("sum", "__one")}, by, rows=rows)
    cells = cut(cells.withColumns({"__i": F.col("__i") - 1, "__j": F.col("__j") - 1}))
    cells = cells.withColumns({"__a": F.floor(F.col("__i") / STRIP), "__b": F.floor(F.col("__j") / STRIP)}).drop("__one")
    keys = [*by, "__i"]
    # both directions at once: later cells below for "down", and, seen from the other end, earlier cells above for "up"
    parts = _within(cells, [*by, "__a"], "__i", by, down, up)
    if cells.where("__a > 0").limit(1).count():
        parts = parts.unionByName(_within(cells, [*by, "__b"], "__a", by, down, up)).groupBy(*keys).agg(F.sum("after_less").alias("after_less"), F.sum("before_more").alias("before_more"))
    out = cells.join(parts, keys)
    grid = _grid(cells, down, up, by)
    if grid is not None:
        out = out.join(grid, [*by, "__a", "__b"], "left").withColumns({c: F.col(c) + F.coalesce(F.col(f"{c}__far"), F.lit(0.0)) for c in ("after_less", "before_more")}).drop("after_less__far", "before_more__far")
    # rows of equal height and all rows, along the order
    totals = cells.groupBy(*by, *order).agg(F.first("__p").alias("__p"), F.sum(down).alias("__d"), F.sum(up).alias("__u"))
    totals = running(totals, "__p", {"__before": ("sum", "__u")}, by, before=True, rows=rows)
    totals = running(totals, "__p", {"__after": ("sum", "__d")}, by, descending=True, before=True, rows=rows)
    totals = cut(totals.select(*by, *order, F.coalesce("__before", F.lit(0.0)).alias("__before"), F.coalesce("__after", F.lit(0.0)).alias("__after")))
    out = running(out, "__p", {"before_equal": ("sum", up)}, (*by, height), before=True, rows=rows)
    out = running(out, "__p", {"after_equal": ("sum", down)}, (*by, height), descending=True, before=True, rows=rows)
    out = out.join(F.broadcast(totals) if totals.count() <= ONE_TASK else totals, [*by, *order])
    out = out.withColumns({"before_equal": F.coalesce("before_equal", F.lit(0.0)), "after_equal": F.coalesce("after_equal", F.lit(0.0))})
    rest = {"after_more": F.col("__after") - F.col("after_less") - F.col("after_equal"), "before_less": F.col("__before") - F.col("before_more") - F.col("before_equal")}
    return out.withColumns(rest).drop("__p", "__ph", "__hp", "__i", "__j", "__a", "__b", "__before", "__after")


def _within(cells: DataFrame, strip: list[str], place: str, by: tuple[str, ...], down: str, up: str) -> DataFrame:
    """(by, __i, after_less, before_more) of each cell among those of its ``strip``; with equal ``place`` no cell is after another."""
    rows = cells.select(*dict.fromkeys([*by, "__i", "__j", strip[-1], place]), F.col(down).cast("double").alias("__down"), F.col(up).cast("double").alias("__up"))

    def run(table):
        import pyarrow as pa

        at, j, d, u = (table.column(c).to_numpy() for c in (place, "__j", "__down", "__up"))
        order = np.lexsort([j, at])
        height = np.empty(len(j), np.int64)
        height[np.argsort(j[order], kind="stable")] = np.arange(len(j))
        low = after_below(height, d[order][:, None])[:, 0]
        # from the other end, with heights turned round: before and above
        high = after_below((len(j) - 1 - height)[::-1].copy(), u[order][::-1, None].copy())[::-1, 0]
        out = {c: table.column(c).take(pa.array(order)) for c in (*by, "__i")}
        return pa.table(out | {"after_less": low, "before_more": high})

    kinds = [f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in by]
    return rows.groupBy(*strip).applyInArrow(run, ", ".join([*kinds, "__i long", "after_less double", "before_more double"]))


def _grid(cells: DataFrame, down: str, up: str, by: tuple[str, ...]) -> DataFrame | None:
    """(by, __a, __b, sums over later strips in lower strips, and earlier ones in higher): None where there is one strip.

    There are as many strips as rows over STRIP, and one row for each two that meet.
    """
    sums = cells.groupBy(*by, "__a", "__b").agg(F.sum(down).alias("d"), F.sum(up).alias("u")).collect()
    groups: dict[tuple, list] = {}
    for r in sums:
        groups.setdefault(tuple(r[c] for c in by), []).append((r["__a"], r["__b"], r["d"], r["u"]))
    found = []
    for key, rows in groups.items():
        a, b = (np.array([r[k] for r in rows]) for k in (0, 1))
        if not a.max():
            continue
        d, u = np.zeros((2, a.max() + 2, b.max() + 2))
        d[a, b + 1], u[a, b + 1] = [r[2] for r in rows], [r[3] for r in rows]
        lower = np.cumsum(d[::-1], 0)[::-1].cumsum(1)  # at (a, b + 1): strips from a on, up to b
        higher = np.cumsum(u, 0)[:, ::-1].cumsum(1)[:, ::-1]  # strips up to a, from b on
        for x, y, *_ in rows:
            found.append((*key, int(x), int(y), float(lower[x + 1, y]), float(higher[x - 1, y + 2] if x and y + 2 < higher.shape[1] else 0.0)))
    if not found:
        return None
    kinds = [f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in by]
    return cells.sparkSession.createDataFrame(found, ", ".join([*kinds, "__a long", "__b long", "after_less__far double", "before_more__far double"]))
