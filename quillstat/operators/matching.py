"""Matching without replacement and full matching on a score.

Units of equal score are interchangeable, so matching runs over cells: the
distinct scores with their numbers of treated units and controls.  What it gives are
flows of so many units from cell to cell; ranks of units in their cells, found by
range-partitioned running sums, turn them into pairs.

Greedy matching is a sweep over the cells.  Blocks that no pair can cross (exact values,
gaps over the calliper) are swept side by side; a block of more than CHUNK cells is
swept in as many rounds, each of which hands on the cells that are still open.

Full matching of least total distance is, on a line, a cover of all units by edges
between neighbouring runs of one arm.  Runs are cut into chunks where a run is short, so a
chunk is a small matrix of least costs by the states at its ends; the chunks'
matrices are multiplied in (min, +) on the driver, one short row each, and then every
chunk traces its own edges back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstat.plans.ordered import ONE_TASK, cut, running

#: Cells of a block that one task sweeps at a time.
CHUNK = 1 << 19


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= ONE_TASK else df


def _units(df: DataFrame, unit: str, treatment: str, score: str, keys: list[str]) -> DataFrame:
    """(keys, u, t, s) of the rows that have all of them."""
    have = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keys)), F.col(unit).alias("u"), (F.col(treatment).cast("double") > 0).alias("t"), F.col(score).cast("double").alias("s"))
    for c in have.columns:
        have = have.where(F.col(c).isNotNull())
    return have.where(~F.isnan("s"))


def sweep(score: np.ndarray, demand: np.ndarray, supply: np.ndarray, limit: float, beyond: float | None, lower_first: bool) -> tuple[list[tuple[int, int, int]], int, np.ndarray, np.ndarray]:
    """(flows, next cell, demand left, supply left) of one pass over cells in falling order of score.

    Each unit of a cell's demand takes the nearest supply left, of equally near ones that
    on the lower side (or, unless ``lower_first``, the upper).  ``beyond`` is the score of
    the next cell that is not here; the pass stops at a cell whose choice it may change.
    Flows are (cell, supplying cell, units); supply above a cell waits on a stack.
    """
    score, demand, supply = score.tolist(), demand.tolist(), supply.tolist()
    stack: list[int] = []
    flows = []
    n, low = len(score), 0
    for i in range(n):
        while demand[i] > 0:
            low = max(low, i)
            while low < n and supply[low] <= 0:
                low += 1
            while stack and supply[stack[-1]] <= 0:
                stack.pop()
            down = score[i] - score[low] if low < n else np.inf
            up = score[stack[-1]] - score[i] if stack else np.inf
            if low == n and beyond is not None:
                unseen = score[i] - beyond
                if unseen <= limit and not (up < unseen or (up == unseen and not lower_first)):
                    return flows, i, np.array(demand), np.array(supply)
            if min(down, up) > limit or (low == n and not stack):
                break
            source = low if down < up or (down == up and lower_first) else stack[-1]
            units = min(demand[i], supply[source])
            flows.append((i, source, units))
            demand[i] -= units
            supply[source] -= units
        if supply[i] > 0:
            stack.append(i)
    return flows, n, np.array(demand), np.array(supply)


def _flows(cells: DataFrame, limit: float, lower_first: bool) -> DataFrame:
    """(block, s, at, c, from, n): n units of demand of cell s from its place ``at`` on, met by cell c from its place ``from`` on.

    ``cells`` has block, chunk, s (falling within a block as chunks rise), demand, supply and
    ``beyond``, the first score of the next chunk.
    """
    import pyarrow as pa

    schema = "block long, s double, c double, at long, taken long, n long, open boolean, demand long, supply long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(-table.column("s").to_numpy(), kind="stable")
        v = {c: table.column(c).to_numpy()[order] for c in ("s", "demand", "supply", "at", "taken")}
        beyond = [x for x in table.column("beyond").to_pylist() if x is not None]
        flows, stop, demand, supply = sweep(v["s"], v["demand"], v["supply"], limit, max(beyond) if beyond else None, lower_first)
        at, taken = v["at"].copy(), v["taken"].copy()
        rows = []
        for i, j, n in flows:
            rows.append((v["s"][i], v["s"][j], int(at[i]), int(taken[j]), n, False, 0, 0))
            at[i] += n
            taken[j] += n
        if beyond:  # what later cells may take, and the demand that waits
            reach = v["s"] - max(beyond) <= limit
            waits = np.arange(len(order)) >= stop
            for i in np.flatnonzero((reach & (supply > 0)) | (waits & (demand > 0))):
                rows.append((v["s"][i], v["s"][i], int(at[i]), int(taken[i]), 0, True, int(demand[i]) if waits[i] else 0, int(supply[i])))
        block = table.column("block")[0].as_py()
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
        kinds = [pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        return pa.table([pa.array(x, k) for x, k in zip([[block] * len(rows), *columns], kinds, strict=True)], names=names)

    zero = F.lit(0).cast("long")
    cells = cells.select("block", "chunk", "s", "demand", "supply", "beyond", zero.alias("at"), zero.alias("taken"))
    rounds = cells.agg(F.max("chunk")).first()[0]
    done, state = None, None
    for k in range((rounds or 0) + 1):
        now = cells.where(F.col("chunk") == k).drop("chunk")
        if state is not None:
            # blocks that have ended have nothing open
            now = now.unionByName(state)
        out = cut(now.groupBy("block").applyInArrow(run, schema))
        met = out.where(~F.col("open")).select("block", "s", "at", "c", F.col("taken").alias("from"), "n")
        done = met if done is None else done.unionByName(met)
        state = out.where("open").select("block", "s", "demand", "supply", F.lit(None).cast("double").alias("beyond"), "at", "taken")
    return done


def greedy_match(df: DataFrame, unit: str, treatment: str, score: str, exact: list[str] | None = None, caliper: float | None = None, std_caliper: bool = True, ratio: int = 1, order: str = "largest") -> DataFrame:
    """(exact, treated, control, distance): up to ``ratio`` controls of each treated unit, no control twice.

    Treated units choose one after the other, by falling (``largest``) or rising
    (``smallest``) score, those of one score by unit; each takes the nearest control that is
    left, of equally near ones that of the lower score, of one score the least unit.
    ``caliper`` is in standard deviations of the score over all units, or in its own measure.
    Rows without a unit, treatment, score or exact value are left out; units are taken to be distinct.
    """
    if order not in ("largest", "smallest") or ratio < 1:
        raise ValueError("order must be largest or smallest, and ratio at least 1")
    keys = exact or []
    names = [f"k{i}" for i in range(len(keys))]
    have = _units(df, unit, treatment, score, keys)
    limit = np.inf
    if caliper is not None:
        limit = float(caliper) * ((have.agg(F.stddev_samp("s")).first()[0] or 0.0) if std_caliper else 1.0) + 1e-12
    sign = 1.0 if order == "largest" else -1.0
    have = cut(have.withColumn("s", sign * F.col("s") + 0.0))
    cells = have.groupBy(*names, "s").agg((F.count_if("t") * ratio).alias("demand"), F.count_if(~F.col("t")).alias("supply"))
    cells = _blocked(cells, names, limit)
    flows = _flows(cells.select("block", "chunk", "s", "demand", "supply", "beyond"), limit, lower_first=order == "largest")
    flows = cut(flows.withColumn("flow", F.monotonically_increasing_id()))
    blocks = cells.select(*names, "s", "block")
    placed = have.join(_small(blocks), [*names, "s"]).withColumn("one", F.lit(1).cast("long"))
    placed = running(placed, "u", {"rank": ("sum", "one")}, ("block", "s", "t")).select(*names, "block", "s", "t", "u", (F.col("rank") - 1).alias("rank"))
    placed = cut(placed)
    wants = placed.where("t").withColumn("place", F.explode(F.sequence(F.col("rank") * ratio, F.col("rank") * ratio + ratio - 1)))
    wants = _in_flow(wants.select(*names, "block", "s", "u", "place"), flows.select("block", "s", "at", "flow", "n"), "at")
    gives = _in_flow(placed.where(~F.col("t")).select("block", "s", "u", F.col("rank").alias("place")), flows.select("block", F.col("c").alias("s"), "from", "flow", "n"), "from")
    pairs = wants.select(*names, "flow", "k", F.col("u").alias("treated"), F.col("s").alias("__s")).join(gives.select("flow", "k", F.col("u").alias("control"), F.col("s").alias("__c")), ["flow", "k"])
    return pairs.select(*(F.col(n).alias(c) for n, c in zip(names, keys, strict=True)), "treated", "control", F.abs(F.col("__s") - F.col("__c")).alias("distance"))


def _blocked(cells: DataFrame, names: list[str], limit: float) -> DataFrame:
    """``cells`` with the block of each, its chunk in it, and the first score of the next chunk."""
    cells = running(cells, "s", {"prev": ("min", "s")}, tuple(names), descending=True, before=True)
    cells = cells.withColumns({"new": (F.col("prev").isNull() | (F.col("prev") - F.col("s") > limit)).cast("long"), "one": F.lit(1).cast("long")})
    cells = running(cells, "s", {"number": ("sum", "new"), "nth": ("sum", "one")}, tuple(names), descending=True)
    first = cells.where("new = 1").select(*names, "number", F.col("nth").alias("first")).withColumn("block", F.monotonically_increasing_id())
    cells = cut(cells.join(cut(first), [*names, "number"]).withColumn("chunk", F.floor((F.col("nth") - F.col("first")) / CHUNK)))
    after = cells.groupBy("block", (F.col("chunk") - 1).alias("chunk")).agg(F.max("s").alias("beyond"))
    return cut(cells.join(after, ["block", "chunk"], "left").select(*names, "block", "chunk", "s", "demand", "supply", "beyond"))


def _in_flow(rows: DataFrame, flows: DataFrame, start: str) -> DataFrame:
    """``rows`` (block, s, place) that lie in a flow of their cell, with its number and their place ``k`` in it.

    The last flow that starts not after a row, by a running maximum over both.
    """
    key = lambda at, k: F.col(at) * 2 + k
    line = rows.withColumns({"key": key("place", 1), "start": F.lit(None).cast("long")})
    line = line.unionByName(flows.select("block", "s", key(start, 0).alias("key"), F.col(start).alias("start")), allowMissingColumns=True)
    line = running(line, "key", {"begun": ("max", "start")}, ("block", "s")).where("place is not null and begun is not null").drop("key", "start")
    found = line.join(_small(flows).withColumnRenamed(start, "begun"), ["block", "s", "begun"])
    return found.withColumn("k", F.col("place") - F.col("begun")).where("k < n")


def matched_weights(pairs: DataFrame) -> DataFrame:
    """(unit, weight) of ATT weights of pairs with several controls: treated 1, each control of k takes 1/k of its treated units, scaled so that controls sum to their number."""
    k = pairs.groupBy("treated").agg(F.count("*").alias("k"))
    taken = pairs.join(k, "treated").groupBy(F.col("control").alias("unit")).agg(F.sum(1 / F.col("k")).alias("w"))
    total = taken.agg((F.count("*") / F.sum("w")).alias("scale"))
    return k.select(F.col("treated").alias("unit"), F.lit(1.0).alias("weight")).unionByName(taken.join(F.broadcast(total)).select("unit", (F.col("w") * F.col("scale")).alias("weight")))


class Line:
    """A chunk of a line: runs of units of one arm in order, and what is known at its ends.

    ``arm`` is 1 for treated units, 0 for controls, 2 for a cell with both, whose units cover
    each other at no cost and offer both arms to their neighbours.  ``sizes`` has (treated, controls)
    of each cell and ``run`` its run.  ``opened`` and ``closed`` tell whether the first and
    the last run are shared with a neighbouring chunk.
    """

    def __init__(self, s: np.ndarray, treated: np.ndarray, controls: np.ndarray, run: np.ndarray, opened: bool, closed: bool) -> None:
        arm = np.where((treated > 0) & (controls > 0), 2, (treated > 0).astype(int))
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        self.arm = arm[first]
        self.opened, self.closed = opened, closed
        self.pos, self.cell, self.nth = [], [], []
        for a, b in zip(first, np.append(first[1:], len(s)), strict=True):
            n = (treated if arm[a] == 1 else controls)[a:b] if arm[a] != 2 else np.array([1])
            cell = np.repeat(np.arange(a, b), n)
            self.pos.append(s[cell])
            self.cell.append(cell)
            self.nth.append(np.concatenate([np.arange(k) for k in n]))
        self.s, self.treated, self.controls = s, treated, controls

    def states(self, end: int) -> int:
        """How many states the first (0) or last (-1) run can be in: how many of its first units are covered from the left."""
        if not (self.opened if end == 0 else self.closed) or self.arm[end] == 2:
            return 1
        return len(self.pos[end]) + 1

    def solve(self, left: int) -> tuple[np.ndarray, list]:
        """(least costs by the state of the last run, choices of each step), the first run being in state ``left``."""
        n = len(self.pos[0])
        f = np.full(n + 1, np.inf)
        f[1 if self.arm[0] == 2 else left] = 0.0
        steps = []
        for k in range(1, len(self.pos)):
            a, b = self.pos[k - 1], self.pos[k]
            n, m = len(a), len(b)
            gap = b[0] - a[-1]
            # p of the last units of a meet q of the first units of b, both or neither none
            whole = np.concatenate([[0.0], np.cumsum((a[-1] - a)[::-1])]) + f[::-1]
            over = f[n] < f[n - 1]  # the last unit of a may be covered from both sides
            if over:
                whole[1] = f[n]
            near = np.minimum.accumulate(whole[1:])
            far = np.minimum.accumulate((whole[1:] + gap * np.arange(1, n + 1))[::-1])[::-1]
            q = np.arange(1, m + 1)
            few = gap * q + near[np.minimum(q, n) - 1]
            many = np.where(q < n, far[np.minimum(q, n - 1)], np.inf)
            new = np.empty(m + 1)
            new[0] = f[n]
            new[1:] = np.minimum(few, many) + np.cumsum(b - b[0])
            steps.append((whole, over, gap, few <= many))
            f = new
            if self.arm[k] == 2:  # covered in any case
                steps[-1] = (*steps[-1], int(f.argmin()))
                f = np.array([np.inf, f.min()])
        return f, steps

    def final(self, f: np.ndarray) -> np.ndarray:
        """Costs by the last run's state."""
        if self.arm[-1] == 2:
            return f[1:]
        return f if self.closed else f[-1:]

    def edges(self, left: int, right: int) -> list[tuple[int, int, int, int]]:
        """(cell, unit, cell, unit) of the edges of least cost between treated units and controls, with given states at the ends."""
        _, steps = self.solve(left)
        out = []
        q = 1 if self.arm[-1] == 2 else right if self.closed else len(self.pos[-1])
        for k in range(len(self.pos) - 1, 0, -1):
            whole, over, gap, few, *chosen = steps[k - 1]
            n = len(self.pos[k - 1])
            if chosen:
                q = chosen[0]
            p = 0
            if q:
                costs = whole[1:] + gap * np.maximum(np.arange(1, n + 1), q)
                p = int(costs[: min(q, n)].argmin()) + 1 if few[q - 1] else q + 1 + int(costs[q:].argmin())
                a, b = n - 1 - np.arange(p), np.arange(q)
                pairs = [(a[min(i, p - 1)] if p >= q else a[i if i < p else 0], b[i if i < q else 0]) for i in range(max(p, q))]
                out += [self._edge(k, int(i), int(j)) for i, j in pairs]
            q = n if p == 0 or (p == 1 and over) else n - p
        return out

    def _edge(self, k: int, i: int, j: int) -> tuple[int, int, int, int]:
        one, two = (int(self.cell[k - 1][i]), int(self.nth[k - 1][i])), (int(self.cell[k][j]), int(self.nth[k][j]))
        treated_first = self.arm[k - 1] == 1 or (self.arm[k - 1] == 2 and self.arm[k] != 1)
        return (*one, *two) if treated_first else (*two, *one)

    def mixed(self) -> list[tuple[int, int, int, int]]:
        """Edges inside the cells with both arms, but for a first cell that the chunk before has."""
        out = []
        for k in range(1 if self.opened else 0, len(self.pos)):
            if self.arm[k] == 2:
                cell = int(self.cell[k][0])
                t, c = int(self.treated[cell]), int(self.controls[cell])
                out += [(cell, i if i < t else 0, cell, i if i < c else 0) for i in range(max(t, c))]
        return out


def _chunk_line(table) -> Line:
    order = np.argsort(table.column("s").to_numpy(), kind="stable")
    s, t, c, run = (table.column(x).to_numpy()[order] for x in ("s", "treated", "controls", "run"))
    return Line(s, t, c, run, bool(table.column("opened")[0].as_py()), bool(table.column("closed")[0].as_py()))


def full_match(df: DataFrame, unit: str, treatment: str, score: str, exact: list[str] | None = None) -> DataFrame:
    """(exact, treated, control, distance): the edges of a full matching of least total distance.

    Every unit of a stratum with both arms is in a subclass of one treated unit with
    controls, or of one control with treated units; strata without both arms, and rows without
    a unit, treatment, score or exact value, are left out.
    """
    keys = exact or []
    names = [f"k{i}" for i in range(len(keys))]
    have = cut(_units(df, unit, treatment, score, keys))
    cells = cut(_chunks(have, names))
    if cells.isEmpty():
        return _named(have.select(*names, F.col("u").alias("treated"), F.col("u").alias("control"), F.lit(0.0).alias("distance")).where("false"), keys)
    import pyarrow as pa

    def costs(table: pa.Table) -> pa.Table:
        line = _chunk_line(table)
        rows = [line.final(line.solve(q)[0]).tolist() for q in range(line.states(0))]
        return pa.table({"line": table.column("line")[:1], "chunk": table.column("chunk")[:1], "costs": pa.array([rows], pa.list_(pa.list_(pa.float64())))})

    tables: dict[int, list] = {}
    for r in cells.groupBy("line", "chunk").applyInArrow(costs, "line long, chunk long, costs array<array<double>>").orderBy("line", "chunk").collect():
        tables.setdefault(r["line"], []).append((r["chunk"], np.array(r["costs"])))
    states = [(line, chunk, a, b) for line, chain in tables.items() for chunk, a, b in _best_states(chain)]
    known = df.sparkSession.createDataFrame(states, "line long, chunk long, at_first long, at_last long")

    def edges(table: pa.Table) -> pa.Table:
        line = _chunk_line(table)
        found = np.array(line.edges(table.column("at_first")[0].as_py(), table.column("at_last")[0].as_py()) + line.mixed(), np.int64).reshape(-1, 4)
        return pa.table({"line": pa.array(np.full(len(found), table.column("line")[0].as_py()), pa.int64()), "ts": line.s[found[:, 0]], "ti": found[:, 1], "cs": line.s[found[:, 2]], "ci": found[:, 3]})

    links = cells.join(_small(known), ["line", "chunk"]).groupBy("line", "chunk").applyInArrow(edges, "line long, ts double, ti long, cs double, ci long")
    links = _stars(cut(links))
    lines = cells.select(*names, "line", "s").distinct()
    ranked = running(have.withColumn("one", F.lit(1).cast("long")), "u", {"rank": ("sum", "one")}, (*names, "s", "t"))
    ranked = cut(ranked.join(lines, [*names, "s"]).select("line", "s", "t", "u", (F.col("rank") - 1).alias("rank"), *names))
    arm = lambda t, name, s, i, *more: ranked.where(F.col("t") == t).select("line", F.col("s").alias(s), F.col("rank").alias(i), F.col("u").alias(name), *more)
    out = links.join(arm(True, "treated", "ts", "ti", *names), ["line", "ts", "ti"]).join(arm(False, "control", "cs", "ci"), ["line", "cs", "ci"])
    return _named(out.select(*names, "treated", "control", F.abs(F.col("ts") - F.col("cs")).alias("distance")), keys)


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keys)})


def _chunks(have: DataFrame, names: list[str]) -> DataFrame:
    """(names, line, chunk, opened, closed, s, treated, controls, run): the cells of each chunk; a run at which lines are cut is in both chunks."""
    cells = have.groupBy(*names, "s").agg(F.count_if("t").alias("treated"), F.count_if(~F.col("t")).alias("controls"))
    both = F.col("treated") * F.col("controls") > 0
    cells = cells.withColumn("arm", F.when(both, 2).otherwise((F.col("treated") > 0).cast("int")))
    cells = running(cells.withColumn("own", F.struct("s", "arm")), "s", {"prev": ("max", "own")}, tuple(names), before=True).drop("own")
    new = F.col("prev").isNull() | (F.col("prev.arm") != F.col("arm")) | both
    cells = cells.withColumns({"new": new.cast("long"), "units": F.when(both, 1).otherwise(F.col("treated") + F.col("controls"))})
    cells = cut(running(cells, "s", {"run": ("sum", "new"), "upto": ("sum", "units")}, tuple(names)).drop("prev", "new"))
    runs = cells.groupBy(*names, "run").agg(F.sum("units").alias("size"), F.max("upto").alias("upto"), F.max("arm").alias("arm"))
    # the first short run of each portion of the line; the runs at its ends are no cuts
    short = runs.where("size <= 2").withColumn("portion", F.floor(F.col("upto") / CHUNK)).where("portion > 0")
    cuts = short.groupBy(*names, "portion").agg(F.min("run").alias("run")).select(*names, "run", F.lit(1).cast("long").alias("is_cut"))
    last = cells.groupBy(*names).agg(F.max("run").alias("runs"), F.sum("treated").alias("nt"), F.sum("controls").alias("nc")).where("nt > 0 and nc > 0").withColumn("line", F.monotonically_increasing_id()).drop("nt", "nc")
    last = cut(last)
    same = [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names]
    runs = runs.join(cuts, [*names, "run"], "left").alias("a").join(_small(last).alias("b"), same if names else F.lit(True)).select("a.*", "b.runs", "b.line")
    runs = runs.withColumn("is_cut", F.when((F.col("run") > 1) & (F.col("run") < F.col("runs")), F.coalesce("is_cut", F.lit(0))).otherwise(0))
    runs = running(runs.select("line", "run", "is_cut"), "run", {"before": ("sum", "is_cut")}, ("line",), before=True)
    runs = runs.withColumn("chunk", F.coalesce("before", F.lit(0)))
    ends = runs.groupBy("line").agg(F.max(F.col("chunk") + F.col("is_cut")).alias("chunks"))
    runs = runs.withColumn("chunk", F.explode(F.when(F.col("is_cut") == 1, F.array("chunk", F.col("chunk") + 1)).otherwise(F.array("chunk"))))
    runs = runs.join(_small(cut(ends)), "line").select("line", "run", "chunk", (F.col("chunk") > 0).alias("opened"), (F.col("chunk") < F.col("chunks")).alias("closed"))
    placed = cells.alias("a").join(_small(last).alias("b"), same if names else F.lit(True)).select("a.*", "b.line")
    return placed.join(runs, ["line", "run"]).select(*names, "line", "chunk", "opened", "closed", "s", "treated", "controls", "run")


def _best_states(chain: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int, int]]:
    """(chunk, first state, last state) of the least sum of costs along a chain of (chunk, costs by both)."""
    best, back = chain[0][1][0], []
    for _, costs in chain[1:]:
        # the state in which a chunk leaves its last run is the one in which the next finds it
        total = best[:, None] + costs
        back.append(total.argmin(0))
        best = total.min(0)
    state = int(best.argmin())
    out = []
    for (chunk, _), choice in zip(reversed(chain), [*reversed(back), None], strict=True):
        first = int(choice[state]) if choice is not None else 0
        out.append((chunk, first, state))
        state = first
    return reversed(out)


def _stars(links: DataFrame) -> DataFrame:
    """``links`` without edges whose two units have other edges too, which only edges of no cost can be: the least of such edges at both its units goes, until there are none."""
    one, two = ["line", "ts", "ti"], ["line", "cs", "ci"]
    every = F.struct("line", "ts", "ti", "cs", "ci")
    while True:
        degree = lambda side, name: links.groupBy(*side).agg(F.count("*").alias(name))
        spare = cut(links.join(degree(one, "a"), one).join(degree(two, "b"), two).where("a > 1 and b > 1").select(*dict.fromkeys(one + two)))
        if spare.isEmpty():
            return links
        least = lambda side, name: spare.groupBy(*side).agg(F.min(every).alias(name))
        gone = spare.join(least(one, "x"), one).join(least(two, "y"), two).where((F.col("x") == every) & (F.col("y") == every)).select(*dict.fromkeys(one + two))
        links = cut(links.join(gone, ["line", "ts", "ti", "cs", "ci"], "left_anti"))


def full_match_weights(pairs: DataFrame, estimand: str = "ATT") -> DataFrame:
    """(unit, treated, subclass, weight) from the edges of :func:`full_match`.

    A subclass is named by the unit that all its edges have, an edge alone by the treated
    one.  ATT: treated 1, controls treated / controls of the subclass; ATE: the subclass's
    units over those of the own arm.  Weights of an arm are scaled to sum to its number.
    """
    if estimand not in ("ATT", "ATE"):
        raise ValueError("estimand must be ATT or ATE")
    controls = pairs.groupBy("treated").agg(F.count("*").alias("nc"))
    treated = pairs.groupBy("control").agg(F.count("*").alias("nt"))
    each = pairs.join(controls, "treated").join(treated, "control")
    centre = F.when(F.col("nt") > 1, F.struct(F.lit(False).alias("treated"), F.col("control").alias("unit"))).otherwise(F.struct(F.lit(True).alias("treated"), F.col("treated").alias("unit")))
    each = each.withColumn("subclass", centre)
    sides = each.select(F.col("treated").alias("unit"), F.lit(True).alias("treated"), "subclass", "nt", "nc").unionByName(each.select(F.col("control").alias("unit"), F.lit(False).alias("treated"), "subclass", "nt", "nc")).distinct()
    t = F.col("treated")
    raw = F.when(t, 1.0).otherwise(F.col("nt") / F.col("nc")) if estimand == "ATT" else (F.col("nt") + F.col("nc")) / F.when(t, F.col("nt")).otherwise(F.col("nc"))
    sides = sides.withColumn("raw", raw.cast("double"))
    total = sides.groupBy("treated").agg((F.count("*") / F.sum("raw")).alias("scale"))
    return sides.join(F.broadcast(total), "treated").select("unit", "treated", "subclass", (F.col("raw") * F.col("scale")).alias("weight"))
