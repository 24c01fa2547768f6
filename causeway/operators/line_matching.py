"""Matching by a score over whole tables: greedy without replacement and optimal, both exact and without blocks.

Rows are cut into ranges of the score, as many as the session has reduce partitions and more where these would hold over RANGE rows. A task
holds one range. What the driver holds is a few numbers for each range.

Greedy: treated rows in a hash order each take their nearest free control. That order is a priority which all controls share, so the outcome is
the one stable matching of "treated rows want near controls, controls want early treated rows", which proposals reach in any order. Each range
settles its own proposals in one pass; a row whose next nearest control lies in another range moves there, with its place on the side it left,
and may displace a later row. Rounds go on until no row moves. Many rows of one score are no hot key: of those, the i-th can't get any of the
i - 1 nearest controls, so it starts beyond the ranges that these fill.

Optimal: on a line, the least total distance is a flow along the sorted rows, and its cost a convex function of the flows between ranges. Each
range gives, for a window of flows in and out, its least costs; a shortest path over the ranges' tables gives the best flows in the window. The
windows move while a flow is at an edge and narrow from coarse to single steps; flows inside their windows at single steps are the optimum,
by convexity. With the flows known each range tells which rows it pairs, and these are paired in order.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.hashrand import uniform
from causeway.functions.workers import by_value
from causeway.operators.quantiles import parts

by_value(__name__)

RANGE, WINDOW, NARROW = 50_000, 8, 8  # rows of a range, steps to either side of a flow, factor from one step to the next
INF = float("inf")


def _given(df: DataFrame, key: str, treatment: str, score: str) -> DataFrame:
    s = F.col(score).cast("double")
    return df.select(F.col(key).cast("long").alias("key"), F.col(treatment).cast("int").alias("t"), s.alias("s")).where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < INF) & F.col(key).isNotNull() & F.col("t").isin(0, 1))


def _packed(rows: DataFrame, n: int, columns: dict[str, str]) -> DataFrame:
    """rng, and the columns as binary arrays: a row for each range of (s, key), in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if len(b)]
        if held:
            whole = pa.Table.from_batches(held)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *[pa.array([whole.column(c).to_numpy().astype(kind).tobytes()], pa.binary()) for c, kind in columns.items()]], ["rng", *columns])

    count = max(parts(rows), -(-n // RANGE))
    ordered = rows.repartitionByRange(count, "s", "key").sortWithinPartitions("s", "key")
    return ordered.select(*columns).mapInArrow(run, ", ".join(["rng int", *[f"{c} binary" for c in columns]]))


# greedy

STATE = "rng int, key long, o double, copy int, s double, lr int, li int, ls double, rr int, ri int, rs double, control long, distance double, moved boolean"
NONE, HERE = -1, -2  # no such range; a place that the range itself must find


def _beyond(count: np.ndarray, low: np.ndarray, high: np.ndarray, at: int, s: float, rank: int) -> tuple[int, int]:
    """First and last of the ranges around `at` whose controls are all among the `rank` nearest of s; (at, at - 1) if there are none."""
    a, b = at, at - 1

    def fits(a: int, b: int) -> bool:
        far = max(s - low[a], high[b] - s)
        far += 1e-9 * max(1.0, abs(s), far)  # so that rounding leaves no equal distance out
        return count[(low <= s + far) & (high >= s - far)].sum() <= rank

    if fits(at, at):
        b = at
        while True:
            left, right = (a > 0 and fits(a - 1, b)), (b + 1 < len(count) and fits(a, b + 1))
            if not (left or right):
                break
            a, b = (a - 1, b) if left else (a, b + 1)
    return a, b


def settle(me: int, z: np.ndarray, ids: np.ndarray, rows: pd.DataFrame, ends: dict[str, np.ndarray], caliper: float) -> list[tuple]:
    """One range's pass: its rows in order take the nearest control that is free of earlier ones, move to the range that holds it, or find none within the caliper.

    ends: for each range, low and high, its controls' least and greatest scores, n, how many they are, and latest, the latest order among their
    holders (infinite while one is free).
    """
    n = len(z)
    free, below, above = [True] * n, [i - 1 for i in range(n)], [i + 1 for i in range(n)]  # links past taken places

    def seek(i: int, links: list[int]) -> int:
        path = []
        while 0 <= i < n and not free[i]:
            path.append(i)
            i = links[i]
        for p in path:
            links[p] = i
        return i

    out = []
    places, lows, highs, counts, latest = ends["rng"], ends["low"], ends["high"], ends["n"], ends["latest"]
    spot = {int(r): i for i, r in enumerate(places)}
    rows = rows.sort_values(["o", "key", "copy"])
    for r in rows.itertuples(index=False):
        lr, li, ls, rr, ri, rs = r.lr, r.li, r.ls, r.rr, r.ri, r.rs
        if li == HERE:
            at = int(np.searchsorted(z, r.s))
            lr, li, rr, ri = me, at - 1, me, at
        if lr == me:
            li = seek(li, below)
            if li >= 0:
                ls = z[li]
            else:
                k = np.flatnonzero(latest[: spot[me]] >= r.o)
                lr, li, ls = (int(places[k[-1]]), int(counts[k[-1]]) - 1, highs[k[-1]]) if len(k) else (NONE, NONE, -INF)
        if rr == me:
            ri = seek(ri, above)
            if ri < n:
                rs = z[ri]
            else:
                k = np.flatnonzero(latest[spot[me] + 1 :] >= r.o)
                rr, ri, rs = (int(places[spot[me] + 1 + k[0]]), 0, lows[spot[me] + 1 + k[0]]) if len(k) else (NONE, NONE, INF)
        left = r.s - ls <= rs - r.s  # of equal distances the lower side
        d, to, i = (r.s - ls, lr, li) if left else (rs - r.s, rr, ri)
        if to == NONE or d > caliper:
            continue
        took = to == me
        if took:
            free[i] = False
        out.append((to, r.key, r.o, r.copy, r.s, lr, li, ls, rr, ri, rs, int(ids[i]) if took else None, d if took else None, not took))
    return out


def _turn(ends: dict[str, np.ndarray], caliper: float):
    def run(rows: pa.Table, range_: pa.Table) -> pa.Table:
        own = range_.to_pylist()[0]
        out = settle(own["rng"], np.frombuffer(own["s"], np.float64), np.frombuffer(own["key"], np.int64), rows.to_pandas(), ends, caliper)
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(TYPES), TYPES, strict=True)], NAMES)

    return run


def greedy(df: DataFrame, key: str, treatment: str, score: str, k: int = 1, caliper: float | None = None, seed: int = 42) -> DataFrame:
    """treated_id, control_id, distance, rank: in a hash order, each treated row takes its k nearest controls within caliper that no earlier row took.

    Of equal distances the lower score comes first, of equal scores below it the larger id, of others the smaller. Rows without a finite score, a
    key or an arm take no part; a table without one of the arms gives no pair.
    """
    from causeway.operators.store_tables import kept

    spark = df.sparkSession
    none = spark.createDataFrame([], "treated_id long, control_id long, distance double, rank int")
    rows = _given(df, key, treatment, score)
    sizes = dict(rows.groupBy("t").count().collect())
    if not sizes.get(0) or not sizes.get(1):
        return none
    limit = INF if caliper is None else float(caliper)
    controls = kept(_packed(rows.where("t = 0"), sizes[0], {"s": "<f8", "key": "<i8"}))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rng, s in zip(b.column("rng").to_pylist(), b.column("s").to_pylist(), strict=True):
                z = np.frombuffer(s, np.float64)
                yield pa.RecordBatch.from_pydict({"rng": pa.array([rng], pa.int32()), "low": [z[0]], "high": [z[-1]], "n": pa.array([len(z)], pa.int64())})

    found = controls.select("rng", "s").mapInArrow(edges, "rng int, low double, high double, n long").orderBy("rng").toPandas()  # a row for each range
    ends = {c: found[c].to_numpy() for c in found.columns} | {"latest": np.full(len(found), INF)}

    buckets = max(16, len(found))
    hashed = rows.where("t = 1").select("key", "s", uniform(F.lit(seed), F.col("key")).alias("o")).withColumn("bucket", F.floor(F.col("o") * buckets))
    crowds = hashed.groupBy("s", "bucket").agg(F.count("*").alias("c"))
    earlier = F.coalesce(F.sum("c").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each bucket
    ranked = hashed.join(crowds.select("s", "bucket", (earlier * k).alias("rank")).where(F.col("rank") >= int(found["n"].min())), ["s", "bucket"], "left")

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, places = ends["n"], ends["low"], ends["high"], ends["rng"]
        known: dict[tuple, tuple] = {}

        def place(s: float, rank: int) -> tuple:
            at = min(int(np.searchsorted(high, s)), len(high) - 1)
            a, b = _beyond(n, low, high, at, s, rank) if rank else (at, at - 1)
            if b < a:
                return (int(places[at]), NONE, HERE, 0.0, NONE, HERE, 0.0)
            left = (int(places[a - 1]), int(n[a - 1]) - 1, float(high[a - 1])) if a else (NONE, NONE, -INF)
            right = (int(places[b + 1]), 0, float(low[b + 1])) if b + 1 < len(n) else (NONE, NONE, INF)
            to = left[0] if s - left[2] <= right[2] - s else right[0]
            return (to, *left, *right)

        for b in batches:
            out = []
            for row in zip(*[b.column(c).to_pylist() for c in ("key", "o", "s", "rank")], strict=True):
                own, o, s, rank = row
                if (s, rank) not in known:
                    known[s, rank] = place(s, rank or 0)
                to, *sides = known[s, rank]
                if to != NONE:
                    out += [(to, own, o, c, s, *sides, None, None, True) for c in range(1, k + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(TYPES), TYPES, strict=True)], NAMES)

    state = kept(ranked.select("key", "o", "s", "rank").mapInArrow(start, STATE))
    while True:
        moved = sorted(r.rng for r in state.where("moved").select("rng").distinct().collect())  # ranges
        if not moved:
            break
        held = {r.rng: (r.n, r.o) for r in state.where("not moved").groupBy("rng").agg(F.count("*").alias("n"), F.max("o").alias("o")).collect()}
        now = dict(ends, latest=np.array([held[r][1] if held.get(r, (0,))[0] == n else INF for r, n in zip(ends["rng"].tolist(), ends["n"].tolist(), strict=True)]))

        busy = F.col("rng").isin(moved)
        fresh = state.where(busy).groupBy("rng").cogroup(controls.join(F.broadcast(spark.createDataFrame([(r,) for r in moved], "rng int")), "rng").groupBy("rng")).applyInArrow(_turn(now, limit), STATE)
        state = kept(state.where(~busy).unionByName(fresh))
    return state.select(F.col("key").alias("treated_id"), F.col("control").alias("control_id"), "distance", F.col("copy").alias("rank"))


NAMES = [c.split()[0] for c in STATE.split(", ")]
TYPES = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]] for c in STATE.split(", ")]


# optimal


def forward(x: list[float], demand: list[bool], start: int, left: float, alone: float | None) -> tuple[int, np.ndarray, list[int]]:
    """The least cost of a range by the flow that leaves it, given the flow `start` that enters: (smallest flow, costs from it on, marks for backward()).

    A flow is how many supplies came by minus how many demands. The cost is convex in it; its slopes are held sorted in two lists, of flows
    below 0 and of others, as going on by a gap makes all of one side cheaper by it and all of the other dearer.
    """
    low, cost, at = start, 0.0, left
    down: list[float] = []  # ascending slopes less down_by
    up: list[float] = []  # ascending negated slopes: the least slope is last
    down_by = up_by = 0.0
    marks = []
    for p, wants in zip(x, demand, strict=True):
        gap, at = p - at, p
        if gap:
            cost += gap * abs(low)
            down_by -= gap
            up_by += gap
        line = alone if wants else 0.0
        if line is None:
            marks.append(0)
        else:
            marks.append(low + bisect_right(down, line - down_by) + len(up) - bisect_left(up, up_by - line))
            if down and line < down[-1] + down_by:
                insort(down, line - down_by)
            else:
                insort(up, up_by - line)
        low -= wants
        target = min(max(-low, 0), len(down) + len(up))
        while len(down) < target:
            down.append(up_by - up.pop() - down_by)
        while len(down) > target:
            up.append(up_by - (down.pop() + down_by))
    slopes = [s + down_by for s in down] + [up_by - s for s in reversed(up)]
    return low, cost + np.concatenate([[0.0], np.cumsum(slopes)]), marks


def backward(demand: list[bool], end: int, marks: list[int], alone: float | None) -> tuple[list[bool], int]:
    """Which rows are paired when the flow `end` leaves, and the flow that entered."""
    flow, paired = end, [False] * len(demand)
    for i in range(len(demand) - 1, -1, -1):
        if demand[i]:
            paired[i] = alone is None or flow < marks[i]
            flow += paired[i]
        else:
            paired[i] = flow - 1 >= marks[i]
            flow -= paired[i]
    return paired, flow


def costs(x: list[float], demand: list[bool], left: float, starts: list[int], ends: list[int], alone: float | None) -> np.ndarray:
    """starts by ends: the least cost of a range between these flows, infinite where there is none."""
    out = np.full((len(starts), len(ends)), INF)
    for i, a in enumerate(starts):
        low, cost, _ = forward(x, demand, a, left, alone)
        at = np.array(ends) - low
        ok = (at >= 0) & (at < len(cost))
        out[i, ok] = cost[at[ok]]
    return out


def best_path(tables: list[np.ndarray]) -> tuple[list[int], float]:
    """The places, one between each two tables, whose total cost is least; of equal costs those named first."""
    total, back = tables[0][0], []
    for t in tables[1:]:
        sums = total[:, None] + t
        back.append(sums.argmin(0))
        total = sums.min(0)
    place = 0
    path = []
    for b in reversed(back):
        place = int(b[place])
        path.append(place)
    return path[::-1], float(total[0])


def feasible(demands: list[int], supplies: list[int], alone: bool) -> list[int]:
    """A flow behind each range but the last that can be continued to none at the end, near zero."""
    n = len(demands)
    least, most = [0] * (n + 1), [0] * (n + 1)
    for r in range(n - 1, -1, -1):
        least[r] = least[r + 1] - supplies[r] + (0 if alone else demands[r])
        most[r] = most[r + 1] + demands[r]
    flow, out = 0, []
    for r in range(n - 1):
        low = max(flow - demands[r], least[r + 1])
        high = min(flow + supplies[r] - (0 if alone else demands[r]), most[r + 1])
        flow = min(max(0, low), high)
        out.append(flow)
    return out


def optimal(df: DataFrame, key: str, treatment: str, score: str, alone: float | None = None) -> DataFrame:
    """treated_id, control_id, distance: one to one, every row of the smaller arm, with the least total distance there is.

    alone: what leaving a row of the smaller arm unpaired costs, so no pair is further apart; None: all are paired. Rows without a finite score, a
    key or an arm take no part; a table without one of the arms gives no pair.
    """
    from causeway.operators.store_tables import kept

    rows = _given(df, key, treatment, score)
    sizes = dict(rows.groupBy("t").count().collect())
    if not sizes.get(0) or not sizes.get(1):
        return df.sparkSession.createDataFrame([], "treated_id long, control_id long, distance double")
    wants = 1 if sizes[1] <= sizes[0] else 0
    packed = kept(_packed(rows.withColumn("demand", (F.col("t") == wants).cast("int")), sizes[0] + sizes[1], {"s": "<f8", "key": "<i8", "demand": "<i8"}))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rng, s, d in zip(*[b.column(c).to_pylist() for c in ("rng", "s", "demand")], strict=True):
                z, d = np.frombuffer(s, np.float64), np.frombuffer(d, np.int64)
                yield pa.RecordBatch.from_pydict({"rng": pa.array([rng], pa.int32()), "low": [z[0]], "high": [z[-1]], "demands": pa.array([int(d.sum())], pa.int64()), "supplies": pa.array([int((1 - d).sum())], pa.int64())})

    ends = packed.select("rng", "s", "demand").mapInArrow(summary, "rng int, low double, high double, demands long, supplies long").orderBy("rng").collect()  # a row for each range
    places = {e.rng: i for i, e in enumerate(ends)}
    lefts = [ends[max(0, i - 1)].high if i else ends[0].low for i in range(len(ends))]
    flows = feasible([e.demands for e in ends], [e.supplies for e in ends], alone is not None)
    steps = sorted(range(-WINDOW, WINDOW + 1), key=abs)
    step = 1
    while step * WINDOW < min(sizes.values()):
        step *= NARROW
    while len(ends) > 1:
        around = [[0], *[[f + step * i for i in steps] for f in flows], [0]]

        def tables(batches: Iterator[pa.RecordBatch], around: list = around) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for rng, s, d in zip(*[b.column(c).to_pylist() for c in ("rng", "s", "demand")], strict=True):
                    i = places[rng]
                    t = costs(np.frombuffer(s, np.float64).tolist(), np.frombuffer(d, np.int64).astype(bool).tolist(), lefts[i], around[i], around[i + 1], alone)
                    yield pa.RecordBatch.from_pydict({"rng": pa.array([rng], pa.int32()), "t": [t.tobytes()]})

        got = {r.rng: np.frombuffer(r.t).reshape(len(around[places[r.rng]]), -1) for r in packed.select("rng", "s", "demand").mapInArrow(tables, "rng int, t binary").collect()}
        path, _ = best_path([got[e.rng] for e in ends])
        moved = [steps[p] for p in path]
        flows = [f + step * m for f, m in zip(flows, moved, strict=True)]
        if all(abs(m) < WINDOW for m in moved):
            if step == 1:
                break
            step //= NARROW

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rng, s, keys, d in zip(*[b.column(c).to_pylist() for c in ("rng", "s", "key", "demand")], strict=True):
                i, z, keys = places[rng], np.frombuffer(s, np.float64), np.frombuffer(keys, np.int64)
                d = np.frombuffer(d, np.int64).astype(bool)
                enter, leave = ([0, *flows][i], [*flows, 0][i])
                low, cost, marks = forward(z.tolist(), d.tolist(), enter, lefts[i], alone)
                paired, first = backward(d.tolist(), leave, marks, alone)
                if first != enter:
                    raise ArithmeticError("the flow that entered does not lead to the one that left")
                paired = np.array(paired, bool)
                for side in (False, True):
                    at = np.flatnonzero(paired & (d == side))
                    yield pa.RecordBatch.from_pydict({"rng": pa.array([rng] * len(at), pa.int32()), "demand": pa.array([side] * len(at), pa.bool_()), "at": pa.array(np.arange(len(at)), pa.int64()), "id": pa.array(keys[at]), "s": pa.array(z[at])})

    rows = kept(packed.mapInArrow(chosen, "rng int, demand boolean, at long, id long, s double"))
    counts = rows.groupBy("demand", "rng").agg(F.count("*").alias("n"))
    before = counts.select("demand", "rng", F.coalesce(F.sum("n").over(Window.partitionBy("demand").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # two rows for each range
    numbered = rows.join(F.broadcast(before), ["demand", "rng"]).withColumn("n", F.col("before") + F.col("at"))
    names = ("treated", "control") if wants == 1 else ("control", "treated")
    side = lambda d, name: numbered.where(F.col("demand") == d).select("n", F.col("id").alias(f"{name}_id"), F.col("s").alias(f"{name}_s"))
    pairs = side(True, names[0]).join(side(False, names[1]), "n")
    return pairs.select("treated_id", "control_id", F.abs(F.col("treated_s") - F.col("control_s")).alias("distance"))
