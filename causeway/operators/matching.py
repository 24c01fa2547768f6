"""Matching on a score, with replacement, by bucketed band joins and ordered unions instead of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.workers import by_value
from causeway.operators.quantiles import cumulative, parts, row_numbers

by_value(__name__)


def _sides(df: DataFrame, key: str, treatment: str, score: str) -> tuple[DataFrame, DataFrame]:
    pick = lambda value, name: df.where(F.col(treatment) == value).select(F.col(key).alias(f"{name}_id"), F.col(score).alias(f"{name}_score"))
    return pick(1, "treated"), pick(0, "control")


def band_pairs(df: DataFrame, key: str, treatment: str, score: str, caliper: float) -> DataFrame:
    """Every treated and control pair within caliper: an equi-join on cells of that width and their neighbours."""
    treated, control = _sides(df, key, treatment, score)
    near = treated.withColumn("cell", F.explode(F.expr(f"transform(array(-1L, 0L, 1L), d -> d + floor(treated_score / {caliper!r}))")))
    there = control.withColumn("cell", F.floor(F.col("control_score") / F.lit(caliper)))
    out = near.join(there, "cell").withColumn("distance", F.abs(F.col("treated_score") - F.col("control_score"))).where(F.col("distance") <= caliper)
    return out.select("treated_id", "control_id", "distance")


def band_scores(df: DataFrame, treatment: str, score: str, caliper: float) -> DataFrame:
    """treated_score, control_score, distance, n: every two scores of a treated and a control row within caliper, and how many pairs of rows have them.

    The pairs of band_pairs() by their scores, so that rows that share a score are not written out against each other; membership is the score itself.
    """
    sizes = df.where(F.col(treatment).isin(0, 1)).groupBy(F.col(treatment).alias("__t"), F.col(score).alias("__s")).agg(F.count("*").alias("__n"))
    keyed = sizes.select("__t", F.struct("__s", "__n").alias("__k"), "__s")
    pairs = band_pairs(keyed, "__k", "__t", "__s", caliper)
    return pairs.select(F.col("treated_id.__s").alias("treated_score"), F.col("control_id.__s").alias("control_score"), "distance", (F.col("treated_id.__n") * F.col("control_id.__n")).alias("n"))


SALTS = 64


def _smallest_ids(control: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """score, ids: the k smallest ids of each score, in order. A score that many rows share is cut in SALTS parts first."""
    salted = control.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    for by in ([score, "__salt"], [score]):
        turn = F.row_number().over(Window.partitionBy(*by).orderBy(key))
        salted = salted.withColumn("__r", turn).where(F.col("__r") <= k).drop("__r")
    return salted.groupBy(score).agg(F.sort_array(F.collect_list(key)).alias("ids"))


def nearest(df: DataFrame, key: str, treatment: str, score: str, k: int = 1, caliper: float = 0.05) -> DataFrame:
    """The k nearest controls of each treated row within caliper, with replacement; ties go to the smaller id. rank from 1.

    Distinct scores are put in order by ranges; the k control scores on either side of a treated score, found by their places in that order,
    hold its k nearest controls, so the work grows with the rows and not with how many are within caliper.
    """
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).select(F.col(key).alias("__k"), F.col(treatment).alias("__t"), F.col(score).cast("double").alias("__s"))
    control = _smallest_ids(rows.where("__t = 0").select("__k", "__s"), "__k", "__s", k)
    treated = rows.where("__t = 1")
    scores = treated.select("__s").distinct().withColumn("ids", F.lit(None).cast(control.schema["ids"].dataType)).unionByName(control).groupBy("__s").agg(F.max("ids").alias("ids"), F.count(F.when(F.col("ids").isNull(), 1)).alias("asks"))
    placed = cumulative(scores.withColumn("has", F.col("ids").isNotNull().cast("int")), "__s", ["has"])
    there = placed.where("has = 1").select(F.col("has_below").alias("at"), F.col("__s").alias("there"), "ids")
    asks = placed.where("asks > 0").select("__s", F.explode(F.sequence(F.col("has_below") - k, F.col("has_below") + k - 1)).alias("at"))
    near = asks.join(there, "at").withColumn("distance", F.abs(F.col("there") - F.col("__s"))).where(F.col("distance") <= caliper)
    options = near.select("__s", F.explode("ids").alias("control_id"), "distance").groupBy("__s").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "control_id"))), 1, k).alias("best"))  # 2 k^2 at most
    out = treated.select(F.col("__k").alias("treated_id"), "__s").join(options, "__s")
    return out.select("treated_id", F.posexplode("best").alias("rank", "b")).select("treated_id", "b.control_id", "b.distance", (F.col("rank") + 1).alias("rank"))


def sorted_pairs(df: DataFrame, key: str, treatment: str, score: str, low: float = 0.05, high: float = 0.95, caliper: float = 0.05) -> DataFrame:
    """treated_id, control_id, distance: each treated row with the nearest control by score, with replacement, within [low, high].

    If an arm has no row there all finite scores count; if no pair is within caliper the nearest controls are taken whatever their distance;
    an arm without any row raises. Ties go to the smaller id.
    """
    finite = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & (F.abs(F.col(score).cast("double")) < float("inf")))
    inside = F.col(score).between(low, high)
    n = finite.agg(*[F.count_if((F.col(treatment) == a) & c).alias(f"n{a}{i}") for a in (0, 1) for i, c in ((0, F.lit(True)), (1, inside))]).first()
    if not n["n00"] or not n["n10"]:
        raise ValueError("matching needs a treated and a control row")
    rows = finite.where(inside) if n["n01"] and n["n11"] else finite
    found = nearest(rows, key, treatment, score, 1, caliper if caliper > 0 else float("inf"))
    if caliper > 0 and found.isEmpty():
        found = nearest(rows, key, treatment, score, 1, float("inf"))
    return found.drop("rank")


def greedy(df: DataFrame, key: str, treatment: str, score: str, block: list[str], k: int = 1, caliper: float | None = None, seed: int = 42) -> DataFrame:
    """Without replacement: within each block, treated rows in a hash order take their k nearest free controls within caliper. treated_id, control_id, distance, rank.

    The order makes it sequential, so blocks (exact matches or score bands) bound the work and a task's memory; a block's rows go to one task.
    """
    import numpy as np
    import pandas as pd

    def run(pdf):
        treated = pdf[pdf["__t"] == 1].sort_values(["__o", "__k"])
        control = pdf[pdf["__t"] == 0].sort_values(["__s", "__k"])
        scores, ids = control["__s"].to_numpy(), control["__k"].to_numpy()
        left, right = np.arange(len(scores)) - 1, np.arange(len(scores)) + 1  # neighbours among the free
        free = np.ones(len(scores), bool)

        def seek(i, step):
            path = []
            links = left if step < 0 else right
            while 0 <= i < len(scores) and not free[i]:
                path.append(i)
                i = links[i]
            for p in path:
                links[p] = i
            return i

        rows = []
        for tid, s in zip(treated["__k"], treated["__s"], strict=True):
            at = int(np.searchsorted(scores, s))
            for rank in range(1, k + 1):
                a, b = seek(at - 1, -1), seek(at, 1)
                options = [(abs(scores[i] - s), ids[i], i) for i in (a, b) if 0 <= i < len(scores)]
                if not options or caliper is not None and min(options)[0] > caliper:
                    break
                d, cid, i = min(options)
                free[i] = False
                rows.append((tid, cid, d, rank))
        return pd.DataFrame(rows, columns=["treated_id", "control_id", "distance", "rank"])

    from causeway.functions.hashrand import uniform

    few = df.select(*block, F.col(key).cast("long").alias("__k"), F.col(treatment).cast("int").alias("__t"), F.col(score).cast("double").alias("__s"), uniform(F.lit(seed), F.col(key)).alias("__o"))
    return few.groupBy(*block).applyInPandas(run, "treated_id long, control_id long, distance double, rank int")


def assignment(cost) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, rows no more than columns, by shortest augmenting paths."""
    import numpy as np

    cost = np.asarray(cost, float)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            i0 = match[j0]
            now = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], j0
            open_ = np.where(used, np.inf, least)
            j1 = int(open_.argmin())
            delta = open_[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]


def line_assignment(a, b, caliper: float | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j) of ascending scores a and b: as many within caliper as can be, of those the ones with the least total distance.

    On a line pairs need not cross, so one row of the table of best costs follows from the row before. Rows are kept at stripes of the
    square root of their number and those between are computed again on the way back: memory is 2 sqrt(n) rows.
    """
    import numpy as np

    a, b = np.asarray(a, float), np.asarray(b, float)
    if len(a) > len(b):
        return [(i, j) for j, i in line_assignment(b, a, caliper)]
    n, m = len(a), len(b)
    if not n:
        return []
    reach = max(a[-1], b[-1]) - min(a[0], b[0])
    alone = n * (reach if caliper is None else min(caliper, reach)) + 1.0  # more than all pairs together can cost

    def step(above, i):
        d = np.abs(a[i] - b)
        taken = above[:-1] + (d if caliper is None else np.where(d <= caliper, d, np.inf))
        here = above + alone
        here[1:] = np.minimum(here[1:], taken)
        return np.minimum.accumulate(here), taken

    width = int(np.ceil(np.sqrt(n)))
    kept, row = [], np.zeros(m + 1)
    for i in range(n):
        if i % width == 0:
            kept.append(row)
        row = step(row, i)[0]
    pairs, j = [], m
    for stripe in range(len(kept) - 1, -1, -1):
        rows, takes = [kept[stripe]], []
        for i in range(stripe * width, min(n, (stripe + 1) * width)):
            best, taken = step(rows[-1], i)
            rows.append(best), takes.append(taken)
        for at in range(len(takes) - 1, -1, -1):
            j = int(np.searchsorted(-rows[at + 1][: j + 1], -rows[at + 1][j]))  # the first place with this cost: costs fall with j
            if j and takes[at][j - 1] <= rows[at][j] + alone:
                pairs.append((stripe * width + at, j - 1))
                j -= 1
    return pairs[::-1]


def class_assignment(a, n, b, m, caliper: float | None = None):
    """How many of the n[i] rows of score a[i], and of the m[j] of b[j], the best pairs of line_assignment() take; a and b ascending and distinct.

    Successive shortest paths between scores, each of which moves as many rows at once as its scores allow: of all flows of a size each is the
    cheapest, and the last is the largest. Where rows seldom share a score the rows are assigned themselves.
    """
    import numpy as np

    (a, b), (n, m) = (np.asarray(x, float) for x in (a, b)), (np.asarray(x, np.int64) for x in (n, m))
    if not len(a) or not len(b):
        return np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    by_class = 90 * (len(a) + len(b)) * (len(a) * len(b) * 3e-9 + 2e-5)  # seconds, roughly
    if min(n.sum(), m.sum()) * 2 * (max(n.sum(), m.sum()) * 1e-8 + 2e-5) < by_class:
        pairs = np.array(line_assignment(np.repeat(a, n), np.repeat(b, m), caliper), np.int64).reshape(-1, 2)
        own = [np.repeat(np.arange(len(k)), k)[pairs[:, side]] for side, k in ((0, n), (1, m))]
        return np.bincount(own[0], minlength=len(a)), np.bincount(own[1], minlength=len(b))
    cost = np.abs(a[:, None] - b[None])
    cost[cost > (np.inf if caliper is None else caliper)] = np.inf
    flow, left, free = np.zeros(cost.shape, np.int64), n.copy(), m.copy()
    least = 1e-13 * max(1.0, np.abs(a).max(), np.abs(b).max())  # what rounding makes is no shorter path
    while True:
        to_a, from_b = np.where(left > 0, 0.0, np.inf), np.full(len(a), -1)
        to_b, from_a = np.full(len(b), np.inf), np.full(len(b), -1)
        back = np.where(flow > 0, cost, -np.inf)
        while True:
            over = to_a[:, None] + cost
            near = over.argmin(0)
            here = over[near, np.arange(len(b))]
            shorter = here < to_b - least
            if not shorter.any():
                break
            to_b[shorter], from_a[shorter] = here[shorter], near[shorter]
            over = to_b[None] - back
            near = over.argmin(1)
            here = over[np.arange(len(a)), near]
            shorter = here < to_a - least
            to_a[shorter], from_b[shorter] = here[shorter], near[shorter]
        ends = np.where(free > 0, to_b, np.inf)
        j = end = int(ends.argmin())
        if ends[j] == np.inf:
            return n - left, m - free
        path, most = [], int(free[j])
        while True:
            i = int(from_a[j])
            path.append((i, j, 1))
            j = int(from_b[i])
            if j < 0:
                break
            path.append((i, j, -1))
            most = min(most, int(flow[i, j]))
        most = min(most, int(left[i]))
        for x, y, sign in path:
            flow[x, y] += sign * most
        left[i] -= most
        free[end] -= most


def optimal(df: DataFrame, key: str, treatment: str, score: str, block: list[str], caliper: float | None = None) -> DataFrame:
    """One to one within each block: as many pairs within caliper as can be, with the least total distance. Rows without a score stay alone.

    A task gets a block's distinct scores and how many rows have each, and tells how many of these are paired. On a line pairs need not cross, so
    the k-th treated row of those that are paired, by score, goes with the k-th control: rows are numbered and joined by number. A task's time
    grows with the cube of a block's distinct scores or the product of its arms, whichever is less.
    """
    import numpy as np
    import pyarrow as pa

    s = F.col(score).cast("double")
    rows = df.where(s.isNotNull() & ~F.isnan(s) & F.col(treatment).isin(0, 1)).select(F.struct(*block).alias("__b"), F.col(key).cast("long").alias("__k"), F.col(treatment).cast("int").alias("__t"), s.alias("__s"))
    sizes = rows.groupBy("__b", "__t", "__s").agg(F.count("*").alias("__size"))

    def solve(group: pa.Table) -> pa.Table:
        t, z, size = (group.column(c).to_numpy() for c in ("__t", "__s", "__size"))
        order = np.lexsort((z, t))
        t, z, size = t[order], z[order], size[order]
        taken = np.concatenate(class_assignment(z[t == 1], size[t == 1], z[t == 0], size[t == 0], caliper)[::-1])
        before = np.cumsum(taken) - taken
        before[t == 1] -= taken[t == 0].sum()
        return pa.table({"b": group.column("__b").take(pa.array(order)), "t": pa.array(t, pa.int32()), "s": z, "taken": pa.array(taken, pa.int64()), "before": pa.array(before, pa.int64())})

    kind = rows.schema["__b"].dataType.simpleString()
    taken = sizes.groupBy("__b").applyInArrow(solve, f"b {kind}, t int, s double, taken long, before long").where("taken > 0")
    numbered = row_numbers(rows.withColumn("__h", F.pmod(F.xxhash64("__k"), F.lit(parts(df))).cast("int")), "__h", [F.col("__k")], ["__b", "__t", "__s"])
    paired = numbered.join(taken, (F.col("__b") == F.col("b")) & (F.col("__t") == F.col("t")) & (F.col("__s") == F.col("s"))).where("__rn <= taken")
    side = lambda arm, name: paired.where(F.col("t") == arm).select("b", (F.col("before") + F.col("__rn")).alias("at"), F.col("__k").alias(f"{name}_id"), F.col("s").alias(f"{name}_score"))
    out = side(1, "treated").join(side(0, "control"), ["b", "at"])
    return out.select("treated_id", "control_id", F.abs(F.col("treated_score") - F.col("control_score")).alias("distance"))
