"""Matching over whole tables against a loop in order and against an assignment of the whole matrix of distances."""

import zlib

import numpy as np
import pytest
from causeway.functions.hashrand import uniform
from causeway.operators import line_matching, matching
from pyspark.sql import functions as F

SCHEMA = "id long, t int, e double"


def scores(kind, n, r):
    if kind == "even":
        return r.random(n)
    if kind == "crowd":  # most rows share one score
        return np.where(r.random(n) < 0.7, 0.5, r.random(n))
    return r.integers(0, 9, n) / 8.0  # few values


def table(kind, treated, control, seed=0):
    r = np.random.default_rng([seed, zlib.crc32(kind.encode())])
    return [(i, int(i < treated), float(s)) for i, s in enumerate(scores(kind, treated + control, r))]


def hard(rows):
    return rows + [(9001, 1, None), (9002, 0, float("nan")), (9003, 0, float("inf")), (None, 1, 0.5), (9004, None, 0.5)]


def in_order(rows, order, k, caliper):
    """Each treated row in its turn takes the nearest of all free controls."""
    free = sorted((s, i) for i, t, s in rows if t == 0)
    out = []
    for i, s in sorted(((i, s) for i, t, s in rows if t == 1), key=lambda x: (order[x[0]], x[0])):
        for rank in range(1, k + 1):
            options = [(abs(z - s), z >= s, j if z >= s else -j, z, j) for z, j in free]
            if not options or min(options)[0] > caliper:
                break
            d, *_, z, j = min(options)
            free.remove((z, j))
            out.append((i, j, d, rank))
    return sorted(out)


@pytest.mark.parametrize("kind", ["even", "crowd", "few"])
@pytest.mark.parametrize(("treated", "control", "k", "caliper"), [(120, 300, 1, None), (200, 150, 1, 0.1), (90, 200, 2, 0.05), (300, 60, 1, None)])
def test_greedy_equals_the_loop(spark, kind, treated, control, k, caliper):
    rows = table(kind, treated, control)
    df = spark.createDataFrame(hard(rows), SCHEMA).repartition(3)
    order = {r.id: r.o for r in df.where("id is not null").select("id", uniform(F.lit(7), F.col("id")).alias("o")).collect()}
    got = sorted(tuple(r) for r in line_matching.greedy(df, "id", "t", "e", k, caliper, seed=7).collect())
    want = in_order(rows, order, k, np.inf if caliper is None else caliper)
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_greedy_of_thousands(spark, monkeypatch):
    """Rows of a crowd start beyond the ranges that earlier ones fill; few rounds, whatever the ranges."""
    monkeypatch.setattr(line_matching, "RANGE", 150)
    rows = table("crowd", 1500, 3500, seed=3)
    df = spark.createDataFrame(rows, SCHEMA)
    order = {r.id: r.o for r in df.select("id", uniform(F.lit(42), F.col("id")).alias("o")).collect()}
    got = sorted(tuple(r)[:2] for r in line_matching.greedy(df, "id", "t", "e").collect())
    assert got == [x[:2] for x in in_order(rows, order, 1, np.inf)]


def test_beyond_skips_only_what_is_taken():
    r = np.random.default_rng(5)
    for _ in range(300):
        z = np.sort(r.integers(0, 30, 40) / 10.0)
        cuts = [0, *sorted(set(r.integers(1, 40, 5).tolist())), 40]
        parts = [z[i:j] for i, j in zip(cuts, cuts[1:])]
        n, low, high = (np.array([f(p) for p in parts]) for f in (len, min, max))
        s, rank = float(r.random() * 3), int(r.integers(0, 40))
        at = min(int(np.searchsorted(high, s)), len(parts) - 1)
        a, b = line_matching._beyond(n, low, high, at, s, rank)
        skipped = np.concatenate(parts[a : b + 1]) if b >= a else np.zeros(0)
        kept = np.concatenate([*parts[:a], *parts[b + 1 :]]) if b >= a else z
        if len(skipped):
            assert len(skipped) <= rank
            assert (np.abs(z - s) <= np.abs(skipped - s).max() + 1e-12).sum() <= rank and len(skipped) + len(kept) == 40


@pytest.mark.parametrize("kind", ["even", "crowd", "few"])
@pytest.mark.parametrize(("treated", "control"), [(60, 140), (140, 60), (1, 30), (75, 75)])
def test_optimal_equals_the_assignment(spark, kind, treated, control):
    rows = table(kind, treated, control, seed=1)
    df = spark.createDataFrame(hard(rows), SCHEMA).repartition(3)
    e = {i: s for i, _, s in rows}
    a, b = ([s for _, t, s in rows if t == x] for x in (1, 0))
    cost = np.abs(np.subtract.outer(a, b))
    cost = cost if treated <= control else cost.T
    got = line_matching.optimal(df, "id", "t", "e").collect()
    assert len(got) == min(treated, control) == len({r.treated_id for r in got}) == len({r.control_id for r in got})
    assert all(r.distance == pytest.approx(abs(e[r.treated_id] - e[r.control_id])) for r in got)
    assert sum(r.distance for r in got) == pytest.approx(sum(cost[i, j] for i, j in matching.assignment(cost)))
    # leaving rows alone at a price: as many more columns that cost it
    price = 0.03
    priced = np.concatenate([np.minimum(cost, price), np.full((len(cost), len(cost)), price)], 1)
    got = line_matching.optimal(df, "id", "t", "e", alone=price).collect()
    assert all(r.distance <= price + 1e-12 for r in got)
    assert sum(r.distance for r in got) + price * (len(cost) - len(got)) == pytest.approx(sum(priced[i, j] for i, j in matching.assignment(priced)))


def test_optimal_in_many_ranges(spark, monkeypatch):
    """Integers, so equal and not only near; flows of hundreds cross the ranges."""
    monkeypatch.setattr(line_matching, "RANGE", 100)
    r = np.random.default_rng(9)
    rows = [(i, 1, float(r.integers(0, 200))) for i in range(700)] + [(1000 + i, 0, float(r.integers(150, 1200))) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    a, b = (np.sort([s for _, t, s in rows if t == x]) for x in (1, 0))
    want = sum(abs(a[i] - b[j]) for i, j in matching.line_assignment(a, b))
    got = line_matching.optimal(df, "id", "t", "e").collect()
    assert len(got) == 700 and sum(x.distance for x in got) == want


def test_tables_without_an_arm(spark):
    for rows in ([], [(1, 1, 0.5)], [(1, 0, 0.5), (2, 0, 0.1)], [(1, 1, None), (2, 0, 0.5)]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert line_matching.greedy(df, "id", "t", "e").collect() == [] and line_matching.optimal(df, "id", "t", "e").collect() == []
    one = spark.createDataFrame([(1, 1, 0.5), (2, 0, 0.9)], SCHEMA)
    assert [tuple(r)[:2] for r in line_matching.greedy(one, "id", "t", "e").collect()] == [(1, 2)] == [tuple(r)[:2] for r in line_matching.optimal(one, "id", "t", "e").collect()]
    assert line_matching.greedy(one, "id", "t", "e", caliper=0.1).collect() == []
