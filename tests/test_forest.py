"""The honest forest on simulated cohorts with known effects."""

import numpy as np
import pytest
from causeway.operators import forest, simulation, tree_growth
from pyspark.sql import functions as F


def test_forest_finds_modifier_and_constant_effects(spark):
    base = simulation.characteristics(spark, 6000, ["x1", "x2", "x3"])
    df = base.withColumn("e", F.lit(0.5)).withColumn("t", (F.pmod(F.xxhash64("unit_id", F.lit("t")), F.lit(2))).cast("int"))
    noise = (F.pmod(F.xxhash64("unit_id", F.lit("y")), F.lit(1000)) / 1000.0 - 0.5) * 0.5
    for effect in (F.when(F.col("x1") > 0, 2.0).otherwise(0.0), F.lit(1.0)):
        own = df.withColumn("tau", effect).withColumn("m", F.col("x2") + 0.5 * F.col("tau")).withColumn("y", F.col("x2") + F.col("t") * F.col("tau") + noise)
        own = own.persist()
        trees = forest.fit_forest(own, "unit_id", "y", "t", "m", "e", ["x1", "x2", "x3"], bags=10)
        out = forest.predict_forest(own, trees, ["x1", "x2", "x3"]).select("tau", "pred_ite", "pred_ite_lower", "pred_ite_upper").toPandas()
        assert abs(out.pred_ite.mean() - out.tau.mean()) < 0.05
        assert np.abs(out.pred_ite - out.tau).mean() < 0.2
        assert (out.pred_ite_lower <= out.pred_ite).all() and (out.pred_ite <= out.pred_ite_upper).all()
        again = forest.fit_forest(own, "unit_id", "y", "t", "m", "e", ["x1", "x2", "x3"], bags=10)
        assert all((a.effect == b.effect).all() for x, y in zip(trees, again, strict=True) for a, b in zip(x, y, strict=True))
        own.unpersist()


def test_crossfit_is_out_of_fold(spark):
    base = simulation.characteristics(spark, 3000, ["x1"])
    df = simulation.simulate(base, simulation.Equation(0.0, {"x1": 1.0}), simulation.Equation(0.0, {"x1": 1.0}, effect=0.5))
    out = forest.crossfit(df, "unit_id", "treatment", "outcome", ["x1"]).toPandas()
    assert len(out) == 3000 and set(out.cv_fold) == {1, 2, 3}
    assert np.abs(out.e_hat - out.true_propensity).mean() < 0.05


def twin(ids, ry, rt, codes, bag, tree, trees, depth, leaf, seed, number):
    """One tree in plain NumPy from the rows themselves: splits and effects by the paths of rows, in the order that nodes are opened."""
    mine, first = tree_growth.drawn(ids, bag, tree, trees, seed)
    ratio = lambda at: (rt[at] * ry[at]).sum() / (rt[at] ** 2).sum() if (rt[at] ** 2).sum() > 1e-9 else None
    effect = ratio(mine & ~first)
    nodes = [[-1, 0, effect if effect is not None else (ratio(mine) or 0.0), mine]]
    level = [0]
    for _ in range(depth):
        below = []
        for at in level:
            rows = nodes[at][3]
            a, b = rows & first, rows & ~first
            tau = ratio(a) or 0.0
            g = rt * (ry - rt * tau)
            best = (0.0, -1, -1)
            for f in tree_growth.features_tried(codes.shape[1], seed, number, at):
                for k in range(tree_growth.BINS):
                    go = codes[:, f] <= k
                    sides = [(a & go).sum(), (a & ~go).sum(), (b & go).sum(), (b & ~go).sum()]
                    if min(sides) >= leaf:
                        gain = g[a & go].sum() ** 2 / sides[0] + g[a & ~go].sum() ** 2 / sides[1]
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, int(f), k)
            if best[1] >= 0:
                go = codes[:, best[1]] <= best[2]
                nodes[at][0], nodes[at][1] = best[1], best[2]
                for side in (go, ~go):
                    own = ratio(b & side)
                    below.append(len(nodes))
                    nodes.append([-1, 0, nodes[at][2] if own is None else own, rows & side])
        level = below
    return nodes


def test_growth_equals_a_loop_over_the_rows(spark, monkeypatch):
    """Also with blocks of a few rows, with few trees at once and with sums that meet by groups of tasks."""
    r = np.random.default_rng(3)
    n = 700
    x = np.column_stack([r.normal(0, 1, n), r.integers(0, 4, n), r.random(n)]).astype(float)
    ry, rt = r.normal(0, 1, n), r.choice([-0.5, 0.5], n)
    ry += rt * (x[:, 0] > 0.3) * 3
    rows = [(i, float(ry[i]), float(rt[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows + [(n, 1.0, 0.5, float("inf"), 1.0, 1.0)], "__key long, __ry double, __rt double, a double, b double, c double").repartition(6)
    cuts = tree_growth.cut_points(df, ["a", "b", "c"])
    codes = np.column_stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)])
    for small in (False, True):
        if small:
            for name, value in (("BLOCK", 50), ("STATE", 1), ("TASKS", 2)):
                monkeypatch.setattr(tree_growth, name, value)
        found, _ = tree_growth.grow(df, ["a", "b", "c"], 2, 2, 3, 15, 5)
        for b in range(2):
            for t in range(2):
                want = twin(np.arange(n), ry, rt, codes, b, t, 2, 3, 15, 5, b * 2 + t)
                got = found[b][t]
                assert [int(f) for f in got.feature] == [w[0] for w in want] and [int(k) for k in got.bin] == [w[1] for w in want]
                assert got.effect == pytest.approx([w[2] for w in want])
                assert (got.predict(x) == got.by_bins().predict(codes)).all()


def test_the_grid_finds_how_deep_effects_go(spark):
    base = simulation.characteristics(spark, 6000, ["x1", "x2"]).withColumn("e", F.lit(0.5)).withColumn("t", F.pmod(F.xxhash64("unit_id", F.lit("t")), F.lit(2)).cast("int"))
    noise = (F.pmod(F.xxhash64("unit_id", F.lit("y")), F.lit(1000)) / 1000.0 - 0.5) * 3
    grid = [(1, 20), (5, 20), (5, 2000)]
    for effect, depth in ((F.lit(1.0), None), (F.when((F.col("x1") > 0) & (F.col("x2") > 0), 3.0).otherwise(0.0), 5)):
        df = base.withColumn("tau", effect).withColumn("m", 0.5 * F.col("tau")).withColumn("y", F.col("t") * F.col("tau") + noise)
        rows = df.select(F.col("unit_id").alias("__key"), (F.col("y") - F.col("m")).alias("__ry"), (F.col("t") - F.col("e")).alias("__rt"), F.col("x1").cast("double").alias("a"), F.col("x2").cast("double").alias("b"))
        trees, table = tree_growth.grow(rows, ["a", "b"], 6, 2, 5, 20, 1)
        best, losses = tree_growth.tuned(trees, table, ["a", "b"], grid, 1)
        assert [x[:2] for x in losses] == grid
        deepest = max(int(t.level[t.feature >= 0].max(initial=-1)) for bag in best for t in bag)
        if depth:
            assert losses[1][2] == min(x[2] for x in losses) and deepest >= 1
        else:
            assert losses[1][2] >= min(losses[0][2], losses[2][2]) - 1e-3
        assert all((t.fewest[t.feature >= 0] >= 20).all() for bag in best for t in bag)


def test_intervals_cover(spark):
    """Over several draws, intervals hold the truth, away from the step, about as often as they say."""
    shares = []
    for draw in range(4):
        base = simulation.characteristics(spark, 3000, ["x1", "x2"], seed=10 + draw).withColumn("e", F.lit(0.5)).withColumn("t", F.pmod(F.xxhash64("unit_id", F.lit(f"t{draw}")), F.lit(2)).cast("int"))
        noise = (F.pmod(F.xxhash64("unit_id", F.lit(f"y{draw}")), F.lit(1000)) / 1000.0 - 0.5) * 2
        df = base.withColumn("tau", F.when(F.col("x1") > 0, 1.0).otherwise(-1.0)).withColumn("m", 0.5 * F.col("tau")).withColumn("y", F.col("t") * F.col("tau") + noise)
        trees = forest.fit_forest(df, "unit_id", "y", "t", "m", "e", ["x1", "x2"], bags=20, trees=4, depth=3)
        out = forest.predict_forest(df, trees, ["x1", "x2"]).where("abs(x1) > 0.2").select("tau", "pred_ite_lower", "pred_ite_upper").toPandas()
        shares.append(((out.pred_ite_lower <= out.tau) & (out.tau <= out.pred_ite_upper)).mean())
    assert np.mean(shares) >= 0.9, shares
    assert forest.fit_forest(df.limit(0), "unit_id", "y", "t", "m", "e", ["x1"]) == []
