"""Distribution functions, assignment, greedy matching, calibration and the R-learner against closed forms and brute force."""

import itertools
import math

import numpy as np
import pytest
from causeway.functions import tails
from causeway.operators import encoding, matching, simulation
from pyspark.sql import functions as F


def test_tails():
    assert tails.normal_cdf(1.959963984540054) == pytest.approx(0.975, abs=1e-12)
    assert tails.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert tails.t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    assert tails.chi2_1_upper(3.841458820694124) == pytest.approx(0.05, abs=1e-12)
    for n, p in ((7, 0.3), (40, 0.9)):
        total = 0.0
        for k in range(n + 1):
            total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            assert tails.binomial_cdf(k, n, p) == pytest.approx(total, abs=1e-12)
    assert tails.mcnemar_p(0, 0) == (1.0, 1.0) and tails.mcnemar_p(3, 3)[0] > 1 and tails.mcnemar_p(3, 3)[1] == 1
    bounds = tails.rosenbaum(30, 10)
    assert all(a[1] >= b[1] and a[2] <= b[2] for a, b in itertools.pairwise(bounds))


def test_assignment_is_least():
    r = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 5), (6, 6), (5, 7)):
        c = r.random((n, m))
        pairs = matching.assignment(c)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == n
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert sum(c[i, j] for i, j in pairs) == pytest.approx(best)


def test_greedy_and_optimal(spark):
    r = np.random.default_rng(1)
    rows = [(i, int(i % 3 == 0), float(r.random()), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, t int, e double, b int")
    pairs = matching.greedy(df, "id", "t", "e", ["b"], caliper=0.2).collect()
    e = {i: x for i, _, x, _ in rows}
    assert len({p.control_id for p in pairs}) == len(pairs) and all(p.distance <= 0.2 and p.treated_id % 2 == p.control_id % 2 for p in pairs)
    every = matching.greedy(df, "id", "t", "e", ["b"]).collect()
    best = matching.optimal(df, "id", "t", "e", ["b"]).collect()
    assert len(best) == len(every) == 40
    assert sum(p.distance for p in best) <= sum(p.distance for p in every) + 1e-9
    assert all(abs(e[p.treated_id] - e[p.control_id]) == pytest.approx(p.distance) for p in best)


def test_class_assignment_is_the_rows_assignment():
    r = np.random.default_rng(9)
    for trial in range(120):
        digits = int(r.integers(1, 4))
        a, b = (np.unique(np.round(r.random(r.integers(0, 7)), digits)) for _ in range(2))
        often = 300 if trial % 2 else 3  # many rows of a score go by flows, few by rows
        n, m = r.integers(1, often, len(a)), r.integers(1, often, len(b))
        caliper = (None, 0.1, 0.3, 0.0)[trial % 4]
        x, y = np.repeat(a, n), np.repeat(b, m)
        pairs = matching.line_assignment(x, y, caliper)
        taken = matching.class_assignment(a, n, b, m, caliper)
        left, right = np.repeat(a, taken[0]), np.repeat(b, taken[1])
        assert len(left) == len(right) == len(pairs) and (taken[0] <= n).all() and (taken[1] <= m).all()
        assert np.abs(left - right).sum() == pytest.approx(sum(abs(x[i] - y[j]) for i, j in pairs)) and (caliper is None or (np.abs(left - right) <= caliper).all())


def test_optimal_pairs_of_many_rows_with_equal_scores(spark):
    """A block was a task whose time grew with the product of its arms, here 7,500 million."""
    rows = spark.range(400_000).select("id", (F.col("id") % 4 == 0).cast("int").alias("t"), (F.floor(F.col("id") / 4) % 50 / 100.0).alias("e"), F.when(F.col("id") % 2 < 2, "x").alias("b"), F.lit(None).cast("string").alias("none"))
    found = matching.optimal(rows, "id", "t", "e", ["b", "none"], 0.05).agg(F.count("*"), F.countDistinct("treated_id"), F.countDistinct("control_id"), F.sum("distance"), F.min(F.col("treated_id") % 4), F.max(F.col("treated_id") % 4)).first()
    assert tuple(found) == (100_000, 100_000, 100_000, 0.0, 0, 0)
    few = spark.createDataFrame([(1, 1, 0.1, "x"), (2, 0, None, "x"), (3, 0, float("nan"), "x"), (4, 0, 0.5, "y"), (5, 1, 0.4, "y"), (6, 1, 0.5, "y")], "id long, t int, e double, b string")
    assert [tuple(p) for p in matching.optimal(few, "id", "t", "e", ["b"], 0.2).collect()] == [(6, 4, 0.0)]
    assert matching.optimal(few.limit(0), "id", "t", "e", ["b"]).count() == 0


def test_band_scores_count_all_pairs_without_writing_them_out(spark):
    """Half a million equal scores in each arm are 250 thousand million pairs of rows, and one of scores."""
    rows = spark.range(1_000_000).select("id", (F.col("id") % 2).cast("int").alias("t"), F.when(F.col("id") < 10, F.col("id") / 10.0).otherwise(5.0).alias("e"))
    got = {(r.treated_score, r.control_score): (r.n, round(r.distance, 9)) for r in matching.band_scores(rows, "t", "e", 0.1000001).collect()}
    want = {(i / 10, j / 10): (1, 0.1) for i in range(1, 10, 2) for j in (i - 1, i + 1) if j < 10}
    assert got == want | {(5.0, 5.0): (499_995**2, 0.0)}
    assert matching.band_scores(rows.limit(0), "t", "e", 0.1).count() == 0


def test_band_pairs_are_all_pairs(spark):
    r = np.random.default_rng(2)
    rows = [(i, int(i % 2), round(float(r.random()), 2)) for i in range(80)]
    got = {(p.treated_id, p.control_id) for p in matching.band_pairs(spark.createDataFrame(rows, "id long, t int, e double"), "id", "t", "e", 0.05).collect()}
    assert got == {(a, b) for a, s, x in rows for b, u, y in rows if s == 1 and u == 0 and abs(x - y) <= 0.05}


def test_known_effect_is_recovered(spark):
    base = simulation.characteristics(spark, 20_000, ["x1", "x2"])
    t = simulation.calibrated(base, simulation.Equation(0.0, {"x1": 0.6}), 0.4)
    df = simulation.simulate(base, t, simulation.Equation(0.0, {"x1": 0.5}), positivity=(0.05, 0.95))
    assert df.agg(F.avg("true_propensity")).first()[0] == pytest.approx(0.4, abs=0.01)
    y = F.col("x1") + F.col("treatment") * (1.0 + 0.5 * F.col("x2"))
    m = F.col("x1") + F.col("true_propensity") * (1.0 + 0.5 * F.col("x2"))
    found = simulation.r_learner(df.withColumn("y", y).withColumn("m", m), "y", "treatment", "m", "true_propensity", ["x1", "x2"])
    assert found["intercept"] == pytest.approx(1.0, abs=1e-3) and found["x2"] == pytest.approx(0.5, abs=1e-3) and found["x1"] == pytest.approx(0.0, abs=1e-3)


def test_statistics_edges(spark):
    from causeway.operators import cohort, effects, metrics, quantiles

    rows = [(i, i % 2, [0.2, 0.2, 0.5, None, 0.9][i % 5]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, t int, e double")
    known = [e for _, _, e in rows if e is not None]
    q = quantiles.quantiles(df, "e", [0.0, 0.3, 0.77, 1.0]).first().q
    assert q == pytest.approx(list(np.quantile(known, [0.0, 0.3, 0.77, 1.0])))
    assert quantiles.quantiles(df.limit(0), "e", [0.5]).first().q == [None]
    got = {(p.treated_id, p["rank"]): p.control_id for p in matching.nearest(df, "id", "t", "e", 3, 0.0).collect()}
    want = {}
    for i, t, e in rows:
        if t == 1 and e is not None:
            for r, (_, c) in enumerate(sorted((abs(e - f), j) for j, u, f in rows if u == 0 and f is not None and f == e)[:3]):
                want[i, r + 1] = c
    assert got == want
    with pytest.raises(ValueError, match="treated and a control"):
        matching.sorted_pairs(df.where("t = 1"), "id", "t", "e")
    far = spark.createDataFrame([(1, 1, 0.1), (2, 0, 0.9), (3, 0, 0.8)], "id long, t int, e double")
    assert [(p.treated_id, p.control_id) for p in matching.sorted_pairs(far, "id", "t", "e", caliper=0.05).collect()] == [(1, 3)]  # nothing within the caliper
    w = effects.poisson_weights(np.arange(4000), 200)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.05
    with pytest.raises(ValueError, match="folds"):
        cohort.folds(df.limit(3), "id", 5)
    alone = cohort.folds(df.withColumn("s", (F.col("id") == 0).cast("int")), "id", 5, strata=["s"])  # a stratum of one row: dealt as without
    assert [r["count"] for r in alone.groupBy("cv_fold").count().collect()] == [10] * 5
    nested = cohort.nested_folds(df.select("id"), "id", 3, 2).toPandas()
    assert len(nested) == 100 and nested.groupby("id").size().eq(2).all() and set(nested.inner_fold) == {1, 2}
    with pytest.raises(ValueError, match="prediction"):
        cohort.out_of_fold(df, [df.select("id").limit(3)], "id")
    c = df.select(metrics.safe_corr(F.col("e"), F.lit(1.0)).alias("x")).first()
    assert c.x is None


def test_specs():
    both = encoding.FeatureSpec("ecog", "categorical", ("0", "1"))
    assert encoding.by_role([both], "confounder") == [both] and encoding.merged([both, both]) == [both]
    with pytest.raises(ValueError, match="roles"):
        encoding.FeatureSpec("x", "continuous", roles=())
