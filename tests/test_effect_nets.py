"""Pair batches, the pair head, the residual stage and gated pooling against NumPy."""

import numpy as np
import pytest
from causeway.operators import effect_nets, gradient_rounds, matching, pooling, simulation
from pyspark.sql import functions as F


def differences(f, w, step=1e-6):
    return np.array([(f(w + s) - f(w - s)) / (2 * step) for s in np.eye(len(w)) * step])


def test_pair_gradient_equals_differences():
    """With the adversary's gradient turned round where it enters the code."""
    r = np.random.default_rng(1)
    net = effect_nets.Net(3, 6, 4, 3)
    w = net.first(2) + r.normal(0, 0.1, net.size())
    v = np.concatenate([r.integers(0, 2, (30, 2)).astype(float), r.normal(0, 1, (30, 6))], 1)
    centre, scale = np.zeros(3), np.ones(3)
    sums = effect_nets.pair_sums(net, w, v, centre, scale, 0.8, 0.3)
    assert sums[0] == 30

    def loss(u, adversary):
        x1, x0 = v[:, 2:5], v[:, 5:]
        (a, b), sig = (net.forward(u, x)[0] for x in (x1, x0)), lambda z: 1 / (1 + np.exp(-z))
        cross = lambda p, y: -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
        gap = (sig(a[:, 1]) - sig(a[:, 0]) + sig(b[:, 1]) - sig(b[:, 0])) / 2 - (v[:, 0] - v[:, 1])
        return cross(sig(a[:, 1]), v[:, 0]) + cross(sig(b[:, 0]), v[:, 1]) + 0.8 * (gap**2).sum() + adversary * (cross(sig(a[:, 2]), 1.0) + cross(sig(b[:, 2]), 0.0))

    assert sums[1] == pytest.approx(loss(w, 0.3))
    plain, whole = differences(lambda u: loss(u, 0.0), w), differences(lambda u: loss(u, 0.3), w)
    adv = whole - plain
    heads = np.zeros(net.size(), bool)
    heads[-(4 * 3 + 3) :] = True
    assert np.abs(sums[2:] - plain - np.where(heads, adv, -adv)).max() < 1e-5


def test_residual_gradient_equals_differences():
    r = np.random.default_rng(3)
    net = effect_nets.Net(2, 5, 3, 1)
    w = net.first(2) + r.normal(0, 0.1, net.size())
    v = r.normal(0, 1, (40, 5))
    sums = effect_nets.residual_sums(net, w, v, np.zeros(2), np.ones(2))
    loss = lambda u: (np.maximum(v[:, 1] ** 2, 1e-3) * (v[:, 0] - v[:, 1] * (v[:, 2] + net.forward(u, v[:, 3:])[0][:, 0])) ** 2).sum()
    assert sums[1] == pytest.approx(loss(w)) and np.abs(sums[2:] - differences(loss, w)).max() < 1e-5


@pytest.mark.parametrize("n", [1, 3, 40, 64])
def test_pair_batches_are_full_and_hold_each_pair(spark, n):
    pairs = spark.createDataFrame([(i, 1000 + i % 7) for i in range(n)], "treated_id long, control_id long")
    out = effect_nets.pair_batches(pairs, ["treated_id", "control_id"], 8).collect()
    size = -(-n // 8)
    assert sorted((r.batch, r.place) for r in out) == [(b, p) for b in range(size) for p in range(8)]
    seen = {i: sum(r.treated_id == i for r in out) for i in range(n)}
    assert set(seen) == set(range(n)) and max(seen.values()) - min(seen.values()) <= 1
    if n == 40:
        other = effect_nets.pair_batches(pairs, ["treated_id", "control_id"], 8, epoch=1).collect()
        assert {(r.batch, r.treated_id) for r in out} != {(r.batch, r.treated_id) for r in other}


def test_rounds_equal_a_loop(spark):
    """Whatever the number of tasks, and when sums meet by groups of tasks first."""
    r = np.random.default_rng(4)
    rows = [(i, *map(float, r.normal(0, 1, 5))) for i in range(300)]
    df = spark.createDataFrame(rows + [(999, None, 1.0, 1.0, 1.0, 1.0)], "id long, y double, t double, b double, x1 double, x2 double").withColumns({"m": F.lit(0.0), "e": F.lit(0.0)})
    v = np.array([x[1:] for x in rows])
    net = effect_nets.Net(2, 6, 3, 1)
    w = net.first(42)
    w[-4:] = 0
    centre, scale = v[:, 3:].mean(0), v[:, 3:].std(0)
    speed = square = np.zeros(len(w))
    losses = []
    for turn in range(5):
        sums = effect_nets.residual_sums(net, w, v, centre, scale)
        losses.append(sums[1] / sums[0])
        w, speed, square = gradient_rounds.moved(w, speed, square, sums[2:] / sums[0], turn, 0.02, 1e-2)
    for parts, tasks in ((3, 128), (9, 2)):
        before, gradient_rounds.TASKS = gradient_rounds.TASKS, tasks
        try:
            got = effect_nets.fit_residual(df.repartition(parts), "id", "y", "t", "m", "e", "b", ["x1", "x2"], 6, 3, rounds=5)
        finally:
            gradient_rounds.TASKS = before
        assert got.losses == pytest.approx(losses) and np.allclose(got.weights, w, atol=1e-9)


def cohort(spark):
    base = simulation.characteristics(spark, 6000, ["x1", "x2"]).withColumn("bend", F.col("x2") * F.col("x2") - 1)
    return simulation.simulate(base, simulation.Equation(0.0, {"x1": 0.8}), simulation.Equation(-0.5, {"x1": 0.4}, effect=0.8, modifiers={"bend": 1.2}), positivity=(0.05, 0.95))


def test_the_pair_head_finds_effects_within_bins_of_propensity(spark):
    """Effects vary with x2 alone, which says nothing of the propensity: bins of it see one effect, the head does not."""
    df = cohort(spark)
    pairs = matching.sorted_pairs(df, "unit_id", "treatment", "true_propensity")
    model = effect_nets.fit_pairs(pairs, df, "unit_id", "outcome", ["x1", "x2"], rounds=80)
    out = effect_nets.scored(df, model, ["x1", "x2"], ["mu0", "mu1"], "z").toPandas()
    sig = lambda z: 1 / (1 + np.exp(-z))
    ite = sig(out.mu1) - sig(out.mu0)
    bins = (out.true_propensity.rank() * 8 / (len(out) + 1)).astype(int)
    by_bin = bins.map(out.true_ite.groupby(bins).mean())
    assert np.corrcoef(ite, out.true_ite)[0, 1] > 0.6 > abs(np.corrcoef(by_bin, out.true_ite)[0, 1])
    assert abs(ite.mean() - out.true_ite.mean()) < 0.06 and [c for c in out if c.startswith("z")] == [f"z{i}" for i in range(8)]


def test_the_residual_stage_finds_what_the_base_misses(spark):
    df = cohort(spark).withColumns({"base": F.lit(0.15), "e": F.col("true_propensity"), "m": F.col("true_y0") + F.col("true_propensity") * F.col("true_ite")})
    model = effect_nets.fit_residual(df.where("unit_id % 2 = 0"), "unit_id", "outcome", "treatment", "m", "e", "base", ["x2"], rounds=120, decay=1e-3)
    out = effect_nets.scored(df.where("unit_id % 2 = 1"), model, ["x2"], ["more"]).toPandas()
    assert np.corrcoef(out.base + out.more, out.true_ite)[0, 1] > 0.6


def plainly(h, gate):
    """One key, from the formula, slot by slot."""
    out = []
    for s in range(gate.slots.shape[1]):
        scores = []
        for x in h:
            g = np.tanh(x @ gate.content + gate.content_bias) * (1 / (1 + np.exp(-(x @ gate.gate + gate.gate_bias))))
            g = (g - g.mean()) / np.sqrt(((g - g.mean()) ** 2).mean() + 1e-5) * gate.gain + gate.shift
            scores.append(float(g @ gate.mix @ gate.slots[:, s]))
        w = np.exp(np.array(scores) - max(scores))
        out += list((w / w.sum()) @ np.array(h))
    return out


@pytest.mark.parametrize("held", [1 << 22, 1])
def test_gated_pooling(spark, monkeypatch, held):
    monkeypatch.setattr(pooling, "HELD", held)
    r = np.random.default_rng(5)
    gate = pooling.Gate.drawn(6, 4, 3)
    gate = pooling.Gate(**(gate.__dict__ | {"slots": gate.slots * 40, "gain": r.normal(1, 0.2, 4), "shift": r.normal(0, 0.1, 4)}))
    rows = [(f"k{int(r.integers(0, 6))}", [float(x) for x in r.normal(0, 3, 6)], int(r.random() < 0.8)) for _ in range(400)]
    rows += [("hot", [float(x) for x in r.normal(0, 3, 6)], 1) for _ in range(3000)]
    want = {k: plainly([x for n, x, u in rows if n == k and u], gate) for k in {x[0] for x in rows}}
    odd = [("none", None, 1), ("none", [1.0], 1), ("k0", [None] * 6, 1), ("k0", [float("nan")] * 6, 1), ("padding", [1.0] * 6, 0), (None, [1.0] * 6, 1)]
    df = spark.createDataFrame(rows + odd, "name string, h array<double>, used int").repartition(7)
    got = {x.name: x.pooled for x in pooling.gated(df, "name", "h", gate, "used").collect()}
    assert set(got) == {*want, "none", "padding", None}
    assert got["none"] is None and got["padding"] is None and got[None] == pytest.approx([1.0] * 18)
    assert all(got[k] == pytest.approx(v) for k, v in want.items())
    assert pooling.gated(df.limit(0), "name", "h", gate).collect() == []
