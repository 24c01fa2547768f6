"""The shared-layer learner against numerical differences, a loop over the whole table in NumPy, and what a linear model can find."""

import numpy as np
import pytest
from causeway.operators import gradient_rounds, shared_layer, simulation
from pyspark.sql import functions as F


def drawn(n, width, seed=0, binary=True):
    r = np.random.default_rng(seed)
    x = r.normal(0, 1, (n, width))
    t = (r.random(n) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    z = 0.5 * x[:, 1] + t * x[:, 0]
    return x, t, ((r.random(n) < 1 / (1 + np.exp(-z))).astype(float) if binary else z + r.normal(0, 0.1, n))


@pytest.mark.parametrize("binary", [True, False])
@pytest.mark.parametrize("smoothing", [0.0, 0.1])
def test_gradient_equals_differences(binary, smoothing):
    layers = shared_layer.Layers(3, 5, 4)
    x, t, y = drawn(40, 3, 1, binary)
    w = layers.first(3) + np.random.default_rng(4).normal(0, 0.1, layers.size())
    size, alpha, beta = layers.size(), 0.7, 0.4

    def loss(v, e):
        """Term by term, with the propensity of the targeted term held at e."""
        o = shared_layer.outputs(layers, v, x)
        logit, sig = np.where(t == 1, o["1"], o["0"]), lambda z: 1 / (1 + np.exp(-z))
        soft = lambda a: a * (1 - smoothing) + 0.5 * smoothing
        cross = lambda p, a: -(a * np.log(p) + (1 - a) * np.log(1 - p)).mean()
        outcome = cross(sig(logit), soft(y)) if binary else ((logit - y) ** 2).mean()
        moment = ((y - (sig(logit) if binary else logit)) * (t / e - (1 - t) / (1 - e))).mean()
        return outcome + alpha * cross(sig(o["t"]), soft(t)) + beta * moment**2

    e = np.clip(1 / (1 + np.exp(-shared_layer.outputs(layers, w, x)["t"])), 1e-3, 1 - 1e-3)
    value, g = shared_layer.combined(shared_layer.gradients(layers, w, x, t, y, alpha, binary, smoothing), size, beta)
    assert value == pytest.approx(loss(w, e))
    step = np.eye(size) * 1e-6
    want = np.array([(loss(w + s, e) - loss(w - s, e)) / 2e-6 for s in step])
    assert np.abs(g - want).max() < 1e-6


@pytest.mark.parametrize("batches", [1, 3])
def test_training_equals_a_loop_over_the_table(spark, batches):
    x, t, y = drawn(600, 2, 2)
    rows = [(i, *map(float, x[i]), float(t[i]), float(y[i])) for i in range(600)] + [(700, None, 1.0, 1.0, 1.0), (701, float("nan"), 1.0, 0.0, 1.0), (702, 1.0, 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, t double, y double").repartition(5)
    model = shared_layer.fit(df, "id", "t", "y", ["a", "b"], 6, 4, rounds=9, batches=batches, seed=1)
    deal = {r.id: r.d for r in df.select("id", F.pmod(F.xxhash64("id"), F.lit(batches)).alias("d")).collect()}
    deals = np.array([deal[i] for i in range(600)])
    z = (x - x.mean(0)) / x.std(0)
    layers = shared_layer.Layers(2, 6, 4)
    w, speed, spread = layers.first(1), np.zeros(layers.size()), np.zeros(layers.size())
    for turn in range(9):
        at = deals == turn % batches
        loss, g = shared_layer.combined(shared_layer.gradients(layers, w, z[at], t[at], y[at], 1.0, True, 0.0), layers.size(), 0.1)
        assert model.losses[turn] == pytest.approx(loss)
        w, speed, spread = gradient_rounds.moved(w, speed, spread, g, turn, 0.02)
    assert np.allclose(model.weights, w, atol=1e-8)
    out = shared_layer.scored(df, model, ["a", "b"]).toPandas()
    assert len(out) == 603 and out[["pred_y0", "pred_y1", "pred_propensity"]].notna().all().all()
    none = shared_layer.fit(df.limit(0), "id", "t", "y", ["a", "b"], rounds=3)
    assert none.losses == [] and len(shared_layer.scored(df, none, ["a", "b"]).collect()) == 603


def test_effects_that_bend_are_found(spark):
    base = simulation.characteristics(spark, 8000, ["x1", "x2"]).withColumn("bend", F.col("x1") * F.col("x1") - 1)
    df = simulation.simulate(base, simulation.Equation(0.0, {"x1": 0.6}), simulation.Equation(-1.0, {"x2": 0.5}, effect=0.6, modifiers={"bend": 1.2}), positivity=(0.05, 0.95))
    model = shared_layer.fit(df.where("unit_id % 2 = 0"), "unit_id", "treatment", "outcome", ["x1", "x2"], rounds=100)
    out = shared_layer.scored(df.where("unit_id % 2 = 1"), model, ["x1", "x2"]).toPandas()
    ite = out.pred_y1 - out.pred_y0
    assert np.corrcoef(ite, out.true_ite)[0, 1] > 0.7
    assert abs(ite.mean() - out.true_ite.mean()) < 0.05
    assert np.abs(out.pred_propensity - out.true_propensity).mean() < 0.06
    assert model.losses[-1] < 0.95 * model.losses[0]
