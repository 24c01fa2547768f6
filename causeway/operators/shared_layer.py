"""Outcomes of both arms and the propensity from one shared representation, with a targeted term.

Two layers that all heads share; a linear propensity head; two layers and an output for each arm. A row's loss is that of its own arm's outcome plus
alpha times the propensity's; beta times the squared mean of residuals times T / e - (1 - T) / (1 - e), taken over all rows of a round, pulls the
outcome heads towards what the propensity says (e counts as fixed there).

Training is by `gradient_rounds`. The targeted term needs the mean over a whole round, so tasks send its gradient apart from the others'.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.workers import by_value
from causeway.operators import gradient_rounds

by_value(__name__)

CLIP = 1e-3


@dataclass(frozen=True)
class Layers:
    inputs: int
    shared: int = 32
    head: int = 16

    def shapes(self) -> dict[str, tuple[int, ...]]:
        d, h, g = self.inputs, self.shared, self.head
        out: dict[str, tuple[int, ...]] = {"w1": (d, h), "b1": (h,), "w2": (h, h), "b2": (h,), "wt": (h, 1), "bt": (1,)}
        for a in "01":
            out |= {f"u1{a}": (h, g), f"c1{a}": (g,), f"u2{a}": (g, g), f"c2{a}": (g,), f"u3{a}": (g, 1), f"c3{a}": (1,)}
        return out

    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes().values())

    def split(self, weights: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes().items():
            n = int(np.prod(shape))
            out[name] = weights[at : at + n].reshape(shape)
            at += n
        return out

    def first(self, seed: int) -> np.ndarray:
        r = np.random.default_rng(seed)
        return np.concatenate([(r.normal(0, np.sqrt(2 / s[0]), s) if len(s) == 2 else np.zeros(s)).ravel() for s in self.shapes().values()])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _elu(z: np.ndarray) -> np.ndarray:
    return np.where(z > 0, z, np.expm1(np.minimum(z, 0)))


def _bent(z: np.ndarray) -> np.ndarray:
    """The slope of _elu."""
    return np.where(z > 0, 1.0, np.exp(np.minimum(z, 0)))


def outputs(layers: Layers, weights: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """Logits of the propensity (t) and of both arms' outcomes (0, 1), and what the gradient needs."""
    w = layers.split(weights)
    z1 = x @ w["w1"] + w["b1"]
    h1 = np.maximum(z1, 0)
    z2 = h1 @ w["w2"] + w["b2"]
    phi = _elu(z2)
    out = {"z1": z1, "h1": h1, "z2": z2, "phi": phi, "t": (phi @ w["wt"] + w["bt"])[:, 0]}
    for a in "01":
        p = phi @ w[f"u1{a}"] + w[f"c1{a}"]
        q = np.maximum(p, 0)
        s = q @ w[f"u2{a}"] + w[f"c2{a}"]
        out |= {f"p{a}": p, f"q{a}": q, f"s{a}": s, f"r{a}": _elu(s)}
        out[a] = (out[f"r{a}"] @ w[f"u3{a}"] + w[f"c3{a}"])[:, 0]
    return out


def pulled_back(layers: Layers, weights: np.ndarray, x: np.ndarray, o: dict[str, np.ndarray], dt: np.ndarray, d0: np.ndarray, d1: np.ndarray) -> np.ndarray:
    """The weights' gradient for given gradients of the three logits, summed over rows."""
    w, g = layers.split(weights), {}
    g["wt"], g["bt"] = o["phi"].T @ dt[:, None], np.array([dt.sum()])
    dphi = dt[:, None] * w["wt"].T
    for a, d in (("0", d0), ("1", d1)):
        g[f"u3{a}"], g[f"c3{a}"] = o[f"r{a}"].T @ d[:, None], np.array([d.sum()])
        ds = d[:, None] * w[f"u3{a}"].T * _bent(o[f"s{a}"])
        g[f"u2{a}"], g[f"c2{a}"] = o[f"q{a}"].T @ ds, ds.sum(0)
        dp = (ds @ w[f"u2{a}"].T) * (o[f"p{a}"] > 0)
        g[f"u1{a}"], g[f"c1{a}"] = o["phi"].T @ dp, dp.sum(0)
        dphi = dphi + dp @ w[f"u1{a}"].T
    dz2 = dphi * _bent(o["z2"])
    g["w2"], g["b2"] = o["h1"].T @ dz2, dz2.sum(0)
    dz1 = (dz2 @ w["w2"].T) * (o["z1"] > 0)
    g["w1"], g["b1"] = x.T @ dz1, dz1.sum(0)
    return np.concatenate([g[name].ravel() for name in layers.shapes()])


def gradients(layers: Layers, weights: np.ndarray, x: np.ndarray, t: np.ndarray, y: np.ndarray, alpha: float, binary: bool, smoothing: float) -> np.ndarray:
    """Sums over rows, one after another in an array: rows, loss without the targeted term, moment, gradient of that loss, gradient of the moment."""
    o = outputs(layers, weights, x)
    ts = t * (1 - smoothing) + smoothing / 2
    ys = y * (1 - smoothing) + smoothing / 2 if binary else y
    logit = np.where(t > 0.5, o["1"], o["0"])
    e = _sigmoid(o["t"])
    p = _sigmoid(logit) if binary else logit
    entropy = lambda z, target: np.maximum(z, 0) - z * target + np.log1p(np.exp(-np.abs(z)))
    loss = (entropy(logit, ys) if binary else (logit - ys) ** 2) + alpha * entropy(o["t"], ts)
    dy = p - ys if binary else 2 * (logit - ys)
    arm = t > 0.5
    plain = pulled_back(layers, weights, x, o, alpha * (e - ts), np.where(arm, 0.0, dy), np.where(arm, dy, 0.0))
    ec = np.clip(e, CLIP, 1 - CLIP)
    h = t / ec - (1 - t) / (1 - ec)
    dm = -h * (p * (1 - p) if binary else 1.0)
    pull = pulled_back(layers, weights, x, o, np.zeros(len(x)), np.where(arm, 0.0, dm), np.where(arm, dm, 0.0))
    return np.concatenate([[len(x), loss.sum(), ((y - p) * h).sum()], plain, pull])


def combined(sums: np.ndarray, size: int, beta: float) -> tuple[float, np.ndarray]:
    """The loss of a round and its gradient, from what gradients() gives, added up over all rows."""
    n = max(1.0, sums[0])
    moment = sums[2] / n
    return sums[1] / n + beta * moment**2, sums[3 : 3 + size] / n + 2 * beta * moment * sums[3 + size :] / n


@dataclass
class Model:
    layers: Layers
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    binary: bool
    losses: list[float]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """y0, y1 and the propensity; a missing or infinite value counts as the mean."""
        z = (x - self.centre) / self.scale
        o = outputs(self.layers, self.weights, np.where(np.isfinite(z), z, 0.0))
        act = _sigmoid if self.binary else np.asarray
        return act(o["0"]), act(o["1"]), _sigmoid(o["t"])


def fit(df: DataFrame, key: str, treatment: str, outcome: str, x: list[str], shared: int = 32, head: int = 16, rounds: int = 120, batches: int = 1, rate: float = 0.02, alpha: float = 1.0, beta: float = 0.1, binary: bool = True, smoothing: float = 0.0, seed: int = 42) -> Model:
    """Rows with a null or non-finite value are left out; without rows the weights stay as they were drawn."""
    layers = Layers(len(x), shared, head)
    rows = gradient_rounds.Rows(df, key, [F.col(c) for c in (treatment, outcome, *x)], batches)
    n, centre, scale = rows.spread(list(range(2, 2 + len(x))))
    size = layers.size()

    def each(weights: np.ndarray, v: np.ndarray) -> np.ndarray:
        return gradients(layers, weights, (v[:, 2:] - centre) / scale, v[:, 0], v[:, 1], alpha, binary, smoothing)

    weights, losses = rows.train(layers.first(seed), 3 + 2 * size, each, lambda s: combined(s, size, beta), rounds if n else 0, rate)
    return Model(layers, weights, centre, scale, binary, losses)


def scored(df: DataFrame, model: Model, x: list[str]) -> DataFrame:
    """df with pred_y0, pred_y1 and pred_propensity."""
    from pyspark.sql import types as T

    names = ("pred_y0", "pred_y1", "pred_propensity")
    schema = T.StructType([*[f for f in df.schema.fields if f.name not in names], *[T.StructField(c, T.DoubleType()) for c in names]])

    def run(given: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in given:
            yield pdf.assign(**dict(zip(names, model.predict(pdf[x].to_numpy(float)), strict=True)))

    return df.drop(*names).mapInPandas(run, schema)
