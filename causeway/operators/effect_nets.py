"""Small nets for effects: a head trained on matched pairs, and a second stage on what a base effect leaves over.

Both share one shape: a hidden layer, a narrow code, linear outputs. They train by gradient rounds over packed rows.

The pair head has three outputs: both arms' outcomes, and an adversary that guesses the arm from the code; its gradient goes back into the code with
the other sign, so the code forgets what only tells treated rows from controls. A pair's loss is that of each row's own outcome, `contrast`
times the squared difference between the pair's mean predicted effect and the difference of its outcomes, and the adversary's.

The residual net predicts what is to be added to a base effect, by the residual loss with rows weighted by their squared treatment residual.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.hashrand import uniform
from causeway.functions.workers import by_value
from causeway.operators import gradient_rounds, quantiles

by_value(__name__)


@dataclass(frozen=True)
class Net:
    inputs: int
    hidden: int
    code: int
    outs: int

    def shapes(self) -> list[tuple[int, ...]]:
        return [(self.inputs, self.hidden), (self.hidden,), (self.hidden, self.code), (self.code,), (self.code, self.outs), (self.outs,)]

    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes())

    def first(self, seed: int) -> np.ndarray:
        r = np.random.default_rng(seed)
        return np.concatenate([(r.normal(0, np.sqrt(2 / s[0]), s) if len(s) == 2 else np.zeros(s)).ravel() for s in self.shapes()])

    def split(self, weights: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([0, *[int(np.prod(s)) for s in self.shapes()]])
        return [weights[a:b].reshape(s) for a, b, s in zip(ends[:-1], ends[1:], self.shapes(), strict=True)]

    def forward(self, weights: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The outputs, the code and the hidden layer."""
        a, b, c, d, e, f = self.split(weights)
        h = np.maximum(x @ a + b, 0)
        z = np.maximum(h @ c + d, 0)
        return z @ e + f, z, h

    def gradient(self, weights: np.ndarray, x: np.ndarray, z: np.ndarray, h: np.ndarray, d_out: np.ndarray, into_code: np.ndarray | None = None) -> np.ndarray:
        """Summed over rows. into_code: what goes back through each output into the code, as multiples of d_out."""
        _, _, c, _, e, _ = self.split(weights)
        dz = ((d_out if into_code is None else d_out * into_code) @ e.T) * (z > 0)
        dh = (dz @ c.T) * (h > 0)
        return np.concatenate([g.ravel() for g in (x.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0), z.T @ d_out, d_out.sum(0))])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _entropy(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) - z * target + np.log1p(np.exp(-np.abs(z)))


@dataclass
class Fitted:
    net: Net
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    losses: list[float]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs and code; a missing or infinite value counts as the mean."""
        z = (x - self.centre) / self.scale
        out, code, _ = self.net.forward(self.weights, np.where(np.isfinite(z), z, 0.0))
        return out, code


def pair_batches(pairs: DataFrame, keys: list[str], per_batch: int, epoch: int = 0, seed: int = 42) -> DataFrame:
    """pairs with batch and place: every batch has per_batch pairs, in an order that a hash of keys and epoch gives; the last is filled up from the first ones, as often as it takes."""
    n = quantiles.parts(pairs)
    hashed = pairs.withColumn("__u", uniform(F.lit(seed), F.lit(epoch), *[F.col(k) for k in keys])).withColumn("__b", F.floor(F.col("__u") * n).cast("int"))
    ranked = quantiles.row_numbers(hashed, "__b", [F.col("__u"), *[F.col(k) for k in keys]]).withColumn("__i", F.col("__rn") - 1).drop("__u", "__b", "__rn")
    whole = F.ceil(F.col("__n") / per_batch) * per_batch
    turns = F.sequence(F.lit(0), F.floor((whole - 1 - F.col("__i")) / F.col("__n")).cast("int"))  # per_batch at most, for a table smaller than a batch
    each = ranked.withColumn("__k", F.explode(turns)).withColumn("__p", F.col("__i") + F.col("__k") * F.col("__n"))
    return each.withColumns({"batch": F.floor(F.col("__p") / per_batch).cast("long"), "place": F.pmod(F.col("__p"), F.lit(per_batch)).cast("int")}).drop("__i", "__k", "__p", "__n")


def pair_sums(net: Net, weights: np.ndarray, v: np.ndarray, centre: np.ndarray, scale: np.ndarray, contrast: float, adversary: float) -> np.ndarray:
    """Pairs, loss and gradient, summed. v: outcome of the treated, of the control, then both rows' features."""
    width, n = net.inputs, len(v)
    y1, y0 = v[:, 0], v[:, 1]
    x = (np.concatenate([v[:, 2 : 2 + width], v[:, 2 + width :]]) - centre) / scale
    out, z, h = net.forward(weights, x)
    m0, m1, adv = out.T
    t = np.concatenate([np.ones(n), np.zeros(n)])
    y = np.concatenate([y1, y0])
    p0, p1 = _sigmoid(m0), _sigmoid(m1)
    gap = (p1[:n] - p0[:n] + p1[n:] - p0[n:]) / 2 - (y1 - y0)
    own = _entropy(np.where(t == 1, m1, m0), y)
    loss = own.sum() + contrast * (gap**2).sum() + adversary * _entropy(adv, t).sum()
    back = contrast * np.concatenate([gap, gap])
    d = np.zeros_like(out)
    d[:, 0] = np.where(t == 0, p0 - y, 0) - back * p0 * (1 - p0)
    d[:, 1] = np.where(t == 1, p1 - y, 0) + back * p1 * (1 - p1)
    d[:, 2] = adversary * (_sigmoid(adv) - t)
    return np.concatenate([[n, loss], net.gradient(weights, x, z, h, d, np.array([1.0, 1.0, -1.0]))])


def _mean(sums: np.ndarray) -> tuple[float, np.ndarray]:
    n = max(1.0, sums[0])
    return sums[1] / n, sums[2:] / n


def fit_pairs(pairs: DataFrame, rows: DataFrame, key: str, outcome: str, x: list[str], hidden: int = 32, code: int = 8, rounds: int = 120, batches: int = 1, rate: float = 0.02, contrast: float = 1.0, adversary: float = 0.1, decay: float = 1e-3, seed: int = 42) -> Fitted:
    """The head of matched pairs (treated_id, control_id) of rows. A batch is drawn by the hash of the treated row."""
    side = lambda name: rows.select(F.col(key).alias(f"{name}_id"), F.col(outcome).alias(f"{name}_y"), *[F.col(c).alias(f"{name}_{i}") for i, c in enumerate(x)])
    both = pairs.select("treated_id", "control_id").join(side("treated"), "treated_id").join(side("control"), "control_id")
    columns = ["treated_y", "control_y", *[f"{name}_{i}" for name in ("treated", "control") for i in range(len(x))]]
    net = Net(len(x), hidden, code, 3)
    packed = gradient_rounds.Rows(both, "treated_id", [F.col(c) for c in columns], batches)
    n, mean, sd = packed.spread(list(range(2, 2 + 2 * len(x))))
    k = len(x)
    centre, scale = (mean[:k] + mean[k:]) / 2, np.sqrt((sd[:k] ** 2 + sd[k:] ** 2) / 2 + (mean[:k] - mean[k:]) ** 2 / 4)
    weights, losses = packed.train(net.first(seed), 2 + net.size(), lambda w, v: pair_sums(net, w, v, centre, scale, contrast, adversary), _mean, rounds if n else 0, rate, decay)
    return Fitted(net, weights, centre, scale, losses)


def residual_sums(net: Net, weights: np.ndarray, v: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Rows, loss and gradient, summed. v: residuals of outcome and treatment, the base effect, then features."""
    ry, rt, base = v[:, 0], v[:, 1], v[:, 2]
    x = (v[:, 3:] - centre) / scale
    out, z, h = net.forward(weights, x)
    weight = np.maximum(rt**2, 1e-3)
    miss = ry - rt * (base + out[:, 0])
    return np.concatenate([[len(v), (weight * miss**2).sum()], net.gradient(weights, x, z, h, (-2 * weight * miss * rt)[:, None])])


def fit_residual(df: DataFrame, key: str, y: str, t: str, m: str, e: str, base: str, x: list[str], hidden: int = 32, code: int = 8, rounds: int = 120, batches: int = 1, rate: float = 0.02, decay: float = 1e-2, seed: int = 42) -> Fitted:
    net = Net(len(x), hidden, code, 1)
    rows = gradient_rounds.Rows(df, key, [F.col(y) - F.col(m), F.col(t) - F.col(e), F.col(base), *[F.col(c) for c in x]], batches)
    n, centre, scale = rows.spread(list(range(3, 3 + len(x))))
    weights = net.first(seed)
    weights[-(code + 1) :] = 0.0  # the net adds nothing until it has learned
    weights, losses = rows.train(weights, 2 + net.size(), lambda w, v: residual_sums(net, w, v, centre, scale), _mean, rounds if n else 0, rate, decay)
    return Fitted(net, weights, centre, scale, losses)


def scored(df: DataFrame, model: Fitted, x: list[str], outputs: list[str], codes: str | None = None) -> DataFrame:
    """df with a column for each output, and with the code's, by the given prefix."""
    from pyspark.sql import types as T

    names = [*outputs, *([f"{codes}{i}" for i in range(model.net.code)] if codes else [])]
    kept = df.drop(*names)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names]])

    def run(given: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in given:
            out, code = model.forward(pdf[x].to_numpy(float))
            both = np.concatenate([out[:, : len(outputs)], code if codes else code[:, :0]], 1)
            yield pdf.assign(**{n: both[:, i] for i, n in enumerate(names)})

    return kept.mapInPandas(run, schema)
