"""Gated attention pooling of vectors by key, with any number of slots and of vectors for a key.

A vector's score in a slot is v W norm(tanh(V h + a) * sigmoid(U h + b)), with norm over the gate's components; a slot's result is the softmax of
its scores over the key's vectors, times the vectors. Each task folds what it has of a key into (greatest score, sum of weights, weighted sum)
a slot, a state that merges in any order, so a key with very many vectors moves one row a task and no vector is exploded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.workers import by_value

by_value(__name__)

HELD = 1 << 22  # numbers in the states that a task holds before it sends them on


@dataclass(frozen=True)
class Gate:
    """V, U: inputs by gate; a, b: gate; w: gate by gate; v: gate by slots; gain and shift of the norm."""

    content: np.ndarray
    content_bias: np.ndarray
    gate: np.ndarray
    gate_bias: np.ndarray
    mix: np.ndarray
    slots: np.ndarray
    gain: np.ndarray
    shift: np.ndarray

    @staticmethod
    def drawn(inputs: int, width: int, slots: int, seed: int = 42) -> Gate:
        """Weights drawn evenly within 1 / sqrt(inputs), as before any training."""
        r = np.random.default_rng(seed)
        even = lambda n, *shape: r.uniform(-1, 1, shape) / np.sqrt(n)
        return Gate(even(inputs, inputs, width), even(inputs, width), even(inputs, inputs, width), even(inputs, width), even(width, width, width), even(width, width, slots), np.ones(width), np.zeros(width))

    def scores(self, h: np.ndarray) -> np.ndarray:
        """Vectors by slots."""
        g = np.tanh(h @ self.content + self.content_bias) / (1 + np.exp(-np.clip(h @ self.gate + self.gate_bias, -500, 500)))
        g = (g - g.mean(1, keepdims=True)) / np.sqrt(g.var(1, keepdims=True) + 1e-5) * self.gain + self.shift
        return g @ self.mix @ self.slots


def joined(states: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One state for several: sums and weights count by how far their greatest score is below the greatest of all."""
    top = np.max([t for t, _, _ in states], 0)
    with np.errstate(invalid="ignore"):
        share = [np.where(t == top, 1.0, np.exp(t - top)) for t, _, _ in states]
    return top, sum(w * f for (_, w, _), f in zip(states, share, strict=True)), sum(s * f[:, None] for (_, _, s), f in zip(states, share, strict=True))


STATE = "top array<double>, weight array<double>, sums array<double>"


def gated(df: DataFrame, key: str, vector: str, gate: Gate, used: str | None = None) -> DataFrame:
    """key, pooled: slots after one another. used: a column of 0 or null for vectors that don't count (padding).

    Null vectors and those of another length or with a null or non-finite component don't count; a key without any that counts has a null result.
    """
    width, slots = gate.content.shape[0], gate.slots.shape[1]
    counts = (F.col(used).cast("int") == 1) if used else F.lit(True)
    v = F.when(counts & (F.size(vector) == width), F.col(vector).cast("array<double>"))
    rows = df.select(F.col(key).alias("__key"), v.alias("__v"))
    kind = rows.schema["__key"].dataType.simpleString()

    def state(keys: list, top: np.ndarray, weight: np.ndarray, sums: np.ndarray, type_: pa.DataType) -> pa.RecordBatch:
        some = weight[:, 0] > 0
        lists = lambda a: pa.array([list(r) if ok else None for r, ok in zip(a.reshape(len(keys), -1).tolist(), some, strict=True)], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(keys, type_), lists(top), lists(weight), lists(sums)], ["__key", "top", "weight", "sums"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush(type_: pa.DataType) -> Iterator[pa.RecordBatch]:
            names = list(held)
            for i in range(0, len(names), 1000):
                part = [held[k] for k in names[i : i + 1000]]
                yield state(names[i : i + 1000], *(np.stack([p[j] for p in part]) for j in range(3)), type_)
            held.clear()

        for b in batches:
            keys = b.column("__key").dictionary_encode("encode")
            names, at = keys.dictionary.to_pylist(), keys.indices.to_numpy(zero_copy_only=False)
            given = b.column("__v").to_pylist()
            good = np.array([x is not None and None not in x for x in given], bool)
            h = np.array([x for x, ok in zip(given, good, strict=True) if ok], float).reshape(-1, width)
            finite = np.isfinite(h).all(1)
            h, at = h[finite], at[good][finite]
            n = len(names)
            top, weight, sums = np.full((n, slots), -np.inf), np.zeros((n, slots)), np.zeros((n, slots, width))
            if len(h):
                s = gate.scores(h)
                np.maximum.at(top, at, s)
                w = np.exp(s - top[at])
                np.add.at(weight, at, w)
                for j in range(slots):
                    np.add.at(sums[:, j], at, w[:, [j]] * h)
            for i, k in enumerate(names):
                own = (top[i], weight[i], sums[i])
                held[k] = joined([held[k], own]) if k in held else own
            if len(held) * slots * (width + 2) > HELD:
                yield from flush(keys.dictionary.type)
        if held:
            yield from flush(keys.dictionary.type)

    def merge(group: pa.Table) -> pa.Table:
        rows = [(np.array(t), np.array(w), np.array(s).reshape(slots, width)) for t, w, s in zip(*[group.column(c).to_pylist() for c in ("top", "weight", "sums")], strict=True) if t is not None]
        pooled = None
        if rows:
            _, weight, sums = joined(rows)
            pooled = (sums / weight[:, None]).ravel().tolist()
        return pa.table({"__key": group.column("__key").slice(0, 1), "pooled": pa.array([pooled], pa.list_(pa.float64()))})

    folded = rows.mapInArrow(fold, f"__key {kind}, {STATE}")
    return folded.groupBy("__key").applyInArrow(merge, f"__key {kind}, pooled array<double>").withColumnRenamed("__key", key)
