"""Training by gradient rounds: rows lie packed in blocks, each task adds up what its blocks give, and the driver moves the weights.

A round reads the blocks of one batch, which a hash of the key draws. One vector a task, or beyond TASKS tasks one a group of tasks, comes to the
driver; its length is the model's, whatever the rows. Sums do not depend on how rows are dealt to tasks, but for rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.workers import by_value
from causeway.operators.store_tables import kept

by_value(__name__)

BLOCK, TASKS = 8192, 128


class Rows:
    """Columns of a table as doubles, packed: deal (the batch that the key's hash draws) and BLOCK rows at most. Rows with a null or non-finite value are left out."""

    def __init__(self, df: DataFrame, key: str, columns: list[Column], batches: int = 1):
        self.width, self.batches = len(columns), batches
        names = [f"__c{i}" for i in range(len(columns))]
        rows = df.select(F.pmod(F.xxhash64(key), F.lit(batches)).cast("int").alias("deal"), *[c.cast("double").alias(n) for c, n in zip(columns, names, strict=True)]).dropna()

        def pack(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in given:
                v = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in names])
                deal, good = b.column("deal").to_numpy(), np.isfinite(v).all(1)
                for d in np.unique(deal):
                    own = v[good & (deal == d)]
                    for i in range(0, len(own), BLOCK):
                        yield pa.RecordBatch.from_pydict({"deal": pa.array([d], pa.int32()), "rows": [np.ascontiguousarray(own[i : i + BLOCK]).tobytes()]})

        self.table = kept(rows.mapInArrow(pack, "deal int, rows binary"))
        self.parts = self.table.rdd.getNumPartitions()

    def summed(self, size: int, each: Callable[[np.ndarray], np.ndarray], turn: int | None = None) -> np.ndarray:
        """each(rows by columns) added up, over all rows or over those of a turn's batch."""
        width = self.width

        def add_up(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            out = np.zeros(size)
            for b in given:
                for r in b.column("rows").to_pylist():
                    out += each(np.frombuffer(r).reshape(-1, width))
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId() // TASKS], pa.int32()), "v": [out.tobytes()]})

        def meet(group: pa.Table) -> pa.Table:
            return pa.table({"part": group.column("part").slice(0, 1), "v": pa.array([sum(np.frombuffer(b) for b in group.column("v").to_pylist()).tobytes()], pa.binary())})

        chosen = self.table if turn is None or self.batches == 1 else self.table.where(F.col("deal") == turn % self.batches)
        found = chosen.select("rows").mapInArrow(add_up, "part int, v binary")
        if self.parts > TASKS:
            found = found.groupBy("part").applyInArrow(meet, "part int, v binary")
        return sum((np.frombuffer(r.v) for r in found.collect()), np.zeros(size))

    def spread(self, columns: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
        """How many rows there are, and the mean and standard deviation of columns; a constant column has 1."""
        k = len(columns)
        m = self.summed(1 + 2 * k, lambda v: np.concatenate([[len(v)], v[:, columns].sum(0), (v[:, columns] ** 2).sum(0)]))
        mean = m[1 : 1 + k] / max(1.0, m[0])
        sd = np.sqrt(np.maximum(m[1 + k :] / max(1.0, m[0]) - mean**2, 0))
        return m[0], mean, np.where(sd > 1e-9, sd, 1.0)

    def train(self, weights: np.ndarray, size: int, each: Callable[[np.ndarray, np.ndarray], np.ndarray], combined: Callable[[np.ndarray], tuple[float, np.ndarray]], rounds: int, rate: float, decay: float = 0.0) -> tuple[np.ndarray, list[float]]:
        """Weights after Adam's rounds, and each round's loss before its step. each(weights, rows) gives `size` sums, combined() the loss and gradient."""
        speed, square, losses = np.zeros(len(weights)), np.zeros(len(weights)), []
        for turn in range(rounds):
            now = weights
            loss, g = combined(self.summed(size, lambda v, now=now: each(now, v), turn))
            losses.append(loss)
            weights, speed, square = moved(weights, speed, square, g, turn, rate, decay)
        return weights, losses


def moved(weights: np.ndarray, speed: np.ndarray, square: np.ndarray, g: np.ndarray, turn: int, rate: float, decay: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step of Adam, with weights that decay by themselves."""
    speed, square = 0.9 * speed + 0.1 * g, 0.999 * square + 0.001 * g * g
    step = (speed / (1 - 0.9 ** (turn + 1))) / (np.sqrt(square / (1 - 0.999 ** (turn + 1))) + 1e-8)
    return weights * (1 - rate * decay) - rate * step, speed, square
