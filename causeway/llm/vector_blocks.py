"""Quantised vectors, packed many to a row, for operators that compare a stated set of queries with all rows.

A component x becomes floor(scale * x), so a score is an integer inner product and no sum depends on its order. Rows are packed into blocks of a
bounded number of rows; queries into groups; what meets in a task is one group and a few blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import by_value, checkpointed, partitions

by_value(__name__)

LAST, MOST = (1 << 63) - 1, 1 << 61  # the id of rows without one; the largest score
SMALL = 1 << 15
BLOCK, GROUP, FEWEST = 4096, 1024, 256  # rows of a block, queries of a group at most; rows that a block has at least, where there are as many


@dataclass
class Shape:
    width: int
    kind: str  # of a component: two bytes while all fit, else a double

    def matrix(self, parts: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(parts), self.kind).reshape(-1, self.width).astype(np.float64)


@dataclass
class Vectors:
    rows: DataFrame  # rid, id, label, vec (little-endian components, as many as the widest vector has), norm
    shape: Shape
    count: int
    norm: float  # the largest


def block_rows(count: int, parts: int) -> int:
    """Rows of a block: BLOCK, fewer where the table is too small to give each partition some."""
    return max(FEWEST, min(BLOCK, -(-count // (4 * max(1, parts)))))


def quantized(vectors: DataFrame, id_col: str, vector_col: str, label: Column | None, scale: float) -> Vectors:
    """The rows that take part: vectors without null or non-finite components (before and after scaling), labels that aren't null; a null id is LAST."""
    v = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: _floor(x * scale))
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("id"), (F.lit(0) if label is None else label).cast("long").alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where(F.col("v").isNotNull() & ~bad & F.col("label").isNotNull())
    top = good.agg(F.max(F.size("v")).alias("w"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("m")).first()
    width, kind = max(1, top["w"] or 0), "<i2" if (top["m"] or 0) < SMALL else "<f8"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.zeros((len(b), width))
            sizes = np.diff(b.column("v").offsets.to_numpy())
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False)
            x[np.arange(width)[None] < sizes[:, None]] = flat
            top = np.maximum(np.abs(x).max(1), 1)
            norm = top * np.linalg.norm(x / top[:, None], axis=1)
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("id"), b.column("label"), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array(norm)], ["rid", "id", "label", "vec", "norm"])

    out = checkpointed(good.mapInArrow(packed, "rid long, id long, label long, vec binary, norm double"))
    count, norm = out.agg(F.count("*"), F.max("norm")).first()
    return Vectors(out, Shape(width, kind), count, norm or 0.0)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows, exact: every partial sum is an integer no larger than the product of the norms. Those beyond MOST become MOST, with their sign."""
    with np.errstate(over="ignore"):
        most = np.sqrt((q * q).sum(1).max(initial=0)) * np.sqrt((x * x).sum(1).max(initial=0)) * (1 + 1e-9)
    if most < 1 << 24:
        return (q.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in r] for r in m.tolist()], object)
    return np.clip(whole(q) @ whole(x).T, -MOST, MOST).astype(np.int64)


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of each row's k highest allowed scores, or all where there are fewer; of equal scores the first columns."""
    s = np.where(allowed, scores, -LAST - 1)
    if s.shape[1] > k:
        cut = np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k][:, None]
        above, equal = s > cut, s == cut
        equal &= np.cumsum(equal, 1, dtype=np.int32) <= (k - above.sum(1))[:, None]
        allowed = allowed & (above | equal)
    return np.nonzero(allowed)


PACKED = "ids binary, rids binary, labels binary, vecs binary"


def pack(ids: list, rids: list, labels: list, vecs: list) -> list[pa.Array]:
    """One row's worth, in the order of ids, for a schema that ends with PACKED."""
    i, r, n = (np.array(x, np.int64) for x in (ids, rids, labels))
    order = np.lexsort((r, i))
    return [pa.array([x[order].tobytes()], pa.binary()) for x in (i, r, n)] + [pa.array([b"".join(vecs[j] for j in order)], pa.binary())]


def unpacked(shape: Shape, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (*(np.frombuffer(row[c], np.int64) for c in ("ids", "rids", "labels")), shape.matrix([row["vecs"]]))


def packer(size: int, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (rid, id, label, vec) in the order given, `size` at a time, with a key of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, held = TaskContext.get().partitionId() << 32, [[], [], [], []]

        def row() -> pa.RecordBatch:
            nonlocal at
            out = pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *pack(*[h[:size] for h in held])], [key, "ids", "rids", "labels", "vecs"])
            for h in held:
                del h[:size]
            at += 1
            return out

        for b in batches:
            for h, c in zip(held, ("id", "rid", "label", "vec"), strict=True):
                h += b.column(c).to_pylist()
            while len(held[0]) >= size:
                yield row()
        if held[0]:
            yield row()

    return run


def in_blocks(v: Vectors) -> DataFrame:
    """block, PACKED: all rows, in blocks, where they are."""
    size = block_rows(v.count, partitions(v.rows.sparkSession))
    return checkpointed(v.rows.mapInArrow(packer(size, "block"), f"block long, {PACKED}"))


def in_groups(queries: DataFrame, count: int) -> DataFrame:
    """grp, PACKED: queries, GROUP at most a row."""
    return checkpointed(queries.repartition(max(1, -(-count // GROUP)), "rid").mapInArrow(packer(GROUP, "grp"), f"grp long, {PACKED}"))


def members(groups: DataFrame) -> DataFrame:
    """grp, pos, id: the rows of groups, by their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, ids in zip(b.column("grp").to_pylist(), b.column("ids").to_pylist(), strict=True):
                own = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(own), pa.int64()), pa.array(np.arange(len(own)), pa.int32()), pa.array(own)], ["grp", "pos", "id"])

    return groups.select("grp", "ids").mapInArrow(run, "grp long, pos int, id long")


def meet(left: DataFrame, right: DataFrame, keys: tuple[str, ...], task: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """task(left's rows, right's rows) for each key; the sides may stem from the same tables."""
    renewed = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy(*keys).cogroup(renewed.groupBy(*keys)).applyInArrow(task, schema)


def null_last(c: Column) -> Column:
    return F.when(c != LAST, c)


def _floor(x: Column) -> Column:
    """As a double whatever its size: floor() of Spark gives a long, whose range doubles leave."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)
