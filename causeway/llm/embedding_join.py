"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are sorted by the cells, on their leading principal directions (of a bounded, documented sample; any orthonormal directions give
right results), of a grid whose side is the distance that the cosine threshold stands for. The sorted sequence is cut into intervals, these
into groups, and groups into blocks of blocks. Blocks are joined recursively: a pair whose boxes are provably more than a side apart is
skipped, any other gives way to the pairs of its parts, in equi-joins on the blocks' numbers, until pairs of groups are left. These are
dealt to tasks; within one, pairs of intervals are skipped by their boxes, then pairs of vectors by the bound p.q + |rest p| |rest q| on
their cosine, and what is left is compared in double precision. Two boxes are apart by the root of the summed squared gaps in all leading
directions. Where the data have no leading directions nothing is provably distant, and the bound alone saves work; no pair that the
threshold admits is ever skipped.

A task returns for each vector its number of links there and a spanning forest of them, never the pairs, so large groups of copies cost
no rows. Blocks, boxes and pairs of blocks stay in tables; only the sample behind the directions comes to the driver.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; a shorter vector counts as padded
with zeros; repeated rows are vectors of their own and link; a null id, and 2^63 - 1, counts as larger than any and is returned as null; other
columns are neither read nor returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import by_value, checkpointed, partitions
from causeway.llm.components import components

by_value(__name__)

LAST = (1 << 63) - 1
SAMPLE_VALUES = 2_000_000  # components of the sample behind the principal directions
GRID, LEADING, INTERVAL, GROUP, FAN = 6, 24, 512, 32_768, 8
CLOSE = 1e-9  # cosines this near the threshold are computed once more, by one formula for all


def directions(units: DataFrame, width: int, count: int) -> np.ndarray:
    """Rows: principal directions of a sample that the driver can hold, all of them, leading first."""
    rate = min(1.0, SAMPLE_VALUES / max(1, width) / max(1, count))
    pick = F.pmod(F.xxhash64("rid"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1
    sample = units.where(pick).limit(2 * SAMPLE_VALUES // max(1, width)).select("unit").toArrow().column(0)
    x = np.frombuffer(b"".join(v.as_py() for v in sample), np.float64).reshape(-1, width)
    return np.linalg.eigh(x.T @ x - len(x) * np.outer(x.mean(0), x.mean(0)))[1].T[::-1] if len(x) else np.eye(width)


def near_pairs(leaves: DataFrame, dims: int, side: float) -> DataFrame:
    """a, b (a <= b): pairs of leaves (block from 0, low0, high0, ...) whose boxes may hold vectors within side of each other.

    Pairs of blocks of FAN ** k leaves, for falling k, each in turn joined to its parts' pairs. What a level holds are the pairs that no level
    above could skip.
    """
    bounds = [f(f"{n}{i}").alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(dims)]
    levels = [leaves.select("block", *[f"{n}{i}" for n in ("low", "high") for i in range(dims)])]
    top = leaves.agg(F.max("block")).first()[0]
    while top:
        top //= FAN
        levels.append(levels[-1].groupBy(F.expr(f"block div {FAN}").alias("block")).agg(*bounds))
    pairs = levels[-1].select(F.col("block").alias("a"), F.col("block").alias("b"))
    for level in reversed(levels[:-1] if len(levels) > 1 else []):
        left, right = (level.select(F.expr(f"block div {FAN}").alias(s), F.col("block").alias(f"{s}1"), *[F.col(f"{n}{i}").alias(f"{s}_{n}{i}") for n in ("low", "high") for i in range(dims)]) for s in "ab")
        gap = lambda i: F.greatest(F.col(f"a_low{i}") - F.col(f"b_high{i}"), F.col(f"b_low{i}") - F.col(f"a_high{i}"), F.lit(0.0))
        apart = sum((gap(i) * gap(i) for i in range(1, dims)), gap(0) * gap(0))
        pairs = pairs.join(left, "a").join(right, "b").where((F.col("a1") <= F.col("b1")) & (apart <= side * side)).select(F.col("a1").alias("a"), F.col("b1").alias("b"))
    return pairs


def forest(rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the given ones, by rounds of least labels."""
    nodes, ends = np.unique(np.concatenate([rows, cols]), return_inverse=True)
    a, b = ends[: len(rows)], ends[len(rows) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low), np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return [(int(nodes[i]), int(nodes[j])) for i, j in enumerate(label) if i != j]
        label = new


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """id_col, n_links (other rows linked directly) and component_id (the smallest id reachable) for each row."""
    side = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("id"), F.monotonically_increasing_id().alias("rid"), v.alias("v"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, width)

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(2)
            flat = column.flatten()
            if len(b) and not column.null_count and not flat.null_count and len(flat) == width * len(b) and (np.diff(column.offsets.to_numpy()) == width).all():
                x = flat.to_numpy(zero_copy_only=False).reshape(-1, width)
            else:
                x = np.zeros((len(b), width))
                for i, v in enumerate(column):
                    if v.is_valid and len(v.values) and not v.values.null_count:
                        x[i, : len(v.values)] = v.values.to_numpy(zero_copy_only=False)
            top = np.abs(x).max(1)
            good = np.isfinite(top) & (top > 0)
            y = np.where(good[:, None], x, 1.0) / np.where(good, top, 1.0)[:, None]  # so that the square neither overflows nor vanishes
            y /= np.linalg.norm(y, axis=1)[:, None]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() if g else None for r, g in zip(np.ascontiguousarray(y), good, strict=True)], pa.binary())], ["id", "rid", "unit"])

    units = checkpointed(rows.mapInArrow(unit, "id long, rid long, unit binary"))
    good = units.where("unit is not null")
    count = good.count()
    base = directions(good, width, count)
    grid, lead = min(GRID, width), min(LEADING, width)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float64).reshape(len(b), width) @ base[:grid].T
                cells = np.floor(x / side).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in cells.T], b.column(1)], ["rid", *[f"c{i}" for i in range(grid)], "unit"])

    cells = [f"c{i}" for i in range(grid)]
    placed = good.select("rid", "unit").mapInArrow(place, ", ".join(["rid long", *[f"{c} long" for c in cells], "unit binary"]))
    each = min(GROUP, max(INTERVAL, -(-count // 10)))
    groups = max(1, -(-count // each))
    ends = [f"{n}{i}" for n in ("low", "high") for i in range(lead)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        group, ids, rows, at = TaskContext.get().partitionId(), [], [], 0

        def interval() -> pa.RecordBatch:
            x = np.frombuffer(b"".join(rows[:INTERVAL]), np.float64).reshape(-1, width)
            own = np.array(ids[:INTERVAL], np.int64)
            del ids[:INTERVAL], rows[:INTERVAL]
            head = x @ base[:lead].T
            box = [pa.array([v]) for v in (*head.min(0).tolist(), *head.max(0).tolist())]
            return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([at], pa.int32()), *box, pa.array([own.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["block", "seq", *ends, "ids", "vectors"])

        for b in batches:
            ids += b.column(0).to_pylist()
            rows += b.column(1).to_pylist()
            while len(ids) >= INTERVAL:
                yield interval()
                at += 1
        if ids:
            yield interval()

    ordered = placed.repartitionByRange(groups, *cells, "rid").sortWithinPartitions(*cells, "rid")
    intervals = checkpointed(ordered.select("rid", "unit").mapInArrow(cut, ", ".join(["block long, seq int", *[f"{c} double" for c in ends], "ids binary, vectors binary"])))
    boxes = intervals.groupBy("block").agg(*[(F.min if c.startswith("low") else F.max)(c).alias(c) for c in ends])
    wanted = checkpointed(near_pairs(boxes, lead, side).withColumn("task", F.xxhash64("a", "b"))) if count else None
    tasks = wanted.count() if count else 0
    sides = (F.struct(F.col("a").alias("block"), F.lit(0).alias("second")), F.struct(F.col("b").alias("block"), F.lit(1).alias("second")))

    def tile(group: pa.Table) -> pa.Table:
        halves: list[list] = [[], []]
        for second, seq, ids, x in zip(*[group.column(c).to_pylist() for c in ("second", "seq", "ids", "vectors")], strict=True):
            x = np.frombuffer(x, np.float64).reshape(-1, width)
            head = x @ base[:lead].T
            rest = np.sqrt(np.maximum(0, 1 - (head * head).sum(1)))
            halves[second].append((seq, head.min(0), head.max(0), np.frombuffer(ids, np.int64), x, np.concatenate([head, rest[:, None]], 1)))
        first, other = (sorted(h, key=lambda b: b[0]) for h in halves)
        alone = not other
        count: dict[int, int] = {}
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for n, (_, lo, hi, ids, x, bound) in enumerate(first):
            for _, lo2, hi2, ids2, x2, bound2 in first[n:] if alone else other:
                gap = np.maximum(0, np.maximum(lo - hi2, lo2 - hi))
                if gap @ gap > side * side:
                    continue
                r, c = np.nonzero(bound @ bound2.T >= cosine - CLOSE)
                if ids2 is ids:
                    r, c = r[r < c], c[r < c]
                if not len(r):
                    continue
                exact = lambda i, j: np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 20_000]], x2[j[k : k + 20_000]]) for k in range(0, len(i), 20_000)])  # noqa: B023, E731
                if len(r) * 8 > len(ids) * len(ids2):
                    likeness = (x @ x2.T)[r, c]
                    close = np.flatnonzero(np.abs(likeness - cosine) < CLOSE)
                    if len(close):
                        likeness[close] = exact(r[close], c[close])
                else:
                    likeness = exact(r, c)
                ok = likeness >= cosine
                u, w = ids[r[ok]], ids2[c[ok]]
                if not len(u):
                    continue
                for k, m in zip(*np.unique(np.concatenate([u, w]), return_counts=True), strict=True):
                    count[int(k)] = count.get(int(k), 0) + int(m)
                edges.append((u, w))
                held += len(u)
                if held > 1 << 20:
                    kept = forest(*(np.concatenate([e[k] for e in edges]) for k in (0, 1)))
                    edges, held = [tuple(np.array(kept).T)], 0
        kept = forest(*(np.concatenate([e[k] for e in edges]) for k in (0, 1))) if edges else []
        root = dict(kept)
        return pa.table({"rid": pa.array(list(count), pa.int64()), "links": pa.array(list(count.values()), pa.int64()), "root": pa.array([root.get(k, k) for k in count], pa.int64())})

    if not count:
        return units.select(F.when(F.col("id") != LAST, F.col("id")).alias(id_col), F.lit(0).cast("long").alias("n_links"), F.when(F.col("id") != LAST, F.col("id")).alias("component_id"))
    deals = wanted.select("task", F.explode(F.when(F.col("a") == F.col("b"), F.array(sides[0])).otherwise(F.array(*sides))).alias("x")).select("task", "x.*")
    dealt = intervals.select("block", "seq", "ids", "vectors").join(deals, "block")
    spread = max(1, min(tasks, 8 * partitions(vectors.sparkSession)))
    linked = checkpointed(dealt.repartition(spread, "task").groupBy("task").applyInArrow(tile, "rid long, links long, root long"))
    roots = components(linked.select(F.col("rid").alias("u"), F.col("root").alias("v")).where("u <> v"))
    named = roots.join(units.select(F.col("rid").alias("node"), "id"), "node")
    label = named.groupBy("component").agg(F.min("id").alias("least")).join(named, "component").select(F.col("node").alias("rid"), "least")
    out = units.select("id", "rid").join(linked.groupBy("rid").agg(F.sum("links").alias("n_links")), "rid", "left").join(label, "rid", "left")
    null = lambda c: F.when(c != LAST, c)
    return out.select(null(F.col("id")).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), null(F.coalesce("least", "id")).alias("component_id"))
