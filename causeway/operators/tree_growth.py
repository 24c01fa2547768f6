"""Honest effect trees grown level by level from histograms, so a tree reads every row that it draws and no task holds a tree's rows.

Features are cut at approximate percentiles, BINS at most. A pass over the table gives, for each open node of each tree, sums by feature and bin:
rows, treatment times outcome residuals and squared treatment residuals, of the half that chooses splits and of the half that estimates. The
gradient of a node's effect is linear in these, so one pass a level tells all splits, and the children's effects with them. Which rows a tree
draws, and to which half they belong, follows from a hash of key and tree.

What a task holds are the sums of the open nodes of a batch of trees, STATE bytes at most; sums meet by node, and the driver gets a few numbers
for each node. Tuning compares pruned copies of the grown trees, which need no sums of their own, by their residual loss on rows that a bag
didn't draw.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.hashrand import uniforms
from causeway.functions.workers import by_value
from causeway.operators.store_tables import kept

by_value(__name__)

BINS, BLOCK, STATE, TASKS = 32, 8192, 1 << 27, 128  # bins of a feature, rows of a block, bytes of sums in a task, tasks whose sums meet at once
BAG, TREE = 0.5, 0.7  # share of the rows that a bag draws, and of these a tree


@dataclass
class Tree:
    """Nodes by number: the feature and threshold of inner ones, children, the effect of each, its level, how few rows its smaller child has in either half, and the threshold as a bin."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    effect: np.ndarray
    level: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    fewest: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bin: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def at(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(64):
            inner = self.feature[at] >= 0
            if not inner.any():
                break
            go = x[np.arange(len(x)), np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.effect[self.at(x)]

    def pruned(self, depth: int, leaf: int) -> Tree:
        """Without splits at a level of depth or deeper and without those that leave a child fewer than leaf rows."""
        stays = (self.level < depth) & (self.fewest >= leaf)
        return Tree(np.where(stays, self.feature, -1), self.threshold, self.left, self.right, self.effect, self.level, self.fewest, self.bin)

    def by_bins(self) -> Tree:
        """For rows given as bins."""
        return Tree(self.feature, self.bin, self.left, self.right, self.effect)


def cut_points(rows: DataFrame, x: list[str]) -> list[np.ndarray]:
    """Ascending thresholds of each feature; the value of the last bin has none."""
    shares = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in x]).first()
    return [np.unique(np.array(found[c] or [], float)) for c in x]


def blocks(rows: DataFrame, x: list[str], cuts: list[np.ndarray]) -> DataFrame:
    """keys, ry, rt and the features' bins, BLOCK rows at most a row. rows: __key, __ry, __rt and x, without nulls; rows with infinite values are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("__ry", "__rt", *x)])
            keys = b.column("__key").to_numpy(zero_copy_only=False).astype(np.int64)
            good = np.isfinite(v).all(1)
            v, keys = v[good], keys[good]
            for i in range(0, len(v), BLOCK):
                part = v[i : i + BLOCK]
                codes = np.column_stack([np.searchsorted(c, part[:, j + 2]) for j, c in enumerate(cuts)]).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({"keys": [keys[i : i + BLOCK].tobytes()], "ry": [part[:, 0].tobytes()], "rt": [part[:, 1].tobytes()], "codes": [codes.tobytes()]})

    return rows.mapInArrow(pack, "keys binary, ry binary, rt binary, codes binary")


def drawn(keys: np.ndarray, bag: int, tree: int, trees: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the tree draws each row, and whether it chooses splits by it."""
    own = 1 + bag * (2 * trees + 1)
    u = uniforms(keys, np.array([own, own + 1 + 2 * tree, own + 2 + 2 * tree]) + seed * 1_000_003)
    return (u[:, 0] < BAG) & (u[:, 1] < TREE), u[:, 2] < 0.5


def unpacked(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["keys"], np.int64), np.frombuffer(row["ry"]), np.frombuffer(row["rt"]), np.frombuffer(row["codes"], np.uint8).reshape(-1, width)


def sums(codes: np.ndarray, node: np.ndarray, nodes: int, ry: np.ndarray, rt: np.ndarray, first: np.ndarray) -> np.ndarray:
    """nodes by features by bins by six: rows, products and squares of the half that chooses, and of the other."""
    width = codes.shape[1]
    out = np.zeros((nodes, width, BINS, 6))
    for half, at in ((0, first), (3, ~first)):
        k, c = node[at], codes[at]
        values = (None, rt[at] * ry[at], rt[at] ** 2)
        for f in range(width):
            place = k * BINS + c[:, f]
            for i, w in enumerate(values):
                out[:, f, :, half + i] = np.bincount(place, w, nodes * BINS).reshape(nodes, BINS)
    return out


def best_split(h: np.ndarray, leaf: int, features: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """The feature and bin whose upper edge splits effects apart most, and the sums of both sides; feature -1 if no split leaves `leaf` rows of both halves on each side."""
    total = h[0].sum(0)
    effect = total[1] / total[2] if total[2] > 1e-9 else 0.0
    best = (0.0, -1, -1)
    for f in features:
        below = np.cumsum(h[f], 0)
        s, n, m = below[:, 1] - effect * below[:, 2], below[:, 0], below[:, 3]
        ok = (n >= leaf) & (total[0] - n >= leaf) & (m >= leaf) & (total[3] - m >= leaf)
        gain = np.where(ok, s**2 / np.maximum(n, 1) + (s[-1] - s) ** 2 / np.maximum(total[0] - n, 1), -1.0)
        k = int(gain.argmax())
        if gain[k] > best[0] + 1e-12 * abs(best[0]):
            best = (float(gain[k]), int(f), k)
    _, f, k = best
    left = h[f][: k + 1].sum(0) if f >= 0 else total
    return f, k, left, total - left


def features_tried(width: int, seed: int, tree: int, node: int) -> np.ndarray:
    tries = min(width, int(np.ceil(np.sqrt(width))) + 1)
    return np.sort(np.random.default_rng([seed, tree, node]).choice(width, tries, replace=False))


def grow(rows: DataFrame, x: list[str], bags: int, trees: int, depth: int, leaf: int, seed: int) -> tuple[list[list[Tree]], DataFrame]:
    """Trees by bag, and the blocks that they were grown on. rows: __key, __ry, __rt and x as doubles without nulls."""
    rows = rows.select("__key", "__ry", "__rt", *x)
    cuts = cut_points(rows, x)
    table = kept(blocks(rows, x, cuts))
    width, every = len(x), bags * trees
    grown = [{"feature": [-1], "bin": [0], "left": [-1], "right": [-1], "effect": [0.0], "level": [0], "fewest": [0.0]} for _ in range(every)]
    wanted = [[0] for _ in range(every)]  # nodes of the level
    for level in range(depth):
        open_trees = [i for i in range(every) if wanted[i]]
        while open_trees:
            size, batch = 0, []
            while open_trees and (not batch or size + len(wanted[open_trees[0]]) * width * BINS * 48 <= STATE):
                size += len(wanted[open_trees[0]]) * width * BINS * 48
                batch.append(open_trees.pop(0))
            for r in _level(table, {i: grown[i] for i in batch}, {i: wanted[i] for i in batch}, width, trees, leaf, seed):
                t, at = grown[r.tree], r.node
                if level == 0:
                    t["effect"][0] = r.here
                if r.feature < 0:
                    continue
                n = len(t["feature"])
                t["feature"][at], t["bin"][at], t["left"][at], t["right"][at], t["fewest"][at] = r.feature, r.bin, n, n + 1, r.fewest
                for effect in (r.left, r.right):
                    for name, value in (("feature", -1), ("bin", 0), ("left", -1), ("right", -1), ("effect", t["effect"][at] if effect is None else effect), ("level", level + 1), ("fewest", 0.0)):
                        t[name].append(value)
        wanted = [[i for i, at in enumerate(t["level"]) if at == level + 1] for t in grown]
    out = [Tree(np.array(t["feature"]), np.array([cuts[f][k] if f >= 0 else 0.0 for f, k in zip(t["feature"], t["bin"], strict=True)], float), np.array(t["left"]), np.array(t["right"]), np.array(t["effect"], float), np.array(t["level"]), np.array(t["fewest"], float), np.array(t["bin"])) for t in grown]
    return [out[b * trees : (b + 1) * trees] for b in range(bags)], table


def _level(table: DataFrame, grown: dict[int, dict], wanted: dict[int, list[int]], width: int, trees: int, leaf: int, seed: int) -> list:
    """tree, node, here (the node's own effect), feature, bin, left and right (effects, null where the half that estimates has none), fewest: a row for each open node that has rows."""
    coded = {i: Tree(*(np.array(t[c]) for c in ("feature", "bin", "left", "right", "effect"))) for i, t in grown.items()}

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = {i: np.zeros((len(nodes), width, BINS, 6)) for i, nodes in wanted.items()}
        number = {i: np.full(len(grown[i]["feature"]), -1) for i in wanted}
        for i, nodes in wanted.items():
            number[i][nodes] = np.arange(len(nodes))
        for b in batches:
            for row in b.to_pylist():
                keys, ry, rt, codes = unpacked(row, width)
                for i in wanted:
                    mine, first = drawn(keys, i // trees, i % trees, trees, seed)
                    at = np.flatnonzero(mine)
                    node = number[i][coded[i].at(codes[at])]
                    at, node = at[node >= 0], node[node >= 0]
                    held[i] += sums(codes[at], node, len(wanted[i]), ry[at], rt[at], first[at])
        part = TaskContext.get().partitionId() // TASKS
        for i, h in held.items():
            some = np.flatnonzero(h[:, 0, :, (0, 3)].sum((0, 2)) > 0)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.int32()), pa.array([i] * len(some), pa.int32()), pa.array([wanted[i][j] for j in some], pa.int32()), pa.array([h[j].tobytes() for j in some], pa.binary())], ["part", "tree", "node", "h"])

    def total(group: pa.Table) -> np.ndarray:
        out = np.zeros((width, BINS, 6))
        for h in group.column("h"):
            out += np.frombuffer(h.as_buffer()).reshape(out.shape)
        return out

    def meet(group: pa.Table) -> pa.Table:
        return group.slice(0, 1).set_column(group.column_names.index("h"), "h", pa.array([total(group).tobytes()], pa.binary()))

    def decide(group: pa.Table) -> pa.Table:
        h, tree, node = total(group), group.column("tree")[0].as_py(), group.column("node")[0].as_py()
        f, k, left, right = best_split(h, leaf, features_tried(width, seed, tree, node))
        ratio = lambda s: float(s[4] / s[5]) if s[5] > 1e-9 else None
        here = h[0].sum(0)
        both = here[:3] + here[3:]
        own = ratio(here) if node == 0 and here[5] > 1e-9 else float(both[1] / both[2]) if both[2] > 1e-9 else 0.0
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()), "here": [own], "feature": pa.array([f], pa.int32()), "bin": pa.array([k], pa.int32()), "left": pa.array([ratio(left)], pa.float64()), "right": pa.array([ratio(right)], pa.float64()), "fewest": [float(min(left[0], left[3], right[0], right[3]))]})

    schema = "part int, tree int, node int, h binary"
    found = table.mapInArrow(add_up, schema)
    if table.rdd.getNumPartitions() > TASKS:
        found = found.groupBy("part", "tree", "node").applyInArrow(meet, schema)
    return found.groupBy("tree", "node").applyInArrow(decide, "tree int, node int, here double, feature int, bin int, left double, right double, fewest double").collect()


def tuned(forest: list[list[Tree]], table: DataFrame, x: list[str], grid: list[tuple[int, int]], seed: int) -> tuple[list[list[Tree]], list[tuple[int, int, float]]]:
    """The forest pruned to the (depth, leaf) of the grid with the least residual loss on rows outside of a bag, and every pair's loss."""
    width, trees = len(x), len(forest[0]) if forest else 1
    copies = [[[t.pruned(d, leaf) for t in bag] for bag in forest] for d, leaf in grid]
    coded = [[[t.by_bins() for t in bag] for bag in copy] for copy in copies]

    def loss(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(len(grid)), 0
        for b in batches:
            for row in b.to_pylist():
                keys, ry, rt, codes = unpacked(row, width)
                outside = np.stack([uniforms(keys, np.array([1 + b * (2 * trees + 1)]) + seed * 1_000_003)[:, 0] >= BAG for b in range(len(forest))])
                used = outside.any(0)
                n += int(used.sum())
                for g, copy in enumerate(coded):
                    each = np.stack([np.mean([t.predict(codes) for t in bag], 0) for bag in copy])
                    tau = (each * outside).sum(0) / np.maximum(outside.sum(0), 1)
                    sums[g] += (((ry - rt * tau) ** 2)[used]).sum()
        yield pa.RecordBatch.from_pydict({"grid": pa.array(np.arange(len(grid)), pa.int32()), "loss": sums, "n": pa.array([n] * len(grid), pa.int64())})

    found = sorted(table.mapInArrow(loss, "grid int, loss double, n long").groupBy("grid").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).collect())
    losses = [(*grid[r.grid], r.loss / max(1, r.n)) for r in found]
    best = min(range(len(losses)), key=lambda i: losses[i][2]) if losses else 0
    return copies[best], losses
