"""Exact top-k search by inner product over a pivot-distance index.

Each vector is keyed by its nearest pivot and the angle to it. Sorted by this key, the rows of one pivot form annuli around it; blocks of at
most BLOCK rows are runs of that order, each with the range of its angles and norms and its least id. For a query q and a block of pivot p the
triangle inequality on angles gives, for every x of the block, angle(q, x) >= gap, the distance of angle(q, p) from the block's range, so
q.x <= |q| |x| cos(gap). A group of queries expands from its nearest annuli outwards, eight times as many blocks in each round, and stops when
no block left can beat the k-th score that a query holds, or equal it with a smaller id. All scores are exact integers, so ties are decided by
id alone, and nothing is dropped: where the data have no structure the bounds exclude little and the search reads all blocks, in tiles of
one group and a few blocks.

Pivots come from a bounded sample (SAMPLE vectors); every row is indexed. The directory of annuli is at most RINGS entries, and one more for
each pivot and partition, whatever the input: beyond RINGS blocks an entry stands for a run of blocks.

Edge cases: rows whose vector is null or holds null or non-finite components (also after scaling) take no part; a shorter vector counts as
padded with zeros and an empty one as zero, which scores 0; a row with a null id is no query, but a candidate whose id is returned as null and
loses ties; repeated rows are rows of their own, so an id that occurs twice is two queries, each a candidate for the other; other columns are
neither read nor returned; an empty table gives an empty result. Scores beyond 2^61 count as 2^61, with their sign.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm import vector_blocks as vb
from causeway.llm.common import by_value, checkpointed, partitions

by_value(__name__)

PIVOTS, SAMPLE, RINGS = 128, 16_384, 65_536
FIRST, FASTER, TILE = 8, 8, 16  # blocks of the first round, factor of each further one, blocks of a task


def _units(x: np.ndarray) -> np.ndarray:
    top = np.maximum(np.abs(x).max(1), 1)[:, None]
    norm = np.linalg.norm(x / top, axis=1)[:, None]
    return x / top / np.where(norm > 0, norm, 1)


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Radians between each row and each pivot; a zero vector is at a right angle to all."""
    return np.arccos(np.clip(_units(x) @ pivots.T, -1, 1))


def pivots_of(v: vb.Vectors) -> np.ndarray:
    """Unit vectors: means of clusters of a sample that the driver can hold (SAMPLE vectors), or the first axis where there are none."""
    rate = min(1.0, SAMPLE / max(1, v.count))
    pick = F.pmod(F.xxhash64("rid"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1
    sample = _units(v.shape.matrix([r.vec for r in v.rows.where(pick).limit(2 * SAMPLE).select("vec").collect()]))
    sample = sample[np.abs(sample).max(1) > 0]
    if not len(sample):
        return np.eye(1, v.shape.width)
    at = np.random.default_rng(7).permutation(len(sample))[: min(PIVOTS, max(1, int(len(sample) ** 0.5)))]
    centres = sample[at]
    for _ in range(5):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1)[:, None]
        centres = np.where(length > 1e-9, sums / np.where(length > 1e-9, length, 1), centres)
    return centres


def upper(angle: np.ndarray, norm: np.ndarray, ring: dict[str, np.ndarray]) -> np.ndarray:
    """Queries by annuli: no score is higher. angle: queries by annuli, to each annulus's pivot."""
    gap = np.maximum(0, np.maximum(ring["low"] - angle, angle - ring["high"]) - 1e-7)
    c = np.cos(np.minimum(gap, np.pi))
    most = norm[:, None] * np.where(c > 0, ring["most"], ring["least"]) * c
    return np.minimum(np.floor(most + np.abs(most) * 1e-9 + 1e-6), float(vb.MOST))


def beats(most: np.ndarray, ids: np.ndarray, score: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Where a score of `most` with an id from `ids` would displace the query's k-th."""
    s = score.astype(float)[:, None]
    return (most > s) | ((most == s) & (ids < held[:, None])) | (np.abs(s) >= 1 << 53)


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """query_id, rank, id_col, score: for each row whose id is divisible by `every` its k highest inner products with other rows."""
    v = vb.quantized(vectors, id_col, vector_col, None, scale)
    out = f"query_id long, rank int, `{id_col}` long, score long"
    spark, shape = vectors.sparkSession, v.shape
    is_query = (F.col("id") % every == 0) & (F.col("id") != vb.LAST)
    n_queries = v.rows.where(is_query).count()
    if not n_queries:
        return spark.createDataFrame([], out)
    pivots = pivots_of(v)
    parts = partitions(spark)
    size = vb.block_rows(v.count, parts)
    run = -(-v.count // size // RINGS) or 1  # blocks behind one entry of the directory

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                a = angles(shape.matrix(b.column("vec").to_pylist()), pivots)
                own = a.argmin(1)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("rid", "id", "label", "vec", "norm")], pa.array(own, pa.int32()), pa.array(a[np.arange(len(own)), own])], ["rid", "id", "label", "vec", "norm", "pivot", "angle"])

    placed = v.rows.mapInArrow(place, "rid long, id long, label long, vec binary, norm double, pivot int, angle double")

    def annuli(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows to blocks; a block has one pivot, an entry of the directory `run` blocks of one pivot at most."""
        from pyspark import TaskContext

        ring, block, held = TaskContext.get().partitionId() << 32, 0, []

        def row() -> pa.RecordBatch:
            nonlocal block
            rid, ids, labels, vecs, norms, _, a = zip(*held[:size], strict=True)
            own = [pa.array([x], t) for x, t in ((ring, pa.int64()), (block // TILE, pa.int32()), (held[0][5], pa.int32()), (min(a), pa.float64()), (max(a), pa.float64()), (min(norms), pa.float64()), (max(norms), pa.float64()), (min(ids), pa.int64()))]
            del held[:size]
            block += 1
            return pa.RecordBatch.from_arrays([*own, *vb.pack(ids, rid, labels, list(vecs))], ["ring", "part", "pivot", "low", "high", "least", "most", "first", "ids", "rids", "labels", "vecs"])

        for b in batches:
            for x in zip(*[b.column(c).to_pylist() for c in ("rid", "id", "label", "vec", "norm", "pivot", "angle")], strict=True):
                if held and (held[0][5] != x[5] or len(held) == size):
                    changed = held[0][5] != x[5]
                    yield row()
                    if changed or block == run:
                        ring, block = ring + 1, 0
                held.append(x)
        if held:
            yield row()

    order = ("pivot", "angle", "id", "rid")
    ordered = placed.repartitionByRange(max(1, min(8 * parts, -(-v.count // size))), *order).sortWithinPartitions(*order)
    blocks = checkpointed(ordered.mapInArrow(annuli, f"ring long, part int, pivot int, low double, high double, least double, most double, first long, {vb.PACKED}"))
    groups = checkpointed(placed.where(is_query).repartitionByRange(max(1, -(-n_queries // vb.GROUP)), *order).sortWithinPartitions(*order).mapInArrow(vb.packer(vb.GROUP, "grp"), f"grp long, {vb.PACKED}"))
    found = blocks.groupBy("ring").agg(F.first("pivot").alias("pivot"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("least").alias("least"), F.max("most").alias("most"), F.min("first").alias("first"), (F.max("part") + 1).alias("parts")).orderBy("ring").toPandas()
    directory = spark.sparkContext.broadcast({c: found[c].to_numpy() for c in found.columns})  # RINGS + pivots + partitions entries at most

    def bar(row: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
        score, held = np.full(n, -vb.LAST - 1), np.full(n, vb.LAST)
        for x in row["held"] or []:
            score[x["pos"]], held[x["pos"]] = x["score"], x["id"]
        return score, held

    def visits(seen: int):
        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Annuli from position `seen` on of the group's order, nearest first, that some query's k-th score doesn't exclude."""
            ring = directory.value
            for b in batches:
                for row in b.to_pylist():
                    q = vb.unpacked(shape, row)[3]
                    a, norm = angles(q, pivots), np.linalg.norm(q, axis=1)
                    score, held = bar(row, len(q))
                    near, wanted = np.full(len(ring["ring"]), np.inf), np.zeros(len(ring["ring"]), bool)
                    for i in range(0, len(q), 64):
                        part = slice(i, i + 64)
                        own = a[part][:, ring["pivot"]]
                        near = np.minimum(near, np.maximum(0, np.maximum(ring["low"] - own, own - ring["high"])).min(0))
                        wanted |= beats(upper(own, norm[part], ring), ring["first"], score[part], held[part]).any(0)
                    order = np.argsort(near, kind="stable")
                    at = np.flatnonzero(wanted[order] & (np.arange(len(order)) >= seen))
                    rings, parts = ring["ring"][order[at]], ring["parts"][order[at]]
                    places, rings, part = np.repeat(at, parts), np.repeat(rings, parts), np.concatenate([np.arange(p) for p in parts] or [np.zeros(0, np.int64)])
                    deal = places // TILE if run == 1 else np.arange(len(places))
                    yield pa.RecordBatch.from_arrays([pa.array([row["grp"]] * len(places), pa.int64()), pa.array(rings.astype(np.int64)), pa.array(part.astype(np.int32)), pa.array(places.astype(np.int64)), pa.array(deal.astype(np.int64))], ["grp", "ring", "part", "place", "deal"])

        return plan

    def tile(near: pa.Table, group: pa.Table) -> pa.Table:
        """The k best of a few blocks for each query of a group, without those that can't displace its k-th."""
        found = [[], [], [], [], []]
        for row in group.to_pylist():
            _, rids, _, q = vb.unpacked(shape, row)
            a, norm = angles(q, pivots), np.linalg.norm(q, axis=1)
            score, held = bar(row, len(q))
            for block in near.to_pylist():
                one = {c: np.array([block[c]]) for c in ("low", "high", "least", "most")}
                live = np.flatnonzero(beats(upper(a[:, [block["pivot"]]], norm, one), np.array([block["first"]]), score, held)[:, 0])
                if not len(live):
                    continue
                ids, others, _, x = vb.unpacked(shape, block)
                s = vb.products(q[live], x)
                ok = (s > score[live, None]) | ((s == score[live, None]) & (ids < held[live, None]))
                for i in np.flatnonzero(np.isin(rids[live], others)):
                    ok[i] &= others != rids[live[i]]
                r, c = vb.best(s, ok, k)
                for to, values in zip(found, (live[r], ids[c], others[c], s[r, c]), strict=False):
                    to.append(values)
                found[4].append(np.full(len(r), row["grp"]))
        columns = [np.concatenate(x or [np.zeros(0)]).astype(np.int64) for x in found]
        return pa.table({"grp": columns[4], "pos": pa.array(columns[0].astype(np.int32)), "id": columns[1], "rid": columns[2], "score": columns[3]})

    top, seen, upto = None, 0, FIRST
    rank = F.row_number().over(Window.partitionBy("grp", "pos").orderBy(F.desc("score"), "id", "rid"))
    while True:
        if top is None:
            known = groups.withColumn("held", F.lit(None).cast("array<struct<pos: int, score: long, id: long>>"))
        else:
            last = top.where(F.col("rank") == k).groupBy("grp").agg(F.collect_list(F.struct("pos", "score", "id")).alias("held"))  # GROUP a row
            known = groups.join(last, "grp", "left")
        wanted = checkpointed(known.mapInArrow(visits(seen), "grp long, ring long, part int, place long, deal long"))
        if wanted.isEmpty():
            break
        now = wanted.where(F.col("place") < upto)
        blocks_of = now.join(blocks, ["ring", "part"])
        groups_of = now.select("grp", "deal").distinct().join(known, "grp")
        fresh = vb.meet(blocks_of, groups_of, ("grp", "deal"), tile, "grp long, pos int, id long, rid long, score long")
        everything = fresh if top is None else top.drop("rank").unionByName(fresh)
        top = checkpointed(everything.withColumn("rank", rank).where(F.col("rank") <= k))
        seen, upto = upto, upto * FASTER

    if top is None:
        return spark.createDataFrame([], out)
    queries = vb.members(groups).withColumnRenamed("id", "query_id")
    return top.join(queries, ["grp", "pos"]).select("query_id", F.col("rank").cast("int").alias("rank"), vb.null_last(F.col("id")).alias(id_col), "score")
