"""Hard negatives by distributed radix selection.

Anchors ask for the k highest integer scores in a window: positives among all scores of their own label, negatives for each positive among the
scores of other labels from `share` of the positive's score up to it. No list of scores is sorted or sent. In each pass every task, which holds
one group of anchors and a stripe of blocks, counts a window's scores by one digit of their distance from the window's top and sends the counts
of the buckets down to its own k-th score alone, which no bucket behind can matter to; the counts added up say in which bucket the k-th score
lies, and the next pass splits that bucket by the next digit. When the k-th score is known, a last pass gathers the rows above it and, of the
rows equal to it, each task's smallest ids, as many as are still needed. Work and messages are the same whether scores are spread or tied:
copies of one vector fill a bucket and not a row each.

The stated anchors are compared with all rows in blocks; the table of blocks is read once a pass. A window's state is a row of a few numbers.

Edge cases: rows with a null label, a null vector, or a null or non-finite component (also after scaling) take no part; a shorter vector counts
as padded with zeros, an empty one as zero; a row with a null id is no anchor and keeps its label, may be a positive or negative whose id is
returned as null, and loses ties; repeated rows are rows of their own; an anchor without another row of its label has no result, nor has a
window that is empty, as those of negative scores are; other columns are neither read nor returned; an empty table gives an empty result.
Scores beyond 2^61 count as 2^61, with their sign.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm import vector_blocks as vb
from causeway.llm.common import by_value, checkpointed, partitions

by_value(__name__)

DIGIT, STRIPE = 10, 16  # bits of a digit, blocks of a task


STATE = ("grp", "win", "pos", "low", "high", "low_now", "upto", "need")


def narrowed(shift: int, k: int):
    """Windows as the next pass sees them: from the bucket that holds the k-th score; all of them from `low` on where there are fewer than k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, low_now, upto, need = (b.column(c).to_numpy() for c in ("low", "low_now", "upto", "need"))
            digit, above = (b.column(c).fill_null(0).to_numpy() for c in ("digit", "above"))
            missed = b.column("digit").is_null().to_numpy(zero_copy_only=False)
            top = np.where(missed, low, upto - (digit << shift))
            bottom = np.where(missed, low, np.maximum(low_now, top - (1 << shift) + 1))
            rest = np.where(missed, k, need - above).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in STATE[:5]], pa.array(bottom), pa.array(top), pa.array(rest)], list(STATE))

    return run


def top_in_windows(v: vb.Vectors, blocks: DataFrame, groups: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """grp, win, rank, id, rid, score: each window's k highest scores among rows with the anchor's label (same), or with another.

    windows: grp, win, pos (the anchor's place in its group), low, high (the scores that count, both included).
    """
    spark, shape = blocks.sparkSession, v.shape
    windows = checkpointed(windows.where("low <= high"))
    widest = windows.agg(F.max(F.col("high").cast("decimal(38,0)") - F.col("low"))).first()[0]
    if widest is None:
        return spark.createDataFrame([], "grp long, win int, rank int, id long, rid long, score long")
    passes = max(1, -(-int(widest).bit_length() // DIGIT))
    n_blocks, n_groups = blocks.count(), groups.count()
    stripes = min(n_blocks, max(-(-n_blocks // STRIPE), -(-2 * partitions(spark) // n_groups)))
    striped = blocks.withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(stripes)).cast("int"))
    deals = groups.select("grp", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"))

    def each(shift: int | None):
        def task(near: pa.Table, group: pa.Table) -> pa.Table:
            """Counts of the digit at shift, or the rows themselves where shift is None."""
            none = (np.zeros(0, np.int64),) * 3 + (np.zeros((0, shape.width)),)
            rows = [none] + [vb.unpacked(shape, b) for b in near.to_pylist()]  # a stripe may have no block
            ids, rids, labels, x = (np.concatenate([r[i] for r in rows]) for i in range(4))
            order = np.lexsort((rids, ids))
            ids, rids, labels, x = ids[order], rids[order], labels[order], x[order]
            out: list[list[np.ndarray]] = [[], [], [], [], []]

            def add(w: dict, *columns: np.ndarray) -> None:
                for to, c in zip(out, (np.full(len(columns[0]), w["win"]), *columns), strict=False):
                    to.append(c)

            key = group.column("grp")[0].as_py()
            for g in group.to_pylist():
                _, own_rids, own_labels, q = vb.unpacked(shape, g)
                mine: dict[int, list[dict]] = {}
                for w in g["windows"] or []:
                    mine.setdefault(w["pos"], []).append(w)
                places = np.array(sorted(mine), np.int64)
                for i in range(0, len(places), 64):
                    scores = vb.products(q[places[i : i + 64]], x)
                    for s, pos in zip(scores, places[i : i + 64].tolist(), strict=True):
                        alike = labels == own_labels[pos]
                        at = np.flatnonzero((alike & (rids != own_rids[pos]) if same else ~alike) & (s >= min(w["from_"] for w in mine[pos])))
                        s = s[at]
                        for w in mine[pos]:
                            if shift is None:
                                above = np.flatnonzero((s > w["from_"]) & (s <= w["high"]))
                                equal = np.flatnonzero(s == w["from_"])[: w["need"]]  # in the order of ids
                                chosen = np.concatenate([above, equal])
                                add(w, ids[at[chosen]], rids[at[chosen]], s[chosen])
                            else:
                                digit = (w["upto"] - s[(s >= w["from_"]) & (s <= w["upto"])]) >> shift
                                n = np.bincount(digit)
                                upto = int(np.searchsorted(np.cumsum(n), w["need"])) + 1
                                full = np.flatnonzero(n[:upto])
                                add(w, full, n[full])
            names = ("win", "id", "rid", "score") if shift is None else ("win", "digit", "n")
            columns = [np.concatenate(c or [np.zeros(0)]).astype(np.int64) for c in out[: len(names)]]
            return pa.table({"grp": pa.array([key] * len(columns[0]), pa.int64()), "win": pa.array(columns[0].astype(np.int32)), **dict(zip(names[1:], columns[1:], strict=True))})

        return task

    def asked(state: DataFrame, shift: int | None, schema: str) -> DataFrame:
        listed = state.groupBy("grp").agg(F.collect_list(F.struct("win", "pos", "high", F.col("low_now").alias("from_"), F.col("upto"), "need")).alias("windows"))  # a few for each of GROUP anchors
        near = deals.join(listed.select("grp"), "grp").join(striped, "stripe")
        group = deals.join(groups.join(listed, "grp"), "grp")
        return vb.meet(near, group, ("grp", "stripe"), each(shift), schema)

    state = windows.select("grp", "win", "pos", "low", "high", F.col("low").alias("low_now"), F.col("high").alias("upto"), F.lit(k).alias("need"))
    for shift in range(DIGIT * (passes - 1), -1, -DIGIT):
        counts = asked(state, shift, "grp long, win int, digit long, n long").groupBy("grp", "win", "digit").agg(F.sum("n").alias("n"))
        upto_here = F.sum("n").over(Window.partitionBy("grp", "win").orderBy("digit"))  # 2 ** DIGIT rows a window at most
        summed = counts.withColumn("upto_here", upto_here).join(state.select("grp", "win", "need"), ["grp", "win"]).where(F.col("upto_here") >= F.col("need"))
        first = summed.groupBy("grp", "win").agg(F.min(F.struct("digit", "n", "upto_here")).alias("hit"))
        joined = state.join(first, ["grp", "win"], "left")
        told = joined.select(*STATE, F.col("hit.digit").alias("digit"), (F.col("hit.upto_here") - F.col("hit.n")).alias("above"))
        now = told.mapInArrow(narrowed(shift, k), "grp long, win int, pos int, low long, high long, low_now long, upto long, need int").persist()
        now.count()  # estimates of size multiply at joins, a checkpoint keeps them, and a pass joins three times: a filled cache has the true size
        state = checkpointed(now)
        now.unpersist()
    rows = asked(state, None, "grp long, win int, id long, rid long, score long")
    rank = F.row_number().over(Window.partitionBy("grp", "win").orderBy(F.desc("score"), "id", "rid"))
    return checkpointed(rows.withColumn("rank", rank).where(F.col("rank") <= k).select("grp", "win", "rank", "id", "rid", "score"))


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (4, 5), scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for anchors, whose ids are divisible by `every`, and their positives.

    A negative has another label than its anchor and a score from share[0] / share[1] of the positive's up to the positive's.
    """
    v = vb.quantized(vectors, id_col, vector_col, F.col(f"`{label_col}`"), scale)
    anchors = v.rows.where((F.col("id") % every == 0) & (F.col("id") != vb.LAST))
    n = anchors.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks, groups = vb.in_blocks(v), vb.in_groups(anchors, n)
    own = vb.members(groups)
    most = int(min(v.norm * v.norm * (1 + 1e-9) + 1, vb.MOST))
    anchored = own.select("grp", F.col("pos").alias("win"), "pos", F.lit(-most).cast("long").alias("low"), F.lit(most).cast("long").alias("high"))
    alike = top_in_windows(v, blocks, groups, anchored, positives, True)
    pairs = alike.select("grp", (F.col("win") * positives + F.col("rank") - 1).cast("int").alias("win"), F.col("win").alias("pos"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    windows = pairs.select("grp", "win", "pos", _least(F.col("positive_score"), *share).alias("low"), F.col("positive_score").alias("high"))
    hard = top_in_windows(v, blocks, groups, windows, negatives, False)
    found = hard.join(pairs, ["grp", "win"]).join(own.select("grp", "pos", F.col("id").alias("anchor_id")), ["grp", "pos"])
    return found.select("anchor_id", vb.null_last(F.col("positive")).alias("positive_id"), F.col("rank").cast("int").alias("rank"), vb.null_last(F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _least(score: Column, a: int, b: int) -> Column:
    """The smallest whole number that is a / b of score or more; exact, as decimals have 38 digits."""
    return F.ceil(score.cast("decimal(20,0)") * F.lit(a).cast("decimal(10,0)") / F.lit(b).cast("decimal(10,0)")).cast("long")
