"""Exact repeats by fixed-block anchors.

A window of `window` words (13) holds a whole aligned block of (window + 1) / 2 words (7) wherever it starts, so each text indexes only its
non-overlapping blocks while every text probes with each of its rolling 7-word windows. A probe that meets another text's block is an
anchor. Anchors are extended: every 13-word window around one is looked up, by two hashes of all its words, and neighbouring windows that
repeat one of a smaller id merge into the maximal repeated span, which is removed.

Index, probes and look-ups travel as packed messages to hash partitions and answers travel back, so a shared passage costs its occurrences
and not their pairs. The few blocks and windows that make up a good part of the corpus (grams.heavy), as a passage that a third of all
texts share, are broadcast instead: such blocks are anchors everywhere, and the smallest id of such windows comes from minima that are taken
before the shuffle. Texts are shuffled once, by id, and joined with the answers.

Anchors only lead to windows that may repeat. Windows are equal if a hash of 48 bits within a hash partition (64 from 65,536 partitions on)
and another of 64 bits are: unlike windows count as equal once in some 10^33 pairs, below 10^-8 over 10^12 windows.

Edge cases: a null text is an empty one; texts shorter than a window lose nothing; rows of one id are one document, so they never repeat
one another, and each is returned; a null id, and 2^63 - 1, counts as larger than any, is returned as null and repeats no other null; other
columns are neither read nor returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm import grams
from causeway.llm.common import by_value, checkpointed, partitions

by_value(__name__)

LAST = (1 << 63) - 1
INDEX, PROBE = 0, 1
MESSAGE = "part int, kind int, message binary"


def second(words: np.ndarray, n: int) -> np.ndarray:
    """Another hash of each n neighbouring words, by other multipliers of other mixtures of the words."""
    return grams.grams(grams.mix(words ^ grams.BASE), n)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, floor: int = grams.FLOOR) -> DataFrame:
    """id_col, n_words, spans (array of first and last word, exclusive, that repeat a smaller id) and kept, the other words joined by spaces.

    floor: blocks and windows that occur less often are never heavy.
    """
    if window % 2 == 0:
        raise ValueError("window must be odd")
    block = (window + 1) // 2
    parts = homes = partitions(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    few = grams.heavy(rows.select("text"), (block, window), floor=floor)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each heavy window (its place among them, and its other hash) the smallest id in this task."""
        hasher, found = grams.Hasher(), {}
        for batch in batches:
            for part, data, bounds in grams.slices(batch, 1):
                words, ends = hasher.words(data, bounds)
                starts, counts = grams.own_windows(ends, window)
                at = grams.among(grams.grams(words, window)[starts], few[window])
                some = np.flatnonzero(at >= 0)
                if len(some):
                    own = np.stack([at[some], second(words, window)[starts[some]].view(np.int64), np.repeat(part.column(0).to_numpy(zero_copy_only=False), counts)[some]])
                    own = own[:, np.lexsort(own[::-1])]
                    new = np.concatenate([[True], (own[:2, 1:] != own[:2, :-1]).any(0)])
                    for place, other, i in own[:, new].T.tolist():
                        found[place, other] = min(i, found.get((place, other), LAST))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()), pa.array(found.values(), pa.int64())], ["place", "other", "id"])

    lowest = np.full(len(few[window]), LAST, np.int64)
    others = np.zeros(len(few[window]), np.uint64)
    if len(few[window]):
        # a row for each heavy window, of unlike windows with one hash the one with the least of the other
        each = rows.mapInArrow(least, "place long, other long, id long").groupBy("place", "other").agg(F.min("id").alias("id")).groupBy("place").agg(F.min(F.struct("other", "id")).alias("x"))
        for r in each.select("place", "x.*").collect():
            lowest[r["place"]], others[r["place"]] = r["id"], np.uint64(r["other"] & ((1 << 64) - 1))

    def heavy_windows(large: np.ndarray, more: np.ndarray) -> np.ndarray:
        """The place of each window among the heavy ones, or -1."""
        at = grams.among(large, few[window])
        return np.where((at >= 0) & (others[at] == more), at, -1) if len(others) else at

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, index, probes = grams.Hasher(), grams.Outbox(parts), grams.Outbox(parts)

        def send() -> Iterator[pa.RecordBatch]:
            yield from grams.sent((p, kind, m) for kind, box in ((INDEX, index), (PROBE, probes)) for p, m in box.flush())

        for batch in batches:
            for part, data, bounds in grams.slices(batch, 1):
                words, ends = hasher.words(data, bounds)
                keys = part.column(0).to_numpy(zero_copy_only=False)
                starts, counts = grams.own_windows(ends, block)
                values = grams.grams(words, block)[starts]
                of = np.repeat(np.arange(len(keys)), counts)
                aligned = (starts - np.repeat(ends[:-1], counts)) % block == 0
                rare = grams.among(values, few[block]) < 0
                for box, some in ((index, aligned & rare), (probes, ~aligned & rare)):
                    box.add(keys, np.bincount(of[some], minlength=len(keys)), values[some])
                if probes.held >= probes.most:
                    yield from send()
        yield from send()

    def anchor(part: int, kinds: list, messages: list) -> Iterator[tuple]:
        read = [grams.unpacked(m)[:2] for m in messages]
        messages.clear()
        keys, values = (np.concatenate([r[i] for r in read]) for i in (0, 1))
        blocks = np.concatenate([np.full(len(r[0]), k == INDEX) for r, k in zip(read, kinds, strict=True)])
        del read
        order, at = grams.groups(values)
        keys, values, blocks = keys[order], values[order], blocks[order]
        many = (np.minimum.reduceat(keys, at[:-1]) != np.maximum.reduceat(keys, at[:-1])) & np.logical_or.reduceat(blocks, at[:-1])
        some = np.repeat(many, np.diff(at))
        for h, m in grams.homed(keys[some], values[some], homes):
            yield h, part, m

    def later(part: int, kinds: list, messages: list) -> Iterator[tuple]:
        """Of the windows in one hash partition, those that start in a smaller id too."""
        read = []
        for m in messages:
            size = int(np.frombuffer(m, "<u4", 1)[0])
            read.append((*grams.unpacked(m.slice(4, size))[:2], np.frombuffer(m, np.uint64, (m.size - 4 - size) // 8, 4 + size)))
        messages.clear()
        keys, values, more = (np.concatenate([r[i] for r in read]) for i in (0, 1, 2))
        del read
        order = np.lexsort((more, values))
        keys, values, more = keys[order], values[order], more[order]
        at = np.append(np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (more[1:] != more[:-1])])), len(values))
        some = keys > np.repeat(np.minimum.reduceat(keys, at[:-1]), np.diff(at))
        for h, m in grams.homed(keys[some], values[some], homes):
            yield h, part, m

    def gather(home: int, sorts: list, messages: list) -> Iterator[pa.RecordBatch]:
        read = [(*grams.unpacked(m)[:2], k) for m, k in zip(messages, sorts, strict=True)]
        messages.clear()
        keys = np.concatenate([r[0] for r in read])
        values = np.concatenate([grams.whole(r[1], r[2], parts) for r in read])
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        at = np.append(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(keys[at[:-1]]), pa.array([np.unique(values[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["id", "found"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held = grams.Hasher(), []

        def send() -> Iterator[tuple]:
            if held:
                keys, values, more = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                for p, own in grams.dealt(grams.part_of(values, parts), parts):
                    first = grams.packed(keys[own], values[own])
                    yield p, PROBE, np.array([len(first)], "<u4").tobytes() + first + more[own].tobytes()

        for batch in batches:
            for part, data, bounds in grams.slices(batch, 1):
                words, ends = hasher.words(data, bounds)
                tiny, large, more = grams.grams(words, block), grams.grams(words, window), second(words, window)
                common, tiny = grams.among(tiny, few[block]) >= 0, grams.identity(tiny, parts)
                rare = heavy_windows(large, more) < 0
                for i, (key, found) in enumerate(zip(part.column(0).to_pylist(), part.column(2), strict=True)):
                    a, b = ends[i], ends[i + 1]
                    if b - a >= window:
                        hit = common[a : b - block + 1].copy()
                        if found.is_valid:
                            hit |= np.isin(tiny[a : b - block + 1], np.frombuffer(found.as_buffer(), np.uint64))
                        before = np.concatenate([[0], np.cumsum(hit)])
                        around = (before[window - block + 1 :] > before[: b - a - window + 1]) & rare[a : b - window + 1]  # an anchor among the blocks of each window
                        some = a + np.flatnonzero(around)
                        if len(some):
                            held.append((np.full(len(some), key), large[some], more[some]))
                if sum(len(x[0]) for x in held) >= grams.FLUSH:
                    yield from grams.sent(send())
        yield from grams.sent(send())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = grams.Hasher()
        for batch in batches:
            for part, data, bounds in grams.slices(batch, 1):
                words, ends = hasher.words(data, bounds)
                large = grams.grams(words, window)
                frequent = heavy_windows(large, second(words, window))
                least_id = np.where(frequent >= 0, lowest[frequent], LAST) if len(lowest) else np.full(len(large), LAST)
                large = grams.identity(large, parts)
                raw, n_words, spans, kept = data.tobytes(), [], [], []
                for i, (key, found) in enumerate(zip(part.column(0).to_pylist(), part.column(2), strict=True)):
                    a, b = int(ends[i]), int(ends[i + 1])
                    texts = raw[bounds[i] : bounds[i + 1]].split()
                    n_words.append(b - a)
                    own = []
                    if b - a >= window:
                        hit = least_id[a : b - window + 1] < key
                        if found.is_valid:
                            hit = hit | (np.isin(large[a : b - window + 1], np.frombuffer(found.as_buffer(), np.uint64)) & (frequent[a : b - window + 1] < 0))
                        if hit.any():
                            edge = np.zeros(b - a + 1, np.int32)
                            edge[: len(hit)] += hit
                            edge[window : window + len(hit)] -= hit
                            gone = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
                            change = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
                            own = list(zip(change[::2], change[1::2], strict=True))
                    spans.append([{"first": x, "last": y} for x, y in own])
                    left, at = [], 0
                    for x, y in own:
                        left += texts[at:x]
                        at = y
                    kept.append(b" ".join(left + texts[at:] if own else texts).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array(kept, pa.string())], ["id", "n_words", "spans", "kept"])

    def answered(messages: DataFrame, by) -> DataFrame:
        return grams.exchanged(grams.exchanged(messages, parts, by, MESSAGE), homes, gather, "id long, found binary")

    anchors = checkpointed(answered(rows.mapInArrow(probe, MESSAGE), anchor))
    asked = rows.join(anchors.hint("shuffle_hash"), "id", "left").select("id", "text", "found").mapInArrow(look_up, MESSAGE)
    out = rows.join(answered(asked, later).hint("shuffle_hash"), "id", "left").select("id", "text", "found").mapInArrow(cut, "id long, n_words long, spans array<struct<first:int,last:int>>, kept string")
    return out.select(F.when(F.col("id") != LAST, F.col("id")).alias(id_col), "n_words", "spans", "kept")
