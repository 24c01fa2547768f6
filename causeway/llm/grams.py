"""Word and n-gram hashes of many texts at once, in NumPy, and packed messages between tasks. For worker functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import by_value

by_value(__name__)

BYTES = 1 << 20  # of text hashed at once, unless one text is longer
FLUSH = 1 << 20  # values that a map task holds before it sends them
HEAVY, FLOOR = 1 << 16, 1000
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * BASE + np.uint64(seed)) | np.uint64(1)


class Hasher:
    """Words are runs of bytes other than ASCII white space; fold: A-Z as a-z."""

    def __init__(self, fold: bool = False):
        self.value = constants(256, 7)
        if fold:
            self.value[65:91] = self.value[97:123]
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.multiplier, self.inverse = int(constants(1, 11)[0]), pow(int(constants(1, 11)[0]), -1, 1 << 64)
        self.powers = self.backs = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, BYTES + 1)
            for name, m in (("powers", self.multiplier), ("backs", self.inverse)):
                out = np.full(size, m, np.uint64)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))

    def words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word of texts that lie in data between bounds, and the number of words before each text's end, from 0."""
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
        solid = ~self.blank[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self._grow(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.powers[: len(data)], out=total[1:])
        hashed = mix((total[ends] - total[starts]) * self.backs[starts] + (ends - starts).astype(np.uint64))
        return hashed, np.searchsorted(starts, bounds)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n neighbouring words, whatever text they are of."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    c = constants(n, 1000 + n)
    out = words[: len(words) - n + 1] * c[0]
    for j in range(1, n):
        out = out + words[j : len(words) - n + 1 + j] * c[j]
    return mix(out)


def slices(batch: pa.RecordBatch, text: int, most: int = BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batch with about `most` bytes of the text column (no nulls) at most, its bytes, and where each text starts and ends."""
    column = batch.column(text)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


class Outbox:
    """Messages from a map task to hash partitions: for each key some 48-bit values, packed by partition, in bounded memory."""

    def __init__(self, parts: int, most: int = FLUSH):
        self.parts, self.most, self.keys, self.values, self.held = parts, most, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray, values: np.ndarray) -> bool:
        """values: 64-bit hashes, of each key in turn as many as counts says. True if it is time to flush."""
        self.keys.append(np.repeat(keys, counts))
        self.values.append(values)
        self.held += len(values)
        return self.held >= self.most

    def flush(self) -> Iterator[tuple[int, bytes]]:
        if self.held:
            keys, values = np.concatenate(self.keys), np.concatenate(self.values)
            for p, own in dealt(part_of(values, self.parts), self.parts):
                yield p, packed(keys[own], values[own])
        self.keys, self.values, self.held = [], [], 0


def dealt(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each number in part with the places where it stands, in their order."""
    part = part.astype(np.uint16 if parts <= 1 << 16 else np.uint32)  # 16 bits: the stable sort is a radix sort
    order = np.argsort(part, kind="stable")
    ordered = part[order]
    at = np.append(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])), len(order)) if len(order) else np.zeros(1, np.int64)
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield int(ordered[a]), order[a:b]


def part_of(values: np.ndarray, parts: int) -> np.ndarray:
    """By the upper 32 bits, for any number of partitions below 2^31."""
    return ((values >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def whole(low: np.ndarray, part: np.ndarray | int, parts: int) -> np.ndarray:
    """What a packed value of a partition stands for: the partition's least 64-bit value with these lower 48 bits, which is the value itself from 2^16 partitions on."""
    first = lambda p: ((p.astype(np.uint64) << np.uint64(32)) + np.uint64(parts - 1)) // np.uint64(parts)
    start = first(np.arange(parts))[part] if np.ndim(part) and parts < len(part) else first(np.asarray(part))  # few divisions
    top = start + (((low >> np.uint64(32)) - start) & np.uint64(0xFFFF))
    return (top << np.uint64(32)) | (low & np.uint64(0xFFFFFFFF))


def identity(values: np.ndarray, parts: int) -> np.ndarray:
    """whole() of hashes that have not travelled."""
    return whole(values & np.uint64((1 << 48) - 1), part_of(values, parts), parts)


def small(counts: np.ndarray) -> bytes:
    """Counts as a byte each, those from 255 on as four more behind."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u4").tobytes()


def large(data: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    """n counts that small() wrote at `at`, and where they end."""
    out = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    big = np.flatnonzero(out == 255)
    out[big] = np.frombuffer(data, "<u4", len(big), at + n)
    return out, at + n + 4 * len(big)


def packed(keys: np.ndarray, values: np.ndarray, extra: np.ndarray | None = None) -> bytes:
    """Runs of equal keys once each, with their lengths, and six bytes of each value; extra: a count beside each value."""
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(at, len(keys)))
    low = (values & np.uint64(0xFFFFFFFF)).astype("<u4")
    high = ((values >> np.uint64(32)) & np.uint64(0xFFFF)).astype("<u2")
    head = np.array([len(at), len(keys), extra is not None], "<u4")
    return b"".join([head.tobytes(), keys[at].astype("<i8").tobytes(), small(counts), low.tobytes(), high.tobytes(), *([small(extra)] if extra is not None else [])])


def unpacked(message) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """keys, values of 48 bits, and extra if there is any; a key for each value."""
    runs, n, more = (int(x) for x in np.frombuffer(message, "<u4", 3))
    keys = np.frombuffer(message, "<i8", runs, 12)
    counts, at = large(message, runs, 12 + 8 * runs)
    low = np.frombuffer(message, "<u4", n, at)
    high = np.frombuffer(message, "<u2", n, at + 4 * n)
    extra = large(message, n, at + 6 * n)[0] if more else None
    return np.repeat(keys, counts), low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)), extra


def groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts values, and where each distinct one starts in it, and the end."""
    order = np.argsort(values)
    ordered = values[order]
    return order, np.append(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])), len(values))


def homed(keys: np.ndarray, values: np.ndarray, homes: int, extra: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """Answers, packed by the home of their key."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    extra = None if extra is None else extra[order]
    for h, own in dealt(keys.astype(np.uint64) % np.uint64(homes), homes):
        yield h, packed(keys[own], values[own], None if extra is None else extra[own])


def exchanged(messages: DataFrame, parts: int, answer: Callable[[int, list, list], Iterator[tuple]], schema: str) -> DataFrame:
    """Messages (part, kind, message) meet those of their part, each part in the partition of its number: answer(part, kinds, messages) gives rows of schema."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds_of = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds_of.get(x.split()[1]) for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for b in batches:
            for part, kind, message in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                kinds, read = held.setdefault(part, ([], []))
                kinds.append(kind), read.append(message.as_buffer())
        for part in sorted(held):
            for out in answer(part, *held.pop(part)):
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, types, strict=True)], names)

    return messages.select("part", "kind", "message").repartitionById(parts, F.col("part")).mapInArrow(run, schema)


def sent(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """(part, kind, message) each in a batch of its own."""
    for part, kind, message in rows:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([message], pa.binary())], ["part", "kind", "message"])


def heavy(texts: DataFrame, sizes: tuple[int, ...], fold: bool = False, most: int = HEAVY, floor: int = FLOOR) -> dict[int, np.ndarray]:
    """For each n the hashes, sorted, of the n-grams that make up about one of `most` or more of all, and at least `floor`: at most `most`, whatever the input.

    texts: one string column without nulls. A map task counts what it holds at a time and reports what is frequent there; an n-gram with twice
    the share is so counted by half at least. Operators keep these few n-grams out of their hash partitions, where one of them alone would
    be a hot key, and treat them by broadcast instead, with equal results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(fold)
        held: dict[int, list[np.ndarray]] = {n: [] for n in sizes}
        size = 0

        def report() -> Iterator[pa.RecordBatch]:
            for n in sizes:
                values, counts = np.unique(np.concatenate([*held[n], np.zeros(0, np.uint64)]), return_counts=True)
                total = int(counts.sum())
                some = counts >= max(2, total // most)
                rows = np.append(values[some], np.uint64(0)).view(np.int64), np.append(counts[some], 0), np.append(np.zeros(some.sum(), np.int64), total)  # the last: of all n-grams
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows[0]), n), pa.int32()), *(pa.array(x, pa.int64()) for x in rows)], ["n", "value", "times", "total"])
                held[n].clear()

        for batch in batches:
            for _, data, bounds in slices(batch, 0):
                words, ends = hasher.words(data, bounds)
                for n in sizes:
                    held[n].append(grams(words, n)[own_windows(ends, n)[0]])
                size += len(words)
                if size >= FLUSH:
                    yield from report()
                    size = 0
        yield from report()

    counted = texts.mapInArrow(run, "n int, value long, times long, total long").groupBy("n", "value").agg(F.sum("times").alias("times"), F.sum("total").alias("total"))
    # both sides pick rows by both sums: a filter on a key would go below the sums, an unused sum be dropped, and the texts be read once for each side
    total = counted.where("total > 0 and times >= 0").select("n", "total")
    # no more than `most` values can have a share of one of `most`
    often = counted.where((F.col("times") >= max(1, floor)) & (F.col("total") >= 0)).select("n", "value", "times").join(F.broadcast(total), "n").where(F.col("times") * most >= F.col("total"))  # total: a row for each n
    found = often.select("n", "value").collect()
    return {n: np.sort(np.array([r["value"] for r in found if r["n"] == n], np.int64).view(np.uint64)) for n in sizes}


def among(values: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Of each value its place in few, which is sorted, or -1. Only values whose upper 20 bits one of few shares are searched for."""
    out = np.full(len(values), -1, np.int64)
    if len(few):
        held = np.zeros(1 << 20, bool)
        held[few >> np.uint64(44)] = True
        some = np.flatnonzero(held[values >> np.uint64(44)])
        own = values[some]
        at = np.minimum(np.searchsorted(few, own), len(few) - 1)
        out[some] = np.where(few[at] == own, at, -1)
    return out


def own_windows(ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of windows of n words within one text each: their starts and how many each text has."""
    counts = np.maximum(np.diff(ends) - n + 1, 0)
    first = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - np.repeat(first, counts) + np.repeat(ends[:-1], counts), counts
