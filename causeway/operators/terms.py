"""Words and pairs of neighbouring words of texts, counted and weighted within Arrow batches: texts never move and no row is made for a term.

A batch's words are cut out of its bytes at once and numbered by a dictionary of the batch; a pair is two numbers. The most frequent terms are
found exactly in two steps. First all terms are counted by the bucket of their hash; a bucket's count is an upper bound for each of its terms.
Then the terms of the fullest buckets are counted by themselves, and if the last one that would be kept is no more frequent than buckets left
out, those are counted too. What comes to the driver is BUCKETS counts and `size` terms, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.scalar import BASE, ORDER, STEP
from causeway.functions.workers import by_value

by_value(__name__)

BUCKETS, PARTS = 1 << 20, 256  # counts of hashes, and the rows that they travel in
BYTES = 1 << 23  # of text that are taken at once
BREAK = "\x00"  # no pair goes across it

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), 95, *range(97, 123)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), 32]] = True


def lowered(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(BREAK), F.lit(" "))


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts, null ones as empty, in runs of BYTES or one text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right")))
        yield texts.slice(at, to - at)
        at = to


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens of `scalar.tokens`, and for each occurrence its number and its text. texts: in lower case, as from slices()."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets[:-1] - offsets[0]
    inside = _IN_WORD[data] & (data != 95)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    own = starts[starts < len(data)]
    first[own] = inside[own]
    kept = ~_BLANK[data]
    first |= kept & ~inside & (data & 0xC0 != 0x80)  # any other character by itself
    begin = np.flatnonzero(first)
    places = np.append(np.flatnonzero(first[kept]), np.count_nonzero(kept)).astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(places), pa.py_buffer(data[kept])).dictionary_encode()
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(np.searchsorted(begin, starts), len(begin))))
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), row


def token_ids(modulus: int):
    """A function of texts in lower case: each token's id, the first 24 bits of its MD5 modulo `modulus`, and its text. A batch's distinct tokens are hashed once."""
    import hashlib

    def of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, rows, start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for some in slices(texts):
            distinct, code, row = tokens(some)
            number = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:3], "big") % modulus for w in distinct.to_pylist()], np.int64)
            ids.append(number[code]), rows.append(row + start)
            start += len(some)
        return np.concatenate(ids), np.concatenate(rows)

    return of


def array_ids(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each element of arrays of ids, and its row."""
    return ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(ids)), pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))


def gram_buckets(ids: np.ndarray, row: np.ndarray, has: np.ndarray, buckets: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of `scalar.ngram_buckets` by row, and the rows; bucket 0 for those rows of `has` without n-gram."""
    found = []
    for n in orders:
        at = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1]) if len(row) >= n else np.zeros(0, np.int64)
        h = ids[at] * BASE + STEP if n == 1 else sum((ids[at + j] * (BASE + STEP * (j + 1)) for j in range(n)), np.full(len(at), ORDER * n))
        found.append(row[at] * buckets + h % buckets)
    key = np.concatenate(found)
    empty = np.flatnonzero(has & (np.bincount(key // buckets, minlength=len(has)) == 0))
    key, _ = _runs(np.concatenate([key, empty * buckets]))
    return key % buckets, key // buckets


class Words:
    """The words of some texts: `words`, the distinct ones, and for each occurrence its number `code` and its text `row`; `left` are the occurrences that the next one follows in the same text."""

    def __init__(self, texts: pa.Array):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        starts = offsets[:-1] - offsets[0]
        inside = _IN_WORD[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        own = starts[starts < len(data)]
        first[own] = inside[own]  # a text's first byte starts a word, whatever stands before
        begin = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        lengths = np.flatnonzero(last) + 1 - begin
        places = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        every = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(places), pa.py_buffer(data[inside]))
        long = np.flatnonzero(lengths >= 2)
        coded = every.take(pa.array(long)).dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at = begin[long]
        self.row = np.repeat(np.arange(len(starts)), np.diff(np.append(np.searchsorted(at, starts), len(at))))
        breaks = np.flatnonzero(data == 0)
        part = self.row + np.searchsorted(breaks, at) if len(breaks) else self.row
        self.left = np.flatnonzero(part[1:] == part[:-1])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return self.code[self.left], self.code[self.left + 1]

    def hashes(self) -> np.ndarray:
        return pd.util.hash_array(self.words.to_numpy(zero_copy_only=False), categorize=False) if len(self.words) else np.zeros(0, np.uint64)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(44)).astype(np.int64)


def _pair_bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _bucket(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each occurs."""
    key = np.sort(key)
    begin = np.flatnonzero(np.append(np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))
    return key[begin], np.diff(np.append(begin, len(key)))


def bucket_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How often terms of each bucket occur, and the number of texts. texts: one column, in lower case."""
    width = BUCKETS // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            n += len(b)
            for some in slices(b.column(0)):
                w = Words(some)
                h = w.hashes()
                total += np.bincount(_bucket(h)[w.code], minlength=BUCKETS)
                left, right = w.pairs()
                total += np.bincount(_pair_bucket(h[left], h[right]), minlength=BUCKETS)
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "counts": [p.tobytes() for p in total.reshape(PARTS, width)], "n": pa.array([n] * PARTS, pa.int64())})

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for c in group.column("counts"):
            total += np.frombuffer(c.as_buffer(), np.int64)
        return pa.table({"part": group.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary()), "n": [pc.sum(group.column("n")).as_py()]})

    schema = "part int, counts binary, n long"
    out, n = np.zeros((PARTS, width), np.int64), 0
    for r in texts.mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).collect():
        out[r.part], n = np.frombuffer(r.counts, np.int64), r.n
    return out.ravel(), n


def counted(texts: DataFrame, chosen: np.ndarray) -> DataFrame:
    """term, df, total: in how many texts each term of the chosen buckets occurs, and how often."""
    packed = np.packbits(chosen)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.unpackbits(packed).astype(bool)
        for b in batches:
            for some in slices(b.column(0)):
                w = Words(some)
                h = w.hashes()
                left, right = w.pairs()
                single, double = asked[_bucket(h)][w.code], asked[_pair_bucket(h[left], h[right])]
                code = np.concatenate([w.code[single], left[double] * len(w.words) + right[double] + len(w.words)])
                row = np.concatenate([w.row[single], w.row[w.left][double]])
                both, tf = _runs(code * len(some) + row)
                if not len(both):
                    continue
                term = both // len(some)  # one for each term and text
                begin = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
                df, total = np.diff(np.append(begin, len(term))), np.add.reduceat(tf, begin)
                term = term[begin]
                pair = term >= len(w.words)
                first, second = (term[pair] - len(w.words)) // len(w.words), (term[pair] - len(w.words)) % len(w.words)
                names = pc.binary_join_element_wise(w.words.take(pa.array(first)), w.words.take(pa.array(second)), pa.scalar(" ", pa.large_string()))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([w.words.take(pa.array(term[~pair])), names]).cast(pa.string()), *[pa.array(np.concatenate([x[~pair], x[pair]])) for x in (df, total)]], ["term", "df", "total"])

    rows = texts.mapInArrow(count, "term string, df long, total long")
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def frequent(texts: DataFrame, least: int, most: float, size: int, n: int | None = None) -> list[tuple[str, float]]:
    """The `size` most frequent terms, ties by term, of those in `least` texts or more and in no more than the share `most`, with their smooth idf. n: the number of texts, if not one a row."""
    counts, rows = bucket_counts(texts)
    n = rows if n is None else n
    floor = max(1, least)
    limit = max(floor, int(np.partition(counts, BUCKETS - 2 * size)[BUCKETS - 2 * size]) if 2 * size < BUCKETS else floor)
    while True:
        found = counted(texts, counts >= limit).where((F.col("df") >= least) & (F.col("df") <= n * most)).orderBy(F.desc("total"), "term").limit(size).collect()
        need = found[-1]["total"] if len(found) == size else floor  # what is rarer isn't kept
        if need >= limit or limit == floor:
            return [(r["term"], float(np.log((1 + n) / (1 + r["df"])) + 1)) for r in found]
        limit = max(need, floor)


class Weights:
    """tf-idf of texts over given terms: (row, place, weight) arrays, by row and place, each row of unit length."""

    def __init__(self, terms: list[tuple[str, float]]):
        parts = [t.split(" ") for t, _ in terms]
        self.idf = np.array([x for _, x in terms])
        self.single = {p[0]: i for i, p in enumerate(parts) if len(p) == 1}
        known = sorted({w for p in parts if len(p) == 2 for w in p})
        number = {w: i for i, w in enumerate(known)}
        self.known, self.base = known, max(1, len(known))
        pairs = sorted((number[p[0]] * self.base + number[p[1]], i) for i, p in enumerate(parts) if len(p) == 2)
        self.pair_key, self.pair_at = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = Words(texts)
        place = lambda some: pc.fill_null(pc.index_in(w.words, pa.array(some, pa.large_string())), -1).to_numpy(zero_copy_only=False)
        names = list(self.single)
        at = np.append(np.array([self.single[x] for x in names], np.int64), -1)[place(names)][w.code]
        row, good = w.row, at >= 0
        at, row = at[good], row[good]
        if len(self.pair_key):
            part = place(self.known)
            left, right = w.pairs()
            a, b = part[left].astype(np.int64), part[right].astype(np.int64)
            both = np.flatnonzero((a >= 0) & (b >= 0))
            key = a[both] * self.base + b[both]
            near = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            same = self.pair_key[near] == key
            at, row = np.concatenate([at, self.pair_at[near[same]]]), np.concatenate([row, w.row[w.left][both[same]]])
        both, tf = _runs(row * len(self.idf) + at)
        row, at = both // max(1, len(self.idf)), both % max(1, len(self.idf))
        x = (1 + np.log(tf)) * self.idf[at] if len(at) else np.zeros(0)
        norm = np.sqrt(np.bincount(row, x * x, len(texts)))
        return row, at, x / norm[row]


def weighted(df: DataFrame, key: str, text: str, terms: list[tuple[str, float]]) -> DataFrame:
    """key, term, weight: a row for each row of df and each of the terms that it has. text: in lower case."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names = Weights(terms), pa.array([t for t, _ in terms], pa.string())
        for b in batches:
            start = 0
            for some in slices(b.column(1)):
                row, at, x = model.of(some)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + start)), names.take(pa.array(at)), pa.array(x)], [key, "term", "weight"])
                start += len(some)

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, term string, weight double")


def _pieces(values: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Where each run of rows begins, and the run: of a quarter of BYTES of text or ids, or one row, as each of them is in several arrays at once."""
    texts = not pa.types.is_list(values.type) and not pa.types.is_large_list(values.type)
    sizes = pc.binary_length(values) if texts else pc.multiply(pc.list_value_length(values), 4)
    ends, at = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES // 4, "right")))
        yield at, values.slice(at, to - at)
        at = to


def bucketed(df: DataFrame, key: str, value: str, of, buckets: int, orders: tuple[int, ...], kept: np.ndarray | None = None) -> DataFrame:
    """key, bucket: each row's distinct buckets, of those in kept. of: makes ids and their rows of the values; a null value has no bucket."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, some in _pieces(b.column(1)):
                bucket, row = gram_buckets(*of(some), some.is_valid().to_numpy(zero_copy_only=False), buckets, orders)
                if kept is not None:
                    good = kept[bucket]
                    bucket, row = bucket[good], row[good]
                for i in range(0, len(row), 1 << 18):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[i : i + (1 << 18)] + start)), pa.array(bucket[i : i + (1 << 18)])], [key, "bucket"])

    return df.select(key, value).mapInArrow(run, f"`{key}` {kind}, bucket long")


def bucket_rows(values: DataFrame, of, buckets: int, orders: tuple[int, ...]) -> np.ndarray:
    """How many rows have each bucket. values: one column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(buckets, np.int64), 0
        for b in batches:
            n += len(b)
            for _, some in _pieces(b.column(0)):
                total += np.bincount(gram_buckets(*of(some), some.is_valid().to_numpy(zero_copy_only=False), buckets, orders)[0], minlength=buckets)
        if n:
            parts = np.array_split(total, min(PARTS, buckets))
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(len(parts)), pa.int32()), "counts": [p.tobytes() for p in parts]})

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_buffer(), np.int64) for c in group.column("counts"))
        return pa.table({"part": group.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, counts binary"
    found = sorted((r.part, r.counts) for r in values.mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema).collect())
    return np.concatenate([np.frombuffer(c, np.int64) for _, c in found]) if found else np.zeros(buckets, np.int64)
