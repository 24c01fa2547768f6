"""Stupid-backoff scores of all documents under the n-gram counts of all others.

Count tables are partitioned by hash and joined to the texts' distinct n-grams. The few n-grams that make up a good part of the corpus
(grams.heavy: at most 65,536 of each length, whatever the input) have a count table of their own, added up before the shuffle and
broadcast, so no frequent word is a hot key and texts need not ask for it. For the others each text asks the hash partitions for its
distinct words and bigrams, in packed messages, with how often it holds each; a partition adds them up over all texts to its part of the
count table and answers with the totals, in the order of the question, so an answer is little more than a byte. Words are asked in one turn
and bigrams in the next. Only trigrams both of whose bigrams other texts hold can be held by other texts, so only these are asked, in a
third turn. At last the texts, which are shuffled once, meet their answers and the scores are summed per document.

A text's own occurrences are taken off every count, else no n-gram would ever be unseen. The score of a word after two words is

    c(u v w) / c(u v)   or, where the count above is 0,   0.4 * c(v w) / c(v)   or   0.16 * c(w) / N   or   0.064 / N

without the longer contexts at a text's start. Words are runs of bytes other than ASCII white space. N-grams are told apart by 48 bits within
a hash partition (64 bits from 65,536 partitions on), texts by 64 bits of a hash of id and text.

Edge cases: a null text is an empty one; a text without words has log_score 0 and no mean_log (null); where no other text has a word, N
counts as 1; repeated rows are texts of their own, count for each other and are returned each for itself; a null id is returned as null;
other columns are neither read nor returned; an empty table gives an empty result.
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

BACKOFF = 0.4
MESSAGE = "part int, kind int, message binary"


def distinct(identities: np.ndarray, starts: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the n-grams that start at `starts`, each in the text of that number: one start for each kind in each text, by text and what it is, its text, how often it occurs there, and the kind at each start."""
    order = np.argsort(identities[starts])
    order = order[np.argsort(texts[order], kind="stable")]
    same, text = identities[starts[order]], texts[order]
    new = np.concatenate([[True], (same[1:] != same[:-1]) | (text[1:] != text[:-1])])[: len(order)]
    first = np.flatnonzero(new)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    return starts[order[first]], text[first], np.diff(np.append(first, len(order))), kind


def windows(ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all n-grams within a text, and their texts' numbers."""
    starts, counts = grams.own_windows(ends, n)
    return starts, np.repeat(np.arange(len(counts), dtype=np.uint16 if len(counts) < 1 << 16 else np.uint32), counts)  # 16 bits: the stable sort is a radix sort


def hot_counts(texts: DataFrame, floor: int) -> tuple[int, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The number of all words, and for each n the hashes, sorted, of the heavy n-grams and how often each occurs."""
    few = grams.heavy(texts, (1, 2, 3), floor=floor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = grams.Hasher(), 0
        found = {n: np.zeros(len(v), np.int64) for n, v in few.items()}
        for batch in batches:
            for _, data, bounds in grams.slices(batch, 0):
                words, ends = hasher.words(data, bounds)
                total += len(words)
                for n, v in few.items():
                    if len(v):
                        at = grams.among(grams.grams(words, n)[grams.own_windows(ends, n)[0]], v)
                        found[n] += np.bincount(at[at >= 0], minlength=len(v))
        rows = [(0, 0, total), *((n, int(i), int(c[i])) for n, c in found.items() for i in np.flatnonzero(c))]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["n", "place", "times"])

    rows = texts.mapInArrow(run, "n long, place long, times long").groupBy("n", "place").agg(F.sum("times").alias("times")).collect()  # 3 * 65,536 + 1 at most
    counts = {n: np.zeros(len(v), np.int64) for n, v in few.items()}
    for r in rows:
        if r["n"]:
            counts[r["n"]][r["place"]] = r["times"]
    return sum(r["times"] for r in rows if not r["n"]), {n: (v, counts[n]) for n, v in few.items()}


def stupid_backoff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", floor: int = grams.FLOOR) -> DataFrame:
    """id_col, n_words, log_score (natural, summed) and mean_log for each row. floor: n-grams that occur less often are never heavy."""
    parts = homes = partitions(docs.sparkSession)
    ids = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(ids.alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).select("id", F.xxhash64("id", "text").alias("key"), "text")
    everything, hot = hot_counts(rows.select("text"), floor)

    def every(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the n-grams at each place of many texts the hashes, what they stand for, and their broadcast counts or 0."""
        values = grams.grams(words, n)
        at = grams.among(values, hot[n][0])
        known = np.where(at >= 0, hot[n][1][at], 0) if len(hot[n][0]) else np.zeros(len(values), np.int64)
        return values, grams.identity(values, parts), known

    def ask(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, box = grams.Hasher(), Question(parts)
            for batch in batches:
                for part, data, bounds in grams.slices(batch, 2):
                    words, ends = hasher.words(data, bounds)
                    values, same, known = every(words, n)
                    places, texts, often, _ = distinct(same, *windows(ends, n))
                    if box.add(part.column(1), places, texts, often, values, known):
                        yield from grams.sent(box.flush())
            yield from grams.sent(box.flush())

        return run

    def others(same: np.ndarray, known: np.ndarray, starts: np.ndarray, texts: np.ndarray, counts: pa.Array) -> np.ndarray:
        """At each place where an n-gram starts how often other texts hold it, 0 elsewhere. same, known: as of every(); counts: each text's answers."""
        out = np.zeros(len(same), np.int64)
        places, text, often, kind = distinct(same, starts, texts)
        total = known[places]
        rest = np.flatnonzero(total == 0)
        if len(rest):
            own, asked = np.unique(text[rest], return_counts=True)
            total[rest] = np.concatenate([grams.large(counts[int(i)].as_buffer(), int(m))[0] for i, m in zip(own, asked, strict=True)])
        out[starts] = (total - often)[kind]
        return out

    def candidates(two: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The starts of trigrams both of whose bigrams other texts hold, and their texts' numbers."""
        starts, texts = windows(ends, 3)
        good = (two[starts] > 0) & (two[starts + 1] > 0)
        return starts[good], texts[good]

    def ask_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, box = grams.Hasher(), Question(parts)
        for batch in batches:
            for part, data, bounds in grams.slices(batch, 2):
                words, ends = hasher.words(data, bounds)
                (_, same2, known2), (values, same, known) = every(words, 2), every(words, 3)
                two = others(same2, known2, *windows(ends, 2), part.column(4))
                places, texts, often, _ = distinct(same, *candidates(two, ends))
                if box.add(part.column(1), places, texts, often, values, known):
                    yield from grams.sent(box.flush())
        yield from grams.sent(box.flush())

    def add_up(part: int, kinds: list, messages: list) -> Iterator[tuple]:
        read = [grams.unpacked(m) for m in messages]
        messages.clear()
        keys, values, often = (np.concatenate([r[i] for r in read]) for i in range(3))
        del read
        values = grams.whole(values, part, parts)
        order, at = grams.groups(values)
        keys, values = keys[order], values[order]
        total = np.repeat(np.add.reduceat(often[order], at[:-1]), np.diff(at))
        order = np.argsort(keys, kind="stable")  # the values of a key stay in order
        keys, values, total = keys[order], values[order], total[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])])  # repeated rows ask the same
        keys, total = keys[new], total[new]
        for h, place in grams.dealt(keys.astype(np.uint64) % np.uint64(homes), homes):
            own = keys[place]
            at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            runs = np.diff(np.append(at, len(own)))
            yield h, part, np.array([len(at)], "<u4").tobytes() + own[at].astype("<i8").tobytes() + grams.small(runs) + grams.small(total[place])

    def gather(home: int, kinds: list, messages: list) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for k in np.argsort(kinds, kind="stable"):
            message = messages[k]
            n = int(np.frombuffer(message, "<u4", 1)[0])
            own = np.frombuffer(message, "<i8", n, 4)
            runs, at = grams.large(message, n, 4 + 8 * n)
            keys.append(np.repeat(own, runs))
            counts.append(grams.large(message, int(runs.sum()), at)[0].astype(np.uint32))
        messages.clear()
        key, count = np.concatenate(keys), np.concatenate(counts)
        del keys, counts
        order = np.argsort(key, kind="stable")  # of one key, in order of partition and value
        key, count = key[order], count[order]
        at = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
        yield pa.RecordBatch.from_arrays([pa.array(key[at[:-1]]), pa.array([grams.small(count[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["key", "counts"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = grams.Hasher()
        for batch in batches:
            for part, data, bounds in grams.slices(batch, 2):
                words, ends = hasher.words(data, bounds)
                (_, same1, known1), (_, same2, known2), (_, same3, known3) = (every(words, n) for n in (1, 2, 3))
                one = others(same1, known1, *windows(ends, 1), part.column(3))  # what other texts hold, at the first word of each n-gram
                two = others(same2, known2, *windows(ends, 2), part.column(4))
                three = others(same3, known3, *candidates(two, ends), part.column(5))
                sizes = np.diff(ends)
                at = np.arange(len(words)) - np.repeat(ends[:-1], sizes)  # place in the text
                rest = np.maximum(1, everything - np.repeat(sizes, sizes))
                p = np.where(at == 0, 1.0, np.where(at == 1, BACKOFF, BACKOFF**2)) * np.where(one > 0, one, BACKOFF) / rest
                if len(words) > 1:
                    seen = (at[1:] > 0) & (two[: len(words) - 1] > 0)
                    p[1:] = np.where(seen, np.where(at[1:] == 1, 1.0, BACKOFF) * two[: len(words) - 1] / np.maximum(one[:-1], 1), p[1:])
                if len(words) > 2:
                    seen = (at[2:] > 1) & (three[: len(words) - 2] > 0)
                    p[2:] = np.where(seen, three[: len(words) - 2] / np.maximum(two[: len(words) - 2], 1), p[2:])
                logs = np.log(p)
                sums = [float(logs[a:b].sum()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes.astype(np.int64)), pa.array(sums, pa.float64())], ["id", "n_words", "log_score"])

    def answered(asked: DataFrame) -> DataFrame:
        return grams.exchanged(grams.exchanged(asked, parts, add_up, MESSAGE), homes, gather, "key long, counts binary")

    # a turn for words and one for bigrams: what a turn holds on disk goes before the next
    singles, pairs = (checkpointed(answered(rows.mapInArrow(ask(n), MESSAGE)).withColumnRenamed("counts", c)) for n, c in ((1, "singles"), (2, "pairs")))
    known = rows.join(singles.hint("shuffle_hash"), "key", "left").join(pairs.hint("shuffle_hash"), "key", "left").select("id", "key", "text", "singles", "pairs")
    second = answered(known.mapInArrow(ask_again, MESSAGE)).withColumnRenamed("counts", "more")
    out = known.join(second.hint("shuffle_hash"), "key", "left").select("id", "key", "text", "singles", "pairs", "more").mapInArrow(score, "id long, n_words long, log_score double")
    return out.select(F.col("id").alias(id_col), "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log"))


class Question:
    """An Outbox of values with counts, text by text."""

    def __init__(self, parts: int, most: int = grams.FLUSH):
        self.parts, self.most = parts, most
        self.rows, self.held = [], 0

    def add(self, keys: pa.Array, places: np.ndarray, texts: np.ndarray, often: np.ndarray, values: np.ndarray, known: np.ndarray) -> bool:
        """The n-grams at places, in the texts of those numbers, whose count isn't known. True if it is time to flush."""
        rest = known[places] == 0
        own = keys.to_numpy(zero_copy_only=False)[texts[rest]]
        self.rows.append((own, values[places[rest]], often[rest].astype(np.uint32)))
        self.held += len(own)
        return self.held >= self.most

    def flush(self) -> Iterator[tuple[int, int, bytes]]:
        if self.held:
            keys, values, often = (np.concatenate(x) for x in zip(*self.rows, strict=True))
            self.rows.clear()
            for p, own in grams.dealt(grams.part_of(values, self.parts), self.parts):
                yield p, 0, grams.packed(keys[own], values[own], often[own])
        self.rows, self.held = [], 0
