"""N-gram Jaccard self-join: rare-first prefix filtering with length, positional and suffix filters.

1. Each text's distinct word shingles, as 64-bit hashes, go in packed messages to hash partitions, which count in how many texts each stands.
   Shingles of one text alone, the most of them, can match nothing; the others come back to their text with that count. The few shingles
   that make up a good part of the corpus (grams.heavy) are broadcast instead and stand last in every text's order, so that a line that all
   texts share is no hot key.
2. In the order of count and hash, singles first, a text of n shingles can only link with another if they share one of its first
   n - ceil(t n) + 1. Texts whose prefix is all singles are done. Texts with equal sets become one class.
3. Classes are joined on prefix shingles, in packed messages to hash partitions. In a few rounds each class tries only its likeliest partner
   of another component, which keeps large groups of near copies from forming all pairs: all that must be known is components. A last
   round takes every pair of classes in different components that share a prefix shingle and was not tried before, under the length,
   positional and suffix filters, so no link that could join components is lost. Each pair is verified once, on the whole sets. The suffix
   filter is a parity signature of the whole set: each bit in which two sets differ is a shingle that only one of them holds.

Shingles are told apart by 48 bits within a hash partition (64 bits from 65,536 partitions on), texts by 64 bits of a hash of id and text.

Edge cases: null or empty texts have no shingle and link with nothing; a text with fewer words than a shingle has is one shingle; repeated
rows are returned each for itself and linked; a null id, and 2^63 - 1, counts as larger than any and is returned as null; other columns are
neither read nor returned by jaccard_components; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm import grams
from causeway.llm.common import by_value, checkpointed, partitions, unused
from causeway.llm.components import stars

by_value(__name__)

LAST = (1 << 63) - 1
MESSAGE = "part int, kind int, message binary"


INFO, QUESTION, HOT = -1, 0, -2


def shared_shingles(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, fold: bool, floor: int) -> DataFrame:
    """key, id, n, singles and tokens of each row: tokens are the shingles that other texts hold too, rarest first; null where nothing can link."""
    parts = homes = partitions(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    ids = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(F.xxhash64(ids, text).alias("key"), F.coalesce(ids, F.lit(LAST)).alias("id"), text.alias("text"))
    few = grams.heavy(rows.select("text"), (words,), fold, floor=floor)[words]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, out = grams.Hasher(fold), grams.Outbox(parts)
        odd, infos, frequent = grams.constants(words, 99), [], []

        def send() -> Iterator[pa.RecordBatch]:
            rows = [(p, QUESTION, m) for p, m in out.flush()]
            if infos:  # a row's id and number of shingles, and its heavy shingles, go to the home of its key
                info = np.concatenate(infos)
                rows += [(h, INFO, info[own].tobytes()) for h, own in grams.dealt(info[:, 0].astype(np.uint64) % np.uint64(homes), homes)]
                keys, at = (np.concatenate(x) for x in zip(*frequent, strict=True))
                rows += [(h, HOT, m) for h, m in grams.homed(keys, at.astype(np.uint64), homes)]
                infos.clear(), frequent.clear()
            yield from grams.sent(rows)

        for batch in batches:
            for part, data, bounds in grams.slices(batch, 2):
                own, ends = hasher.words(data, bounds)
                shingles = grams.grams(own, words)
                found = []
                for i in range(len(part)):
                    a, b = ends[i], ends[i + 1]
                    if b - a >= words:
                        found.append(np.unique(shingles[a : b - words + 1]))
                    elif b > a:
                        found.append(grams.mix((own[a:b] * odd[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
                    else:
                        found.append(own[:0])
                keys, ids = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                counts = np.array([len(x) for x in found], np.int64)
                infos.append(np.stack([keys, ids, counts], 1))
                values, of = np.concatenate(found), np.repeat(np.arange(len(part)), counts)
                at = grams.among(values, few)
                frequent.append((keys[of[at >= 0]], at[at >= 0]))
                if out.add(keys, np.bincount(of[at < 0], minlength=len(part)), values[at < 0]) or len(infos) > 500:
                    yield from send()
        yield from send()

    def count(part: int, kinds: list, messages: list) -> Iterator[tuple]:
        asked = []
        for kind, message in zip(kinds, messages, strict=True):
            if kind == QUESTION:
                asked.append(grams.unpacked(message)[:2])
            else:
                yield part, kind, message.to_pybytes()
        messages.clear()
        if not asked:
            return
        keys, values = np.concatenate([r[0] for r in asked]), np.concatenate([r[1] for r in asked])
        asked.clear()
        order, at = grams.groups(values)
        keys, values = keys[order], values[order]
        many = np.minimum.reduceat(keys, at[:-1]) != np.maximum.reduceat(keys, at[:-1])  # not from one text's repeated rows alone
        often = np.diff(at)
        some, df = np.repeat(many, often), np.repeat(often, often)
        for h, m in grams.homed(keys[some], values[some], homes, df[some]):
            yield h, part, m

    def gather(home: int, sorts: list, messages: list) -> Iterator[pa.RecordBatch]:
        infos, keys, values, dfs = [], [], [], []
        for kind, message in zip(sorts, messages, strict=True):
            if kind == INFO:
                infos.append(np.frombuffer(message, np.int64).reshape(-1, 3))
            elif kind == HOT:
                k, at, _ = grams.unpacked(message)
                keys.append(k), values.append(few[at.astype(np.int64)]), dfs.append(np.full(len(k), np.iinfo(np.int64).max))  # last in the order, for every text
            else:
                k, v, d = grams.unpacked(message)
                keys.append(k), values.append(grams.whole(v, kind, parts)), dfs.append(d)
        messages.clear()
        info = np.concatenate(infos) if infos else np.zeros((0, 3), np.int64)
        key = np.concatenate([*keys, np.zeros(0, np.int64)])
        value, df = np.concatenate([*values, np.zeros(0, np.uint64)]), np.concatenate([*dfs, np.zeros(0, np.int64)])
        order = np.lexsort((value, df, key))
        key, value = key[order], value[order].view(np.int64)
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (key[1:] != key[:-1])])[: len(key)]  # repeated rows say the same
        key, value = key[new], value[new]
        n = info[:, 2]
        first, last = np.searchsorted(key, info[:, 0]), np.searchsorted(key, info[:, 0], "right")
        single = n - (last - first)
        live = (n > 0) & (single <= n - -(-percent * n // 100))
        tokens = [value[a:b] if x else None for a, b, x in zip(first, last, live, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(info[:, 0]), pa.array(info[:, 1]), pa.array(n), pa.array(single), pa.array(tokens, pa.list_(pa.int64()))], ["key", "id", "n", "singles", "tokens"])

    asked = grams.exchanged(rows.mapInArrow(ask, MESSAGE), parts, count, MESSAGE)
    return grams.exchanged(asked, homes, gather, "key long, id long, n long, singles long, tokens array<long>")


BITS = 512  # of a set's parity signature
BLOCK = 1 << 19  # pairs looked at at once


def posted(sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """Each class's prefix, packed by hash partition of the shingle: part, kind, message. sets: key, n, singles, tokens, comp."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple] = []
        columns: list[list[np.ndarray]] = [[], [], []]  # shingle, place, the shingle before
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not runs:
                return
            of = np.repeat(np.arange(len(runs)), [r[5] for r in runs])
            token, at, prior = (np.concatenate(c) for c in columns)
            meta = np.array([r[:4] for r in runs], np.int64)
            signs = np.stack([r[4] for r in runs])
            for p, own in grams.dealt(grams.part_of(token, parts), parts):
                which, local = np.unique(of[own], return_inverse=True)
                message = b"".join(x.tobytes() for x in (np.array([len(which), len(own)], "<i8"), meta[which], signs[which], local.astype("<u4"), at[own].astype("<u4"), token[own], prior[own]))
                yield from grams.sent([(p, 0, message)])
            runs.clear()
            for c in columns:
                c.clear()

        for b in batches:
            for key, n, singles, tokens, comp in zip(*[b.column(i) for i in range(5)], strict=True):
                n, singles = n.as_py(), singles.as_py()
                own = tokens.values.to_numpy(zero_copy_only=False).view(np.uint64)
                many = min(len(own), n - -(-percent * n // 100) + 1 - singles)
                sign = np.packbits((np.bincount((own >> np.uint64(20)).astype(np.int64) & (BITS - 1), minlength=BITS) & 1).astype(np.uint8)).view(np.uint64)
                runs.append((key.as_py(), n, singles, comp.as_py(), sign, many))
                columns[0].append(own[:many])
                columns[1].append(np.arange(singles, singles + many))
                columns[2].append(np.concatenate([np.zeros(1, np.uint64), own[: many - 1]]))
                held += many
                if held > 1 << 19:
                    yield from flush()
                    held = 0
        yield from flush()

    return sets.select("key", "n", "singles", "tokens", "comp").mapInArrow(send, MESSAGE)


def received(messages: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of posted(): a row (key, n, singles, comp) and a signature for each class and message, then for each shingle its class, place, itself and the one before."""
    meta, signs, of, at, token, prior, base = [], [], [], [], [], [], 0
    for data in messages:
        runs, n = (int(x) for x in np.frombuffer(data, "<i8", 2))
        meta.append(np.frombuffer(data, np.int64, 4 * runs, 16).reshape(-1, 4))
        signs.append(np.frombuffer(data, np.uint64, runs * BITS // 64, k := 16 + 32 * runs).reshape(-1, BITS // 64))
        of.append(np.frombuffer(data, "<u4", n, k := k + runs * BITS // 8).astype(np.int64) + base)
        at.append(np.frombuffer(data, "<u4", n, k := k + 4 * n).astype(np.int64))
        token.append(np.frombuffer(data, np.uint64, n, k := k + 4 * n))
        prior.append(np.frombuffer(data, np.uint64, n, k + 8 * n))
        base += runs
    messages.clear()
    return tuple(np.concatenate(x) for x in (meta, signs, of, at, token, prior))


def likeliest(posts: DataFrame, percent: int, parts: int, turn: int) -> DataFrame:
    """u, v: each class with the class of another component that is first in most of the lists of its prefix: the one with the fewest shingles of its own, in later turns another order."""

    def pivots(part: int, kinds: list, messages: list) -> Iterator[pa.RecordBatch]:
        meta, _, of, _, token, _ = received(messages)
        key, n, comp = meta[of, 0], meta[of, 1], meta[of, 3]
        rank = meta[of, 2].astype(np.uint64) if turn == 0 else grams.mix(key.view(np.uint64) + np.uint64(turn))
        order = np.lexsort((key, rank, token))
        token, key, n, comp = token[order], key[order], n[order], comp[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        pivot = np.repeat(first, np.diff(np.append(first, len(token))))
        ok = (comp != comp[pivot]) & (np.minimum(n, n[pivot]) * 100 >= np.maximum(n, n[pivot]) * percent)
        pairs, times = np.unique(np.stack([key[ok], key[pivot[ok]]], 1), axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(times)], ["u", "v", "times"])

    tried = grams.exchanged(posts, parts, pivots, "u long, v long, times long").groupBy("u", "v").agg(F.sum("times").alias("times"))
    best = tried.groupBy("u").agg(F.max_by("v", F.struct("times", "v")).alias("v"))
    return best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def candidates(posts: DataFrame, percent: int, parts: int) -> DataFrame:
    """u, v: all pairs of classes of different components that share a prefix shingle and pass the length, positional and suffix filters.

    In the list of a shingle, each class that isn't of the list's most frequent component meets all those of other components near enough in
    length, so a long list of one component costs no pairs. A pair that shares the shingle before too was met there already. The suffix
    filter bounds what two sets share by their parity signatures: each bit in which they differ is a shingle that only one of them holds.
    """

    def pairs(part: int, kinds: list, messages: list) -> Iterator[pa.RecordBatch]:
        meta, signs, of, at, token, prior = received(messages)
        order = np.lexsort((meta[of, 0], meta[of, 1], token))
        of, at, token, prior = of[order], at[order], token[order], prior[order]
        key, n, single, comp = (meta[of, k] for k in range(4))
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        many = np.diff(np.append(first, len(token)))
        which = np.repeat(np.arange(len(first)), many)
        by = np.lexsort((comp, which))  # the components of each list in runs, the longest of them leads
        start = np.flatnonzero(np.concatenate([[True], (comp[by][1:] != comp[by][:-1]) | (which[by][1:] != which[by][:-1])]))
        long = np.diff(np.append(start, len(by)))
        best = np.lexsort((-long, which[by][start]))
        lead = np.zeros(len(first), np.int64)
        lead[which[by][start][best][::-1]] = comp[by][start][best][::-1]  # the first of each list is written last
        asks = np.flatnonzero(comp != lead[which])
        # where in the list, which is in order of n, the sets near enough in length stand
        place = which * (1 << 32) + np.minimum(n, (1 << 32) - 1)
        low = np.searchsorted(place, which[asks] * (1 << 32) + -(-n[asks] * percent // 100))
        high = np.searchsorted(place, which[asks] * (1 << 32) + np.minimum(n[asks] * 100 // percent, (1 << 32) - 1), "right")
        width = high - low
        upto = np.cumsum(width)
        a = 0
        while a < len(asks):  # some of those that ask at a time, a million pairs or one asker's own
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + BLOCK, "right")))
            for lo in range(0, int(width[a]) if b == a + 1 else 1, BLOCK):
                if b == a + 1:
                    j = np.arange(low[a] + lo, min(high[a], low[a] + lo + BLOCK))
                    i = np.full(len(j), asks[a])
                else:
                    i = np.repeat(asks[a:b], width[a:b])
                    j = np.arange(len(i)) - np.repeat(upto[a:b] - width[a:b] - (upto[a - 1] if a else 0), width[a:b]) + np.repeat(low[a:b], width[a:b])
                ok = (comp[i] != comp[j]) & ((comp[j] == lead[which[j]]) | (i < j)) & ((prior[i] != prior[j]) | (prior[i] == 0))
                i, j = i[ok], j[ok]
                need = (n[i] + n[j]) * percent
                ok = (np.minimum(at[i], at[j]) + np.minimum(n[i] - at[i], n[j] - at[j])) * (100 + percent) >= need
                i, j, need = i[ok], j[ok], need[ok]
                differ = np.bitwise_count(signs[of[i]] ^ signs[of[j]]).sum(1, dtype=np.int64)
                ok = (n[i] - single[i] + n[j] - single[j] - differ) * (100 + percent) >= 2 * need
                u, v = key[i[ok]], key[j[ok]]
                out = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
                if len(out):
                    yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["u", "v"])
            a = b

    return grams.exchanged(posts, parts, pairs, "u long, v long").distinct()


def labelled_rows(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, fold: bool, rounds: int, floor: int) -> DataFrame:
    """key, id, n and first for each row; first: the (id, key) that is smallest in the row's component."""
    parts = partitions(docs.sparkSession)
    found = checkpointed(shared_shingles(docs, id_col, text_col, words, percent, fold, floor))
    # a shingle of its own makes a set unlike any other
    live = found.where("tokens is not null").select("key", "id", "n", "singles", "tokens", F.struct("n", F.xxhash64("tokens"), F.when(F.col("singles") > 0, F.col("key")).otherwise(F.hash("tokens"))).alias("set"))
    classes = checkpointed(live.groupBy("set").agg(F.min("key").alias("class"), F.min(F.struct("id", "key")).alias("least")))
    member = live.select("key", "set").join(classes, "set").select("key", "class")
    sets = checkpointed(live.join(classes.select(F.col("class").alias("key")), "key", "left_semi").dropDuplicates(["key"]).select("key", "n", "singles", "tokens"))
    state, tried, labelled = None, None, sets.withColumn("comp", F.col("key"))
    for turn in range(rounds + 1):
        posts = posted(labelled, percent, parts)
        if turn == rounds:
            pairs = candidates(posts, percent, parts)
            pairs = pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti")
        else:
            pairs = checkpointed(likeliest(posts, percent, parts, turn))
            tried = pairs if tried is None else tried.unionByName(pairs)
        linked = verified(pairs, sets, percent)
        state = stars(linked if state is None else linked.unionByName(state))  # stars stand for all links before
        labelled = sets.join(state.select(F.col("u").alias("key"), F.col("v").alias("component")), "key", "left").withColumn("comp", F.coalesce("component", "key")).drop("component")
    grouped = checkpointed(classes.select("class", "least").join(state.select(F.col("u").alias("class"), F.col("v").alias("root")), "class", "left").withColumn("root", F.coalesce("root", "class")))
    least = grouped.groupBy("root").agg(F.min("least").alias("first"))
    labels = grouped.join(least, "root").select("class", "first").join(member, "class").select("key", "first").distinct()
    return found.select("key", "id", "n").join(labels, "key", "left").withColumn("first", F.coalesce("first", F.struct("id", "key")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, fold: bool = True, rounds: int = 1, floor: int = grams.FLOOR) -> DataFrame:
    """id_col, n_shingles and component_id for each row; texts link where 100 * shared >= percent * all of their shingles. floor: shingles that occur less often are never heavy."""
    out = labelled_rows(docs, id_col, text_col, words, percent, fold, rounds, floor)
    null = lambda c: F.when(c != LAST, c)
    return out.select(null(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), null(F.col("first.id")).alias("component_id"))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, fold: bool = True, floor: int = grams.FLOOR) -> DataFrame:
    """id_col, n_shingles and n_links for each row: the number of other rows that it links with.

    Every pair of classes that shares a prefix shingle and passes the filters is verified, those of one component too, so the work grows
    with the number of links, which in a group of n different near copies is n (n - 1) / 2.
    """
    parts = partitions(docs.sparkSession)
    found = checkpointed(shared_shingles(docs, id_col, text_col, words, percent, fold, floor))
    live = found.where("tokens is not null").select("key", "n", "singles", "tokens", F.struct("n", F.xxhash64("tokens"), F.when(F.col("singles") > 0, F.col("key")).otherwise(F.hash("tokens"))).alias("set"))
    classes = checkpointed(live.groupBy("set").agg(F.min("key").alias("class"), F.count("*").alias("size")))
    member = live.select("key", "set").distinct().join(classes, "set").select("key", "class", "size")
    sets = checkpointed(live.join(classes.select(F.col("class").alias("key")), "key", "left_semi").dropDuplicates(["key"]).select("key", "n", "singles", "tokens"))
    linked = verified(candidates(posted(sets.withColumn("comp", F.col("key")), percent, parts), percent, parts), sets, percent)
    ends = linked.select(F.explode(F.array(F.struct(F.col("u").alias("class"), F.col("v").alias("other")), F.struct(F.col("v").alias("class"), F.col("u").alias("other")))).alias("x")).select("x.*")
    outside = ends.join(classes.select(F.col("class").alias("other"), F.col("size").alias("many")), "other").groupBy("class").agg(F.sum("many").alias("outside"))
    counts = member.join(outside, "class", "left").select("key", (F.col("size") - 1 + F.coalesce("outside", F.lit(0))).alias("links"))
    alone = found.where("tokens is null and n > 0").groupBy("key").agg((F.count("*") - 1).alias("copies"))  # links with its repeated rows alone
    out = found.select("key", "id", "n").join(counts, "key", "left").join(alone, "key", "left")
    return out.select(F.when(F.col("id") != LAST, F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("links", "copies", F.lit(0)).cast("long").alias("n_links"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs u, v of classes that link, by their whole sets."""
    for s in "uv":
        pairs = pairs.join(sets.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("tokens").alias(f"tokens_{s}")), s)
    shared = F.size(F.array_intersect("tokens_u", "tokens_v"))
    return pairs.where(shared * (100 + percent) >= (F.col("n_u") + F.col("n_v")) * percent).select("u", "v")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """One row of each component: the smallest id's. All columns stay, whatever their names.

    Unlike texts under one id are rows of their own: each is kept unless its own component has a smaller id, or the same id with a smaller
    hash of the text. Of repeated rows (equal id and text) one is kept. Null and empty texts link with nothing, so each id's stays. Rows
    without an id, which nothing could name, are all kept. An empty table gives an empty result.
    """
    key, ids = unused(docs, "key"), F.col(f"`{id_col}`").cast("long")
    named = docs.where(ids.isNotNull()).withColumn(key, F.xxhash64(ids, F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    out = labelled_rows(named, id_col, text_col, words, percent, True, 1, grams.FLOOR)
    first = out.where(F.col("first.key") == F.col("key")).select(F.col("key").alias(key)).distinct()
    kept = named.join(first, key, "left_semi").dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.unionByName(docs.where(ids.isNull()))
