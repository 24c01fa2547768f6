"""Divergence of sources within each language, exactly, from counts of terms.

Counts by (lang, source, term) are added up within the tasks that read the texts, and then by key. A term's counts form a sparse vector over its
language's sources; terms with equal vectors are grouped, and each distinct vector is evaluated once for every pair of sources and multiplied by
the number of its terms. Ranked terms are the original ones.

Sources of a language are numbered; pairs are cut into tiles of TILE by TILE sources and vectors into chunks of about CHUNK entries, so a task
holds one tile's sums and one chunk, however many sources or terms a language has. The result itself has each pair of sources, as asked for.
All arithmetic is in whole numbers.

Edge cases: null text, lang and source are ''; empty and null texts count as documents without terms, so their groups occur; a language without
kept terms gives pairs of value 0 and no terms; a language with one source gives no pair; repeated rows are documents of their own; other columns
are not read; an empty table gives an empty result. Terms are cut by bytes of UTF-8, in which every letter beyond ASCII has only bytes of 0x80 and more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import by_value, checkpointed

by_value(__name__)

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
UNIT, ADDED = 1_000_000_000, 5  # shares are in billionths, counts are smoothed by 5
HELD, TILE, CHUNK, SALTS = 500_000, 512, 1_000_000, 32  # terms that a reading task holds, sources of a tile, entries of a chunk, parts of a hot key


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences, and documents that hold the term. docs: text, lang, source without nulls."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict[bytes, list[int]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in held.items():
                words = list(terms)
                for i in range(0, len(words), 50_000):
                    part = words[i : i + 50_000]
                    columns = [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([terms[w][0] for w in part], pa.int64()), pa.array([terms[w][1] for w in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

        for b in batches:
            for text, lang, source in zip(b.column("text").cast(pa.binary()), b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True):
                terms = held.setdefault((lang, source), {})
                before = len(terms)
                own: dict[bytes, int] = {}
                for t in TERM.findall(text.as_py().lower()):
                    own[t] = own.get(t, 0) + 1
                for t, n in own.items():
                    if t in terms:
                        terms[t][0] += n
                        terms[t][1] += 1
                    else:
                        terms[t] = [n, 1]
                size += len(terms) - before
                if size > HELD:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    counted = docs.select("text", "lang", "source").mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column) -> Column:
    """1 + floor(UNIT * (n + ADDED) / total), exactly."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(UNIT).cast("decimal(12,0)") * (n + ADDED).cast("decimal(19,0)"), total.cast("decimal(20,0)"))


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """As share(), by long division three digits at a time, which 64 bits hold up to totals of 9e15."""
    rest, out = n + ADDED, np.zeros(np.broadcast(n, total).shape, np.int64)
    whole, rest = np.divmod(rest, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return 1 + whole * UNIT + out


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, terms: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: each source's other sources by the sum of differing shares, and its `terms` most over-represented terms."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    given = docs.select(text(text_col).alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source"))
    counts = term_counts(given)
    vector = F.array_sort(F.collect_list(F.struct("source", "n")))  # an entry for each source
    kept = checkpointed(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), vector.alias("vec")).where(F.col("docs") >= least_docs).drop("docs"))
    entries = kept.select("lang", F.explode("vec").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"), F.count("*").alias("entries"))
    size = kept.groupBy("lang").agg(F.count("*").alias("v"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a row for each source
    whole = F.sum("n").over(Window.partitionBy("lang"))
    some = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    named = given.select("lang", "source").distinct().join(entries, ["lang", "source"], "left").join(size, "lang", "left").select("lang", "source", some("v"), some("n"), some("entries"))
    profile = checkpointed(named.withColumns({"at": number.cast("int"), "lang_n": whole}))
    return _pairs(kept, profile).unionByName(_terms(kept, profile, terms))


def total(n: Column) -> Column:
    return n + F.col("v") * ADDED


def _pairs(kept: DataFrame, profile: DataFrame) -> DataFrame:
    langs = profile.groupBy("lang").agg(F.floor(F.max("at") / TILE).cast("int").alias("last"), (F.floor(F.sum("entries") / CHUNK) + 1).cast("int").alias("chunks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    distinct = kept.groupBy("lang", "vec").agg(F.count("*").alias("m")).withColumn("hash", F.xxhash64("vec")).withColumn("salt", F.pmod("hash", F.lit(SALTS)).cast("int"))
    chunk = F.pmod(F.shiftright("hash", 8), F.col("chunks")).cast("int").alias("chunk")
    a = distinct.join(langs, ["lang", "salt"]).select("lang", "vec", "m", "last", chunk, F.explode(F.sequence(F.lit(0), F.col("last"))).alias("a"))
    vectors = a.select("lang", "vec", "m", "chunk", "a", F.explode(F.sequence("a", "last")).alias("b"))
    tiles = langs.where("salt = 0").select("lang", "last", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).select("lang", "last", "chunk", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("a")).select("lang", "chunk", "a", F.explode(F.sequence("a", "last")).alias("b"))
    blocks = profile.select("lang", "source", "at", total(F.col("n")).alias("total"), F.floor(F.col("at") / TILE).cast("int").alias("block"))
    sources = tiles.join(blocks, "lang").where((F.col("block") == F.col("a")) | (F.col("block") == F.col("b")))
    key = ("lang", "a", "b", "chunk")

    def tile(vectors: pa.Table, sources: pa.Table) -> pa.Table:
        """Sums over a chunk's vectors for each pair of the tile's sources, and how many terms they are; vectors without entries here are left to the caller."""
        import pyarrow.compute as pc

        if not len(vectors) or not len(sources):
            return pa.table({"lang": pa.array([], pa.string()), "i": pa.array([], pa.int32()), "j": pa.array([], pa.int32()), "value": pa.array([], pa.int64()), "m": pa.array([], pa.int64())})
        sources = sources.sort_by("at").combine_chunks()
        at, totals, block = (sources.column(c).to_numpy() for c in ("at", "total", "block"))
        names = sources.column("source").combine_chunks()
        first, second = np.flatnonzero(block == vectors.column("a")[0].as_py()), np.flatnonzero(block == vectors.column("b")[0].as_py())
        value, terms = np.zeros((len(first), len(second)), np.int64), 0
        step = max(256, (1 << 21) // len(at))
        for part in vectors.select(["vec", "m"]).combine_chunks().to_batches(max_chunksize=step):
            vec, m = part.column("vec"), part.column("m").to_numpy()
            flat = vec.flatten()
            row = np.repeat(np.arange(len(part)), np.diff(vec.offsets.to_numpy()))
            column = pc.fill_null(pc.index_in(flat.field("source"), value_set=names), -1).to_numpy()
            here = column >= 0
            n = np.zeros((len(part), len(at)), np.int64)
            n[row[here], column[here]] = flat.field("n").to_numpy()[here]
            some = np.unique(row[here])
            p, m = shares(n[some], totals[None]), m[some]
            terms += int(m.sum())
            for i, k in enumerate(first):
                value[i] += (np.abs(p[:, [k]] - p[:, second]) * m[:, None]).sum(0)
        i, j = np.meshgrid(at[first], at[second], indexing="ij")
        keep = i < j
        return pa.table({"lang": pa.array([vectors.column("lang")[0].as_py()] * int(keep.sum()), pa.string()), "i": pa.array(i[keep], pa.int32()), "j": pa.array(j[keep], pa.int32()), "value": value[keep], "m": pa.array([terms] * int(keep.sum()), pa.int64())})

    sums = vectors.groupBy(*key).cogroup(sources.groupBy(*key)).applyInArrow(tile, "lang string, i int, j int, value long, m long").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"), F.sum("m").alias("m"))
    side = profile.select("lang", "source", "at", "v", F.when(F.col("v") > 0, share(F.lit(0), total(F.col("n")))).alias("zero"))
    other = side.select("lang", F.col("source").alias("item"), F.col("at").alias("at2"), F.col("zero").alias("zero2"))
    pairs = side.join(other, "lang").where("at <> at2").withColumns({"i": F.least("at", "at2"), "j": F.greatest("at", "at2")}).join(sums, ["lang", "i", "j"], "left")
    absent = (F.col("v") - F.coalesce("m", F.lit(0))) * F.coalesce(F.abs(F.col("zero") - F.col("zero2")), F.lit(0))  # terms that neither tile of sources holds
    valued = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("value", F.lit(0)) + absent).cast("long").alias("value"))
    return valued.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _terms(kept: DataFrame, profile: DataFrame, most: int) -> DataFrame:
    salted = profile.select("lang", "source", "v", F.col("n").alias("source_n"), "lang_n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    of_lang = F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    each = kept.select("lang", "term", of_lang.alias("all_n"), F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int").alias("salt"), F.explode("vec").alias("x")).select("lang", "term", "all_n", "salt", F.col("x.source").alias("source"), F.col("x.n").alias("n"))
    more = share(F.col("n"), total(F.col("source_n"))) - share(F.col("all_n"), total(F.col("lang_n")))
    valued = each.join(salted, ["lang", "source", "salt"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), more.cast("long").alias("value")).where("value > 0")
    return valued.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= most)
