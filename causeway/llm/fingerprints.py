"""Document fingerprints by winnowing. JVM expressions only.

The units of a text are pieces of up to three code points of its runs of non-blank characters, cut where content tells and not by count
from a run's start: after each code point of END, which takes up to two others before it along; further ones before it stand alone, and so
do those after the last of a run but for its final three, which are one unit. What a code point's unit is depends on the three code points
on either side at most, so an edit disturbs no unit further away, in text without blanks either. A rolling window of k units is a gram (each is
hashed from its k units, as array functions keep no state from one window to the next); of
each w neighbouring grams the one with the least hash is kept, the rightmost of equals. Any passage of w + k - 1 units that two texts share
is thus found in both (the match guarantee), and the place of each kept gram, counted in units, and located() in code points,
tell where.

A gram's 32-bit hash and its place are one long, hash first and the place counted backwards, so the minimum of a window is the least hash
and the rightmost place; the minima of w = 2^m grams come from m rounds of pairwise minima at a distance, read in place: slices would copy the
grams six times a text.

Edge cases: a null text is an empty one; without units the fingerprint is empty, with fewer than k units they are one gram together, with
fewer than w grams their minimum is kept; two empty fingerprints are alike (1), an empty and another not at all (0); repeated rows are
fingerprinted each for itself; other columns are neither read nor returned; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import let, partitions

K, ROUNDS = 5, 3  # units in a gram; 2 ** ROUNDS grams in a window
BLANKS = " \t\n\v\f\r"
#: About a third of letters and digits; all code points beyond ASCII end a unit too.
ENDS = "cfiloruxCFILORUX258"
OTHERS = "".join(rf"\x{i:02x}" for i in range(128) if chr(i) not in BLANKS + ENDS)
#: ASCII classes as lists of characters, which Java looks up in a table, and possessive counts: what either would try again can't match, as OTHERS and the ends are disjoint.
UNIT = r"N{0,2}+E|N{1,3}+(?![^B])|N".replace("N", f"[{OTHERS}]").replace("E", rf"[{ENDS}\x{{80}}-\x{{10FFFF}}]").replace("B", "".join(rf"\x{ord(c):02x}" for c in BLANKS))
PLACES = (1 << 31) - 1


def winnow(text: Column, k: int = K, rounds: int = ROUNDS) -> Column:
    """The kept grams in order, as (hash, place): array<struct<hash:int, place:int>>."""
    units = F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: F.hash(u))
    pack = lambda h, i: F.shiftleft(F.pmod(h.cast("long"), F.lit(1 << 32)), 31).bitwiseOR(F.lit(PLACES) - i)  # noqa: E731  unsigned hash, place backwards

    def grams(u: Column) -> Column:
        starts = F.slice(u, F.lit(1), F.size(u) - (k - 1))
        some = F.transform(starts, lambda x, i: pack(F.hash(x, *[F.get(u, i + j) for j in range(1, k)]), i))
        whole = F.array(pack(F.aggregate(u, F.lit(0), lambda s, x: F.hash(s, x)), F.lit(0)))
        return F.when(F.size(u) == 0, F.array().cast("array<bigint>")).when(F.size(u) < k, whole).otherwise(some)

    def minima(g: Column) -> Column:
        for shift in [1 << j for j in range(rounds)]:
            g = let(g, paired(shift))
        # the last windows are cut off by the end; without a whole one the first has all grams
        return let(g, lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - ((1 << rounds) - 1), F.least(F.size(a), F.lit(1)))))

    def paired(shift: int):
        return lambda a: F.transform(a, lambda x, i: F.least(x, F.get(a, i + shift)))  # beyond the end null, which least passes over

    kept = F.array_distinct(minima(let(units, grams)))
    return F.transform(kept, lambda x: F.struct(F.shiftright(x, 31).cast("long").alias("hash"), (F.lit(PLACES) - x.bitwiseAND(F.lit(PLACES))).cast("int").alias("place")))


def located(text: Column, grams: Column, k: int = K) -> Column:
    """For each kept gram its hash and where it stands in the text: array<struct<hash, first, last>> in code points, last exclusive.

    For texts whose fingerprints have matched: the work is the text's length for each gram.
    """
    pieces = F.split(F.regexp_replace(F.translate(text, "\x01", "\x02"), UNIT, "\x01$0\x01"), "\x01")  # units at odd places, from 0, what is between them at even ones
    n = lambda p, upto: F.char_length(F.array_join(F.slice(p, F.lit(1), upto), ""))
    units = lambda p: F.floor((F.size(p) - 1) / 2).cast("int")
    span = lambda p, g: F.struct(g["hash"].alias("hash"), n(p, g["place"] * 2 + 1).alias("first"), n(p, F.least(g["place"] + k, units(p)) * 2).alias("last"))
    return let(pieces, lambda p: F.transform(grams, lambda g: span(p, g)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of hashes."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def with_next(docs: DataFrame, id_col: str, text_col: str, rows_each: int = 500) -> DataFrame:
    """id, text, and of the next document in descending order of id (after the last: the first) its text.

    The table is dealt into ranges of ids by bounds from approximate percentiles, up to eight for each of the session's reduce partitions.
    The first row of a range follows the last row of the range below, so it goes there too, and is answered there; the smallest id is answered
    in the highest range. Ties of ids are ordered by text.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("key", F.coalesce(F.col("id"), F.lit(-(1 << 63))).cast("long"))
    n, low = rows.agg(F.count("*"), F.min("key")).first()
    many = max(1, min(n // rows_each, 8 * partitions(docs.sparkSession)))
    bounds = [low]
    if many > 1:
        found = rows.agg(F.percentile_approx("key", [i / many for i in range(1, many)], 100 * many)).first()[0]
        bounds = sorted({low, *found})
    last = len(bounds) - 1
    # bounds in runs: a row compares with each run's first, then within one run
    width = max(1, math.isqrt(len(bounds)))
    runs = F.from_json(F.lit(json.dumps([bounds[i : i + width] for i in range(0, len(bounds), width)])), "array<array<bigint>>")
    coarse = F.size(F.filter(runs, lambda r: F.get(r, 0) <= F.col("key"))) - 1
    bucket = F.col("run") * width + F.size(F.filter(F.get(runs, F.col("run")), lambda b: b <= F.col("key"))) - 1
    dealt = rows.withColumn("run", coarse).withColumn("bucket", bucket)
    first = F.col("key") == F.get(F.get(runs, F.col("run")), F.col("bucket") - F.col("run") * width)
    below = F.when(F.col("bucket") == 0, last).otherwise(F.col("bucket") - 1)
    own, other = (F.struct(b.cast("int").alias("bucket"), F.lit(turn).alias("turn"), F.lit(asks).alias("asks")) for b, turn, asks in ((F.col("bucket"), 0, True), (below, 1, True)))
    gives = F.struct(F.col("bucket").cast("int").alias("bucket"), F.lit(0).alias("turn"), F.lit(False).alias("asks"))
    return dealt.withColumn("at", F.explode(F.when(first, F.array(gives, other)).otherwise(F.array(own)))).select("id", "key", "text", "at.bucket", "at.turn", "at.asks")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """id_col, `grams` and n_chars for each row: the operator for one table by itself."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`"), F.char_length(text).cast("long").alias("n_chars"), winnow(text, k, rounds).alias("grams"))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """Each text beside its edited form, whose last third is the next document's beginning, and beside the next document."""
    n = partitions(docs.sparkSession)
    dealt = with_next(docs, id_col, text_col).repartition(n, "bucket").withColumn("grams", winnow(F.col("text"), k, rounds))  # several ranges a partition even them out
    order = Window.partitionBy("bucket").orderBy("turn", "key", "text")
    paired = dealt.withColumn("next_text", F.lag("text").over(order)).withColumn("next_grams", F.lag("grams").over(order)).where("asks")
    length = F.char_length("text")
    third = F.floor(length / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), length - third), F.substring(F.col("next_text"), F.lit(1), third))
    return paired.withColumn("edited", edited).withColumn("edited_grams", winnow(F.col("edited"), k, rounds))
