"""Mixing sources to target weights by Poisson replication.

Each source has a rate: its target share of all characters, times `epochs` times all characters, over its own characters. A document
occurs as often as a Poisson variable with its source's rate, which comes from inverting the distribution at a uniform that the seed and
the id determine: any executor, and any retry, gives the same copies. All copies are then ordered by another hash: a global shuffle.

The counts behind the rates cover all rows. The rates, one row a source, are literals of the plan while there are at most `few` sources and
their thresholds at most TABLE numbers together, and else come by a join whose side of documents is salted, so that a source with a third of
all rows spreads over many tasks; a source's thresholds then come from its rate, with as many steps as the rate asks for. A document that
is drawn very often is copied in two steps with a shuffle between, PIECE copies a row at most, so no task writes all of its copies.

Edge cases: a null source is a source; a null id hashes as the empty string; repeated rows have the same uniform and so the same number
of copies; null and empty texts weigh one character; an empty table gives an empty result; other columns are carried along, whatever
their names, except that `copy` and `shuffle_key` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import let, unused

FEW, SALTS, TABLE, PIECE = 1000, 64, 20_000, 1000


def uniform(key: Column) -> Column:
    """In [0, 1), from 52 bits of md5: other engines can compute the same."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def thresholds(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable, as far as a double tells them from 1."""
    upto = F.ceil(rate + F.sqrt(rate) * 12 + 30).cast("int")

    def step(state: Column, k: Column) -> Column:
        log = state["log"] + F.ln(rate / k)
        total = F.element_at(state["out"], -1) + F.exp(log)
        return F.struct(log.alias("log"), F.concat(state["out"], F.array(total)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), upto), F.struct((-rate).alias("log"), F.array(F.exp(-rate)).alias("out")), step)["out"]


def rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", targets: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """__source, __rate. Without targets a source's weight is its size to the power `temperature`; a source that targets lack has weight 0."""
    size = F.greatest(F.coalesce(F.char_length(F.col(f"`{text_col}`")), F.lit(0)), F.lit(1)).cast("double")
    sizes = docs.select(F.col(f"`{source_col}`").alias("__source"), size.alias("__size")).groupBy("__source").agg(F.sum("__size").alias("__size"))
    if targets is None:
        weight = F.pow("__size", F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, share in targets.items():
            weight = F.when(F.col("__source").eqNullSafe(F.lit(name)), F.lit(float(share))).otherwise(weight)
    weighted = sizes.withColumn("__weight", weight)
    totals = weighted.agg(F.sum("__weight").alias("__weights"), F.sum("__size").alias("__all"))  # one row
    rate = F.when(F.col("__weights") > 0, F.col("__weight") / F.col("__weights") * F.col("__all") * epochs / F.col("__size")).otherwise(0.0)
    return weighted.join(F.broadcast(totals)).select("__source", rate.alias("__rate"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", targets: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: str = "mix-1", few: int = FEW, keep: bool = False) -> DataFrame:
    """docs with each row as often as drawn, `copy` (from 1) and `shuffle_key`, in order of shuffle_key. keep: no columns are added, those of docs stay, whatever their names."""
    table = rates(docs, source_col, text_col, targets, temperature, epochs)
    known = table.limit(few + 1).collect()
    ids = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    u = uniform(F.concat(F.lit(seed + "|"), ids))
    base = docs if keep else docs.drop("copy", "shuffle_key")
    count = lambda rate: F.when(rate > 0, let(u, lambda x: F.size(F.filter(thresholds(rate), lambda c: c <= x)))).otherwise(0)
    size = sum(math.ceil(r["__rate"] + 12 * math.sqrt(r["__rate"]) + 30) for r in known if r["__rate"] > 0)
    taken = {c: unused(base, c) for c in ("u", "n", "salt", "source", "rate", "piece", "copy", "shuffle_key")}
    source = F.col(f"`{source_col}`")
    if len(known) <= few and size <= TABLE:
        drawn = F.lit(0)
        for r in known:
            if r["__rate"] > 0:
                cuts = poisson_thresholds(r["__rate"])
                drawn = F.when(source.eqNullSafe(F.lit(r["__source"])), F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(taken["u"])))).otherwise(drawn)
        counted = base.withColumn(taken["u"], u).withColumn(taken["n"], drawn).drop(taken["u"])
    else:
        salted = table.select(F.col("__source").alias(taken["source"]), F.col("__rate").alias(taken["rate"]), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(taken["salt"]))
        left = base.withColumn(taken["salt"], F.pmod(F.xxhash64(ids), F.lit(SALTS)).cast("int"))
        same = left[source_col].eqNullSafe(salted[taken["source"]]) & (left[taken["salt"]] == salted[taken["salt"]])
        counted = left.join(salted, same).drop(salted[taken["salt"]]).withColumn(taken["n"], count(F.col(taken["rate"]))).drop(taken["salt"], taken["source"], taken["rate"])
    n, piece = F.col(taken["n"]), F.col(taken["piece"])
    drawn_rows = counted.where(n > 0)
    if len(known) > few or any(r["__rate"] > PIECE / 4 for r in known):  # else no draw comes near PIECE
        pieces = drawn_rows.withColumn(taken["piece"], F.explode(F.sequence(F.lit(0), F.floor((n - 1) / PIECE).cast("int")))).repartition(F.xxhash64(ids, piece))
        steps = F.sequence(piece * PIECE + 1, F.least(n, (piece + 1) * PIECE))
        copies = pieces.withColumn(taken["copy"], F.explode(steps)).drop(taken["piece"], taken["n"])
    else:
        copies = drawn_rows.withColumn(taken["copy"], F.explode(F.sequence(F.lit(1), n))).drop(taken["n"])
    key = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "#"), ids, F.lit("#"), F.col(taken["copy"]).cast("string"))), 1, 15), 16, 10).cast("long")
    out = copies.withColumn(taken["shuffle_key"], key).orderBy(taken["shuffle_key"], F.col(f"`{id_col}`"), taken["copy"])
    return out.drop(taken["shuffle_key"], taken["copy"]) if keep else out


def poisson_thresholds(rate: float) -> list[float]:
    """As thresholds(), on the driver for one source; stops where the sum no longer changes."""
    log, out = -rate, [math.exp(-rate)]
    for k in range(1, math.ceil(rate + 12 * math.sqrt(rate) + 30) + 1):
        log += math.log(rate / k)
        if (total := out[-1] + math.exp(log)) == out[-1] and k > rate:
            break
        out.append(total)
    return out
