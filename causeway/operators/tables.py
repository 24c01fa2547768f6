"""Shapes of feature tables: lookups, interactions, discovery of columns, long and wide forms, padding, soft assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.hashrand import uniform
from causeway.operators import quantiles

UNKNOWN, PADDING = 1, 0


def token_ids(docs: DataFrame, key: str, tokens: str, vocabulary: DataFrame, most: int | None = None) -> DataFrame:
    """key, ids: each token's id in its order, 1 for unknown ones, cut before the lookup. A join, so the vocabulary may be of any size."""
    cut = F.slice(tokens, 1, most) if most else F.col(tokens)
    long = docs.select(key, F.posexplode(cut).alias("pos", "token")).join(vocabulary.select("token", "token_id"), "token", "left")
    out = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("token_id", F.lit(UNKNOWN)).alias("id")))).alias("x")).select(key, F.transform("x", lambda x: x["id"]).alias("ids"))
    return docs.select(key).join(out, key, "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))


def padded(ids: Column, length: int, pad: int = PADDING) -> tuple[Column, Column]:
    """ids cut or filled to length, and 1 where they are real."""
    n = F.least(F.size(ids), F.lit(length))
    fill = lambda x: F.array_repeat(F.lit(x), F.lit(length) - n)
    return F.concat(F.slice(ids, 1, length), fill(pad)), F.concat(F.array_repeat(F.lit(1), n), fill(0))


def byte_ids(text: Column, most: int) -> Column:
    """UTF-8 bytes plus 1, 0 being for padding."""
    digits = F.hex(F.substring(F.encode(text, "UTF-8"), 1, most))
    each = F.regexp_extract_all(digits, F.lit(".."), F.lit(0))  # one pass; a lambda would encode the text again for each byte
    return F.transform(each, lambda x: F.conv(x, 16, 10).cast("int") + 1)


def normalized_category(value: Column, categories: list[str]) -> Column:
    """The declared category that equals value after trimming, in any case, with - and blanks as _; null without one."""
    norm = lambda x: F.regexp_replace(F.lower(F.trim(x)), "[ -]", "_")
    out = F.lit(None).cast("string")
    for c in reversed(categories):
        out = F.when(norm(value) == norm(F.lit(c)), F.lit(c)).otherwise(out)
    return out


def interactions(columns: list[str]) -> list[Column]:
    """Products of each two columns, named a_x_b."""
    return [(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"{a}_x_{b}") for i, a in enumerate(columns) for b in columns[i + 1 :]]


def discovered(df: DataFrame, prefix: str, share: float = 0.5) -> DataFrame:
    """column, numeric: string columns with the prefix, numeric if at least `share` of the non-null values parse."""
    found = [c for c in df.columns if c.startswith(prefix)]
    one = df.agg(*[F.coalesce(F.try_divide(F.count(F.col(c).cast("string").try_cast("double")), F.count(c)), F.lit(0.0)).alias(c) for c in found])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (F.col(c) >= share).alias("numeric")) for c in found])).alias("x")).select("x.*")


def coalesced_features(df: DataFrame, names: list[str], prefixes: tuple[str, ...] = ("explicit_feat_", "explicit_conf_", "llm_extracted_")) -> DataFrame:
    """For each name the first prefix's column that exists becomes the first prefix's, with its missing flag or one inferred from nulls."""
    new = {}
    for n in names:
        source = next((p for p in prefixes if p + n in df.columns), None)
        if source is None:
            raise ValueError(f"no column for {n}")
        new[prefixes[0] + n] = F.col(source + n)
        new[f"{prefixes[0]}{n}_missing"] = F.col(f"{source}{n}_missing") if f"{source}{n}_missing" in df.columns else F.col(source + n).isNull()
    return df.withColumns(new)


def long_features(df: DataFrame, key: str, names: list[str], prefix: str = "explicit_feat_") -> DataFrame:
    """key, name, value, missing: a row for each feature."""
    rows = [F.struct(F.lit(n).alias("name"), F.col(prefix + n).cast("string").alias("value"), F.coalesce(F.col(f"{prefix}{n}_missing") if f"{prefix}{n}_missing" in df.columns else F.col(prefix + n).isNull(), F.lit(False)).alias("missing")) for n in names]
    return df.select(key, F.explode(F.array(*rows)).alias("x")).select(key, "x.*")


def continuous_stats(df: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
    """feature, mean, std: of what can be read as a finite number and whose <column>_missing, where there is one, isn't true. std over a sample, 1e-6 at least; 0 and 1 without any number."""
    aggs = []
    for c in columns:
        own = f"{prefix}{c}"
        x = F.expr(f"try_cast(`{own}` AS double)")
        seen = ~F.coalesce(F.col(f"`{own}_missing`").cast("boolean"), F.lit(False)) if f"{own}_missing" in df.columns else F.lit(True)
        x = F.when(seen & ~F.isnan(x) & (F.abs(x) < float("inf")), x)
        aggs.append(F.struct(F.lit(c).alias("feature"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.when(F.count(x) == 0, 1.0).otherwise(F.greatest(F.coalesce(F.stddev_samp(x), F.lit(1e-6)), F.lit(1e-6))).alias("std")))
    return df.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def category_shares(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """category, share over the declared categories; equal shares if none occurs."""
    counts = df.agg(*[F.count_if(F.col(column) == c).alias(f"c{i}") for i, c in enumerate(categories)])
    total = sum((F.col(f"c{i}") for i in range(1, len(categories))), F.col("c0"))
    share = lambda i: F.when(total == 0, 1.0 / len(categories)).otherwise(F.col(f"c{i}") / F.nullif(total, F.lit(0)))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("category"), share(i).alias("share")) for i, c in enumerate(categories)])).alias("x")).select("x.*")


def soft_assignment(distances: DataFrame, key: str, slot: str, distance: str, top: int = 4, temperature: float = 1.0) -> DataFrame:
    """key, slot, weight: softmax of -d^2 / temperature over the nearest `top` slots, ties by slot."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(distance, slot))
    score = -F.col(distance) * F.col(distance) / temperature
    near = distances.withColumn("__r", rank).where(F.col("__r") <= top).withColumn("__s", score)
    w = Window.partitionBy(key)
    return near.withColumn("__e", F.exp(F.col("__s") - F.max("__s").over(w))).withColumn("weight", F.col("__e") / F.sum("__e").over(w)).select(key, slot, "weight")


def perturbed(text: Column, alternatives: dict[str, list[str]], key: Column, seed: int = 1) -> Column:
    """Each name in the text gives way, everywhere and in any case, to one of its alternatives by hash; later names may change earlier replacements."""
    import re

    out = text
    for name, others in alternatives.items():
        pick = F.get(F.array(*[F.lit(o) for o in others]), F.floor(uniform(F.lit(seed), F.lit(name), key) * len(others)).cast("int"))
        out = F.regexp_replace(out, F.lit(rf"(?i)\b{re.escape(name)}\b"), pick)
    return out


def tolerant_json(text: Column, schema: str) -> Column:
    """The whole text, a fenced block, or what stands between the outermost braces, as a struct; the first that parses."""
    tries = (text, F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.regexp_extract(text, r"(?s)\{.*\}", 0))
    good = [F.when(F.try_parse_json(t).isNotNull() & F.trim(t).startswith("{"), F.from_json(t, schema)) for t in tries]
    return F.coalesce(*good)


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def balanced_batches(df: DataFrame, key: str, bin_col: str, treatment: str, size: int, epoch: int = 0, seed: int = 3) -> DataFrame:
    """key, bin, batch: batches of size / 2 rows of either arm within a bin, in an order that a hash of the epoch gives; the shorter arm repeats to fill."""
    half, n = size // 2, quantiles.parts(df)
    hashed = df.where(F.col(bin_col) >= 0).select(key, bin_col, treatment, uniform(F.lit(seed), F.lit(epoch), F.col(key)).alias("__u")).withColumn("__b", F.floor(F.col("__u") * n).cast("int"))
    ranked = quantiles.row_numbers(hashed, "__b", [F.col("__u"), F.col(key)], [bin_col, treatment]).select(key, bin_col, treatment, (F.col("__rn") - 1).alias("__i"))
    sizes = ranked.groupBy(bin_col).agg(F.count_if(F.col(treatment) == 1).alias("__a"), F.count_if(F.col(treatment) == 0).alias("__b")).where("__a > 0 AND __b > 0").withColumn("__m", F.ceil(F.greatest("__a", "__b") / half).cast("int"))
    both = ranked.join(F.broadcast(sizes), bin_col).withColumn("__n", F.when(F.col(treatment) == 1, F.col("__a")).otherwise(F.col("__b")))  # a row for each bin
    turns = F.sequence(F.lit(0), F.floor((F.col("__m") * half - 1 - F.col("__i")) / F.col("__n")).cast("int"))
    each = both.withColumn("__k", F.explode(turns)).withColumn("batch", F.floor((F.col("__i") + F.col("__k") * F.col("__n")) / half).cast("int"))
    return each.select(key, F.col(bin_col).alias("bin"), "batch", treatment)


def chunk_grid(chunks: Column, length: int, count: int, pad: int = PADDING) -> tuple[Column, Column, Column]:
    """(ids, token_mask, chunk_mask) of one row's chunks: count by length ids, missing ones padded, with masks of real tokens and of real chunks."""
    n = F.least(F.size(chunks), F.lit(count))
    blank = lambda x: F.array_repeat(F.array_repeat(F.lit(x), length), F.lit(count) - n)
    cut = F.slice(chunks, 1, count)
    ids = F.concat(F.transform(cut, lambda c: padded(c, length, pad)[0]), blank(pad))
    mask = F.concat(F.transform(cut, lambda c: padded(c, length, pad)[1]), blank(0))
    return ids, mask, F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(count) - n))


def attention_pooled(df: DataFrame, key: str, position: str, vector: str, score: Column) -> DataFrame:
    """key, pooled: each key's vectors weighted by the softmax of score over them, null scores left out. Sums by element, so a key may have any number of vectors."""
    rows = df.withColumn("__s", score.cast("double")).where("__s is not null")
    top = rows.groupBy(key).agg(F.max("__s").alias("__top"))
    each = rows.join(top, key).withColumn("__w", F.exp(F.col("__s") - F.col("__top"))).select(key, "__w", F.posexplode(vector).alias("dim", "x"))
    sums = each.groupBy(key, "dim").agg((F.sum(F.col("__w") * F.col("x")) / F.sum("__w")).alias("v"))
    return sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda p: p["v"]).alias("pooled"))


def ordered(df: DataFrame, row_id: str) -> DataFrame:
    """The table in the order that rows were read, by the id they got then."""
    return df.orderBy(row_id)


def joined_by_row(a: DataFrame, b: DataFrame, row_id: str) -> DataFrame:
    """Columns side by side by row id; raises where one side lacks a row, which a join by position would hide."""
    out = a.join(b, row_id)
    if (n := a.count()) != b.count() or n != out.count():
        raise ValueError("both tables must have the same rows")
    return out


def stacked(*vectors: Column | None) -> Column:
    """Feature vectors end to end; absent and null ones are skipped."""
    empty = F.array().cast("array<double>")
    return F.concat(empty, *[F.coalesce(v.cast("array<double>"), empty) for v in vectors if v is not None])
