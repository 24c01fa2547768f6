"""Rows of a cohort: validation, splits, folds, trimming, bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.hashrand import uniform
from causeway.operators import quantiles


def load_dataset(spark: SparkSession, path: str, split: str | list[str] | None = None, split_column: str = "split") -> DataFrame:
    """Parquet or CSV by suffix; rows of one split, or of several together, if asked for."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix not in ("parquet", "csv"):
        raise ValueError(f"can't read {path}: parquet or csv expected")
    df = spark.read.parquet(path) if suffix == "parquet" else spark.read.csv(path, header=True, inferSchema=True)
    if split is None:
        return df
    if split_column not in df.columns:
        raise ValueError(f"no column {split_column}")
    return df.where(F.col(split_column).isin(split))


def null_counts(df: DataFrame, required: list[str]) -> DataFrame:
    """One row for each required column and its nulls, from one pass; raises where a column is missing."""
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in required])).alias("x")).select("x.*")


def validate(df: DataFrame, text: str, treatment: str, outcome: str) -> DataFrame:
    bad = [r["column"] for r in null_counts(df, [text, treatment, outcome]).where("nulls > 0").collect()]
    if bad:
        raise ValueError(f"null values in {', '.join(bad)}")
    return df


def folds(df: DataFrame, key: str, k: int, seed: int = 42, strata: list[str] | None = None) -> DataFrame:
    """cv_fold from 1 to k: rows in order of a hash, dealt in equal runs over the table, or in turn within each stratum.

    With strata, if there is one only or the smallest has fewer than k rows, the table is dealt as without; fewer rows than k raise. The order
    comes from counts by range of the hash and offsets, so no task sees a whole table or stratum.
    """
    n = quantiles.parts(df)
    hashed = df.withColumn("__u", uniform(F.lit(seed), F.col(key))).withColumn("__b", F.floor(F.col("__u") * n).cast("int"))
    order = [F.col("__u"), F.col(key)]
    sizes = df.groupBy(*(strata or [])).agg(F.count("*").alias("n")).agg(F.sum("n"), F.min("n"), F.count("*")).first()
    if (sizes[0] or 0) and sizes[0] < k:
        raise ValueError(f"{sizes[0]} rows can't make {k} folds")
    if strata and (sizes[2] or 0) > 1 and sizes[1] >= k:
        ranked = quantiles.row_numbers(hashed, "__b", order, strata)
        return ranked.withColumn("cv_fold", (F.pmod(F.col("__rn") - 1, F.lit(k)) + 1).cast("int")).drop("__u", "__b", "__rn", "__n")
    ranked = quantiles.row_numbers(hashed, "__b", order)
    return ranked.withColumn("cv_fold", (F.expr(f"(__rn - 1) * {k} div __n") + 1).cast("int")).drop("__u", "__b", "__rn", "__n")


def nested_folds(df: DataFrame, key: str, outer: int, inner: int, seed: int = 42, turn: int = 0, strata: list[str] | None = None) -> DataFrame:
    """A row for each row of df and each outer fold (outer_fold) in whose training part it is, with its inner_fold there, drawn within that part alone with seed + 1000 * outer_fold + turn."""
    dealt = folds(df, key, outer, seed, strata)
    out = None
    for f in range(1, outer + 1):
        part = folds(dealt.where(F.col("cv_fold") != f).drop("cv_fold"), key, inner, seed + 1000 * f + turn, strata).withColumnRenamed("cv_fold", "inner_fold").withColumn("outer_fold", F.lit(f))
        out = part if out is None else out.unionByName(part)
    return out


def out_of_fold(df: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """df with the columns that the folds' parts hold beside the key; raises if a row has no prediction or more than one."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    n, filled = df.count(), whole.agg(F.count("*"), F.countDistinct(key)).first()
    if n != filled[0] or n != filled[1]:
        raise ValueError(f"{filled[1]} of {n} rows have a prediction, in {filled[0]} rows")
    return df.join(whole, key)


def trim_by_propensity(df: DataFrame, low: float, high: float, propensity: str) -> DataFrame:
    return df.where(F.col(propensity).between(low, high))


def trimming_report(df: DataFrame, low: float, high: float, propensity: str) -> DataFrame:
    """Counts and spreads; the spread before is over the population and the one after over a sample."""
    e, kept = F.col(propensity), F.col(propensity).between(low, high)
    return df.agg(F.count("*").alias("n"), F.count_if(kept).alias("n_kept"), F.count_if(e < low).alias("n_low"), F.count_if(e > high).alias("n_high"), F.avg(e).alias("mean_before"), F.stddev_pop(e).alias("std_before"), F.avg(F.when(kept, e)).alias("mean_after"), F.stddev_samp(F.when(kept, e)).alias("std_after"))


def overlap_filter(df: DataFrame, low: float, high: float, propensity: str) -> DataFrame:
    """Finite propensities in [low, high]; all finite ones if none is there; an error if none is finite."""
    finite = df.where(F.col(propensity).isNotNull() & ~F.isnan(propensity) & (F.abs(propensity) < float("inf")))
    n, inside = finite.agg(F.count("*"), F.count_if(F.col(propensity).between(low, high))).first()
    if not n:
        raise ValueError("no finite propensity")
    return trim_by_propensity(finite, low, high, propensity) if inside else finite


def propensity_bins(df: DataFrame, key: str, treatment: str, propensity: str, n_bins: int, least: int = 1) -> DataFrame:
    """bin: equal runs in the order of propensity and key; -1 where an arm has fewer than `least` rows in the bin."""
    ranked = quantiles.row_numbers(quantiles.ranged(df, propensity, "__b"), "__b", [F.col(propensity), F.col(key)])
    binned = ranked.withColumn("bin", F.expr(f"cast((__rn - 1) * {n_bins} div __n as int)")).drop("__b", "__rn", "__n")
    arms = binned.groupBy("bin").agg(F.count_if(F.col(treatment) == 1).alias("__t"), F.count_if(F.col(treatment) == 0).alias("__c"))
    ok = F.when((F.col("__t") >= least) & (F.col("__c") >= least), F.col("bin")).otherwise(-1)
    return binned.join(F.broadcast(arms), "bin").withColumn("bin", ok).drop("__t", "__c")
