"""Order statistics without a task that sees the whole table: row numbers, cumulative counts and exact quantiles by ranges.

A column's approximate percentiles cut it into as many ranges as the session has reduce partitions. Counts by range give each range's offset,
so what is ordered in one task is one range. One row of cuts and a row for each range are all that is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parts(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ranged(df: DataFrame, value: str, out: str, weight: str | None = None) -> DataFrame:
    """df with `out`, the number of the row's range of value; null values are in the first."""
    n = parts(df)
    cuts = df.agg(F.percentile_approx(F.col(value).cast("double"), [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("__q"))
    step = max(1, int(n**0.5))
    v = F.col(value).cast("double")
    below = lambda some: F.size(F.filter(some, lambda c: c <= v))
    runs = F.filter("__q", lambda _, i: i % step == 0)  # each run's first cut, so a row meets two runs' worth of cuts and not all
    one = df.join(F.broadcast(cuts.withColumn("__runs", runs)))
    run = F.greatest(below(F.col("__runs")) - 1, F.lit(0))
    return one.withColumn("__run", run).withColumn(out, F.coalesce(F.col("__run") * step + below(F.slice("__q", F.col("__run") * step + 1, F.lit(step))), F.lit(0))).drop("__q", "__runs", "__run")


def row_numbers(df: DataFrame, bucket: str, order: list[Column], within: list[str] | None = None) -> DataFrame:
    """df with __rn, from 1 in the order of (bucket, order), and __n, how many there are, for the table or within each group. bucket must not decrease along the order."""
    groups = within or []
    sizes = df.groupBy(*groups, bucket).agg(F.count("*").alias("__c"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # a row for each group and range
    whole = Window.partitionBy(*groups)
    offsets = sizes.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col(bucket).alias("__range"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"), F.sum("__c").over(whole).alias("__n"))
    local = F.row_number().over(Window.partitionBy(*groups, bucket).orderBy(*order))
    same = F.col(bucket).eqNullSafe(F.col("__range"))
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = df.withColumn("__local", local).join(offsets, same)
    return out.withColumn("__rn", F.col("__before") + F.col("__local")).drop("__local", "__before", "__range", *[f"__g{i}" for i in range(len(groups))])


def cumulative(counts: DataFrame, value: str, columns: list[str]) -> DataFrame:
    """For each distinct value the sums of columns over smaller ones, as <column>_below."""
    cut = ranged(counts, value, "__r")
    sums = cut.groupBy("__r").agg(*[F.sum(c).alias(f"__s_{c}") for c in columns])
    over = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = sums.select("__r", *[F.coalesce(F.sum(f"__s_{c}").over(over), F.lit(0)).alias(f"__p_{c}") for c in columns])
    local = Window.partitionBy("__r").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rest = [c for c in counts.columns if c != value]
    return cut.join(F.broadcast(before), "__r").select(value, *rest, *[(F.col(f"__p_{c}") + F.coalesce(F.sum(c).over(local), F.lit(0))).alias(f"{c}_below") for c in columns])


def quantiles(df: DataFrame, value: str, qs: list[float]) -> DataFrame:
    """One row: q, the exact quantiles (linear between neighbours) of the values that aren't null; null elements without any."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    ranks = cumulative(counts, "v", ["c"]).join(F.broadcast(total))  # one row
    at = lambda rank: F.max(F.when((F.col("c_below") <= rank) & (rank < F.col("c_below") + F.col("c")), F.col("v")))
    aggs = []
    for i, q in enumerate(qs):
        h = F.lit(float(q)) * (F.col("n") - 1)
        aggs += [at(F.floor(h)).alias(f"lo{i}"), at(F.ceil(h)).alias(f"hi{i}"), F.max(h - F.floor(h)).alias(f"w{i}")]
    one = ranks.agg(*aggs)
    return one.select(F.array(*[F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"w{i}") for i in range(len(qs))]).alias("q"))
