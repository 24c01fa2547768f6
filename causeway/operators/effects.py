"""Effect estimates, balance and tests over treated and control rows, each one or two aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import tails
from causeway.functions.hashrand import poisson_weights
from causeway.functions.scalar import clever_covariate
from causeway.functions.workers import by_value
from causeway.operators.quantiles import quantiles

by_value(__name__)


def _arm(t: str, value: int, x: Column) -> Column:
    return F.when(F.col(t) == value, x)


def smd(mean1: Column, mean0: Column, var1: Column, var0: Column) -> Column:
    pooled = F.sqrt((F.coalesce(var1, F.lit(0.0)) + F.coalesce(var0, F.lit(0.0))) / 2)
    return F.when(pooled < 1e-10, 0.0).otherwise(F.abs(mean1 - mean0) / pooled)


def balance(df: DataFrame, treatment: str, covariates: list[str]) -> DataFrame:
    """covariate, mean_treated, mean_control, smd: one pass over all covariates."""
    aggs = [f(_arm(treatment, a, F.col(c).cast("double"))).alias(f"{c}__{n}{a}") for c in covariates for a in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp))]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("covariate"), F.col(f"{c}__m1").alias("mean_treated"), F.col(f"{c}__m0").alias("mean_control"), smd(*[F.col(f"{c}__{x}") for x in ("m1", "m0", "v1", "v0")]).alias("smd")) for c in covariates]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def balance_change(df: DataFrame, pairs: DataFrame, key: str, treatment: str, covariates: list[str]) -> DataFrame:
    """balance() before matching and on the matched rows, which repeat as often as they are matched."""
    matched = pairs.select(F.explode(F.array(F.struct(F.col("treated_id").alias(key)), F.struct(F.col("control_id").alias(key)))).alias("x")).select("x.*").join(df, key)
    before, after = balance(df, treatment, covariates), balance(matched, treatment, covariates)
    out = before.select("covariate", F.col("smd").alias("smd_before")).join(after.select("covariate", F.col("smd").alias("smd_after")), "covariate")
    return out.withColumn("smd_reduction", F.when(F.col("smd_before") == 0, 0.0).otherwise((F.col("smd_before") - F.col("smd_after")) / F.col("smd_before")))


def overlap(df: DataFrame, treatment: str, propensity: str, bins: int = 50) -> DataFrame:
    """Common support, shares of each arm inside, overlap of the arms' histograms on [0, 1] (the last bin closed), means and spreads (population)."""
    e = F.col(propensity)
    of = lambda a, x=e: _arm(treatment, a, x)
    edges = df.agg(*[f(of(a)).alias(f"{n}{a}") for a in (0, 1) for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg), ("std", F.stddev_pop), ("n", F.count))])
    low, high = F.greatest("lo0", "lo1"), F.least("hi0", "hi1")
    edges = edges.select("*", low.alias("low"), high.alias("high"))
    inside = df.join(F.broadcast(edges.select("low", "high"))).agg(*[F.avg(of(a, e.between(F.col("low"), F.col("high")).cast("double"))).alias(f"inside{a}") for a in (0, 1)])
    hist = df.where(e.between(0, 1)).groupBy(F.least(F.floor(e * bins), F.lit(bins - 1)).alias("bin")).agg(*[F.count(of(a)).alias(f"c{a}") for a in (0, 1)])
    sums = hist.agg(F.sum("c0").alias("s0"), F.sum("c1").alias("s1"))
    common = hist.join(F.broadcast(sums)).agg(F.sum(F.least(F.try_divide("c0", "s0"), F.try_divide("c1", "s1"))).alias("overlap"))
    return edges.join(F.broadcast(inside)).join(F.broadcast(common)).select("low", "high", F.col("inside1").alias("treated_inside"), F.col("inside0").alias("control_inside"), "overlap", F.col("mean1").alias("mean_treated"), F.col("mean0").alias("mean_control"), F.col("std1").alias("std_treated"), F.col("std0").alias("std_control"))


def winsorized(df: DataFrame, propensity: str, q: float) -> DataFrame:
    """The propensity clipped to its exact q and 1 - q quantiles (linear), as `e`."""
    cuts = quantiles(df, propensity, [q, 1 - q]).withColumnRenamed("q", "__q")
    return df.join(F.broadcast(cuts)).withColumn("e", F.greatest(F.least(F.col(propensity), F.col("__q")[1]), F.col("__q")[0])).drop("__q")  # one row


def hajek(t: Column, y: Column, e: Column, w: Column | None = None) -> Column:
    """Normalised inverse probability weighting, as an aggregate."""
    w = F.lit(1.0) if w is None else w
    return F.try_divide(F.sum(w * t * y / e), F.sum(w * t / e)) - F.try_divide(F.sum(w * (1 - t) * y / (1 - e)), F.sum(w * (1 - t) / (1 - e)))


def ate_ipw(df: DataFrame, treatment: str, outcome: str, propensity: str, q: float = 0.01) -> DataFrame:
    t, y = F.col(treatment).cast("double"), F.col(outcome).cast("double")
    return winsorized(df, propensity, q).agg(hajek(t, y, F.col("e")).alias("ate"), F.count_if(t == 1).alias("n_treated"), F.count_if(t == 0).alias("n_control"))


DRAWS = 1000


def drawn_sums(df: DataFrame, key: Column, terms: list[Column], draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """draw (from 1) and s, the sums of the terms over a Poisson bootstrap sample (an approximation of the multinomial one).

    A row's weight in a draw comes from a hash of its key (long) and the draw, so retries agree. No row is multiplied: each task adds up its
    rows' weighted terms for all draws in NumPy and gives one row a draw.
    """
    width = len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((draws, width))
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            x = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(width)], 1)
            for at in range(0, len(keys), 512):
                total += poisson_weights(keys[at : at + 512], draws, seed).T @ x[at : at + 512]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, draws + 1, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["draw", "s"])

    rows = df.select(F.coalesce(key.cast("long"), F.lit(-1)), *[F.coalesce(t.cast("double"), F.lit(0.0)) for t in terms])
    named = rows.toDF("k", *[f"t{i}" for i in range(width)]).mapInArrow(run, "draw int, s array<double>")
    return named.groupBy("draw").agg(F.array(*[F.sum(F.get("s", i)) for i in range(width)]).alias("s"))


def interval(draws: DataFrame, statistic: Column, level: float = 0.95) -> DataFrame:
    """se (sample), and lower and upper percentiles, of a statistic of the draws' sums `s`; a draw without it is left out."""
    tail = (1 - level) / 2
    each = draws.select(statistic.alias("x")).where("x is not null")  # a row for each draw
    return each.agg(F.stddev_samp("x").alias("se"), F.percentile("x", F.lit(tail)).alias("lower"), F.percentile("x", F.lit(1 - tail)).alias("upper"))


def _ratio(a: int, b: int) -> Column:
    return F.try_divide(F.get("s", a), F.get("s", b))


def bootstrap_ipw(df: DataFrame, key: str, treatment: str, outcome: str, propensity: str, draws: int = DRAWS, q: float = 0.01, level: float = 0.95) -> DataFrame:
    """se, lower and upper of ate_ipw(); the quantiles that clip stay those of all rows."""
    t, y, e = F.col(treatment).cast("double"), F.col(outcome).cast("double"), F.col("e")
    terms = [t * y / e, t / e, (1 - t) * y / (1 - e), (1 - t) / (1 - e)]
    return interval(drawn_sums(winsorized(df, propensity, q), F.col(key), terms, draws), _ratio(0, 1) - _ratio(2, 3), level)


def bootstrap_stratified(df: DataFrame, key: str, treatment: str, outcome: str, propensity: str, k: int = 5, draws: int = DRAWS, level: float = 0.95) -> DataFrame:
    """se, lower and upper of ate_stratified(); the strata stay those of all rows."""
    y = F.col(outcome).cast("double")
    cell = lambda s, a: (F.col("stratum") == s) & (F.col(treatment) == a)
    terms = [F.when(cell(s, a), x).otherwise(0.0) for s in range(k) for a in (1, 0) for x in (F.lit(1.0), y)]
    g = lambda s, a, x: F.get("s", 4 * s + 2 * (1 - a) + x)
    both = lambda s: (g(s, 1, 0) > 0) & (g(s, 0, 0) > 0)
    n = lambda s: F.when(both(s), g(s, 1, 0) + g(s, 0, 0)).otherwise(0.0)
    difference = lambda s: F.when(both(s), F.try_divide(g(s, 1, 1), g(s, 1, 0)) - F.try_divide(g(s, 0, 1), g(s, 0, 0))).otherwise(0.0)
    top, bottom = sum((n(s) * difference(s) for s in range(1, k)), n(0) * difference(0)), sum((n(s) for s in range(1, k)), n(0))
    return interval(drawn_sums(strata_of(df, propensity, k), F.col(key), terms, draws), F.try_divide(top, bottom), level)


def bootstrap_matched(outcomes: DataFrame, draws: int = DRAWS, level: float = 0.95) -> DataFrame:
    """se, lower and upper of the mean pair difference, over pairs."""
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    pair = number("treated_id").bitwiseXOR(F.shiftleft(number("control_id"), 31))
    return interval(drawn_sums(outcomes, pair, [F.lit(1.0), F.col("y1") - F.col("y0")], draws), _ratio(1, 0), level)


def strata_of(df: DataFrame, propensity: str, k: int) -> DataFrame:
    """stratum: which of k runs between exact quantiles a row's propensity is in; closed below, the last closed above."""
    cuts = quantiles(df, propensity, [i / k for i in range(1, k)]).withColumnRenamed("q", "__q")
    return df.join(F.broadcast(cuts)).withColumn("stratum", F.size(F.filter("__q", lambda c: c <= F.col(propensity)))).drop("__q")  # one row


def ate_stratified(df: DataFrame, treatment: str, outcome: str, propensity: str, k: int = 5) -> DataFrame:
    """Strata without both arms weigh 0, others their size."""
    y = F.col(outcome).cast("double")
    each = strata_of(df, propensity, k).groupBy("stratum").agg(F.avg(_arm(treatment, 1, y)).alias("m1"), F.avg(_arm(treatment, 0, y)).alias("m0"), F.count("*").alias("n")).where("m1 is not null and m0 is not null")
    return each.agg(F.try_divide(F.sum(F.col("n") * (F.col("m1") - F.col("m0"))), F.sum("n")).alias("ate"), F.count("*").alias("n_strata"), F.sum("n").alias("n_used"))


def crude(df: DataFrame, treatment: str, outcome: str) -> DataFrame:
    y = F.col(outcome).cast("double")
    return df.agg(F.avg(_arm(treatment, 1, y)).alias("mean_treated"), F.avg(_arm(treatment, 0, y)).alias("mean_control"), (F.avg(_arm(treatment, 1, y)) - F.avg(_arm(treatment, 0, y))).alias("difference"), F.count(_arm(treatment, 1, y)).alias("n_treated"), F.count(_arm(treatment, 0, y)).alias("n_control"))


def pair_outcomes(pairs: DataFrame, df: DataFrame, key: str, outcome: str) -> DataFrame:
    """treated_id, control_id, y1, y0."""
    y = lambda side, name: df.select(F.col(key).alias(side), F.col(outcome).cast("double").alias(name))
    return pairs.select("treated_id", "control_id").join(y("treated_id", "y1"), "treated_id").join(y("control_id", "y0"), "control_id")


def att_matched(outcomes: DataFrame) -> DataFrame:
    """Mean pair difference, its t statistic, and distinct units on either side."""
    d = F.col("y1") - F.col("y0")
    return outcomes.agg(F.avg(d).alias("att"), F.count("*").alias("n_pairs"), (F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count("*").cast("double")) + 1e-10)).alias("t_statistic"), F.countDistinct("treated_id").alias("n_treated"), F.countDistinct("control_id").alias("n_control"))


def mcnemar(outcomes: DataFrame) -> DataFrame:
    """Discordant pairs, the statistic (none 0, under 25 without and else with continuity correction), and p, exact under 25 pairs and then not capped at 1."""
    one = outcomes.agg(F.count_if((F.col("y1") == 1) & (F.col("y0") == 0)).alias("b"), F.count_if((F.col("y1") == 0) & (F.col("y0") == 1)).alias("c"))
    n, d = (F.col("b") + F.col("c")).cast("double"), F.abs(F.col("b") - F.col("c")).cast("double")
    out = one.withColumn("statistic", F.when(n == 0, 0.0).when(n < 25, d * d / n).otherwise((d - 1) * (d - 1) / n))
    return out.withColumn("p", tails.mcnemar_p_column(F.col("b"), F.col("c")))


def paired_t(outcomes: DataFrame) -> DataFrame:
    """mean, t and the two-sided p with n - 1 degrees of freedom."""
    d = F.col("y1") - F.col("y0")
    one = outcomes.agg(F.avg(d).alias("mean"), (F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count("*").cast("double")) + 1e-10)).alias("t"), F.count("*").alias("n"))
    return one.withColumn("p", tails.t_two_sided_column(F.col("t"), (F.col("n") - 1).cast("double")))


def rosenbaum(outcomes: DataFrame) -> DataFrame:
    """gamma, p_plus, p_minus of the sign test on pairs, from two counts."""
    n = outcomes.agg(F.count_if(F.col("y1") > F.col("y0")).alias("up"), F.count_if(F.col("y1") < F.col("y0")).alias("down"))
    grid = F.explode(F.array(*[F.lit(g) for g in tails.GAMMAS]))
    return n.select("*", grid.alias("gamma")).select("gamma", *[tails.rosenbaum_column(F.col("up"), F.col("down"), F.col("gamma"), side).alias(f"p_{side}") for side in ("plus", "minus")])


def overlap_weights(e: Column) -> Column:
    """e (1 - e), at least 1e-4, before it is divided by its mean."""
    return F.greatest(e * (1 - e), F.lit(1e-4))


def with_overlap_weights(df: DataFrame, propensity: str, out: str = "weight") -> DataFrame:
    """df with overlap weights whose mean is 1."""
    w = overlap_weights(F.col(propensity))
    return df.join(F.broadcast(df.agg(F.avg(w).alias("__w")))).withColumn(out, w / F.col("__w")).drop("__w")  # one row


def targeted_moment(y: Column, t: Column, e: Column, factual: Column) -> Column:
    """The squared mean of residual times clever covariate, as an aggregate."""
    m = F.avg((y - factual) * clever_covariate(t, e))
    return m * m
