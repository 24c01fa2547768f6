"""Metrics of predictions. Ranks come from counts by distinct value, so ties are averaged and no window orders the whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import tails
from causeway.operators.quantiles import cumulative

def auroc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Share of positive and negative pairs in order, ties half; null with one class only."""
    counts = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("v")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    out = cumulative(counts, "v", ["p", "n"]).agg(F.sum(F.col("p") * (F.col("n_below") + F.col("n") / 2.0)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return out.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / F.col("p") / F.col("n")).alias("auroc"), F.col("p").alias("n_positive"), F.col("n").alias("n_negative"))


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    counts = df.groupBy(F.col(value)).agg(F.count("*").alias("c"))
    ranks = cumulative(counts, value, ["c"]).select(value, (F.col("c_below") + (F.col("c") + 1) / 2.0).alias(out))
    return df.join(ranks, value)


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson over rows that have both, as an aggregate; null where either side is constant or there are fewer than two such rows."""
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count(F.when(a.isNotNull() & b.isNotNull(), 1)) >= 2) & (spread > 0), F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0)))


def effect_metrics(df: DataFrame, pred: str, true: str, lower: str, upper: str) -> DataFrame:
    p, t = F.col(pred), F.col(true)
    return df.agg(F.avg((p - t) * (p - t)).alias("mse"), F.avg(F.abs(p - t)).alias("mae"), safe_corr(p, t).alias("corr"), F.abs(F.avg(p) - F.avg(t)).alias("ate_bias"), F.avg(t.between(F.col(lower), F.col(upper)).cast("double")).alias("coverage"), F.avg(F.col(upper) - F.col(lower)).alias("width"))


def rank_corr(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: spearman, Pearson's correlation of average ranks; null where either side is constant."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("__a"), F.col(b).alias("__b"))
    ranks = average_ranks(average_ranks(both, "__a", "__ra"), "__b", "__rb")
    return ranks.agg(safe_corr(F.col("__ra"), F.col("__rb")).alias("spearman"))


def all_effect_metrics(df: DataFrame, pred: str, true: str, lower: str, upper: str, propensity: str, treatment: str, y0: str, y1: str, true_y0: str, true_y1: str) -> DataFrame:
    """One row: effect_metrics(), both mean effects, spearman, the propensity's AUROC, and the squared errors of both arms' means."""
    error = lambda p, t: F.avg((F.col(p) - F.col(t)) * (F.col(p) - F.col(t)))
    rest = df.agg(F.avg(pred).alias("ate_pred"), F.avg(true).alias("ate_true"), error(y0, true_y0).alias("y0_mse"), error(y1, true_y1).alias("y1_mse"), F.sqrt(error(pred, true)).alias("pehe"))
    out = effect_metrics(df, pred, true, lower, upper)
    for one in (rest, rank_corr(df, pred, true), auroc(df, treatment, propensity).select(F.col("auroc").alias("propensity_auroc"))):
        out = out.join(F.broadcast(one))  # one row each
    return out


def r_loss(y: Column, t: Column, m: Column, e: Column, tau: Column) -> Column:
    d = y - m - tau * (t - e)
    return F.avg(d * d)


def group_summary(df: DataFrame, groups: list[str], metrics: list[str]) -> DataFrame:
    """count, mean, std, min and max of each metric for each group, null keys included; four digits, half to even."""
    aggs = [F.bround(f(F.col(m)), 4).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    return df.groupBy(*groups).agg(F.count("*").alias("n"), *aggs)


def welch(df: DataFrame, group: str, metric: str) -> DataFrame:
    """t, degrees of freedom, two-sided p and stars (at 0.05, 0.01 and 0.001) for each unordered pair of groups with two rows or more each.

    Groups are configurations, a short list: pairs grow with its square.
    """
    g = df.where(F.col(metric).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.avg(metric).alias("m"), F.var_samp(metric).alias("v"), F.count("*").alias("n")).where("n >= 2")
    a, b = (g.select(*[F.col(c).alias(f"{c}_{s}") for c in ("g", "m", "v", "n")], F.lit(1).alias("one")) for s in "ab")
    sa, sb = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    t = F.try_divide(F.col("m_a") - F.col("m_b"), F.sqrt(sa + sb))
    df_ = F.try_divide((sa + sb) * (sa + sb), sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1))
    return a.join(b, (a["one"] == b["one"]) & (F.col("g_a") < F.col("g_b"))).select(F.col("g_a").alias("group_a"), F.col("g_b").alias("group_b"), t.alias("t"), df_.alias("df")).withColumn("p", tails.t_two_sided_column(F.col("t"), F.col("df"))).withColumn("stars", F.when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise(""))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts with margins: a null where a margin sums over that side."""
    return df.cube(row, column).agg(F.count("*").alias("n"), F.grouping(row).alias("all_rows"), F.grouping(column).alias("all_columns"))


def pivot(df: DataFrame, row: str, column: str, values: list, measure: str) -> DataFrame:
    """A row for each value of row; for each of values of column the mean of measure and how many it is of, as <value>_mean and <value>_n. Null and NaN measures don't count; a combination without any has a null mean."""
    m = F.when(~F.isnan(F.col(measure).cast("double")), F.col(measure).cast("double"))
    cell = lambda v: F.when(F.col(column).eqNullSafe(F.lit(v)), m)
    return df.groupBy(row).agg(*[a for v in values for a in (F.avg(cell(v)).alias(f"{v}_mean"), F.count(cell(v)).alias(f"{v}_n"))])


def fold_metrics(df: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, mean and population std over finite values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("x.*")
    finite = long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    return finite.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"))
