"""Reports over predictions, extractions and experiment results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators.metrics import safe_corr
from causeway.operators.quantiles import quantiles


def prediction_summary(df: DataFrame, effect: str, lower: str, upper: str, propensity: str) -> DataFrame:
    """Spread of the effects (sample), share of rows whose interval leaves out 0, mean propensity."""
    x = F.col(effect)
    away = ((F.col(lower) > 0) | (F.col(upper) < 0)).cast("double")
    return df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(away).alias("share_significant"), F.avg(propensity).alias("mean_propensity"))


def effect_summary(df: DataFrame, effect: str, lower: str | None = None, upper: str | None = None) -> DataFrame:
    """Mean, spread (population), range, exact median and signs of the effects, and with intervals the share in percent that leave out 0."""
    x = F.col(effect)
    away = [(100.0 * F.avg(((F.col(lower) > 0) | (F.col(upper) < 0)).cast("double"))).alias("percent_significant")] if lower else []
    one = df.agg(F.avg(x).alias("ate"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.count_if(x > 0).alias("n_positive"), F.count_if(x < 0).alias("n_negative"), *away)
    return one.join(F.broadcast(quantiles(df, effect, [0.5]).select(F.get("q", 0).alias("median"))))  # one row


def strict_group_summary(df: DataFrame, groups: list[str], metric: str, keep_null_groups: bool = False) -> DataFrame:
    """Mean and sample spread for each group; groups with a null key are left out unless kept."""
    rows = df if keep_null_groups else df.dropna(subset=groups)
    return rows.groupBy(*groups).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count("*").alias("n"))


def extraction_accuracy(df: DataFrame, categorical: dict[str, tuple[str, str]], unknown: str = "unknown") -> DataFrame:
    """feature, category, accuracy, n of extracted against true values that aren't unknown; a null category is the whole feature."""
    rows = F.array(*[F.struct(F.lit(name).alias("feature"), F.col(found).cast("string").alias("found"), F.col(true).cast("string").alias("category")) for name, (found, true) in categorical.items()])
    long = df.select(F.explode(rows).alias("x")).select("x.*").where((F.col("found") != unknown) & F.col("category").isNotNull())
    hit = (F.col("found") == F.col("category")).cast("double")
    return long.groupingSets([[F.col("feature"), F.col("category")], [F.col("feature")]], "feature", "category").agg(F.avg(hit).alias("accuracy"), F.count("*").alias("n"))


def extraction_errors(df: DataFrame, continuous: dict[str, tuple[str, str]]) -> DataFrame:
    """feature, correlation, mae, rmse, n, coverage of extracted against true numbers; coverage is the share of true values that were extracted."""
    rows = F.array(*[F.struct(F.lit(name).alias("feature"), F.col(found).cast("double").alias("found"), F.col(true).cast("double").alias("true")) for name, (found, true) in continuous.items()])
    long = df.select(F.explode(rows).alias("x")).select("x.*").where("true is not null")
    d = F.col("found") - F.col("true")
    return long.groupBy("feature").agg(safe_corr(F.col("found"), F.col("true")).alias("correlation"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.count("found").alias("n"), (F.count("found") / F.count("*")).alias("coverage"))


def regression_by_arm(df: DataFrame, treatment: str, truth: str, predicted: str) -> DataFrame:
    """R squared and root mean squared error in each arm."""
    means = df.groupBy(treatment).agg(F.avg(truth).alias("__m"))
    e, d = F.col(truth) - F.col(predicted), F.col(truth) - F.col("__m")
    return df.join(F.broadcast(means), treatment).groupBy(treatment).agg((1 - F.try_divide(F.sum(e * e), F.sum(d * d))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"))


def variability(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Spread of the groups' means, and mean of the groups' spreads."""
    each = df.groupBy(group).agg(F.avg(metric).alias("m"), F.stddev_samp(metric).alias("s"))
    return each.agg(F.stddev_samp("m").alias("std_of_means"), F.avg("s").alias("mean_of_stds"), F.count("*").alias("n_groups"))


def member_contrast(df: DataFrame, members: str, metric: str) -> DataFrame:
    """member, mean_with, mean_without for each element that occurs in the array column."""
    total = df.agg(F.sum(metric).alias("__s"), F.count(metric).alias("__n"))
    each = df.select(F.explode(F.array_distinct(members)).alias("member"), metric).groupBy("member").agg(F.sum(metric).alias("s"), F.count(metric).alias("n"))
    return each.join(F.broadcast(total)).select("member", (F.col("s") / F.col("n")).alias("mean_with"), F.try_divide(F.col("__s") - F.col("s"), F.col("__n") - F.col("n")).alias("mean_without"))


def residual_contrast(df: DataFrame, bin_col: str, t: Column, y: Column, limit: float) -> DataFrame:
    """For each bin the sum of residual products over that of squares (1e-6 at least), clipped."""
    ratio = F.sum(t * y) / F.greatest(F.sum(t * t), F.lit(1e-6))
    return df.groupBy(bin_col).agg(F.greatest(F.least(ratio, F.lit(limit)), F.lit(-limit)).alias("contrast"))


def candidate_gain(baseline: DataFrame, candidate: DataFrame, fold: str, loss: str) -> DataFrame:
    """Relative gain in mean loss, and the share of common folds in which the candidate is strictly better."""
    b, c = baseline.select(fold, F.col(loss).alias("b")), candidate.select(fold, F.col(loss).alias("c"))
    return b.join(c, fold).agg(((F.avg("b") - F.avg("c")) / F.greatest(F.abs(F.avg("b")), F.lit(1e-8))).alias("gain"), F.avg((F.col("c") < F.col("b")).cast("double")).alias("share_better"), F.count("*").alias("n_folds"))


def top_rows(df: DataFrame, metric: str, n: int, key: str, largest: bool = True) -> DataFrame:
    """The n rows with the largest or smallest metric, missing ones left out, ties by key."""
    good = df.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    return good.orderBy(F.desc(metric) if largest else F.asc(metric), key).limit(n)


def stat_pooling(df: DataFrame, key: str, vector: str, mask: str | None = None) -> DataFrame:
    """key, dim, mean, std (population), max, min over the rows of a key whose mask, if there is one, isn't 0, element by element."""
    rows = df.where(F.col(mask) != 0) if mask else df
    long = rows.select(key, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return long.groupBy(key, "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.max("x").alias("max"), F.min("x").alias("min"))


def result_rows(df: DataFrame) -> DataFrame:
    """One wide row for each result document that wasn't skipped: its config and metrics objects side by side."""
    kept = df.where(~F.coalesce(F.col("skipped"), F.lit(False))) if "skipped" in df.columns else df
    return kept.select("config.*", "metrics.*")


def open_jobs(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs of the grid without a result yet."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")
