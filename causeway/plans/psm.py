"""The matching report: overlap, pairs, balance, estimates by several methods, tests and sensitivity, and its files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import tails
from causeway.operators import effects, matching
from causeway.operators.quantiles import quantiles


@dataclass
class Report:
    overlap: DataFrame
    pairs: DataFrame
    balance: DataFrame
    estimates: DataFrame
    sensitivity: DataFrame


def caliper_of(df: DataFrame, propensity: str, factor: float = 0.2, scale: str = "std_compat") -> float:
    """raw: the factor; std_compat: times the spread of the logit, though raw scores are compared, as is widely done; std: times the spread of the score."""
    from causeway.functions.scalar import logit

    if scale == "raw":
        return factor
    x = logit(F.col(propensity)) if scale == "std_compat" else F.col(propensity)
    return factor * float(df.agg(F.stddev_pop(x)).first()[0] or 0.0)


def estimates(df: DataFrame, outcomes: DataFrame, key: str, treatment: str, outcome: str, propensity: str, effect: str | None = None, level: float = 0.95, draws: int = effects.DRAWS) -> DataFrame:
    """method, estimate, lower, upper, p: crude, matched, weighted and stratified, the latter three with bootstrap intervals; a model's mean effect with percentiles of its effects, which are not an interval of the mean.

    p is that of Student's t with the bootstrap's standard error and one degree of freedom less than there are pairs, for pairs, else of the normal.
    """
    none = lambda *names: [F.lit(None).cast("double").alias(n) for n in names]
    out = effects.crude(df, treatment, outcome).select(F.lit("crude").alias("method"), F.col("difference").alias("estimate"), *none("lower", "upper", "p"))
    found = {
        "matched": (effects.att_matched(outcomes).select(F.col("att").alias("estimate"), (F.col("n_pairs") - 1).cast("double").alias("df")), effects.bootstrap_matched(outcomes, draws, level)),
        "weighted": (effects.ate_ipw(df, treatment, outcome, propensity).select(F.col("ate").alias("estimate"), F.lit(1e9).alias("df")), effects.bootstrap_ipw(df, key, treatment, outcome, propensity, draws, level=level)),
        "stratified": (effects.ate_stratified(df, treatment, outcome, propensity).select(F.col("ate").alias("estimate"), F.lit(1e9).alias("df")), effects.bootstrap_stratified(df, key, treatment, outcome, propensity, draws=draws, level=level)),
    }
    for name, (point, spread) in found.items():
        one = point.join(F.broadcast(spread))  # one row each
        p = tails.t_two_sided_column(F.col("estimate") / (F.coalesce("se", F.lit(0.0)) + 1e-10), F.col("df"))
        out = out.unionByName(one.select(F.lit(name).alias("method"), "estimate", "lower", "upper", p.alias("p")))
    return out.unionByName(model_row(df, effect, "model, percentiles of effects", level)) if effect else out


def model_row(df: DataFrame, effect: str, name: str, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    q = quantiles(df, effect, [tail, 1 - tail])
    return df.agg(F.avg(effect).alias("estimate")).join(F.broadcast(q)).select(F.lit(name).alias("method"), "estimate", F.get("q", 0).alias("lower"), F.get("q", 1).alias("upper"), F.lit(None).cast("double").alias("p"))  # one row


def compared(df: DataFrame, effect: str, methods: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """method, estimate, lower, upper: a model's mean effect with percentiles of its effects beside other methods' estimates, each the named column of a one-row table."""
    out = model_row(df, effect, "model").drop("p")
    for name, (column, of) in methods.items():
        row = of(df)
        bounds = [(F.col(c) if c in row.columns else F.lit(None)).cast("double").alias(c) for c in ("lower", "upper")]
        out = out.unionByName(row.select(F.lit(name).alias("method"), F.col(column).alias("estimate"), *bounds))
    return out


def report(df: DataFrame, key: str, treatment: str, outcome: str, propensity: str, covariates: list[str], k: int = 1, caliper: float | None = None, effect: str | None = None) -> Report:
    width = caliper if caliper is not None else max(1e-6, caliper_of(df, propensity))
    pairs = matching.nearest(df, key, treatment, propensity, k, width)
    outcomes = effects.pair_outcomes(pairs, df, key, outcome)
    return Report(effects.overlap(df, treatment, propensity), pairs, effects.balance_change(df, pairs, key, treatment, covariates), estimates(df, outcomes, key, treatment, outcome, propensity, effect), effects.rosenbaum(outcomes))


def save(found: Report, folder: str) -> None:
    """CSV for the tables, one JSON line for the summary."""
    for name in ("pairs", "balance", "sensitivity"):
        getattr(found, name).write.mode("overwrite").csv(f"{folder}/{name}", header=True)
    summary = found.estimates.agg(F.collect_list(F.struct("*")).alias("estimates")).join(F.broadcast(found.overlap))
    summary.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{folder}/summary")
