"""Cohorts with known effects: compiled linear predictors, simulated treatments and outcomes, and the closed-form R-learner."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.hashrand import normal, uniform
from causeway.functions.scalar import sigmoid


@dataclass(frozen=True)
class Equation:
    """intercept + sum of coefficient * column + sum of coefficient * product of columns + treatment * (effect + sum of modifier * column)."""

    intercept: float = 0.0
    main: dict[str, float] = field(default_factory=dict)
    products: dict[tuple[str, ...], float] = field(default_factory=dict)
    effect: float = 0.0
    modifiers: dict[str, float] = field(default_factory=dict)

    def compile(self, columns: list[str], treatment: Column | None = None) -> Column:
        """One expression. Unknown columns count as 0."""
        known = lambda c: F.col(c).cast("double") if c in columns else F.lit(0.0)
        out = F.lit(self.intercept)
        for c, b in self.main.items():
            out = out + F.lit(b) * known(c)
        for cs, b in self.products.items():
            term = F.lit(b)
            for c in cs:
                term = term * known(c)
            out = out + term
        if treatment is not None:
            inner = F.lit(self.effect)
            for c, b in self.modifiers.items():
                inner = inner + F.lit(b) * known(c)
            out = out + treatment * inner
        return out


def characteristics(spark, n: int, normals: list[str], seed: int = 1, partitions: int = 8) -> DataFrame:
    """unit_id and standard normal columns from hashes."""
    base = spark.range(0, n, 1, partitions).withColumnRenamed("id", "unit_id")
    return base.select("unit_id", *[normal(F.lit(seed), F.lit(c), F.col("unit_id")).alias(c) for c in normals])


def sampled(df: DataFrame, specs: list, stats: dict[str, dict], key: str = "unit_id", seed: int = 1) -> DataFrame:
    """df with a value for each feature: normal with its mean and std, or a category by its proportions, which are brought to a sum of 1 over the declared categories; equal ones where none is given."""
    new = {}
    for s in specs:
        own = stats.get(s.name, {})
        if s.kind == "continuous":
            new[s.name] = own.get("mean", 0.0) + own.get("std", 1.0) * normal(F.lit(seed), F.lit(s.name), F.col(key))
            continue
        shares = [max(0.0, own.get("proportions", {}).get(c, 0.0)) for c in s.categories]
        shares = [x / sum(shares) for x in shares] if sum(shares) > 0 else [1.0 / len(s.categories)] * len(s.categories)
        u, cuts = uniform(F.lit(seed), F.lit(s.name), F.col(key)), np.cumsum(shares)
        pick = F.lit(s.categories[-1])
        for c, cut in reversed(list(zip(s.categories[:-1], cuts, strict=False))):
            pick = F.when(u < float(cut), c).otherwise(pick)
        new[s.name] = pick
    return df.withColumns(new)


def design(specs: list, stats: dict[str, dict]) -> dict[str, Column]:
    """The columns that equations name: z-scores of numbers, and name_category for each category but the first."""
    out = {}
    for s in specs:
        if s.kind == "continuous":
            own = stats.get(s.name, {})
            out[s.name] = (F.col(s.name).cast("double") - own.get("mean", 0.0)) / max(own.get("std", 1.0), 1e-6)
        else:
            out |= {f"{s.name}_{c}": F.coalesce((F.col(s.name) == c).cast("double"), F.lit(0.0)) for c in s.categories[1:]}
    return out


def coefficient_names(specs: list, role: str | None = None) -> list[str]:
    return [n for s in specs if role is None or role in s.roles for n in ([s.name] if s.kind == "continuous" else [f"{s.name}_{c}" for c in s.categories[1:]])]


def checked(equation: Equation, names: list[str]) -> Equation:
    """The equation without terms that name anything else."""
    return replace(equation, main={c: b for c, b in equation.main.items() if c in names}, products={cs: b for cs, b in equation.products.items() if all(c in names for c in cs)}, modifiers={c: b for c, b in equation.modifiers.items() if c in names})


def random_equation(names: list[str], modifiers: list[str] | None = None, effect: float = 0.0, main_scale: float = 1.0, product_scale: float = 0.5, products: int = 2, seed: int = 5) -> Equation:
    """Normal coefficients for all names, some products of two of them and, with modifiers, the effect's terms; the same for one seed."""
    r = np.random.default_rng(seed)
    main = {n: float(r.normal() * main_scale) for n in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    some = sorted(r.choice(len(pairs), min(products, len(pairs)), replace=False).tolist()) if pairs else []
    return Equation(0.0, main, {pairs[i]: float(r.normal() * product_scale) for i in some}, effect, {n: float(r.normal() * product_scale) for n in modifiers or []})


def rescaled(df: DataFrame, equation: Equation, target: float, with_treatment: bool = False) -> Equation:
    """Coefficients times what brings the linear predictor's spread (population, the larger one of both arms) to target; intercept and effect stay, and all where there is no spread."""
    base = replace(equation, intercept=0.0)
    spread = df.agg(*[F.stddev_pop(base.compile(df.columns, F.lit(float(a)) if with_treatment else None)).alias(f"s{a}") for a in ((0, 1) if with_treatment else (0,))]).first()
    top = max(float(x or 0.0) for x in spread)
    if top <= 0:
        return equation
    times = lambda d: {c: b * target / top for c, b in d.items()}
    return replace(equation, main=times(equation.main), products=times(equation.products), modifiers=times(equation.modifiers))


def fitted_equation(df: DataFrame, target: str, columns: list[str], treatment: str | None = None, modifiers: list[str] | None = None, ridge: float = 0.01) -> Equation:
    """A logistic model of target on columns and their products of two, and, with a treatment, on it and its products with modifiers, as an equation."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    terms = [F.col(c).cast("double") for c in columns] + [F.col(a).cast("double") * F.col(b) for a, b in pairs]
    if treatment:
        terms += [F.col(treatment).cast("double"), *[F.col(treatment) * F.col(c).cast("double") for c in modifiers or []]]
    names = [f"__{i}" for i in range(len(terms))]
    ready = VectorAssembler(inputCols=names, outputCol="__x").transform(df.select(F.col(target).cast("double").alias("__y"), *[t.alias(n) for t, n in zip(terms, names, strict=True)]))
    model = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=ridge, maxIter=100).fit(ready)
    c = [float(x) for x in model.coefficients]
    k, p = len(columns), len(pairs)
    rest = c[k + p :]
    return Equation(float(model.intercept), dict(zip(columns, c, strict=False)), dict(zip(pairs, c[k : k + p], strict=True)), rest[0] if rest else 0.0, dict(zip(modifiers or [], rest[1:], strict=False)))


def simulate(df: DataFrame, treatment: Equation, outcome: Equation, key: str = "unit_id", seed: int = 7, positivity: tuple[float, float] = (0.02, 0.98)) -> DataFrame:
    """df with true_propensity, treatment, true_y0, true_y1, true_ite and outcome, a Bernoulli draw of the factual probability."""
    cols = df.columns
    e = F.greatest(F.least(sigmoid(treatment.compile(cols)), F.lit(positivity[1])), F.lit(positivity[0]))
    out = df.withColumn("true_propensity", e).withColumn("treatment", (uniform(F.lit(seed), F.lit("t"), F.col(key)) < F.col("true_propensity")).cast("int"))
    out = out.withColumns({f"true_y{a}": sigmoid(outcome.compile(cols, F.lit(float(a)))) for a in (0, 1)}).withColumn("true_ite", F.col("true_y1") - F.col("true_y0"))
    p = F.when(F.col("treatment") == 1, F.col("true_y1")).otherwise(F.col("true_y0"))
    return out.withColumn("outcome", (uniform(F.lit(seed), F.lit("y"), F.col(key)) < p).cast("int"))


def calibrated(df: DataFrame, equation: Equation, target: float, steps: int = 40, low: float = -10.0, high: float = 10.0) -> Equation:
    """The equation with the intercept at which the mean probability is target, else the nearer end of [low, high].

    Sixteen trial intercepts a job divide the interval by seventeen each time.
    """
    base = Equation(0.0, equation.main, equation.products, equation.effect, equation.modifiers)
    lp = df.select(base.compile(df.columns).alias("lp")).cache()
    try:
        while high - low > 1e-9 and steps > 0:
            trial = np.linspace(low, high, 18)[1:-1]
            means = lp.agg(*[F.avg(sigmoid(F.col("lp") + float(a))).alias(f"m{i}") for i, a in enumerate(trial)]).first()
            above = [m >= target for m in means]
            k = above.index(True) if any(above) else len(above)
            low, high = ([low, *trial, high][k], [low, *trial, high][k + 1])
            steps -= 1
    finally:
        lp.unpersist()
    return Equation((low + high) / 2, equation.main, equation.products, equation.effect, equation.modifiers)


def r_learner(df: DataFrame, y: str, t: str, m: str, e: str, x: list[str], ridge: float = 1e-6) -> dict[str, float]:
    """Linear effect by residuals: weighted least squares of the outcome's on the treatment's residual times (1, x), from one aggregation of moments."""
    rt, ry = F.col(t) - F.col(e), F.col(y) - F.col(m)
    z = [rt, *[rt * F.col(c) for c in x]]
    k = len(z)
    sums = df.agg(*[F.sum(z[i] * z[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(z[i] * ry).alias(f"b{i}") for i in range(k)]).first()
    a = np.array([[sums[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    b = np.array([sums[f"b{i}"] for i in range(k)], float)
    beta = np.linalg.solve(a + ridge * np.eye(k), b)
    return dict(zip(["intercept", *x], map(float, beta), strict=True))
