"""Estimators of individual effects behind one interface: each takes a table and gives out-of-fold predictions.

Every estimator returns the table with cv_fold, pred_propensity, pred_outcome, pred_ite and its interval, pred_y0 and pred_y1. Nothing that
predicts a row has seen its fold: vocabularies, normalisation, nuisances and forests are fitted on the other folds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.scalar import arm_means, sigmoid
from causeway.operators import cohort, effect_nets, encoding, forest, matching, metrics, shared_layer, simulation, textmodels
from causeway.operators.encoding import FeatureSpec
from causeway.operators.store_tables import kept

PREDICTED = ("cv_fold", "pred_propensity", "pred_outcome", "pred_ite", "pred_ite_lower", "pred_ite_upper", "pred_y0", "pred_y1")


@dataclass(frozen=True)
class Columns:
    key: str = "unit_id"
    text: str = "text"
    treatment: str = "treatment"
    outcome: str = "outcome"
    binary: bool = True


def _matrix(train: DataFrame, df: DataFrame, specs: list[FeatureSpec], prefix: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """df with the encoded features as columns, by statistics of train, and each feature's column names."""
    numbers = [s.name for s in specs if s.kind == "continuous"]
    stats = encoding.normalization(train.select(*[F.col(f"`{prefix}{n}`").alias(n) for n in numbers]), numbers) if numbers else {}
    columns, names = {}, {}
    for s in specs:
        each = encoding.encoded([s], stats, prefix)
        names[s.name] = [f"__{s.name}_{i}" for i in range(len(each))]
        columns |= dict(zip(names[s.name], each, strict=True))
    return df.withColumns(columns), names


def effect_forest(df: DataFrame, c: Columns, specs: list[FeatureSpec], folds: int = 3, prefix: str = "", dims: int = 0, confounders_only: bool = False, learner: str = "forest", bags: int = 12, seed: int = 42, **forest_options) -> DataFrame:
    """A causal forest on features, with text if dims > 0: nuisances see confounders and the text's leading dimensions, the forest the effect modifiers.

    confounders_only: features without the role of a confounder are left out, of both parts. Without modifiers the forest sees what nuisances see.
    """
    used = encoding.by_role(specs, "confounder") if confounders_only else specs
    dealt = cohort.folds(df, c.key, folds, seed)
    parts = []
    for f in range(1, folds + 1):
        train = dealt.where(F.col("cv_fold") != f)
        wide, names = _matrix(train, dealt, used, prefix)
        text = [f"svd_{i}" for i in range(dims)]
        if dims:
            wide = textmodels.text_svd(train, wide, c.key, c.text, dims, seed=seed)
        w = [x for s in encoding.by_role(used, "confounder") for x in names[s.name]] + text or [x for s in used for x in names[s.name]] + text
        x = [n for s in encoding.by_role(used, "effect_modifier") for n in names[s.name]] or w
        own = wide.where(F.col("cv_fold") != f).select(*dict.fromkeys([c.key, c.treatment, c.outcome, *w, *x])).persist()  # numbers, read some twenty times
        try:
            fitted = forest.crossfit(own, c.key, c.treatment, c.outcome, w, folds, c.binary, seed + f, learner=learner)
            trees = forest.fit_forest(fitted, c.key, c.outcome, c.treatment, "m_hat", "e_hat", x, bags=bags, seed=seed, **forest_options)
            test = _nuisances(own, wide.where(F.col("cv_fold") == f), c, w, learner, seed)
        finally:
            own.unpersist()
        parts.append(finished(forest.predict_forest(test, trees, x), c).select(*df.columns, *PREDICTED))
    return _union(parts)


def _nuisances(train: DataFrame, test: DataFrame, c: Columns, w: list[str], learner: str, seed: int) -> DataFrame:
    """test with e_hat and m_hat by models of train."""
    from pyspark.ml.feature import VectorAssembler

    put = VectorAssembler(inputCols=w, outputCol="__x")
    train, test = put.transform(train).persist(), put.transform(test)
    try:
        for target, out, binary in ((c.treatment, "e_hat", True), (c.outcome, "m_hat", c.binary)):
            test = forest.scored(train, test, target, out, binary, learner, seed)
    finally:
        train.unpersist()
    return test.drop("__x").withColumn("e_hat", F.greatest(F.least("e_hat", F.lit(0.99)), F.lit(0.01)))


def finished(df: DataFrame, c: Columns) -> DataFrame:
    y0, y1 = arm_means(F.col("m_hat"), F.col("e_hat"), F.col("pred_ite"), c.binary)
    return df.withColumns({"pred_y0": y0, "pred_y1": y1, "pred_propensity": F.col("e_hat"), "pred_outcome": F.col("m_hat")})


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def explicit_forest(df: DataFrame, c: Columns, specs: list[FeatureSpec], **how) -> DataFrame:
    return effect_forest(df, c, specs, **how)


def confounder_forest(df: DataFrame, c: Columns, specs: list[FeatureSpec], **how) -> DataFrame:
    return effect_forest(df, c, specs, confounders_only=True, **how)


def tfidf_forest(df: DataFrame, c: Columns, specs: list[FeatureSpec], dims: int = 16, **how) -> DataFrame:
    """tf-idf of the training folds, its leading dimensions beside the features."""
    return effect_forest(df, c, specs, dims=dims, **how)


def best_attainable(df: DataFrame, c: Columns, specs: list[FeatureSpec], prefix: str = "true_", **how) -> DataFrame:
    """The same forest on the features' true values, of those with the role of a confounder: what no extraction can beat."""
    return effect_forest(df, c, specs, prefix=prefix, confounders_only=True, **how)


def two_models(df: DataFrame, c: Columns, specs: list[FeatureSpec], folds: int = 3, prefix: str = "", dims: int = 0, learner: str = "linear", seed: int = 42) -> DataFrame:
    """An outcome model for each arm and a propensity model, on features and the text's leading dimensions. The interval is not estimated (null)."""
    from pyspark.ml.feature import VectorAssembler

    dealt = cohort.folds(df, c.key, folds, seed)
    parts = []
    for f in range(1, folds + 1):
        train = dealt.where(F.col("cv_fold") != f)
        wide, names = _matrix(train, dealt, specs, prefix)
        if dims:
            wide = textmodels.text_svd(train, wide, c.key, c.text, dims, seed=seed)
        w = [x for s in specs for x in names[s.name]] + [f"svd_{i}" for i in range(dims)]
        ready = VectorAssembler(inputCols=w, outputCol="__x").transform(wide).persist()
        try:
            own, test = ready.where(F.col("cv_fold") != f), ready.where(F.col("cv_fold") == f)
            test = forest.scored(own, test, c.treatment, "pred_propensity", True, learner, seed)
            for a in (0, 1):
                test = forest.scored(own.where(F.col(c.treatment) == a), test, c.outcome, f"pred_y{a}", c.binary, learner, seed)
        finally:
            ready.unpersist()
        none = F.lit(None).cast("double")
        e = F.col("pred_propensity")
        test = test.withColumns({"pred_ite": F.col("pred_y1") - F.col("pred_y0"), "pred_ite_lower": none, "pred_ite_upper": none, "pred_outcome": e * F.col("pred_y1") + (1 - e) * F.col("pred_y0")})
        parts.append(test.select(*df.columns, *PREDICTED))
    return _union(parts)


def shared_outcomes(df: DataFrame, c: Columns, specs: list[FeatureSpec], folds: int = 3, prefix: str = "", dims: int = 0, seed: int = 42, **how) -> DataFrame:
    """Both arms' outcomes and the propensity from one shared representation of features and the text's leading dimensions (`shared_layer`). The interval is not estimated (null)."""
    dealt = cohort.folds(df, c.key, folds, seed)
    parts = []
    for f in range(1, folds + 1):
        train = dealt.where(F.col("cv_fold") != f)
        wide, names = _matrix(train, dealt, specs, prefix)
        if dims:
            wide = textmodels.text_svd(train, wide, c.key, c.text, dims, seed=seed)
        w = [x for s in specs for x in names[s.name]] + [f"svd_{i}" for i in range(dims)]
        model = shared_layer.fit(wide.where(F.col("cv_fold") != f), c.key, c.treatment, c.outcome, w, binary=c.binary, seed=seed + f, **how)
        test = shared_layer.scored(wide.where(F.col("cv_fold") == f), model, w)
        none, e = F.lit(None).cast("double"), F.col("pred_propensity")
        test = test.withColumns({"pred_ite": F.col("pred_y1") - F.col("pred_y0"), "pred_ite_lower": none, "pred_ite_upper": none, "pred_outcome": e * F.col("pred_y1") + (1 - e) * F.col("pred_y0")})
        parts.append(test.select(*df.columns, *PREDICTED))
    return _union(parts)


def linear_effects(df: DataFrame, c: Columns, specs: list[FeatureSpec], folds: int = 3, prefix: str = "", dims: int = 0, learner: str = "linear", seed: int = 42) -> DataFrame:
    """An R-learner: nuisances on everything, then a linear effect of the modifiers by residuals, from moments of the other folds alone. The interval is not estimated (null)."""
    dealt = cohort.folds(df, c.key, folds, seed)
    parts = []
    for f in range(1, folds + 1):
        train = dealt.where(F.col("cv_fold") != f)
        wide, names = _matrix(train, dealt, specs, prefix)
        text = [f"svd_{i}" for i in range(dims)]
        if dims:
            wide = textmodels.text_svd(train, wide, c.key, c.text, dims, seed=seed)
        w = [x for s in specs for x in names[s.name]] + text
        x = [n for s in encoding.by_role(specs, "effect_modifier") for n in names[s.name]] + text or w
        own = wide.where(F.col("cv_fold") != f).drop("cv_fold")
        beta = simulation.r_learner(forest.crossfit(own, c.key, c.treatment, c.outcome, w, folds, c.binary, seed + f, learner=learner), c.outcome, c.treatment, "m_hat", "e_hat", x, ridge=1.0)
        tau = F.lit(beta["intercept"])
        for n in x:
            tau = tau + F.lit(beta[n]) * F.col(n)
        none = F.lit(None).cast("double")
        test = _nuisances(own, wide.where(F.col("cv_fold") == f), c, w, learner, seed).withColumns({"pred_ite": tau, "pred_ite_lower": none, "pred_ite_upper": none})
        parts.append(finished(test, c).select(*df.columns, *PREDICTED))
    return _union(parts)


def contrastive_effects(df: DataFrame, c: Columns, specs: list[FeatureSpec], folds: int = 3, prefix: str = "", bins: int = 8, learner: str = "linear", limit: float = 1.0, seed: int = 42) -> DataFrame:
    """Effects of propensity bins: in each bin of the training folds the contrast of residuals, which the bin's held-out rows get. The interval is not estimated (null)."""
    from causeway.operators import reports

    dealt = cohort.folds(df, c.key, folds, seed)
    parts = []
    for f in range(1, folds + 1):
        train = dealt.where(F.col("cv_fold") != f)
        wide, names = _matrix(train, dealt, specs, prefix)
        w = [x for s in specs for x in names[s.name]]
        own = wide.where(F.col("cv_fold") != f).drop("cv_fold")
        fitted = forest.crossfit(own, c.key, c.treatment, c.outcome, w, folds, c.binary, seed + f, learner=learner)
        binned = cohort.propensity_bins(fitted, c.key, c.treatment, "e_hat", bins)
        targets = reports.residual_contrast(binned, "bin", F.col(c.treatment) - F.col("e_hat"), F.col(c.outcome) - F.col("m_hat"), limit)
        edges = binned.where("bin >= 0").groupBy("bin").agg(F.min("e_hat").alias("low")).join(targets, "bin").orderBy("low").collect()  # a row for each bin
        test = _nuisances(own, wide.where(F.col("cv_fold") == f), c, w, learner, seed)
        tau = F.lit(edges[0]["contrast"] if edges else 0.0)
        for r in edges[1:]:
            tau = F.when(F.col("e_hat") >= r["low"], r["contrast"]).otherwise(tau)
        none = F.lit(None).cast("double")
        parts.append(finished(test.withColumns({"pred_ite": tau, "pred_ite_lower": none, "pred_ite_upper": none}), c).select(*df.columns, *PREDICTED))
    return _union(parts)


def pair_contrast(df: DataFrame, c: Columns, specs: list[FeatureSpec], folds: int = 3, prefix: str = "", dims: int = 0, caliper: float = 0.05, learner: str = "linear", seed: int = 42, **how) -> DataFrame:
    """A head trained on pairs of the other folds that are matched by propensity (`effect_nets`). The interval is not estimated (null)."""
    dealt = cohort.folds(df, c.key, folds, seed)
    parts = []
    for f in range(1, folds + 1):
        train = dealt.where(F.col("cv_fold") != f)
        wide, names = _matrix(train, dealt, specs, prefix)
        if dims:
            wide = textmodels.text_svd(train, wide, c.key, c.text, dims, seed=seed)
        w = [x for s in specs for x in names[s.name]] + [f"svd_{i}" for i in range(dims)]
        own = kept(wide.where(F.col("cv_fold") != f).drop("cv_fold"))
        fitted = kept(forest.crossfit(own, c.key, c.treatment, c.outcome, w, folds, c.binary, seed + f, learner=learner).select(c.key, c.treatment, "e_hat"))
        pairs = matching.sorted_pairs(fitted, c.key, c.treatment, "e_hat", caliper=caliper)
        model = effect_nets.fit_pairs(pairs, own, c.key, c.outcome, w, seed=seed + f, **how)
        test = effect_nets.scored(_nuisances(own, wide.where(F.col("cv_fold") == f), c, w, learner, seed), model, w, ["__mu0", "__mu1"])
        none = F.lit(None).cast("double")
        test = test.withColumns({"pred_ite": sigmoid(F.col("__mu1")) - sigmoid(F.col("__mu0")), "pred_ite_lower": none, "pred_ite_upper": none})
        parts.append(finished(test, c).select(*df.columns, *PREDICTED))
    return _union(parts)


def residual_modifier(df: DataFrame, c: Columns, specs: list[FeatureSpec], mode: str = "additive", folds: int = 3, prefix: str = "", dims: int = 8, learner: str = "linear", bags: int = 12, seed: int = 42, **how) -> DataFrame:
    """What the text adds to the effect that the features give, in one of three ways.

    base: the effect forest on features alone. additive: to it a net's residual effect from the text's leading dimensions, trained on what the base
    leaves over out of fold. replacing: a forest on the features and the net's code. Intervals are those of the forest, moved by what the net adds.
    """
    if mode not in ("base", "additive", "replacing"):
        raise ValueError(f"unknown mode {mode}")
    dealt = cohort.folds(df, c.key, folds, seed)
    text = [f"svd_{i}" for i in range(dims)]
    parts = []
    for f in range(1, folds + 1):
        train = dealt.where(F.col("cv_fold") != f)
        wide, names = _matrix(train, dealt, specs, prefix)
        wide = textmodels.text_svd(train, wide, c.key, c.text, dims, seed=seed)
        w = [x for s in specs for x in names[s.name]]
        own = kept(wide.where(F.col("cv_fold") != f).drop("cv_fold"))
        options = dict(bags=bags, seed=seed)
        fitted = kept(forest.crossfit(own, c.key, c.treatment, c.outcome, w + text, folds, c.binary, seed + f, learner=learner))
        test = _nuisances(own, wide.where(F.col("cv_fold") == f), c, w + text, learner, seed)
        if mode == "base":
            trees, x = forest.fit_forest(fitted, c.key, c.outcome, c.treatment, "m_hat", "e_hat", w, **options), w
        else:
            base = forest.out_of_fold(fitted, c.key, c.outcome, c.treatment, w, folds, **options)
            model = effect_nets.fit_residual(base, c.key, c.outcome, c.treatment, "m_hat", "e_hat", "pred_ite", text, seed=seed + f, **how)
            codes = [f"__code{i}" for i in range(model.net.code)]
            test = effect_nets.scored(test, model, text, ["__more"], "__code")
            x = w + codes if mode == "replacing" else w
            seen = effect_nets.scored(fitted, model, text, ["__more"], "__code")
            trees = forest.fit_forest(seen, c.key, c.outcome, c.treatment, "m_hat", "e_hat", x, **options)
        test = forest.predict_forest(test, trees, x)
        if mode == "additive":
            test = test.withColumns({n: F.col(n) + F.col("__more") for n in ("pred_ite", "pred_ite_lower", "pred_ite_upper")})
        parts.append(finished(test, c).select(*df.columns, *PREDICTED))
    return _union(parts)


#: The estimators by the name that a configuration gives.
MODELS: dict[str, Callable[..., DataFrame]] = {
    "explicit_forest": explicit_forest,
    "confounder_forest": confounder_forest,
    "tfidf_forest": tfidf_forest,
    "best_attainable": best_attainable,
    "two_models": two_models,
    "shared_outcomes": shared_outcomes,
    "linear_effects": linear_effects,
    "pair_contrast": pair_contrast,
    "residual_modifier": residual_modifier,
    "contrastive_effects": contrastive_effects,
}


def run(model: str, df: DataFrame, c: Columns, specs: list[FeatureSpec], **how) -> DataFrame:
    if model not in MODELS:
        raise ValueError(f"unknown model {model}: {', '.join(sorted(MODELS))}")
    return MODELS[model](df, c, specs, **how)


def against_truth(predictions: DataFrame, c: Columns, ite: str = "true_ite", y0: str = "true_y0", y1: str = "true_y1") -> DataFrame:
    """One row: the metrics of predictions against the truth that a simulation knows."""
    return metrics.all_effect_metrics(predictions, "pred_ite", ite, "pred_ite_lower", "pred_ite_upper", "pred_propensity", c.treatment, "pred_y0", "pred_y1", y0, y1)


def semi_synthetic(df: DataFrame, c: Columns, specs: list[FeatureSpec], treatment: simulation.Equation, outcome: simulation.Equation, arms: dict[str, dict], repeats: int = 1, dgp: int = 0, seed: int = 7) -> DataFrame:
    """dgp_index, repeat_index, arm and metrics: treatments and outcomes are drawn again for each repeat by the equations, and each arm, a model with its options, estimates the effects."""
    out = None
    for r in range(repeats):
        drawn = simulation.simulate(df, treatment, outcome, c.key, seed + r)
        for name, how in arms.items():
            options = dict(how)
            row = against_truth(run(options.pop("model"), drawn, c, specs, **options), c)
            row = row.select(F.lit(dgp).alias("dgp_index"), F.lit(r).alias("repeat_index"), F.lit(name).alias("arm"), "*")
            out = row if out is None else out.unionByName(row)
    return out
