"""Cross-fitted nuisances and an honest causal forest with intervals.

Nuisances: for each fold a Spark ML model (linear or a forest) fitted on the other folds scores it. Causal forest: each bag draws a subsample by
hash, half of all rows whatever their number; its trees split one half of theirs to spread the residual-on-residual effect and estimate leaves
on the other (honesty). They are grown level by level from histograms (`tree_growth`), so no task holds a bag. The trees, bounded by their number
and depth, travel with the scoring function; the spread between bags gives the interval. Effects are scored out of fold: a fold's rows by a
forest that has not seen them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.hashrand import uniform
from causeway.functions.workers import by_value
from causeway.operators import tree_growth
from causeway.operators.tree_growth import Tree

by_value(__name__)


def crossfit(df: DataFrame, key: str, treatment: str, outcome: str, features: list[str], k: int = 3, binary_outcome: bool = True, seed: int = 42, clip: tuple[float, float] = (0.01, 0.99), learner: str = "linear", fold: str | None = None) -> DataFrame:
    """df with cv_fold, e_hat and m_hat, predicted by models that saw other folds only. A fold whose training rows have one class gets their mean.

    learner: linear (logistic for classes) or forest. fold names a column of folds from 1 to k to use instead of drawing them. Training reads
    cached rows, the result is computed from df when it is asked for.
    """
    from pyspark.ml.feature import VectorAssembler

    folded = df.withColumn("cv_fold", F.col(fold).cast("int") if fold else F.floor(uniform(F.lit(seed), F.col(key)) * k).cast("int") + 1)
    ready = VectorAssembler(inputCols=features, outputCol="__x").transform(folded).persist()
    try:
        parts = []
        for f in range(1, k + 1):
            train, test = ready.where(F.col("cv_fold") != f), ready.where(F.col("cv_fold") == f)
            for target, out, binary in ((treatment, "e_hat", True), (outcome, "m_hat", binary_outcome)):
                test = scored(train, test, target, out, binary, learner, seed)
            parts.append(test)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.withColumn("e_hat", F.greatest(F.least("e_hat", F.lit(clip[1])), F.lit(clip[0]))).drop("__x")
    finally:
        ready.unpersist()


def scored(train: DataFrame, test: DataFrame, target: str, out: str, binary: bool, learner: str = "linear", seed: int = 42) -> DataFrame:
    """test with `out`, the probability or value of target by a model of train; both have the vector __x."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor

    n, mean, kinds = train.agg(F.count("*"), F.avg(target), F.countDistinct(target)).first()
    if not n or kinds < 2:
        return test.withColumn(out, F.lit(float(mean or 0.0)))
    named = dict(featuresCol="__x", labelCol=target, predictionCol="__p") | (dict(probabilityCol="__q", rawPredictionCol="__r") if binary else {})
    if learner == "forest":
        model = (RandomForestClassifier if binary else RandomForestRegressor)(numTrees=40, maxDepth=6, minInstancesPerNode=10, seed=seed, **named)
    else:
        model = (LogisticRegression if binary else LinearRegression)(regParam=1.0 / n, maxIter=50, **named)
    return model.fit(train).transform(test).withColumn(out, vector_to_array("__q")[1] if binary else F.col("__p")).drop("__p", "__q", "__r")


def fit_forest(df: DataFrame, key: str, y: str, t: str, m: str, e: str, x: list[str], bags: int = 24, trees: int = 4, depth: int = 6, leaf: int = 20, seed: int = 1, grid: list[tuple[int, int]] | None = None) -> list[list[Tree]]:
    """Trees by bag. Rows with a null or non-finite value in any used column are left out; a table without rows gives no tree.

    grid: pairs of depth and leaf to choose from by the residual loss on rows outside of a bag; the trees are grown once, as deep as any pair asks.
    """
    if grid:
        depth, leaf = max(d for d, _ in grid), min(n for _, n in grid)
    names = [f"__x{i}" for i in range(len(x))]
    rows = df.select(F.col(key).cast("long").alias("__key"), (F.col(y) - F.col(m)).cast("double").alias("__ry"), (F.col(t) - F.col(e)).cast("double").alias("__rt"), *[F.col(c).cast("double").alias(n) for c, n in zip(x, names, strict=True)]).dropna()
    if rows.isEmpty():
        return []
    forest, table = tree_growth.grow(rows, names, bags, trees, depth, leaf, seed)
    return tree_growth.tuned(forest, table, names, grid, seed)[0] if grid else forest


def predict_forest(df: DataFrame, forest: list[list[Tree]], x: list[str], level_z: float = 1.959963984540054) -> DataFrame:
    """df with pred_ite, pred_ite_lower and pred_ite_upper. The variance between bags, less what their few trees add, gives the interval; a quarter of it at least, as the difference of two noisy numbers can be near 0."""
    from pyspark.sql import types as T

    packed = [[g.__dict__ for g in bag] for bag in forest]
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("pred_ite", "pred_ite_lower", "pred_ite_upper")]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [[Tree(**g) for g in bag] for bag in packed]
        for pdf in batches:
            a = pdf[x].to_numpy(float)
            each = np.array([[g.predict(a) for g in bag] for bag in own])
            means = each.mean(1)
            tau = means.mean(0)
            within = each.var(1, ddof=1).mean(0) / each.shape[1] if each.shape[1] > 1 else 0.0
            between = means.var(0, ddof=1) if len(own) > 1 else np.zeros(len(a))
            sd = np.sqrt(np.maximum(between - within, between / 4))
            yield pdf.assign(pred_ite=tau, pred_ite_lower=tau - level_z * sd, pred_ite_upper=tau + level_z * sd)

    return df.mapInPandas(run, schema)


def out_of_fold(df: DataFrame, key: str, y: str, t: str, x: list[str], k: int, **how) -> DataFrame:
    """df (with cv_fold, e_hat and m_hat) with pred_ite and its interval, each fold's from a forest of the other folds."""
    out = None
    for f in range(1, k + 1):
        trees = fit_forest(df.where(F.col("cv_fold") != f), key, y, t, "m_hat", "e_hat", x, **how)
        part = predict_forest(df.where(F.col("cv_fold") == f), trees, x) if trees else df.where(F.col("cv_fold") == f).withColumns({c: F.lit(None).cast("double") for c in ("pred_ite", "pred_ite_lower", "pred_ite_upper")})
        out = part if out is None else out.unionByName(part)
    return out
