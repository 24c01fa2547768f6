"""Result documents, grids, datasets and caches go out and come back."""

import hashlib
import re

import numpy as np
import pytest
from causeway.operators import embedding, encoding, forest, simulation, textmodels
from causeway.plans import arms, store
from pyspark.sql import functions as F


def test_results_and_resume(spark, tmp_path):
    folder = str(tmp_path / "results")
    grid = store.job_grid(spark, {"dgp": [0, 1], "arm": ["a", "b"]})
    assert grid.count() == 4 and store.remaining(spark, grid, folder, ["dgp", "arm"]).count() == 4
    store.save_result(spark, {"dgp": "0", "arm": "a", "config": {"x": 1}, "metrics": {"corr": 0.5}}, folder, ["dgp", "arm"])
    store.save_result(spark, {"dgp": "0", "arm": "a", "config": {"x": 2}, "metrics": {"corr": 0.7}}, folder, ["dgp", "arm"])  # again
    store.save_result(spark, {"dgp": "1", "arm": "b", "config": {"x": 1}, "metrics": {"mse": 0.1}}, folder, ["dgp", "arm"])
    left = {(r.dgp, r.arm) for r in store.remaining(spark, grid, folder, ["dgp", "arm"]).collect()}
    assert left == {("0", "b"), ("1", "a")}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "one.json").write_text('{"config": {"m": "x"}, "metrics": {"corr": 0.1}, "skipped": false}')
    (tmp_path / "docs" / "two.json").write_text('{"config": {"m": "y"}, "metrics": {"mse": 0.2}}')
    (tmp_path / "docs" / "three.json").write_text('{"config": {"m": "z"}, "metrics": {"mse": 0.2}, "skipped": true}')
    out = store.load_results(spark, str(tmp_path / "docs"))
    assert sorted((r.m, r["corr"], r.mse) for r in out.collect()) == [("x", 0.1, None), ("y", None, 0.2)]
    summary = store.aggregate(out, ["m"], "mse", str(tmp_path / "all"))
    assert summary.count() == 2 and spark.read.parquet(str(tmp_path / "all" / "all_results.parquet")).count() == 2
    log = store.fold_log([spark.createDataFrame([(1, 0.5)], "fold int, loss double"), spark.createDataFrame([(2, 0.6, 1.0)], "fold int, loss double, auc double")], str(tmp_path / "log"))
    assert log.count() == 2 and spark.read.csv(str(tmp_path / "log"), header=True).columns == ["fold", "loss", "auc"]
    with pytest.raises(ValueError, match="unknown model"):
        arms.run("x", out, arms.Columns(), [])


def test_execution_order(spark):
    jobs = store.job_grid(spark, {"dataset": ["a", "b"], "length": [900, 100], "model": ["m", "n"]})
    rows = store.execution_order(jobs, ["dataset", "length"], "length").orderBy("turn").collect()
    assert [r.length for r in rows] == ["100"] * 4 + ["900"] * 4
    keys = [r.cache_key for r in rows]
    assert all(keys[i] == keys[i + 1] for i in range(0, 8, 2)) and len(set(keys)) == 4


def test_dataset_and_cache(spark, tmp_path):
    specs = [encoding.FeatureSpec("x", "continuous", roles=("confounder",))]
    df = spark.createDataFrame([(1, "abc", 1, 0), (2, "abcde", 0, 1)], "id long, text string, t int, y int")
    written = store.write_dataset(df, str(tmp_path / "d"), {"treatment": {"intercept": 0.1}}, specs, "t", "y", "text")
    assert store.read_metadata(spark, str(tmp_path / "d")) == written and written["statistics"]["mean_chars"] == 4.0 and written["effect_modifiers"] == []


class Failing(embedding.WordBuckets):
    """Breaks off at a text that holds a word."""

    def __init__(self, width, word):
        super().__init__(width)
        self.word = word

    def client(self):
        ask, word = super().client(), self.word

        def run(texts):
            if any(word in t for t in texts):
                raise RuntimeError("lost")
            return ask(texts)

        return run


def test_vectors_survive_broken_runs_and_changed_texts(spark, tmp_path):
    texts = [(i, " ".join(f"w{(i * 7 + j) % 30}" for j in range(i * 9))) for i in range(12)] + [(20, None), (21, ""), (None, "a b"), (3, "other text of one id"), (5, None)]
    df = spark.createDataFrame([*texts, texts[2]], "id long, text string")
    size, overlap, e = 16, 4, embedding.WordBuckets(8)
    cache = store.VectorCache(spark, str(tmp_path / "v"), e, size, overlap)
    assert not cache.valid(df, "id", "text") and cache.missing(df, "id", "text").count() == len(texts) + 1
    broken = store.VectorCache(spark, str(tmp_path / "v"), Failing(8, "other"), size, overlap)
    assert broken.path == cache.path
    with pytest.raises(Exception, match="lost"):
        broken.fill(df, "id", "text", waves=4)
    left = cache.missing(df, "id", "text").count()
    assert left > 0
    done = cache._stored(df, "id").count()
    cache.fill(df, "id", "text", waves=4)
    assert cache.valid(df, "id", "text") and cache._stored(df, "id").count() == len(texts) and done < len(texts)
    for row in cache.load(df, "id", "text").collect():
        words = re.findall(r"[a-z0-9]+", row.text or "")
        chunks = [words[i : i + size] for i in range(0, max(len(words), 1), size - overlap)]
        want = np.array([np.bincount([int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % 8 for w in c], minlength=8) for c in chunks])
        assert row.offsets == [8 * i for i in range(len(chunks) + 1)]
        assert np.array_equal(np.frombuffer(row.block, "<f2").reshape(-1, 8), want)
    changed = df.withColumn("text", F.when(F.col("id") == 4, "new words").otherwise(F.col("text")))
    assert [r.id for r in cache.missing(changed, "id", "text").collect()] == [4] and not cache.valid(changed, "id", "text")
    assert cache.load(changed, "id", "text").where("block is null").count() == 1
    assert store.VectorCache(spark, str(tmp_path / "v"), e, size, 5).path != cache.path
    out = embedding.unpacked(cache.load(df, "id", "text"), "id")
    assert out.where("id = 11").first().vectors[0] == [float(x) for x in np.frombuffer(cache.load(df, "id", "text").where("id = 11").first().block, "<f2")[:8]]
    assert embedding.embedded(df.limit(0), "id", "text", e).count() == 0


def test_vectors_keep_half_precision(spark):
    class Normal(embedding.WordBuckets):
        def client(self):
            return lambda texts: np.stack([np.random.default_rng(len(t)).normal(size=8) for t in texts])

    class Short(embedding.WordBuckets):
        def client(self):
            return lambda texts: np.zeros((len(texts), 3))

    df = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(5)], "id long, text string")
    for r in embedding.unpacked(embedding.embedded(df, "id", "text", Normal(8), batch=2), "id").collect():
        x = np.random.default_rng(r.id + 1).normal(size=8)
        assert len(r.vectors) == 1 and np.allclose(r.vectors[0], x, rtol=1e-3) and np.array_equal(np.float32(r.vectors[0]), x.astype("f2").astype("f4"))
    with pytest.raises(Exception, match="owes 8"):
        embedding.embedded(df, "id", "text", Short(8)).count()


def test_svd_finds_the_leading_directions(spark):
    r = np.random.default_rng(2)
    words = ["alpha beta", "gamma delta", "zeta eta theta"]
    docs = [(i, " ".join(words[i % 3] for _ in range(3)) + f" w{r.integers(40)} w{r.integers(40)}") for i in range(120)]
    df = spark.createDataFrame(docs, "id long, text string")
    terms = textmodels.fitted_terms(df, "text", least=2)
    n = terms.count()
    vectors = textmodels.term_vectors(df, "id", "text", terms)
    x = np.zeros((120, n))
    for row in vectors.collect():
        x[row.id, row["at"]] = row.x
    assert np.allclose((x**2).sum(1), 1)
    basis = textmodels.svd_basis(vectors, n, 3, rounds=8)
    assert np.allclose(basis.T @ basis, np.eye(3), atol=1e-9)
    s = np.linalg.svd(x, compute_uv=False)[:3]
    assert np.allclose(np.linalg.norm(x @ basis, axis=0), s, rtol=1e-2)
    out = {e.id: [e.svd_0, e.svd_1, e.svd_2] for e in textmodels.embedded(vectors, "id", basis).collect()}
    assert all(np.allclose(out[i], x[i] @ basis) for i in range(120))
    assert textmodels.text_svd(df, df, "id", "text", dims=2, least=1000).agg(F.sum("svd_0")).first()[0] == 0.0


def test_slots_keep_labels_apart(spark):
    rows = [(i, label, value) for i in range(30) for label, value in (("Hemoglobin", f"{i} g/dL"), ("Smoking status", "never"))]
    m = spark.createDataFrame(rows, "id long, label string, value string")
    centres = textmodels.mention_slots(m, 2)
    out = textmodels.slot_features(m, "id", centres, top=2, temperature=0.05).toPandas()
    strong = out[out.presence > 0.9]
    assert len(strong) == 60 and strong.groupby("id").slot.nunique().min() == 2
    hb = strong[(strong.id == 7) & strong.number.notna()]
    assert abs(hb.number.iloc[0] - 7) < 1e-6


def test_a_noise_modifier_shows_no_effect_out_of_fold(spark):
    base = simulation.characteristics(spark, 3000, ["x1", "noise"])
    df = simulation.simulate(base, simulation.Equation(0.0, {"x1": 0.5}), simulation.Equation(-0.5, {"x1": 0.5}, effect=0.8))
    fitted = forest.crossfit(df, "unit_id", "treatment", "outcome", ["x1", "noise"])
    out = forest.out_of_fold(fitted, "unit_id", "outcome", "treatment", ["noise"], 3, bags=4).toPandas()
    assert len(out) == 3000 and out.unit_id.is_unique
    r = (out.outcome - out.m_hat) * (out.treatment - out.e_hat)
    assert abs(np.corrcoef(out.pred_ite, r)[0, 1]) < 0.06  # in sample it would follow the noise it was fitted to
    assert abs(out.pred_ite.mean() - out.true_ite.mean()) < 0.06


def test_equations(spark):
    base = simulation.characteristics(spark, 8000, ["x1", "x2"])
    e = simulation.Equation(-0.3, {"x1": 0.9, "x2": -0.6}, {("x1", "x2"): 0.4})
    scaled = simulation.rescaled(base, e, 2.0)
    assert base.agg(F.stddev_pop(scaled.compile(base.columns))).first()[0] == pytest.approx(2.0) and scaled.intercept == -0.3
    assert simulation.rescaled(base, simulation.Equation(0.5), 2.0) == simulation.Equation(0.5)
    df = simulation.simulate(base, e, simulation.Equation(0.0), positivity=(0.0, 1.0))
    found = simulation.fitted_equation(df, "treatment", ["x1", "x2"], ridge=0.0)
    assert found.main["x1"] == pytest.approx(0.9, abs=0.1) and found.main["x2"] == pytest.approx(-0.6, abs=0.1) and found.products[("x1", "x2")] == pytest.approx(0.4, abs=0.1)
    assert simulation.random_equation(["a", "b"], seed=3) == simulation.random_equation(["a", "b"], seed=3)
    specs = [encoding.FeatureSpec("x", "continuous"), encoding.FeatureSpec("g", "categorical", ("a", "b"), roles=("confounder",))]
    assert simulation.coefficient_names(specs) == ["x", "g_b"] and simulation.coefficient_names(specs, "effect_modifier") == ["x"]


def test_pivot_and_continuous_stats(spark):
    import pandas as pd
    from causeway.operators import metrics, tables

    rows = [("a", "x", 1.0), ("a", "x", 3.0), ("a", "y", float("nan")), ("b", "x", None), ("b", None, 5.0), (None, "y", 7.0)]
    out = {r.g: r for r in metrics.pivot(spark.createDataFrame(rows, "g string, h string, v double"), "g", "h", ["x", "y"], "v").collect()}
    assert (out["a"].x_mean, out["a"].x_n, out["a"].y_mean, out["a"].y_n) == (2.0, 2, None, 0) and out["b"].x_n == 0 and out[None].y_mean == 7.0
    given = [("1", False, "4"), ("2.5", False, "x"), ("9", True, None), ("odd", False, None), (None, None, None)]
    df = spark.createDataFrame(given, "f_a string, f_a_missing boolean, f_b string")
    got = {r.feature: (r.mean, r["std"]) for r in tables.continuous_stats(df, ["a", "b"], "f_").collect()}
    want = pd.Series([1.0, 2.5])
    assert got["a"] == (want.mean(), want.std()) and got["b"] == (4.0, 1e-6)
    none = {r.feature: (r.mean, r["std"]) for r in tables.continuous_stats(df.limit(0), ["a"], "f_").collect()}
    assert none == {"a": (0.0, 1.0)}


def test_ranges_do_not_depend_on_how_cuts_are_searched(spark):
    from causeway.operators import quantiles
    from pyspark.sql import functions as F

    df = spark.range(3000).select((F.pmod(F.xxhash64("id"), F.lit(700)) / 7.0).alias("v")).union(spark.sql("SELECT CAST(NULL AS DOUBLE)"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (8, 97, 1000):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            cuts = df.agg(F.percentile_approx("v", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0]
            assert all(r.b == (0 if r.v is None else sum(c <= r.v for c in cuts)) for r in quantiles.ranged(df, "v", "b").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
