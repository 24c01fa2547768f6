"""Queries of folds, joins by row, metrics, simulation, text models, estimators and the job grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions import scalar
from causeway.functions.hashrand import uniform
from causeway.operators import cohort, effects, forest, metrics, pooling, reports, search, simulation, tables, textmodels
from causeway.operators.encoding import FeatureSpec
from causeway.plans import arms, cohorts, store
from causeway.plans.cohorts import ORDERS_SQL
from causeway.plans.registry import query, rounded, u
from causeway.sources.tables import table

# folds and rows


def _nested_sql(outer: int, inner: int) -> str:
    fold = lambda seed, key, k: f"CAST((row_number() OVER (ORDER BY {u(seed, key)}, {key}) - 1) * {k} // count(*) OVER () + 1 AS INTEGER)"
    parts = [f"SELECT c_custkey, {fold(repr(str(42 + 1000 * f)), 'c_custkey', inner)} AS inner_fold, {f} AS outer_fold FROM dealt WHERE cv_fold <> {f}" for f in range(1, outer + 1)]
    return f"WITH dealt AS (SELECT c_custkey, {fold(repr('42'), 'c_custkey', outer)} AS cv_fold FROM customer) " + " UNION ALL ".join(parts)


@query(_nested_sql(3, 2))
def p7_nested_folds(spark, d):
    return cohort.nested_folds(table(spark, d, "customer").select("c_custkey"), "c_custkey", 3, 2)


@query(
    f"SELECT unit_id, round((sum(y) OVER () - sum(y) OVER (PARTITION BY f)) / (count(*) OVER () - count(*) OVER (PARTITION BY f)), 4) AS predicted FROM (SELECT unit_id, y, (row_number() OVER (ORDER BY {u('42', 'unit_id')}, unit_id) - 1) * 4 // count(*) OVER () AS f FROM units)",
    ORDERS_SQL,
)
def p8_u1_out_of_fold(spark, d):
    df = cohort.folds(cohorts.orders(spark, d).select("unit_id", "y"), "unit_id", 4)
    mean = lambda f: df.where(F.col("cv_fold") != f).agg(F.round(F.avg("y"), 4).alias("predicted"))
    parts = [df.where(F.col("cv_fold") == f).select("unit_id").join(F.broadcast(mean(f))) for f in range(1, 5)]  # one row
    return cohort.out_of_fold(df.select("unit_id"), parts, "unit_id")


@query("SELECT source, count(*) AS n FROM documents WHERE lang IN ('en', 'de') GROUP BY source")
def p1_splits_together(spark, d):
    return cohort.load_dataset(spark, f"{d}/documents.parquet", ["en", "de"], "lang").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT unit_id, round(e, 9) AS e FROM units", ORDERS_SQL)
def p3_overlap_fallback(spark, d):
    """No propensity is within the band, so all finite ones stay."""
    return rounded(cohort.overlap_filter(cohorts.orders(spark, d), 1.5, 1.6, "e").select("unit_id", "e"), 9)


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def j2_t1_joined_by_row(spark, d):
    o = table(spark, d, "orders")
    out = tables.joined_by_row(o.select("o_orderkey", "o_totalprice"), o.select("o_orderkey", "o_orderstatus").orderBy(F.desc("o_orderkey")), "o_orderkey")
    return tables.ordered(out, "o_orderkey")


@query(
    "SELECT a.c_nationkey AS c_nationkey, a.band AS band, round(a.m, 4) AS mean_a, round(b.m, 4) AS mean_b FROM (SELECT c_nationkey, band, avg(y) AS m FROM units WHERE t = 1 GROUP BY ALL) a JOIN (SELECT c_nationkey, band, avg(y) AS m FROM units WHERE t = 0 GROUP BY ALL) b USING (c_nationkey, band)",
    ORDERS_SQL,
)
def j1_arms_joined(spark, d):
    """The results of two arms side by side, by the keys of a run, with a suffix each."""
    one = lambda a, s: cohorts.orders(spark, d).where(F.col("t") == a).groupBy("c_nationkey", "band").agg(F.round(F.avg("y"), 4).alias(f"mean_{s}"))
    return one(1, "a").join(one(0, "b"), ["c_nationkey", "band"])


@query("SELECT unit_id, round(least(0.5, e) + 0.1, 6) AS a, round(c_nationkey, 6)::DOUBLE AS b, 2 AS width FROM units", ORDERS_SQL)
def h10_stacked(spark, d):
    v = tables.stacked(F.array(F.least(F.lit(0.5), F.col("e")) + 0.1), None, F.array("c_nationkey"))
    return cohorts.orders(spark, d).select("unit_id", F.round(F.get(v, 0), 6).alias("a"), F.get(v, 1).alias("b"), F.size(v).alias("width"))


@query(
    "SELECT c_custkey, name, value, value IS NULL AS missing FROM (SELECT c_custkey, 'segment' AS name, nullif(c_mktsegment, 'BUILDING') AS value FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer)"
)
def h8_h13_long_features(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("explicit_conf_segment"), F.col("c_nationkey").alias("llm_extracted_nation"))
    return tables.long_features(tables.coalesced_features(c, ["segment", "nation"]), "c_custkey", ["segment", "nation"])


# statistics


@query(
    "SELECT round(avg(pow(e - truth, 2)), 9) AS mse, round(avg(abs(e - truth)), 9) AS mae, round(corr(e, truth), 9) AS corr, round(abs(avg(e) - avg(truth)), 9) AS ate_bias, round(avg(CAST(truth BETWEEN e - 0.5 AND e + 0.5 AS INTEGER)), 9) AS coverage, "
    "round(avg(e + 0.5 - (e - 0.5)), 9) AS width, round(avg(e), 9) AS ate_pred, round(avg(truth), 9) AS ate_true, round(avg(pow(0.5 - y_high, 2)), 9) AS y0_mse, round(avg(pow(e - y_high, 2)), 9) AS y1_mse, round(sqrt(avg(pow(e - truth, 2))), 9) AS pehe, "
    "round(corr(ra, rb), 9) AS spearman, round((sum(ra) FILTER (t = 1) - count(*) FILTER (t = 1) * (count(*) FILTER (t = 1) + 1) / 2) / count(*) FILTER (t = 1) / count(*) FILTER (t = 0), 9) AS propensity_auroc FROM (SELECT *, "
    "rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2 AS ra, rank() OVER (ORDER BY truth) + (count(*) OVER (PARTITION BY truth) - 1) / 2 AS rb FROM (SELECT *, c_acctbal / 10000 AS truth FROM units))",
    ORDERS_SQL,
)
def a12_all_effect_metrics(spark, d):
    df = cohorts.orders(spark, d).withColumns({"lo": F.col("e") - 0.5, "hi": F.col("e") + 0.5, "truth": F.col("c_acctbal") / 10000, "half": F.lit(0.5)})
    return rounded(metrics.all_effect_metrics(df, "e", "truth", "lo", "hi", "e", "t", "half", "e", "y_high", "y_high"), 9)


@query(
    "SELECT 'balance' AS feature, round(corr(found, c_acctbal), 9) AS correlation, round(avg(abs(found - c_acctbal)), 6) AS mae, round(sqrt(avg(pow(found - c_acctbal, 2))), 6) AS rmse, count(found) AS n, round(count(found) / count(*), 9) AS coverage FROM (SELECT c_acctbal, CASE WHEN c_custkey % 10 > 0 THEN c_acctbal + c_custkey % 7 END AS found FROM customer)"
)
def a19_extraction_errors(spark, d):
    df = table(spark, d, "customer").withColumn("found", F.when(F.col("c_custkey") % 10 > 0, F.col("c_acctbal") + F.col("c_custkey") % 7))
    out = reports.extraction_errors(df, {"balance": ("found", "c_acctbal")})
    return out.select("feature", F.round("correlation", 9).alias("correlation"), F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), "n", F.round("coverage", 9).alias("coverage"))


@query("SELECT round(e * (1 - e) / avg(e * (1 - e)) OVER (), 6) AS weight, unit_id FROM units WHERE e * (1 - e) > 1e-4", ORDERS_SQL)
def g9_overlap_weights(spark, d):
    return effects.with_overlap_weights(cohorts.orders(spark, d), "e").select("unit_id", F.round("weight", 6).alias("weight"))


@query("SELECT band, round(pow(avg((y_high - 0.5) * (t / c - (1 - t) / (1 - c))), 2), 9) AS moment FROM (SELECT *, greatest(least(e, 0.999), 0.001) AS c FROM units) GROUP BY band", ORDERS_SQL)
def g8_targeted_moment(spark, d):
    return rounded(cohorts.orders(spark, d).groupBy("band").agg(effects.targeted_moment(F.col("y_high"), F.col("t"), F.col("e"), F.lit(0.5)).alias("moment")), 9)


@query("SELECT round(quantile_cont(o_totalprice, 0.01), 6) AS low, round(quantile_cont(o_totalprice, 0.5), 6) AS middle, round(quantile_cont(o_totalprice, 0.999), 6) AS high FROM orders")
def g12_exact_quantiles(spark, d):
    from causeway.operators.quantiles import quantiles

    q = quantiles(table(spark, d, "orders"), "o_totalprice", [0.01, 0.5, 0.999])
    return q.select(*[F.round(F.get("q", i), 6).alias(n) for i, n in enumerate(("low", "middle", "high"))])


@query(
    "SELECT candidate, round(gain, 6) AS r_loss_improvement, 0.0::DOUBLE AS outcome_auroc_delta, round(treatment_delta, 6) AS treatment_auroc_delta, round(better, 6) AS improved_fold_fraction, gain >= 0.01 AND treatment_delta >= -0.02 AND better >= 0.6 AS passes_acceptance FROM ("
    "SELECT x.s AS candidate, (b.loss - avg(x.loss)) / greatest(abs(b.loss), 1e-8) AS gain, avg(x.ta) - b.ta AS treatment_delta, avg(CAST(x.loss < o.loss AS INTEGER)) AS better FROM m x JOIN (SELECT band, loss FROM m WHERE s = 'AUTOMOBILE') o USING (band), (SELECT avg(loss) AS loss, avg(ta) AS ta FROM m WHERE s = 'AUTOMOBILE') b "
    "WHERE x.s <> 'AUTOMOBILE' GROUP BY x.s, b.loss, b.ta)",
    ORDERS_SQL,
    "m AS (SELECT c_mktsegment AS s, band, avg(pow(y_high - e, 2)) AS loss, avg(e) AS ta FROM units GROUP BY ALL)",
)
def a17_compared_candidates(spark, d):
    """Segments stand for candidates and bands for folds; the first segment is the baseline."""
    s = F.col("c_mktsegment")
    rows = cohorts.orders(spark, d).groupBy(F.when(s != "AUTOMOBILE", s).alias("candidate"), F.col("band").alias("fold")).agg(F.avg((F.col("y_high") - F.col("e")) * (F.col("y_high") - F.col("e"))).alias("r_loss"), F.lit(0.7).alias("outcome_auroc"), F.avg("e").alias("treatment_auroc"))
    return rounded(search.compared(rows))


@query("SELECT unit_id AS name, round(e, 6) AS gain FROM units WHERE e >= 0.2 AND band >= 1 ORDER BY round(e, 6) DESC, unit_id LIMIT 1", ORDERS_SQL)
def t4_best_candidate(spark, d):
    c = cohorts.orders(spark, d).select(F.col("unit_id").alias("name"), F.col("unit_id").alias("pos"), F.round("e", 6).alias("gain"), F.lit(0.0).alias("outcome_drop"), F.lit(0.0).alias("treatment_drop"), F.when(F.col("band") >= 1, 1.0).otherwise(0.0).alias("share_better"))
    return search.accepted(c, 0.2, 0.02, 0.6).select("name", "gain")


@query(
    "SELECT label, CAST(dim - 1 AS INTEGER) AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(max(x), 6) AS max, round(min(x), 6) AS min FROM (SELECT label, generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE vec_id % 3 <> 0) GROUP BY ALL"
)
def m24_masked_pooling(spark, d):
    e = table(spark, d, "embeddings").withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    return rounded(reports.stat_pooling(e, "label", "embedding", "mask"))


@query(
    "SELECT label, dim, round(sum(w * x) / sum(w), 6) AS pooled FROM (SELECT label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x, exp(CAST(embedding[1] AS DOUBLE) * 4) AS w FROM embeddings) GROUP BY ALL"
)
def w8_attention_pooling(spark, d):
    out = tables.attention_pooled(table(spark, d, "embeddings"), "label", "vec_id", "embedding", F.get("embedding", 0).cast("double") * 4)
    return rounded(out.select("label", F.posexplode("pooled").alias("dim", "pooled")))


# simulation


SPECS = [FeatureSpec("x1", "continuous"), FeatureSpec("group", "categorical", ("a", "b", "c"))]
STATS = {"x1": {"mean": 2.0, "std": 3.0}, "group": {"proportions": {"a": 2.0, "b": 1.0, "c": 1.0}}}


@query(
    f"SELECT c_custkey, round(2 + 3 * sqrt(-2 * ln(greatest({u(repr('1'), repr('x1'), 'c_custkey', repr('a'))}, 1e-12))) * cos(2 * 3.141592653589793 * {u(repr('1'), repr('x1'), 'c_custkey', repr('b'))}), 6) AS x1, CASE WHEN {u(repr('1'), repr('group'), 'c_custkey')} < 0.5 THEN 'a' WHEN {u(repr('1'), repr('group'), 'c_custkey')} < 0.75 THEN 'b' ELSE 'c' END AS \"group\" FROM customer"
)
def m18_sampled_characteristics(spark, d):
    return rounded(simulation.sampled(table(spark, d, "customer").select("c_custkey"), SPECS, STATS, "c_custkey"))


def _base(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("unit_id"), (F.col("c_acctbal") / 5000).alias("x1"), (F.col("c_nationkey") / 12.0 - 1).alias("x2"))


BASE_SQL = "base AS (SELECT c_custkey AS unit_id, c_acctbal / 5000 AS x1, c_nationkey / 12.0::DOUBLE - 1 AS x2 FROM customer)"


@query("SELECT term, round(b * 2.0 / s, 6) AS coefficient FROM (SELECT unnest(['x1', 'x2', 'x1 x2']) AS term, unnest([0.8::DOUBLE, -0.5, 0.3]) AS b), (SELECT stddev_pop(0.8 * x1 - 0.5 * x2 + 0.3 * x1 * x2) AS s FROM base)", BASE_SQL)
def g3_rescaled_equation(spark, d):
    e = simulation.rescaled(_base(spark, d), simulation.Equation(-1.0, {"x1": 0.8, "x2": -0.5}, {("x1", "x2"): 0.3}), 2.0)
    rows = [*e.main.items(), *((" ".join(k), v) for k, v in e.products.items())]
    return rounded(spark.createDataFrame(rows, "term string, coefficient double"))


@query("SELECT 0.3::DOUBLE AS target, 0.3::DOUBLE AS reached")
def g4_calibrated_intercept(spark, d):
    base = _base(spark, d)
    e = simulation.calibrated(base, simulation.Equation(0.0, {"x1": 0.8, "x2": -0.5}), 0.3)
    return base.agg(F.lit(0.3).alias("target"), F.round(F.avg(scalar.sigmoid(e.compile(base.columns))), 6).alias("reached"))


def _determinant(m: list[list[str]]) -> str:
    a, b, c = m
    return f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {a[1]} * ({b[0]} * {c[2]} - {b[2]} * {c[0]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"


def _learner_sql() -> str:
    z = ["1.0", "x1", "x2"]
    sums = [f"sum(rt * rt * {z[i]} * {z[j]}) + {1e-6 if i == j else 0.0!r} AS a{i}{j}" for i in range(3) for j in range(3)] + [f"sum(rt * ry * {z[i]}) AS b{i}" for i in range(3)]
    matrix = [[f"a{i}{j}" for j in range(3)] for i in range(3)]
    solved = [_determinant([[f"b{i}" if j == k else f"a{i}{j}" for j in range(3)] for i in range(3)]) + " / " + _determinant(matrix) for k in range(3)]
    return f"SELECT unnest(['intercept', 'x1', 'x2']) AS term, unnest([{', '.join(f'round({s}, 6)' for s in solved)}]) AS coefficient FROM (SELECT {', '.join(sums)} FROM (SELECT x1, x2, t - e AS rt, y - (y0 + e * (y1 - y0)) AS ry FROM drawn))"


SIGMOID = "1 / (1 + exp(-({x})))"
DRAWN = (
    f"drawn AS (SELECT *, CAST({u('7', repr('y'), 'unit_id')} < CASE WHEN t = 1 THEN y1 ELSE y0 END AS INTEGER) AS y FROM (SELECT *, CAST({u('7', repr('t'), 'unit_id')} < e AS INTEGER) AS t FROM (SELECT *, "
    f"greatest(least({SIGMOID.format(x='-0.2 + 0.8 * x1 - 0.5 * x2')}, 0.98), 0.02) AS e, {SIGMOID.format(x='0.1 + 0.4 * x1 + 0.3 * x1 * x2')} AS y0, {SIGMOID.format(x='0.1 + 0.4 * x1 + 0.3 * x1 * x2 + 0.5 + 0.7 * x2')} AS y1 FROM base)))"
)
TREATMENT, OUTCOME = simulation.Equation(-0.2, {"x1": 0.8, "x2": -0.5}), simulation.Equation(0.1, {"x1": 0.4}, {("x1", "x2"): 0.3}, effect=0.5, modifiers={"x2": 0.7})


@query(_learner_sql(), BASE_SQL, DRAWN)
def m14_r_learner(spark, d):
    df = simulation.simulate(_base(spark, d), TREATMENT, OUTCOME).withColumn("m", F.col("true_y0") + F.col("true_propensity") * F.col("true_ite"))
    found = simulation.r_learner(df, "outcome", "treatment", "m", "true_propensity", ["x1", "x2"])
    return rounded(spark.createDataFrame(sorted(found.items()), "term string, coefficient double"))


@query("SELECT 'treatment' AS equation, true AS close UNION ALL SELECT 'outcome', true")
def m16_fitted_equations(spark, d):
    """Logistic fits to a simulated cohort: their probabilities are near the true ones, 0.06 on average."""
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit_id"), (F.col("o_totalprice") / 200_000 - 1).alias("x1"), (F.pmod("o_custkey", F.lit(25)) / 12.0 - 1).alias("x2"))
    df = simulation.simulate(base, TREATMENT, OUTCOME).persist()
    t = simulation.fitted_equation(df, "treatment", ["x1", "x2"])
    y = simulation.fitted_equation(df, "outcome", ["x1", "x2"], "treatment", ["x2"])
    off = lambda p, truth: F.avg(F.abs(scalar.sigmoid(p) - F.col(truth)))
    one = df.agg(off(t.compile(df.columns), "true_propensity").alias("treatment"), off(y.compile(df.columns, F.lit(1.0)), "true_y1").alias("outcome"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("equation"), (F.col(c) < 0.06).alias("close")) for c in ("treatment", "outcome")])).alias("x")).select("x.*")


@query("SELECT 'x1' AS term UNION ALL SELECT 'x2' UNION ALL SELECT 'x1 x2' UNION ALL SELECT 'effect x2'")
def m19_random_equation(spark, d):
    """Terms of a seeded equation after unknown names are taken out."""
    e = simulation.checked(simulation.random_equation(["x1", "x2", "gone"], ["x2", "gone"], products=3), ["x1", "x2"])
    rows = [*e.main, *(" ".join(k) for k in e.products), *(f"effect {k}" for k in e.modifiers)]
    return spark.createDataFrame([(r,) for r in rows], "term string")


@query("SELECT pick, names FROM (VALUES ('both', 'a,b'), ('modifiers', 'b,d'), ('first', 'a,b,c')) AS t(pick, names)")
def a32_exact_counts(spark, d):
    s = [FeatureSpec("a", "continuous", roles=("confounder",)), FeatureSpec("b", "continuous"), FeatureSpec("c", "continuous", roles=("confounder",)), FeatureSpec("d", "continuous", roles=("effect_modifier",))]
    picks = {"both": search.exact_counts(s, 2, 2, 1), "modifiers": search.exact_counts(s, 2, 1, 2), "first": search.exact_counts(s, 3)}
    return spark.createDataFrame([(k, ",".join(x.name for x in v)) for k, v in picks.items()], "pick string, names string")


@query("SELECT strategy, names FROM (VALUES ('true_first', 'a,b,c,d'), ('modifiers_first', 'c,b,d,a'), ('mixed', 'a,c,b,d'), ('distractors', 'd,c,b,a'), ('none', '')) AS t(strategy, names)")
def e5_starting_features(spark, d):
    meta = {"confounders": [{"name": "a", "type": "continuous"}, {"name": "b", "type": "continuous"}], "effect_modifiers": [{"name": "c", "type": "continuous"}, {"name": "b", "type": "continuous"}]}
    left, right = search.specs_of(meta, "confounders"), search.specs_of(meta, "effect_modifiers")
    rows = [(k, ",".join(s.name for s in search.starting_specs(left, right, [FeatureSpec("d", "continuous")], 4, k))) for k in ("true_first", "modifiers_first", "mixed", "distractors", "none")]
    return spark.createDataFrame(rows, "strategy string, names string")


# job grid


OPTIONS = {"dataset": ["one", "two"], "model": ["explicit_forest", "tfidf_forest"], "length": [100, 400, 900]}
GRID_SQL = "grid AS (SELECT * FROM (SELECT unnest(['one', 'two']) AS dataset), (SELECT unnest(['explicit_forest', 'tfidf_forest']) AS model), (SELECT unnest(['100', '400', '900']) AS length) WHERE NOT (model = 'explicit_forest' AND length <> '100'))"


@query("SELECT dataset, model, length FROM grid", GRID_SQL)
def j9_job_grid(spark, d):
    return store.job_grid(spark, OPTIONS, "model = 'explicit_forest' AND length <> '100'").drop("job")


@query(
    "SELECT dataset, model, length, substr(md5('{\"dataset\":\"' || dataset || '\",\"length\":\"' || length || '\"}'), 1, 12) AS cache_key, CAST(length AS DOUBLE) AS size FROM grid",
    GRID_SQL,
)
def e4_execution_order(spark, d):
    out = store.execution_order(store.job_grid(spark, OPTIONS, "model = 'explicit_forest' AND length <> '100'"), ["dataset", "length"], "length")
    return out.select("dataset", "model", "length", "cache_key", F.col("turn.size").alias("size"))


# text models


@query("SELECT count(*) AS n, true AS leading, true AS bounded FROM documents")
def m2_text_svd(spark, d):
    """Coordinates of unit vectors on orthonormal directions: rows are no longer than 1, and the first direction holds the most."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = textmodels.text_svd(docs, docs, "doc_id", "text", dims=4, size=2000)
    square = lambda i: F.sum(F.col(f"svd_{i}") * F.col(f"svd_{i}"))
    longest = F.max(sum((F.col(f"svd_{i}") * F.col(f"svd_{i}") for i in range(1, 4)), F.col("svd_0") * F.col("svd_0")))
    return out.agg(F.count("*").alias("n"), (square(0) >= square(3)).alias("leading"), (longest <= 1 + 1e-9).alias("bounded"))


@query(
    "SELECT c_custkey, round((coalesce(b, m) - avg(coalesce(b, m)) OVER ()) / stddev_pop(coalesce(b, m)) OVER (), 6) AS cand_balance, CAST(coalesce(s, 'x') = 'x' AS DOUBLE) AS x, CAST(coalesce(s, 'x') = 'y' AS DOUBLE) AS y FROM raw, (SELECT quantile_cont(b, 0.5) AS m FROM raw)",
    "raw AS (SELECT c_custkey, CASE WHEN c_custkey % 9 > 0 THEN c_acctbal END AS b, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'y' ELSE 'x' END AS s FROM customer)",
)
def m3_candidate_encoder(spark, d):
    k = F.col("c_custkey")
    df = table(spark, d, "customer").select("c_custkey", F.when(k % 9 > 0, F.col("c_acctbal")).alias("cand_balance"), F.when(k % 5 == 1, "y").when(k % 5 > 1, "x").alias("cand_s"))
    out = df.select("c_custkey", *textmodels.candidate_columns(df, "cand_"))
    return out.select("c_custkey", F.round("cand_balance", 6).alias("cand_balance"), F.col("`cand_s=x`").alias("x"), F.col("`cand_s=y`").alias("y"))


@query()
def m22_mention_slots(spark, d):
    """Slots of the labels of `Label: value` lines made of part columns."""
    p = table(spark, d, "part")
    lines = F.array(F.struct(F.lit("Brand").alias("label"), F.col("p_brand").alias("value")), F.struct(F.lit("Size").alias("label"), F.col("p_size").cast("string").alias("value")), F.struct(F.lit("Retail price").alias("label"), F.col("p_retailprice").cast("string").alias("value")))
    m = p.select("p_partkey", F.explode(lines).alias("m")).select("p_partkey", "m.*")
    return textmodels.slot_features(m, "p_partkey", textmodels.mention_slots(m, 3), top=2)


@query("SELECT vec_id, true AS same FROM embeddings")
def g13_v6_projected_vectors(spark, d):
    """Vectors times a seeded matrix, and whether each is what NumPy makes of it by a second way."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    matrix = textmodels.projection("model", 64, 8)
    first = F.aggregate(F.zip_with("embedding", F.array(*[F.lit(float(x)) for x in matrix[:, 0]]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return e.join(textmodels.projected(e, "vec_id", "embedding", matrix), "vec_id").select("vec_id", (F.abs(F.get("projected", 0) - first) < 1e-9).alias("same"))


# estimators, against the truth of a simulated cohort over all orders


FEATURES = [FeatureSpec("x1", "continuous", roles=("confounder", "effect_modifier")), FeatureSpec("x2", "continuous", roles=("confounder", "effect_modifier"))]
COHORT = arms.Columns()
FEW = {"folds": 2, "bags": 6, "learner": "linear"}  # two folds halve the models to fit


def _cohort(spark, d):
    """x2 stands in the text too, in words."""
    o = table(spark, d, "orders")
    x2 = F.floor(uniform(F.lit(3), F.col("o_orderkey")) * 5) / 2.0 - 1
    base = o.select(F.col("o_orderkey").alias("unit_id"), ((F.col("o_totalprice") - 150_000) / 80_000).alias("x1"), x2.alias("x2"))
    word = F.element_at(F.array(*[F.lit(w) for w in ("lowest", "low", "middle", "high", "highest")]), (F.col("x2") * 2 + 3).cast("int"))
    base = base.withColumn("text", F.concat(F.lit("the grade was "), word, F.lit(" on that day"))).withColumns({"true_x1": F.col("x1"), "true_x2": F.col("x2")})
    outcome = simulation.Equation(-1.2, {"x1": 0.3}, effect=1.2, modifiers={"x2": 1.5})
    return simulation.simulate(base, simulation.Equation(0.0, {"x1": 0.6, "x2": -0.4}), outcome, positivity=(0.05, 0.95))


BOUNDS = "SELECT (SELECT count(*) FROM orders) AS n, true AS correlated, true AS unbiased"


def _bounds(predictions):
    one = arms.against_truth(predictions, COHORT).join(F.broadcast(predictions.agg(F.count("*").alias("n"))))  # one row
    return one.select("n", (F.col("corr") > 0.5).alias("correlated"), (F.col("ate_bias") < 0.05).alias("unbiased"))


@query(BOUNDS)
def m8_explicit_forest(spark, d):
    return _bounds(arms.explicit_forest(_cohort(spark, d), COHORT, FEATURES, **FEW))


@query(BOUNDS)
def m9_m11_tfidf_forest(spark, d):
    """The modifier is known from the text alone."""
    return _bounds(arms.tfidf_forest(_cohort(spark, d), COHORT, [FeatureSpec("x1", "continuous", roles=("confounder",))], dims=5, **FEW))


@query(BOUNDS)
def m10_confounder_forest(spark, d):
    specs = [*FEATURES, FeatureSpec("absent", "continuous", roles=("effect_modifier",))]  # left out, so no column is asked for
    return _bounds(arms.confounder_forest(_cohort(spark, d), COHORT, specs, **FEW))


@query(BOUNDS)
def m20_best_attainable(spark, d):
    return _bounds(arms.best_attainable(_cohort(spark, d), COHORT, FEATURES, **FEW))


@query(BOUNDS)
def m13_two_models(spark, d):
    return _bounds(arms.two_models(_cohort(spark, d), COHORT, FEATURES, folds=2))


GATE = pooling.Gate.drawn(64, 3, 1)


def _gate_sql() -> str:
    dot = lambda w: f"list_dot_product(x, [{', '.join(repr(float(c)) for c in w)}])"
    each = [f"(2 / (1 + exp(-2 * ({dot(GATE.content[:, k])} + {float(GATE.content_bias[k])!r}))) - 1) / (1 + exp(-({dot(GATE.gate[:, k])} + {float(GATE.gate_bias[k])!r}))) AS g{k}" for k in range(3)]
    weight = (GATE.mix @ GATE.slots)[:, 0]
    score = " + ".join(f"(g{k} - mean) / sqrt(((g0 - mean) ^ 2 + (g1 - mean) ^ 2 + (g2 - mean) ^ 2) / 3 + 1e-5) * {float(weight[k])!r}" for k in range(3))
    return f"""WITH v AS (SELECT label, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL), g AS (SELECT label, x, {', '.join(each)} FROM v),
    s AS (SELECT label, x, {score} AS s FROM (SELECT *, (g0 + g1 + g2) / 3 AS mean FROM g)), w AS (SELECT label, x, exp(s - max(s) OVER (PARTITION BY label)) AS w FROM s)
    SELECT label, CAST(dim AS INTEGER) AS dim, round(sum(w * c) / sum(w), 6) AS value FROM (SELECT label, w, unnest(x) AS c, generate_subscripts(x, 1) - 1 AS dim FROM w) GROUP BY label, dim"""


@query(_gate_sql())
def w8_gated_pooling(spark, d):
    """Vectors of a label pooled by a gate of three components and one slot."""
    pooled = pooling.gated(table(spark, d, "embeddings"), "label", "embedding", GATE)
    return pooled.select("label", F.posexplode("pooled").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(BOUNDS)
def m15_linear_effects(spark, d):
    return _bounds(arms.linear_effects(_cohort(spark, d), COHORT, FEATURES, folds=2))


@query("SELECT (SELECT count(*) FROM orders) AS n, true AS unbiased")
def m12_contrastive_effects(spark, d):
    """Effects by propensity bin are coarse, their mean is not."""
    return _bounds(arms.contrastive_effects(_cohort(spark, d), COHORT, FEATURES, folds=2)).drop("correlated")


@query("SELECT (SELECT count(*) FROM orders) AS n, true AS near_propensity, true AS near_outcome")
def m5_nuisance_forests(spark, d):
    df = forest.crossfit(_cohort(spark, d), "unit_id", "treatment", "outcome", ["x1", "x2"], learner="forest")
    m = F.col("true_y0") + F.col("true_propensity") * F.col("true_ite")
    return df.agg(F.count("*").alias("n"), (F.avg(F.abs(F.col("e_hat") - F.col("true_propensity"))) < 0.08).alias("near_propensity"), (F.avg(F.abs(F.col("m_hat") - m)) < 0.08).alias("near_outcome"))


@query("SELECT 0 AS dgp_index, repeat_index, arm, true AS correlated FROM (SELECT unnest([0]) AS repeat_index), (SELECT unnest(['linear', 'two_models']) AS arm)")
def m21_semi_synthetic_arms(spark, d):
    base = _cohort(spark, d).select("unit_id", "x1", "x2", "text")
    out = arms.semi_synthetic(base, COHORT, FEATURES, simulation.Equation(0.0, {"x1": 0.6}), simulation.Equation(-1.2, {"x1": 0.3}, effect=1.2, modifiers={"x2": 1.5}), {"linear": {"model": "linear_effects", "folds": 2}, "two_models": {"model": "two_models", "folds": 2}}, repeats=1)
    return out.select("dgp_index", "repeat_index", "arm", (F.col("corr") > 0.5).alias("correlated"))
