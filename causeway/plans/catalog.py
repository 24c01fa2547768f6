"""Every registered query of the analytics operators, with its SQL for another engine over the same tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from causeway.functions import hashrand, scalar
from causeway.functions.hashrand import uniform
from causeway.operators import cohort, effect_nets, effects, embedding, encoding, extraction, forest, line_matching, matching, metrics, reports, search, simulation, tables, terms
from causeway.plans import cohorts
from causeway.plans.cohorts import LABELLED_SQL, ORDERS_SQL
from causeway.plans.registry import QUERIES, SQL, binomial_cdf_sql, erfc_sql, query, rounded, t_two_sided_sql, u
from causeway.sources.tables import table

# sources and cohorts


@query("SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def nation_order_totals(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT * FROM (SELECT 'text' AS \"column\", count(*) FILTER (text IS NULL) AS nulls FROM documents UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL) FROM documents UNION ALL SELECT 'n_chars', count(*) FILTER (n_chars IS NULL) FROM documents)")
def s2_null_counts(spark, d):
    return cohort.null_counts(table(spark, d, "documents"), ["text", "lang", "n_chars"])


@query("SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source")
def s1_split_scan(spark, d):
    return cohort.load_dataset(spark, f"{d}/documents.parquet", "en", "lang").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (e BETWEEN 0.3 AND 0.4) AS n_kept, count(*) FILTER (e < 0.3) AS n_low, count(*) FILTER (e > 0.4) AS n_high, round(avg(e), 6) AS mean_before, round(stddev_pop(e), 6) AS std_before, round(avg(e) FILTER (e BETWEEN 0.3 AND 0.4), 6) AS mean_after, round(stddev_samp(e) FILTER (e BETWEEN 0.3 AND 0.4), 6) AS std_after FROM units", ORDERS_SQL)
def p2_propensity_trimming(spark, d):
    return rounded(cohort.trimming_report(cohorts.orders(spark, d), 0.3, 0.4, "e"))


@query("SELECT unit_id, round(e, 9) AS e FROM units WHERE e BETWEEN 0.35 AND 0.36", ORDERS_SQL)
def p3_overlap_filter(spark, d):
    return rounded(cohort.overlap_filter(cohorts.orders(spark, d), 0.35, 0.36, "e").select("unit_id", "e"), 9)


@query(f"SELECT o_orderkey, CAST((row_number() OVER (ORDER BY {u('42', 'o_orderkey')}, o_orderkey) - 1) * 5 // count(*) OVER () + 1 AS INTEGER) AS cv_fold FROM orders")
def p5_folds(spark, d):
    return cohort.folds(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5)


@query(f"SELECT unit_id, CAST((row_number() OVER (PARTITION BY t, y_high ORDER BY {u('42', 'unit_id')}, unit_id) - 1) % 5 + 1 AS INTEGER) AS cv_fold FROM units", ORDERS_SQL)
def p6_stratified_folds(spark, d):
    return cohort.folds(cohorts.orders(spark, d), "unit_id", 5, strata=["t", "y_high"]).select("unit_id", "cv_fold")


@query("SELECT unit_id, CASE WHEN count(*) FILTER (t = 1) OVER (PARTITION BY bin) >= 1 AND count(*) FILTER (t = 0) OVER (PARTITION BY bin) >= 1 THEN bin ELSE -1 END AS bin FROM (SELECT unit_id, t, CAST((row_number() OVER (ORDER BY e, unit_id) - 1) * 8 // count(*) OVER () AS INTEGER) AS bin FROM units)", ORDERS_SQL)
def w1_propensity_bins(spark, d):
    return cohort.propensity_bins(cohorts.orders(spark, d), "unit_id", "t", "e", 8).select("unit_id", "bin")


# effects


@query("SELECT round(avg(y) FILTER (t = 1), 4) AS mean_treated, round(avg(y) FILTER (t = 0), 4) AS mean_control, round(avg(y) FILTER (t = 1) - avg(y) FILTER (t = 0), 4) AS difference, count(*) FILTER (t = 1) AS n_treated, count(*) FILTER (t = 0) AS n_control FROM units", ORDERS_SQL)
def a7_crude_difference(spark, d):
    return rounded(effects.crude(cohorts.orders(spark, d), "t", "y"), 4)


@query(
    "SELECT covariate, round(m1, 6) AS mean_treated, round(m0, 6) AS mean_control, round(CASE WHEN sqrt((v1 + v0) / 2) < 1e-10 THEN 0 ELSE abs(m1 - m0) / sqrt((v1 + v0) / 2) END, 6) AS smd FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS covariate, avg({c}) FILTER (t = 1) AS m1, avg({c}) FILTER (t = 0) AS m0, coalesce(var_samp({c}) FILTER (t = 1), 0) AS v1, coalesce(var_samp({c}) FILTER (t = 0), 0) AS v0 FROM units" for c in ("c_acctbal", "c_nationkey", "band"))
    + ")",
    ORDERS_SQL,
)
def a1_balance(spark, d):
    return rounded(effects.balance(cohorts.orders(spark, d), "t", ["c_acctbal", "c_nationkey", "band"]))


@query(
    "SELECT greatest(lo0, lo1) AS low, least(hi0, hi1) AS high, round(i1, 6) AS treated_inside, round(i0, 6) AS control_inside, round(o, 6) AS overlap, round(mean1, 6) AS mean_treated, round(mean0, 6) AS mean_control, round(std1, 6) AS std_treated, round(std0, 6) AS std_control FROM edges, "
    "(SELECT avg(CAST(e BETWEEN greatest(lo0, lo1) AND least(hi0, hi1) AS INTEGER)) FILTER (t = 1) AS i1, avg(CAST(e BETWEEN greatest(lo0, lo1) AND least(hi0, hi1) AS INTEGER)) FILTER (t = 0) AS i0 FROM units, edges), "
    "(SELECT sum(least(c0 / s0, c1 / s1)) AS o FROM (SELECT least(floor(e * 50), 49) AS b, count(*) FILTER (t = 0) AS c0, count(*) FILTER (t = 1) AS c1, sum(count(*) FILTER (t = 0)) OVER () AS s0, sum(count(*) FILTER (t = 1)) OVER () AS s1 FROM units WHERE e BETWEEN 0 AND 1 GROUP BY b))",
    ORDERS_SQL,
    "edges AS (SELECT min(e) FILTER (t = 0) AS lo0, min(e) FILTER (t = 1) AS lo1, max(e) FILTER (t = 0) AS hi0, max(e) FILTER (t = 1) AS hi1, avg(e) FILTER (t = 0) AS mean0, avg(e) FILTER (t = 1) AS mean1, stddev_pop(e) FILTER (t = 0) AS std0, stddev_pop(e) FILTER (t = 1) AS std1 FROM units)",
)
def a3_overlap(spark, d):
    return rounded(effects.overlap(cohorts.orders(spark, d), "t", "e"))


HAJEK = "sum({w}t * y / c) / sum({w}t / c) - sum({w}(1 - t) * y / (1 - c)) / sum({w}(1 - t) / (1 - c))"
WINSOR = "winsor AS (SELECT unit_id, t, y, greatest(least(e, q[2]), q[1]) AS c FROM units, (SELECT quantile_cont(e, [0.01, 0.99]) AS q FROM units))"


@query(f"SELECT round({HAJEK.format(w='')}, 4) AS ate, count(*) FILTER (t = 1) AS n_treated, count(*) FILTER (t = 0) AS n_control FROM winsor", ORDERS_SQL, WINSOR)
def a5_ipw(spark, d):
    return rounded(effects.ate_ipw(cohorts.orders(spark, d), "t", "y", "e"), 4)


@query(
    "SELECT round(sum(n * (m1 - m0)) / sum(n), 4) AS ate, count(*) AS n_strata, CAST(sum(n) AS BIGINT) AS n_used FROM (SELECT s, avg(y) FILTER (t = 1) AS m1, avg(y) FILTER (t = 0) AS m0, count(*) AS n FROM (SELECT t, y, len(list_filter(q, lambda c: c <= e)) AS s FROM units, (SELECT quantile_cont(e, [0.2, 0.4, 0.6, 0.8]) AS q FROM units)) GROUP BY s) WHERE m1 IS NOT NULL AND m0 IS NOT NULL",
    ORDERS_SQL,
)
def a6_stratified(spark, d):
    return rounded(effects.ate_stratified(cohorts.orders(spark, d), "t", "y", "e"), 4)


def _drawn_sql(base: str, key: str) -> str:
    """The rows of base for each of 1000 draws with w, hashrand.poisson_weights() as SQL: products and sums modulo 2^64 from halves of 32 bits."""
    low = 4294967295

    def times(x: str, m: int) -> str:
        first = f"(({x}) & {low}) * {m & low}::UBIGINT"
        upper = f"(((({x}) >> 32) * {m & low}::UBIGINT) & {low}) + (((({x}) & {low}) * {m >> 32}::UBIGINT) & {low}) + (({first}) >> 32)"
        return f"((({upper}) & {low}) * 4294967296::UBIGINT + (({first}) & {low}))"

    def plus(x: str, y: str) -> str:
        lower = f"((({x}) & {low}) + (({y}) & {low}))"
        return f"((((({x}) >> 32) + (({y}) >> 32) + ({lower} >> 32)) & {low}) * 4294967296::UBIGINT + ({lower} & {low}))"

    p, total, cuts = 0.36787944117144233, 0.0, []
    for k in range(12):
        p = p if k == 0 else p / k
        total += p
        cuts.append(f"CAST(q >= {total!r}::DOUBLE AS INTEGER)")
    x = f"SELECT *, {times(f'CAST({key} AS UBIGINT)', hashrand.KEY)} AS k0 FROM {base}"
    x = f"SELECT a.*, draw, {plus('k0', 'd0')} AS v0 FROM ({x}) a, (SELECT draw, {times('CAST(draw AS UBIGINT)', hashrand.DRAW)} AS d0 FROM range(1, 1001) AS r(draw))"
    x = f"SELECT *, {times('xor(v0, v0 >> 30)', hashrand.FIRST)} AS v1 FROM ({x})"
    x = f"SELECT *, {times('xor(v1, v1 >> 27)', hashrand.SECOND)} AS v2 FROM ({x})"
    x = f"SELECT *, CAST(xor(v2, v2 >> 31) >> 11 AS DOUBLE) / 9007199254740992.0 AS q FROM ({x})"
    return f"(SELECT *, {' + '.join(cuts)} AS w FROM ({x}))"


@query(
    f"SELECT round(stddev_samp(ate), 4) AS se, round(quantile_cont(ate, 0.025), 4) AS lower, round(quantile_cont(ate, 0.975), 4) AS upper "
    f"FROM (SELECT draw, {HAJEK.format(w='w * ')} AS ate FROM {_drawn_sql('winsor', 'unit_id')} WHERE w > 0 GROUP BY draw)",
    ORDERS_SQL,
    WINSOR,
)
def a8_bootstrap(spark, d):
    return rounded(effects.bootstrap_ipw(cohorts.orders(spark, d), "unit_id", "t", "y", "e"), 4)


STRATA = "strata AS (SELECT unit_id, t, y, len(list_filter(q, lambda c: c <= e)) AS s FROM units, (SELECT quantile_cont(e, [0.2, 0.4, 0.6, 0.8]) AS q FROM units))"


@query(
    "SELECT round(stddev_samp(ate), 4) AS se, round(quantile_cont(ate, 0.025), 4) AS lower, round(quantile_cont(ate, 0.975), 4) AS upper FROM ("
    "SELECT draw, sum(n * (m1 - m0)) / sum(n) AS ate FROM (SELECT draw, s, sum(w * y) FILTER (t = 1) / sum(w) FILTER (t = 1) AS m1, sum(w * y) FILTER (t = 0) / sum(w) FILTER (t = 0) AS m0, sum(w) AS n "
    f"FROM {_drawn_sql('strata', 'unit_id')} WHERE w > 0 GROUP BY draw, s) WHERE m1 IS NOT NULL AND m0 IS NOT NULL GROUP BY draw)",
    ORDERS_SQL,
    STRATA,
)
def a6_stratified_interval(spark, d):
    return rounded(effects.bootstrap_stratified(cohorts.orders(spark, d), "unit_id", "t", "y", "e"), 4)


# matching

NEAR = "a.t = 1 AND b.t = 0 AND b.e BETWEEN a.e - 0.000501 AND a.e + 0.000501 AND abs(a.e - b.e) <= 0.0005"
PAIRS = (
    "pairs AS MATERIALIZED (SELECT * FROM (SELECT a.unit_id AS treated_id, b.unit_id AS control_id, abs(a.e - b.e) AS distance, "
    f"row_number() OVER (PARTITION BY a.unit_id ORDER BY abs(a.e - b.e), b.unit_id) AS rank FROM units a JOIN units b ON {NEAR}) WHERE rank <= {{k}})"
)


@query(f"SELECT count(*) AS n, round(sum(abs(a.e - b.e)), 6) AS total FROM units a JOIN units b ON {NEAR}", ORDERS_SQL)
def j6_band_pairs(spark, d):
    scores = matching.band_scores(cohorts.orders(spark, d), "t", "e", 0.0005)
    return rounded(scores.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("n") * F.col("distance")).alias("total")))


@query("SELECT treated_id, control_id, round(distance, 9) AS distance, CAST(rank AS INTEGER) AS rank FROM pairs", ORDERS_SQL, PAIRS.format(k=3))
def j3_nearest_controls(spark, d):
    return rounded(matching.nearest(cohorts.orders(spark, d), "unit_id", "t", "e", 3, 0.0005).select("treated_id", "control_id", "distance", "rank"), 9)


@query(
    "SELECT count(*) AS n_pairs, count(DISTINCT control_id) AS n_controls, round(avg(distance), 9) AS mean_distance FROM ("
    "SELECT a.unit_id, b.unit_id AS control_id, abs(a.e - b.e) AS distance, row_number() OVER (PARTITION BY a.unit_id ORDER BY abs(a.e - b.e), b.unit_id) AS r "
    "FROM units a JOIN units b ON a.t = 1 AND b.t = 0 AND a.e BETWEEN 0.05 AND 0.95 AND b.e BETWEEN a.e - 0.00101 AND a.e + 0.00101 AND b.e BETWEEN 0.05 AND 0.95 AND abs(a.e - b.e) <= 0.001) WHERE r = 1",
    ORDERS_SQL,
)
def j5_sorted_pairs(spark, d):
    pairs = matching.sorted_pairs(cohorts.orders(spark, d), "unit_id", "t", "e", caliper=0.001)
    return rounded(pairs.agg(F.count("*").alias("n_pairs"), F.countDistinct("control_id").alias("n_controls"), F.avg("distance").alias("mean_distance")), 9)


def _outcomes(spark, d, y):
    units = cohorts.orders(spark, d)
    return effects.pair_outcomes(matching.nearest(units, "unit_id", "t", "e", 1, 0.0005), units, "unit_id", y)


OUTCOMES = "outcomes AS (SELECT treated_id, control_id, a.{y} AS y1, b.{y} AS y0 FROM pairs JOIN units a ON a.unit_id = treated_id JOIN units b ON b.unit_id = control_id)"


@query(
    "SELECT round(avg(y1 - y0), 4) AS att, count(*) AS n_pairs, round(avg(y1 - y0) / (stddev_samp(y1 - y0) / sqrt(count(*)) + 1e-10), 6) AS t_statistic, count(DISTINCT treated_id) AS n_treated, count(DISTINCT control_id) AS n_control FROM outcomes",
    ORDERS_SQL,
    PAIRS.format(k=1),
    OUTCOMES.format(y="y"),
)
def a4_att_matched(spark, d):
    out = effects.att_matched(_outcomes(spark, d, "y"))
    return out.withColumn("att", F.round("att", 4)).withColumn("t_statistic", F.round("t_statistic", 6))


@query(
    "SELECT round(stddev_samp(x), 4) AS se, round(quantile_cont(x, 0.025), 4) AS lower, round(quantile_cont(x, 0.975), 4) AS upper FROM (SELECT draw, sum(w * (y1 - y0)) / sum(w) AS x FROM "
    f"{_drawn_sql('outcomes', 'xor(CAST(treated_id AS UBIGINT), CAST(control_id AS UBIGINT) << 31)')} WHERE w > 0 GROUP BY draw)",
    ORDERS_SQL,
    PAIRS.format(k=1),
    OUTCOMES.format(y="y"),
)
def a4_att_interval(spark, d):
    return rounded(effects.bootstrap_matched(_outcomes(spark, d, "y")), 4)


DISCORDANT = "counts AS (SELECT count(*) FILTER (y1 > y0) AS b, count(*) FILTER (y1 < y0) AS c FROM outcomes)"


@query(
    "SELECT b, c, round(CASE WHEN b + c = 0 THEN 0 WHEN b + c < 25 THEN (b - c) * (b - c) / (b + c) ELSE (abs(b - c) - 1) * (abs(b - c) - 1) / (b + c) END, 6) AS statistic, "
    f"round(CASE WHEN b + c = 0 THEN 1 WHEN b + c < 25 THEN 2 * {binomial_cdf_sql('least(b, c)', 'b + c', '0.5')} ELSE {erfc_sql('sqrt((abs(b - c) - 1) * (abs(b - c) - 1) / (b + c) / 2)')} END, 6) AS p FROM counts",
    ORDERS_SQL,
    PAIRS.format(k=1),
    OUTCOMES.format(y="y_high"),
    DISCORDANT,
)
def a9_mcnemar(spark, d):
    return rounded(effects.mcnemar(_outcomes(spark, d, "y_high")))


@query(
    f"SELECT round(m, 4) AS mean, round(t, 6) AS t, n, round({t_two_sided_sql('t', 'n - 1.0')}, 6) AS p FROM (SELECT avg(y1 - y0) AS m, avg(y1 - y0) / (stddev_samp(y1 - y0) / sqrt(count(*)) + 1e-10) AS t, count(*) AS n FROM outcomes)",
    ORDERS_SQL,
    PAIRS.format(k=1),
    OUTCOMES.format(y="y"),
)
def a10_paired_t(spark, d):
    out = effects.paired_t(_outcomes(spark, d, "y"))
    return out.select(F.round("mean", 4).alias("mean"), F.round("t", 6).alias("t"), "n", F.round("p", 6).alias("p"))


def _bound_sql(q: str) -> str:
    p = f"2 * {binomial_cdf_sql('c', 'b + c', q)}"
    return f"round(CASE WHEN b + c = 0 THEN 1 WHEN gamma = 1 THEN {p} ELSE least(1, {p}) END, 6)"


@query(
    f"SELECT gamma, {_bound_sql('gamma / (1 + gamma)')} AS p_plus, {_bound_sql('1 / (1 + gamma)')} AS p_minus FROM counts, (SELECT unnest([1.0::DOUBLE, 1.1, 1.2, 1.3, 1.5, 1.75, 2.0, 3.0]) AS gamma)",
    ORDERS_SQL,
    PAIRS.format(k=1),
    OUTCOMES.format(y="y_high"),
    DISCORDANT,
)
def a9_a11_sensitivity(spark, d):
    return rounded(effects.rosenbaum(_outcomes(spark, d, "y_high")))


# metrics


@query("SELECT round((sum(r) FILTER (y_high = 1) - count(*) FILTER (y_high = 1) * (count(*) FILTER (y_high = 1) + 1) / 2) / count(*) FILTER (y_high = 1) / count(*) FILTER (y_high = 0), 9) AS auroc, count(*) FILTER (y_high = 1) AS n_positive, count(*) FILTER (y_high = 0) AS n_negative FROM (SELECT y_high, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2 AS r FROM units)", ORDERS_SQL)
def a13_auroc(spark, d):
    return rounded(metrics.auroc(cohorts.orders(spark, d), "y_high", "c_acctbal"), 9)


@query("SELECT unit_id, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2 AS average_rank FROM units", ORDERS_SQL)
def w2_average_ranks(spark, d):
    return metrics.average_ranks(cohorts.orders(spark, d), "c_acctbal", "average_rank").select("unit_id", "average_rank")


@query("SELECT round(avg(pow(e - t, 2)), 9) AS mse, round(avg(abs(e - t)), 9) AS mae, round(corr(e, t), 9) AS corr, round(abs(avg(e) - avg(t)), 9) AS ate_bias, round(avg(CAST(t BETWEEN e - 0.5 AND e + 0.5 AS INTEGER)), 9) AS coverage, round(avg(e + 0.5 - (e - 0.5)), 9) AS width FROM units", ORDERS_SQL)
def a12_effect_metrics(spark, d):
    df = cohorts.orders(spark, d).withColumns({"lo": F.col("e") - 0.5, "hi": F.col("e") + 0.5, "truth": F.col("t").cast("double")})
    return rounded(metrics.effect_metrics(df, "e", "truth", "lo", "hi"), 9)


@query("SELECT c_mktsegment, round(avg(pow(y_high - 0.5 - 0.1 * (t - e), 2)), 9) AS r_loss, round(corr(y, c_acctbal), 9) AS corr FROM units GROUP BY c_mktsegment", ORDERS_SQL)
def a14_r_loss(spark, d):
    df = cohorts.orders(spark, d)
    return rounded(df.groupBy("c_mktsegment").agg(metrics.r_loss(F.col("y_high"), F.col("t"), F.lit(0.5), F.col("e"), F.lit(0.1)).alias("r_loss"), metrics.safe_corr(F.col("y"), F.col("c_acctbal")).alias("corr")), 9)


@query("SELECT metric, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, count(*) AS n FROM (SELECT 'y' AS metric, y AS v FROM units UNION ALL SELECT 'e', e FROM units) GROUP BY metric", ORDERS_SQL)
def a16_fold_metrics(spark, d):
    return rounded(metrics.fold_metrics(cohorts.orders(spark, d), ["y", "e"]), 4)


@query("SELECT c_mktsegment, status, count(*) AS n, round_even(avg(e), 4) AS e_mean, round_even(stddev_samp(e), 4) AS e_std, round_even(min(e), 4) AS e_min, round_even(max(e), 4) AS e_max FROM units GROUP BY ALL", ORDERS_SQL)
def a25_group_summary(spark, d):
    return metrics.group_summary(cohorts.orders(spark, d), ["c_mktsegment", "status"], ["e"])


@query("SELECT group_a, group_b, round(t, 6) AS t, round(df, 4) AS df, round(p, 6) AS p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM (SELECT *, " + t_two_sided_sql("t", "df") + " AS p FROM (SELECT a.g AS group_a, b.g AS group_b, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t, pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) AS df FROM g a JOIN g b ON a.g < b.g))", ORDERS_SQL, "g AS (SELECT c_mktsegment AS g, avg(y) AS m, var_samp(y) AS v, count(*) AS n FROM units GROUP BY 1 HAVING count(*) >= 2)")
def a26_welch(spark, d):
    out = metrics.welch(cohorts.orders(spark, d), "c_mktsegment", "y")
    return out.withColumn("t", F.round("t", 6)).withColumn("df", F.round("df", 4)).withColumn("p", F.round("p", 6))


@query("SELECT c_mktsegment, status, count(*) AS n, CAST(grouping(c_mktsegment) AS INTEGER) AS all_rows, CAST(grouping(status) AS INTEGER) AS all_columns FROM units GROUP BY CUBE (c_mktsegment, status)", ORDERS_SQL)
def a27_crosstab(spark, d):
    out = metrics.crosstab(cohorts.orders(spark, d), "c_mktsegment", "status")
    return out.withColumn("all_rows", F.col("all_rows").cast("int")).withColumn("all_columns", F.col("all_columns").cast("int"))


@query("SELECT c_mktsegment, " + ", ".join(f"round(avg(y) FILTER (status = '{v}'), 4) AS \"{v}_mean\", count(y) FILTER (status = '{v}') AS \"{v}_n\"" for v in "FOP") + " FROM units GROUP BY c_mktsegment", ORDERS_SQL)
def a27_pivot_means(spark, d):
    return rounded(metrics.pivot(cohorts.orders(spark, d), "c_mktsegment", "status", list("FOP"), "y"), 4)


# text


TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+|[^\\s]')"


@query(f"SELECT doc_id, len({TOKENS}) AS n_tokens, md5(array_to_string({TOKENS}, ' ')) AS tokens_md5 FROM documents")
def f1_tokens(spark, d):
    t = scalar.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


VOCABULARY = f"vocab AS (SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS INTEGER) AS token_id FROM (SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS}) AS token FROM documents) GROUP BY token HAVING count(*) >= 2) QUALIFY row_number() OVER (ORDER BY n DESC, token) <= 498)"


@query("SELECT * FROM vocab", VOCABULARY)
def t3_vocabulary(spark, d):
    return encoding.vocabulary(table(spark, d, "documents"), "text", 500)


@query("SELECT doc_id, sha1(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS text_hash FROM documents")
def f4_text_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", scalar.normalized_hash(F.col("text")).alias("text_hash"))


@query("SELECT page_id, substr(regexp_replace(url, '[^\\p{L}\\p{N}._-]', '_', 'g'), 1, 100) AS name FROM pages")
def f5_safe_filename(spark, d):
    return table(spark, d, "pages").select("page_id", scalar.safe_filename(F.col("url")).alias("name"))


@query("SELECT event_id, TRY_CAST(regexp_extract(props, '[-+]?\\d+(?:\\.\\d+)?') AS DOUBLE) AS number FROM events")
def f8_first_number(spark, d):
    return table(spark, d, "events").select("event_id", scalar.first_number(F.col("props")).alias("number"))


@query(
    "SELECT 'p_size' AS feature, round(avg(p_size), 6) AS mean, round(stddev_samp(p_size), 6) AS std FROM part UNION ALL SELECT 'p_retailprice', round(avg(p_retailprice), 6), round(stddev_samp(p_retailprice), 6) FROM part "
    "UNION ALL SELECT 'p_name', coalesce(round(avg(TRY_CAST(p_name AS DOUBLE)), 6), 0), coalesce(round(stddev_samp(TRY_CAST(p_name AS DOUBLE)), 6), 1) FROM part"
)
def a20_continuous_stats(spark, d):
    return rounded(tables.continuous_stats(table(spark, d, "part"), ["p_size", "p_retailprice", "p_name"]))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def h1_json_response(spark, d):
    return table(spark, d, "events").select("event_id", encoding.parsed_json(F.concat(F.lit("Answer: "), F.col("props"), F.lit(" done")), "k long")["k"].alias("k"))


def ids(text: str = "text") -> Column:
    """Token ids below 1000 from a checksum, in place of a learned vocabulary."""
    return F.transform(scalar.tokens(F.col(text)), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("long"), F.lit(1000)))


IDS = f"list_transform({TOKENS}, lambda w: CAST(CAST('0x' || substr(md5(w), 1, 6) AS UBIGINT) AS BIGINT) % 1000)"


@query("SELECT doc_id, i, to_json(c) AS chunk FROM (SELECT doc_id, unnest(range(0, greatest(len(x), 1), 48)) AS i, x[i + 1 : i + 64] AS c FROM (SELECT doc_id, " + IDS + " AS x FROM documents))")
def w4_chunks(spark, d):
    each = table(spark, d, "documents").select("doc_id", ids().alias("x")).select("doc_id", F.posexplode(scalar.chunks(F.col("x"), 64, 16)).alias("i", "c"))
    return each.select("doc_id", (F.col("i") * 48).cast("long").alias("i"), F.concat(F.lit("["), F.array_join(F.col("c").cast("array<string>"), ","), F.lit("]")).alias("chunk"))


BUCKETS = f"list_transform({TOKENS}, lambda w: CAST(CAST('0x' || substr(md5(w), 1, 6) AS UBIGINT) AS BIGINT) % 64)"


@query(
    "SELECT doc_id, i, CAST(len(c) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(c, lambda b: b + 1)), 0) AS BIGINT) AS checksum, CAST(coalesce(list_max(map_values(list_histogram(c))), 0) AS BIGINT) AS peak "
    "FROM (SELECT doc_id, i // 48 AS i, x[i + 1 : i + 64] AS c FROM (SELECT doc_id, unnest(range(0, greatest(len(x), 1), 48)) AS i, x FROM (SELECT doc_id, coalesce(" + BUCKETS + ", []) AS x FROM documents)))"
)
def v6_chunk_vectors(spark, d):
    """Each chunk's vector by the offline embedder, read back from half floats: its sum, its largest number and a sum weighted by place."""
    made = embedding.embedded(table(spark, d, "documents"), "doc_id", "text", embedding.WordBuckets(64), 64, 16)
    each = embedding.unpacked(made, "doc_id").select("doc_id", F.posexplode("vectors").alias("i", "v"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x).cast("long")
    return each.select("doc_id", F.col("i").cast("long").alias("i"), total("v").alias("n_words"), total(F.transform("v", lambda x, k: x * (k + 1).cast("double"))).alias("checksum"), F.array_max("v").cast("long").alias("peak"))


@query(
    "SELECT doc_id, CAST(coalesce(list_aggregate(CASE WHEN len(x) <= 32 THEN x ELSE x[1:16] || x[len(x) - 15:] END, 'sum'), 0) AS BIGINT) AS checksum FROM (SELECT doc_id, " + IDS + " AS x FROM documents)",
)
def p10_token_window(spark, d):
    x = table(spark, d, "documents").select("doc_id", ids().alias("x"))
    return x.select("doc_id", F.aggregate(scalar.token_window(F.col("x"), 32, "head_tail"), F.lit(0).cast("long"), lambda a, b: a + b).alias("checksum"))


@query(
    "SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN kept USING (term))",
    "docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]{2,}') AS w FROM documents)",
    "tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM docs UNION ALL SELECT doc_id, a || ' ' || b FROM (SELECT doc_id, unnest(w[1 : len(w) - 1]) AS a, unnest(w[2 : len(w)]) AS b FROM docs WHERE len(w) > 1)) GROUP BY ALL)",
    "kept AS (SELECT term, count(*) AS df, sum(tf) AS total, (SELECT count(*) FROM docs) AS n FROM tf GROUP BY term HAVING count(*) >= 5 AND count(*) <= 0.95 * (SELECT count(*) FROM docs) ORDER BY total DESC, term LIMIT 10000)",
)
def m1_tfidf(spark, d):
    return rounded(encoding.tfidf(table(spark, d, "documents"), "doc_id", "text"))


# encoding

SPECS = [encoding.FeatureSpec("c_mktsegment", "categorical", ("automobile", "building", "furniture", "machinery", "household")), encoding.FeatureSpec("c_acctbal", "continuous", roles=("confounder",))]


@query(
    "SELECT unit_id, "
    + ", ".join(f"CAST(lower(c_mktsegment) = '{c}' AS DOUBLE) AS c_mktsegment_{c}" for c in SPECS[0].categories[1:])
    + ", 0.0::DOUBLE AS c_mktsegment_missing, round((c_acctbal - m) / greatest(s, 1e-6), 6) AS c_acctbal_normalized, 0.0::DOUBLE AS c_acctbal_missing FROM units, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM units)",
    ORDERS_SQL,
)
def h9_role_encoding(spark, d):
    df = cohorts.orders(spark, d)
    return rounded(df.select("unit_id", *encoding.encoded(SPECS, encoding.normalization(df, ["c_acctbal"]))))


@query("SELECT feature, value, n, 1.0::DOUBLE AS coverage FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS r FROM (SELECT 'lang' AS feature, lang AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL)) WHERE r <= 8")
def a18_extraction_summary(spark, d):
    return encoding.extraction_summary(table(spark, d, "documents"), ["lang", "source"])


@query("SELECT 'c_acctbal' AS feature, round(quantile_cont(c_acctbal, 0.5), 4) AS number, NULL AS value FROM units UNION ALL SELECT 'status', NULL, (SELECT status FROM units GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)", ORDERS_SQL)
def a21_imputation(spark, d):
    out = encoding.imputation(cohorts.orders(spark, d), ["c_acctbal"], ["status"])
    number = F.round(F.col("value").try_cast("double"), 4)
    return out.select("feature", number.alias("number"), F.when(number.isNull(), F.col("value")).alias("value"))


PURITY = (
    "scored AS (SELECT *, greatest(0, te - abs(control)) * greatest(smallest, 1) * pow(1 - n / (all_n0 + all_n1), 2) AS raw, n >= 10 AND n <= all_n0 + all_n1 - 10 AND smallest >= 3 AND te > 0 AS good FROM (SELECT *, n0 + n1 AS n, "
    "(s1 / greatest(n1, 1) - s0 / greatest(n0, 1)) - ((all_s1 - s1) / greatest(all_n1 - n1, 1) - (all_s0 - s0) / greatest(all_n0 - n0, 1)) AS te, "
    "s0 / greatest(n0, 1) - (all_s0 - s0) / greatest(all_n0 - n0, 1) AS control, least(n0, n1, all_n0 - n0, all_n1 - n1) AS smallest FROM "
    "(SELECT term, count(*) FILTER (t = 0) AS n0, count(*) FILTER (t = 1) AS n1, coalesce(sum(y) FILTER (t = 0), 0) AS s0, coalesce(sum(y) FILTER (t = 1), 0) AS s1 FROM (SELECT DISTINCT doc_id, t, y, unnest("
    + TOKENS
    + ") AS term FROM labelled) GROUP BY term), (SELECT count(*) FILTER (t = 0) AS all_n0, count(*) FILTER (t = 1) AS all_n1, sum(y) FILTER (t = 0) AS all_s0, sum(y) FILTER (t = 1) AS all_s1 FROM labelled)))"
)


def _purity(spark, d):
    units = cohorts.labelled(spark, d)
    long = units.select("doc_id", F.explode(F.array_distinct(scalar.tokens(F.col("text")))).alias("term"))
    return encoding.purity(long, units, "doc_id", "term", "t", "y", least=10, least_arm=3)


@query("SELECT term, n, round(te, 6) AS te_difference, round(control, 6) AS control_difference, round(CASE WHEN good THEN raw END, 6) AS score FROM scored", LABELLED_SQL, PURITY)
def a30_purity(spark, d):
    return rounded(_purity(spark, d))


@query("SELECT term, round(raw, 6) AS score FROM scored WHERE good AND raw > 0 ORDER BY round(raw, 6) DESC, term LIMIT 20", LABELLED_SQL, PURITY)
def t5_purest_terms(spark, d):
    return encoding.purest(rounded(_purity(spark, d)).where("score > 0"), "term", 20).select("term", "score")


# simulation

BUILT = {"x1": 0.8, "x2": -0.5}


def _simulated(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("unit_id"), (F.col("c_acctbal") / 5000).alias("x1"), (F.col("c_nationkey") / 12.0 - 1).alias("x2"))
    return simulation.simulate(base, simulation.Equation(-0.2, BUILT), simulation.Equation(0.1, {"x1": 0.4}, {("x1", "x2"): 0.3}, effect=0.5, modifiers={"x2": 0.7}))


def _clipped(x: str) -> str:
    return f"1 / (1 + exp(-({x})))"


@query(
    f"SELECT unit_id, round(e, 9) AS true_propensity, t AS treatment, round(y0, 9) AS true_y0, round(y1, 9) AS true_y1, round(y1 - y0, 9) AS true_ite, CAST({u('7', chr(39) + 'y' + chr(39), 'unit_id')} < CASE WHEN t = 1 THEN y1 ELSE y0 END AS INTEGER) AS outcome FROM (SELECT *, CAST({u('7', chr(39) + 't' + chr(39), 'unit_id')} < e AS INTEGER) AS t FROM (SELECT unit_id, greatest(least({_clipped('-0.2 + 0.8 * x1 - 0.5 * x2')}, 0.98), 0.02) AS e, {_clipped('0.1 + 0.4 * x1 + 0.3 * x1 * x2')} AS y0, {_clipped('0.1 + 0.4 * x1 + 0.3 * x1 * x2 + 0.5 + 0.7 * x2')} AS y1 FROM (SELECT c_custkey AS unit_id, c_acctbal / 5000 AS x1, c_nationkey / 12.0::DOUBLE - 1 AS x2 FROM customer)))"
)
def m17_simulated_cohort(spark, d):
    return rounded(_simulated(spark, d).drop("x1", "x2"), 9)


@query(f"SELECT conv_id, turn FROM conversations WHERE {u('17', 'conv_id', 'turn')} < 0.1")
def t7_sampled_turns(spark, d):
    return table(spark, d, "conversations").where(uniform(F.lit(17), F.col("conv_id"), F.col("turn")) < 0.1).select("conv_id", "turn")


# reports


@query("SELECT round(avg(e), 9) AS mean, round(stddev_samp(e), 9) AS std, round(min(e), 9) AS min, round(max(e), 9) AS max, round(avg(CAST(e - 0.35 > 0 OR e + 0.1 < 0 AS INTEGER)), 9) AS share_significant, round(avg(e), 9) AS mean_propensity FROM units", ORDERS_SQL)
def s3_prediction_summary(spark, d):
    df = cohorts.orders(spark, d).withColumns({"lo": F.col("e") - 0.35, "hi": F.col("e") + 0.1})
    return rounded(reports.prediction_summary(df, "e", "lo", "hi", "e"), 9)


@query("SELECT round(avg(x), 6) AS ate, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, round(quantile_cont(x, 0.5), 6) AS median, count(*) FILTER (x > 0) AS n_positive, count(*) FILTER (x < 0) AS n_negative, round(100 * avg(CAST(x - 0.1 > 0 OR x + 0.1 < 0 AS INTEGER)), 6) AS percent_significant FROM (SELECT e - 0.4 AS x FROM units)", ORDERS_SQL)
def a33_effect_summary(spark, d):
    return rounded(reports.effect_summary(cohorts.orders(spark, d).withColumn("x", F.col("e") - 0.4).withColumns({"lo": F.col("x") - 0.1, "hi": F.col("x") + 0.1}), "x", "lo", "hi"))


@query("SELECT g, round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS std, count(*) AS n FROM (SELECT nullif(status, 'P') AS g, y FROM units) WHERE g IS NOT NULL GROUP BY g", ORDERS_SQL)
def s11_strict_group_summary(spark, d):
    return rounded(reports.strict_group_summary(cohorts.orders(spark, d).withColumn("g", F.nullif("status", F.lit("P"))), ["g"], "y"), 4)


@query("SELECT feature, category, round(accuracy, 6) AS accuracy, n FROM (SELECT 'status' AS feature, status AS category, avg(CAST(found = status AS INTEGER)) AS accuracy, count(*) AS n FROM (SELECT status, CASE WHEN unit_id % 7 = 0 THEN 'unknown' WHEN unit_id % 5 = 0 THEN 'O' ELSE status END AS found FROM units) WHERE found <> 'unknown' GROUP BY GROUPING SETS ((status), ()))", ORDERS_SQL)
def a19_extraction_accuracy(spark, d):
    found = F.when(F.col("unit_id") % 7 == 0, "unknown").when(F.col("unit_id") % 5 == 0, "O").otherwise(F.col("status"))
    return rounded(reports.extraction_accuracy(cohorts.orders(spark, d).withColumn("found", found), {"status": ("found", "status")}))


@query("SELECT t, round(1 - sum(pow(y - p, 2)) / sum(pow(y - m, 2)), 6) AS r2, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse FROM (SELECT t, y, 100000 + 10 * c_acctbal AS p, avg(y) OVER (PARTITION BY t) AS m FROM units) GROUP BY t", ORDERS_SQL)
def a24_regression_by_arm(spark, d):
    out = reports.regression_by_arm(cohorts.orders(spark, d).withColumn("p", 100000 + 10 * F.col("c_acctbal")), "t", "y", "p")
    return out.withColumn("r2", F.round("r2", 6)).withColumn("rmse", F.round("rmse", 4))


@query("SELECT round(stddev_samp(m), 4) AS std_of_means, round(avg(s), 4) AS mean_of_stds, count(*) AS n_groups FROM (SELECT avg(y) AS m, stddev_samp(y) AS s FROM units GROUP BY c_nationkey)", ORDERS_SQL)
def a29_variability(spark, d):
    return rounded(reports.variability(cohorts.orders(spark, d), "c_nationkey", "y"), 4)


@query("SELECT member, round(avg(y) FILTER (has), 4) AS mean_with, round(avg(y) FILTER (NOT has), 4) AS mean_without FROM (SELECT member, y, list_contains([c_mktsegment, status], member) AS has FROM units, (SELECT DISTINCT unnest([c_mktsegment, status]) AS member FROM units)) GROUP BY member", ORDERS_SQL)
def a28_member_contrast(spark, d):
    return rounded(reports.member_contrast(cohorts.orders(spark, d).withColumn("members", F.array("c_mktsegment", "status")), "members", "y"), 4)


@query("SELECT band, round(greatest(least(sum((t - e) * (y_high - 0.5)) / greatest(sum(pow(t - e, 2)), 1e-6), 0.02), -0.02), 6) AS contrast FROM units GROUP BY band", ORDERS_SQL)
def a31_residual_contrast(spark, d):
    return rounded(reports.residual_contrast(cohorts.orders(spark, d), "band", F.col("t") - F.col("e"), F.col("y_high") - 0.5, 0.02))


@query("SELECT round((avg(b) - avg(c)) / greatest(abs(avg(b)), 1e-8), 6) AS gain, round(avg(CAST(c < b AS INTEGER)), 6) AS share_better, count(*) AS n_folds FROM (SELECT c_nationkey, avg(e) AS b, avg(CASE WHEN t = 1 THEN e ELSE 0.4 END) AS c FROM units GROUP BY c_nationkey)", ORDERS_SQL)
def a17_candidate_gain(spark, d):
    rows = cohorts.orders(spark, d).groupBy("c_nationkey").agg(F.avg("e").alias("b"), F.avg(F.when(F.col("t") == 1, F.col("e")).otherwise(0.4)).alias("c"))
    return rounded(reports.candidate_gain(rows.withColumnRenamed("b", "loss"), rows.withColumnRenamed("c", "loss"), "c_nationkey", "loss"))


@query("SELECT unit_id, y FROM units ORDER BY y DESC, unit_id LIMIT 10", ORDERS_SQL)
def t2_top_rows(spark, d):
    return reports.top_rows(cohorts.orders(spark, d), "y", 10, "unit_id").select("unit_id", "y")


@query("SELECT label, CAST(dim - 1 AS INTEGER) AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(max(x), 6) AS max, round(min(x), 6) AS min FROM (SELECT label, generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL")
def m24_stat_pooling(spark, d):
    return rounded(reports.stat_pooling(table(spark, d, "embeddings"), "label", "embedding"))


@query(
    "SELECT covariate, round(b, 6) AS smd_before, round(a, 6) AS smd_after, round(CASE WHEN b = 0 THEN 0 ELSE (b - a) / b END, 6) AS smd_reduction FROM (SELECT 'c_acctbal' AS covariate, "
    "(SELECT abs(avg(c_acctbal) FILTER (t = 1) - avg(c_acctbal) FILTER (t = 0)) / sqrt((var_samp(c_acctbal) FILTER (t = 1) + var_samp(c_acctbal) FILTER (t = 0)) / 2) FROM units) AS b, "
    "(SELECT abs(avg(x.c_acctbal) - avg(z.c_acctbal)) / sqrt((var_samp(x.c_acctbal) + var_samp(z.c_acctbal)) / 2) FROM pairs JOIN units x ON x.unit_id = treated_id JOIN units z ON z.unit_id = control_id) AS a)",
    ORDERS_SQL,
    PAIRS.format(k=1),
)
def a2_balance_change(spark, d):
    units = cohorts.orders(spark, d)
    return rounded(effects.balance_change(units, matching.nearest(units, "unit_id", "t", "e", 1, 0.0005), "unit_id", "t", ["c_acctbal"]))


@query("SELECT a.n_nationkey AS nation, b.r_regionkey AS region FROM nation a, region b WHERE NOT (a.n_nationkey % 3 = 0 AND b.r_regionkey < 2)")
def j9_j10_open_jobs(spark, d):
    n, r = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation")), table(spark, d, "region").select(F.col("r_regionkey").alias("region"))
    grid = n.crossJoin(r)  # a job grid: two short lists of options
    return reports.open_jobs(grid, grid.where("nation % 3 = 0 AND region < 2"), ["nation", "region"])


@query("SELECT unit_id, round(CASE WHEN t = 1 THEN greatest(least(0.5 + (1 - e) * 0.9, 1), 0) ELSE greatest(least(0.5 - e * 0.9, 1), 0) END, 9) AS factual, round(t / greatest(least(e, 0.999), 0.001) - (1 - t) / (1 - greatest(least(e, 0.999), 0.001)), 6) AS clever, round(greatest(e * (1 - e), 1e-4), 9) AS overlap_weight, round(t * 0.9 + 0.05, 9) AS smoothed, round(ln(e / (1 - e)), 6) AS logit FROM units", ORDERS_SQL)
def g6_p9_arm_means(spark, d):
    e, t = F.col("e"), F.col("t")
    y0, y1 = scalar.arm_means(F.lit(0.5), e, F.lit(0.9), True)
    out = cohorts.orders(spark, d).select("unit_id", F.round(scalar.factual(t, y1, y0), 9).alias("factual"), F.round(scalar.clever_covariate(t, e), 6).alias("clever"), F.round(effects.overlap_weights(e), 9).alias("overlap_weight"), F.round(scalar.smoothed_label(t, 0.1), 9).alias("smoothed"), F.round(scalar.logit(e), 6).alias("logit"))
    return out


@query("SELECT event_id, regexp_extract_all(lower('code ' || event_type || '_is_k ' || props), '[a-z]+(?:_[a-z0-9]+){2,}')[1] AS code FROM events")
def f13_category_codes(spark, d):
    return table(spark, d, "events").select("event_id", F.get(scalar.category_codes(F.concat(F.lit("code "), F.col("event_type"), F.lit("_is_k "), F.col("props"))), 0).alias("code"))


@query("SELECT conv_id, turn, trim(substr(text, length('thoughts FINAL:') + 1)) AS answer FROM (SELECT conv_id, turn, 'thoughts FINAL:' || text AS text FROM conversations)")
def f22_after_marker(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", scalar.after_marker(F.concat(F.lit("thoughts FINAL:"), F.col("text")), "final:").alias("answer"))


@query()
def j3_greedy_without_replacement(spark, d):
    return matching.greedy(cohorts.orders(spark, d), "unit_id", "t", "e", ["c_mktsegment", "band"], caliper=0.01)


@query()
def j4_optimal_pairs(spark, d):
    return matching.optimal(cohorts.orders(spark, d), "unit_id", "t", "e", ["c_mktsegment", "band"], caliper=0.05)


@query()
def j3_w3_greedy_global(spark, d):
    """Over the whole table, without blocks."""
    return line_matching.greedy(cohorts.orders(spark, d), "unit_id", "t", "e", caliper=0.01)


@query()
def j4_optimal_global(spark, d):
    """Every treated order, with the least total distance over the whole table."""
    return line_matching.optimal(cohorts.orders(spark, d), "unit_id", "t", "e")


@query()
def m6_crossfit_nuisances(spark, d):
    return forest.crossfit(_simulated(spark, d), "unit_id", "treatment", "outcome", ["x1", "x2"]).select("unit_id", "cv_fold", "e_hat", "m_hat")


@query()
def m7_causal_forest(spark, d):
    """Each fold's effects by a forest of the other folds."""
    fitted = forest.crossfit(_simulated(spark, d), "unit_id", "treatment", "outcome", ["x1", "x2"])
    return forest.out_of_fold(fitted.select("unit_id", "x1", "x2", "cv_fold", "e_hat", "m_hat", "treatment", "outcome", "true_ite"), "unit_id", "outcome", "treatment", ["x1", "x2"], 3, bags=8).drop("treatment", "outcome", "cv_fold")


@query(r"""SELECT event_id, props, TRY_CAST(regexp_extract(props, '"k"\D{0,20}(-?\d+(?:\.\d+)?)', 1) AS DOUBLE) AS explicit_feat_k, false AS explicit_feat_k_missing FROM events""")
def v2_extracted_features(spark, d):
    specs = [encoding.FeatureSpec("k", "continuous")]
    return extraction.extract(table(spark, d, "events").select("event_id", "props"), "props", specs, extraction.KeywordProvider(specs))


PROMPT_SPECS = [encoding.FeatureSpec("ecog_status", "categorical", ("0", "1", "2"), description="performance status at baseline"), encoding.FeatureSpec("age", "continuous")]


@query(
    "SELECT conv_id, turn, 'Extract these features, as known before treatment, and answer with one flat JSON object; use null where the text doesn''t say.\n"
    "- ecog_status (categorical: one of 0, 1, 2): performance status at baseline\n- age (continuous): age\n\nText:\n' || substr(text, 1, 8000) AS prompt FROM conversations".replace("\\n", "' || chr(10) || '"),
)
def f23_prompt(spark, d):
    from causeway.functions import notes

    return table(spark, d, "conversations").select("conv_id", "turn", notes.extraction_prompt(F.col("text"), PROMPT_SPECS).alias("prompt"))


def _gram_sql(n: int) -> str:
    if n == 1:
        return "(x[i] * 1000003 + 9176)"
    return "(" + " + ".join(f"x[i + {j}] * {1_000_003 + 9_176 * (j + 1)}" for j in range(n)) + f" + {19_260_817 * n})"


@query(
    "SELECT doc_id, bucket FROM (SELECT doc_id, bucket, count(*) OVER (PARTITION BY bucket) AS c FROM (SELECT doc_id, CAST(0 AS BIGINT) AS bucket FROM x WHERE len(x) = 0 UNION "
    + " UNION ".join(f"SELECT doc_id, {_gram_sql(n)} % 32768 AS bucket FROM (SELECT doc_id, x, unnest(range(1, len(x) - {n - 2})) AS i FROM x WHERE len(x) >= {n})" for n in (1, 2, 3))
    + ")) WHERE c >= 5 AND c <= (SELECT count(*) FROM documents) - 5",
    "x AS (SELECT doc_id, " + IDS + " AS x FROM documents)",
)
def m4_hashed_ngrams(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    return encoding.hashed_ngrams(docs, "doc_id", "text", 32_768, (1, 2, 3), 5, terms.token_ids(1000))  # the ids of ids()


@query("SELECT covariate, mean, std, n FROM (SELECT 'y' AS covariate, round(avg(y), 4) AS mean, round(greatest(stddev_pop(y), 1e-6), 4) AS std, count(*) AS n FROM units UNION ALL SELECT 'e', round(avg(e), 4), round(greatest(stddev_pop(e), 1e-6), 4), count(*) FROM units)", ORDERS_SQL)
def a22_normalization(spark, d):
    df = cohorts.orders(spark, d)
    stats, n = encoding.normalization(df, ["y", "e"]), df.count()
    return spark.createDataFrame([(c, round(m, 4), round(s, 4), n) for c, (m, s) in sorted(stats.items())], "covariate string, mean double, std double, n long")


# shapes of tables


@query(
    "SELECT doc_id, '[' || coalesce(string_agg(coalesce(token_id, 1), ',' ORDER BY i), '') || ']' AS ids FROM documents LEFT JOIN (SELECT doc_id AS d, unnest(x) AS token, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, "
    + TOKENS
    + " AS x FROM documents)) ON d = doc_id LEFT JOIN big USING (token) GROUP BY doc_id",
    VOCABULARY.replace("vocab AS", "big AS").replace("<= 498", "<= 49998"),
)
def f2_token_ids(spark, d):
    docs = table(spark, d, "documents")
    out = tables.token_ids(docs.select("doc_id", scalar.tokens(F.col("text")).alias("x")), "doc_id", "x", encoding.vocabulary(docs, "text", 50_000))
    return out.select("doc_id", F.concat(F.lit("["), F.array_join(F.col("ids").cast("array<string>"), ","), F.lit("]")).alias("ids"))


@query(
    "SELECT conv_id, turn, CAST(coalesce(sum(CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) + 1), 0) AS BIGINT) AS checksum FROM (SELECT conv_id, turn, h, unnest(range(0, least(length(h) // 2, 65536))) AS i FROM (SELECT conv_id, turn, hex(encode(text)) AS h FROM conversations)) GROUP BY ALL",
)
def f25_byte_ids(spark, d):
    x = table(spark, d, "conversations").select("conv_id", "turn", tables.byte_ids(F.col("text"), 512 * 128).alias("b"))
    return x.select("conv_id", "turn", F.aggregate("b", F.lit(0).cast("long"), lambda a, b: a + b).alias("checksum"))


@query("SELECT unit_id, round(c_acctbal * c_nationkey, 4) AS c_acctbal_x_c_nationkey, round(c_acctbal * e, 4) AS c_acctbal_x_e, round(c_nationkey * e, 6) AS c_nationkey_x_e FROM units", ORDERS_SQL)
def h12_interactions(spark, d):
    out = cohorts.orders(spark, d).select("unit_id", *tables.interactions(["c_acctbal", "c_nationkey", "e"]))
    return out.select("unit_id", F.round("c_acctbal_x_c_nationkey", 4).alias("c_acctbal_x_c_nationkey"), F.round("c_acctbal_x_e", 4).alias("c_acctbal_x_e"), F.round("c_nationkey_x_e", 6).alias("c_nationkey_x_e"))


@query("SELECT * FROM (VALUES ('p_name', false), ('p_brand', false), ('p_type', false), ('p_size', true), ('p_partkey', true), ('p_retailprice', true)) AS t(\"column\", \"numeric\")")
def h11_discovered_columns(spark, d):
    return tables.discovered(table(spark, d, "part"), "p_")


@query("SELECT status AS category, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM units WHERE status IN ('F', 'O', 'P') GROUP BY status", ORDERS_SQL)
def a20_category_shares(spark, d):
    return rounded(tables.category_shares(cohorts.orders(spark, d), "status", ["F", "O", "P"]))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def h3_tolerant_json(spark, d):
    p = F.col("props")
    text = F.when(F.col("event_id") % 3 == 0, p).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Sure:\n```json\n"), p, F.lit("\n```"))).otherwise(F.concat(F.lit("The answer is "), p, F.lit(".")))
    return table(spark, d, "events").select("event_id", tables.tolerant_json(text, "k long")["k"].alias("k"))


@query("SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'building' THEN 'Building' WHEN 'furniture' THEN 'FURNITURE' END AS category FROM customer")
def j8_normalized_category(spark, d):
    return table(spark, d, "customer").select("c_custkey", tables.normalized_category(F.concat(F.lit(" "), F.col("c_mktsegment")), ["Building", "FURNITURE"]).alias("category"))


@query("SELECT user_id, event_type, round(exp(-s * s) / sum(exp(-s * s)) OVER (PARTITION BY user_id), 6) AS weight FROM (SELECT user_id, event_type, d / 100 AS s, row_number() OVER (PARTITION BY user_id ORDER BY d / 100, event_type) AS r FROM (SELECT user_id, event_type, avg(value) AS d FROM events GROUP BY ALL)) WHERE r <= 2")
def w7_soft_assignment(spark, d):
    each = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.avg("value") / 100).alias("s"))
    return rounded(tables.soft_assignment(each, "user_id", "event_type", "s", 2))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def u5_first_rows(spark, d):
    return tables.first_rows(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query(
    "SELECT unit_id, bin, CAST((i + k * n) // 16 AS INTEGER) AS batch, t FROM (SELECT *, unnest(range(0, (ceil(m / 16.0)::BIGINT * 16 - 1 - i) // n + 1)) AS k FROM (SELECT *, "
    f"row_number() OVER (PARTITION BY bin, t ORDER BY {u('3', '0', 'unit_id')}, unit_id) - 1 AS i, count(*) OVER (PARTITION BY bin, t) AS n FROM binned) JOIN (SELECT bin, greatest(count(*) FILTER (t = 1), count(*) FILTER (t = 0)) AS m FROM binned GROUP BY bin HAVING count(DISTINCT t) = 2) USING (bin))",
    ORDERS_SQL,
    "binned AS (SELECT unit_id, t, CAST((row_number() OVER (ORDER BY e, unit_id) - 1) * 8 // count(*) OVER () AS INTEGER) AS bin FROM units)",
)
def y1_balanced_batches(spark, d):
    return tables.balanced_batches(cohort.propensity_bins(cohorts.orders(spark, d), "unit_id", "t", "e", 8), "unit_id", "bin", "t", 32)


@query(
    "SELECT treated_id, control_id, CAST((i + k * n) // 16 AS BIGINT) AS batch, CAST((i + k * n) % 16 AS INTEGER) AS place FROM (SELECT *, unnest(range(0, ((n + 15) // 16 * 16 - 1 - i) // n + 1)) AS k FROM "
    f"(SELECT *, row_number() OVER (ORDER BY {u('42', '0', 'treated_id', 'control_id')}, treated_id, control_id) - 1 AS i, count(*) OVER () AS n FROM pairs))",
    ORDERS_SQL,
    "pairs AS (SELECT treated_id, control_id FROM (SELECT a.unit_id AS treated_id, b.unit_id AS control_id, row_number() OVER (PARTITION BY a.unit_id ORDER BY abs(a.e - b.e), b.unit_id) AS r "
    "FROM units a JOIN units b ON a.t = 1 AND b.t = 0 AND a.e BETWEEN 0.05 AND 0.95 AND b.e BETWEEN a.e - 0.00101 AND a.e + 0.00101 AND b.e BETWEEN 0.05 AND 0.95 AND abs(a.e - b.e) <= 0.001) WHERE r = 1)",
)
def y1_pair_batches(spark, d):
    pairs = matching.sorted_pairs(cohorts.orders(spark, d), "unit_id", "t", "e", caliper=0.001).select("treated_id", "control_id")
    return effect_nets.pair_batches(pairs, ["treated_id", "control_id"], 16)


@query("SELECT a.doc_id AS doc_id, a.quality AS quality_a, b.quality AS quality_b FROM labels a JOIN labels b ON a.doc_id = b.doc_id AND a.toxic = b.toxic")
def j1_result_join(spark, d):
    a, b = (table(spark, d, "labels").select("doc_id", "toxic", F.col("quality").alias(f"quality_{s}")) for s in "ab")
    return a.join(b, ["doc_id", "toxic"]).select("doc_id", "quality_a", "quality_b")


@query("SELECT count(*) AS n, round(avg(t), 6) AS treatment_rate, round(avg(y), 6) AS outcome_rate, round(avg(length(text)), 4) AS mean_chars, round(stddev_samp(length(text)), 4) AS std_chars FROM labelled", LABELLED_SQL)
def a23_dataset_statistics(spark, d):
    n = F.char_length("text").cast("double")
    return cohorts.labelled(spark, d).agg(F.count("*").alias("n"), F.round(F.avg("t"), 6).alias("treatment_rate"), F.round(F.avg("y"), 6).alias("outcome_rate"), F.round(F.avg(n), 4).alias("mean_chars"), F.round(F.stddev_samp(n), 4).alias("std_chars"))


REPORT = (
    "SELECT 'crude' AS method, round(avg(y_high) FILTER (t = 1) - avg(y_high) FILTER (t = 0), 4) AS estimate FROM units UNION ALL SELECT 'matched', round(avg(y1 - y0), 4) FROM outcomes UNION ALL "
    f"SELECT 'weighted', round({HAJEK.format(w='').replace('* y', '* y_high')}, 4) FROM winsor JOIN units USING (unit_id, t) UNION ALL "
    "SELECT 'stratified', round(sum(n * (m1 - m0)) / sum(n), 4) FROM (SELECT s, avg(y_high) FILTER (t = 1) AS m1, avg(y_high) FILTER (t = 0) AS m0, count(*) AS n FROM strata JOIN units USING (unit_id, t) GROUP BY s) WHERE m1 IS NOT NULL AND m0 IS NOT NULL UNION ALL "
    "SELECT 'model, percentiles of effects', round(avg(e), 4) FROM units"
)


@query(REPORT, ORDERS_SQL, WINSOR, STRATA, PAIRS.format(k=1), OUTCOMES.format(y="y_high"))
def a35_matching_report(spark, d):
    from causeway.plans import psm

    return rounded(psm.report(cohorts.orders(spark, d), "unit_id", "t", "y_high", "e", ["c_acctbal"], caliper=0.0005, effect="e").estimates.select("method", "estimate"), 4)


@query(
    "SELECT method, round(estimate, 4) AS estimate, round(lower, 4) AS lower, round(upper, 4) AS upper FROM (SELECT 'model' AS method, avg(e) AS estimate, quantile_cont(e, 0.025) AS lower, quantile_cont(e, 0.975) AS upper FROM units UNION ALL "
    "SELECT 'crude', avg(y_high) FILTER (t = 1) - avg(y_high) FILTER (t = 0), NULL, NULL FROM units)",
    ORDERS_SQL,
)
def a34_method_comparison(spark, d):
    from causeway.plans import psm

    return rounded(psm.compared(cohorts.orders(spark, d), "e", {"crude": ("difference", lambda df: effects.crude(df, "t", "y_high"))}), 4)


from causeway.plans import catalog_models, catalog_text  # noqa: E402, F401  they register their queries
