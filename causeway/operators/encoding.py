"""Features: vocabularies, tf-idf, hashed n-grams and their purity, role-tagged encoding, summaries of extracted values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.scalar import tokens
from causeway.functions.workers import by_value
from causeway.operators import terms
from causeway.operators.quantiles import quantiles

by_value(__name__)


@dataclass(frozen=True)
class FeatureSpec:
    """A feature by name: `categorical` with its categories (the first is the reference) or `continuous`; roles from confounder and effect_modifier."""

    name: str
    kind: str
    categories: tuple[str, ...] = ()
    roles: tuple[str, ...] = ("confounder", "effect_modifier")
    description: str = ""
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        if self.kind not in ("categorical", "continuous"):
            raise ValueError(f"{self.name}: unknown kind {self.kind}")
        if not self.roles or set(self.roles) - {"confounder", "effect_modifier"}:
            raise ValueError(f"{self.name}: roles must name confounder or effect_modifier")


def by_role(specs: list[FeatureSpec], role: str | None) -> list[FeatureSpec]:
    return [s for s in specs if role is None or role in s.roles]


def merged(specs: list[FeatureSpec]) -> list[FeatureSpec]:
    """One spec a name: the first definition with the roles of all, in order."""
    out: dict[str, FeatureSpec] = {}
    for s in specs:
        old = out.get(s.name)
        out[s.name] = s if old is None else FeatureSpec(old.name, old.kind, old.categories, tuple(dict.fromkeys(old.roles + s.roles)), old.description)
    return list(out.values())


def vocabulary(df: DataFrame, text: str, size: int = 10_000, least: int = 2) -> DataFrame:
    """token, n, token_id: the most frequent tokens, ties by token; ids from 2, after padding and unknown."""
    counts = df.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    top = counts.orderBy(F.desc("n"), "token").limit(size - 2)  # at most size rows are left for the window
    return top.withColumn("token_id", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) + 1).cast("int"))


def tfidf(df: DataFrame, key: str, text: str, least: int = 5, most: float = 0.95, size: int = 10_000) -> DataFrame:
    """key, term, weight: words and word pairs, sublinear tf, smoothed idf, unit length; terms in too few or too many rows are left out."""
    rows, n = df.select(key, terms.lowered(F.col(text)).alias("__text")), None
    if _repeats(df, key):  # rows of one key are one text, without pairs across them
        rows, n = rows.groupBy(key).agg(F.array_join(F.collect_list("__text"), terms.BREAK).alias("__text")), df.count()
    return terms.weighted(rows, key, "__text", terms.frequent(rows.select("__text"), least, most, size, n))


def _repeats(df: DataFrame, key: str) -> bool:
    """Whether a key, null among them, has more than one row."""
    return not df.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").isEmpty()


def hashed_ngrams(df: DataFrame, key: str, ids: str, buckets: int, orders: tuple[int, ...] = (1, 2, 3), least: int = 1, of=terms.array_ids) -> DataFrame:
    """key, bucket: each document's distinct buckets, those with at least `least` documents and at most all but `least`; null ids have none.

    Buckets are found within batches, once to count their documents and once to give the kept ones; only the counts come to the driver. of: what
    makes ids and their rows of an Arrow array of the column `ids`, if that doesn't hold arrays of ids.
    """
    n = df.count()
    if _repeats(df, key):  # rows of one key are one document
        long = terms.bucketed(df, key, ids, of, buckets, orders).distinct()
        kept = long.groupBy("bucket").agg(F.count("*").alias("c")).where((F.col("c") >= least) & (F.col("c") <= n - least)).select("bucket")
        return long.join(F.broadcast(kept), "bucket").select(key, "bucket")  # `buckets` rows at most
    counts = terms.bucket_rows(df.select(ids), of, buckets, orders)
    return terms.bucketed(df, key, ids, of, buckets, orders, (counts >= least) & (counts <= n - least))


def purity(long: DataFrame, units: DataFrame, key: str, feature: str, treatment: str, outcome: str, alpha: float = 1.0, beta: float = 2.0, gamma: float = 1.0, least: int = 20, least_arm: int = 5) -> DataFrame:
    """feature, n, te_difference, control_difference, score: how far a feature's presence raises the effect beyond what it does to the control outcome.

    score = max(0, te - gamma |control|) * (smallest of the four cells) ** alpha * (1 - share of rows) ** beta, null where there are too few
    rows with or without the feature or in a cell, or the difference isn't positive. A mean over no rows counts as 0.
    """
    t, y = F.col(treatment), F.col(outcome).cast("double")
    arms = [F.count_if(t == a).alias(f"n{a}") for a in (0, 1)] + [F.coalesce(F.sum(F.when(t == a, y)), F.lit(0.0)).alias(f"s{a}") for a in (0, 1)]
    total = units.agg(*[F.count_if(t == a).alias(f"all_n{a}") for a in (0, 1)], *[F.coalesce(F.sum(F.when(t == a, y)), F.lit(0.0)).alias(f"all_s{a}") for a in (0, 1)])
    with_ = long.join(units.select(key, treatment, outcome), key).groupBy(feature).agg(*arms).join(F.broadcast(total))  # one row
    one = F.lit(1)
    inside = [F.col(f"s{a}") / F.greatest(F.col(f"n{a}"), one) for a in (0, 1)]
    outside = [(F.col(f"all_s{a}") - F.col(f"s{a}")) / F.greatest(F.col(f"all_n{a}") - F.col(f"n{a}"), one) for a in (0, 1)]
    te = (inside[1] - inside[0]) - (outside[1] - outside[0])
    control = inside[0] - outside[0]
    count, rows = F.col("n0") + F.col("n1"), F.col("all_n0") + F.col("all_n1")
    smallest = F.least(F.col("n0"), F.col("n1"), F.col("all_n0") - F.col("n0"), F.col("all_n1") - F.col("n1"))
    score = F.greatest(te - gamma * F.abs(control), F.lit(0.0)) * F.pow(F.greatest(smallest, one).cast("double"), F.lit(alpha)) * F.pow(1 - count / rows, F.lit(beta))
    good = (count >= least) & (count <= rows - least) & (smallest >= least_arm) & (te > 0)
    return with_.select(feature, count.alias("n"), te.alias("te_difference"), control.alias("control_difference"), F.when(good, score).alias("score"))


def purest(scored: DataFrame, feature: str, top: int = 1) -> DataFrame:
    """The `top` features with the largest scores of purity(), ties by feature."""
    return scored.where("score is not null").orderBy(F.desc("score"), feature).limit(top)


def normalization(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population spread (1e-6 at least) of the non-missing values; (0, 1) without any."""
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (0.0, 1.0) if row[f"{c}__m"] is None else (row[f"{c}__m"], max(row[f"{c}__s"], 1e-6)) for c in columns}


def encoded(specs: list[FeatureSpec], stats: dict[str, tuple[float, float]], prefix: str = "") -> list[Column]:
    """Columns for a matrix: k - 1 indicators or a z-score, and a missing flag, for each spec. An unseen category has no indicator and isn't missing."""
    out = []
    for s in specs:
        x = F.col(f"`{prefix}{s.name}`")
        missing = x.isNull()
        if s.kind == "categorical":
            norm = lambda v: F.regexp_replace(F.lower(F.trim(v)), "[ -]", "_")
            out += [F.coalesce((norm(x.cast("string")) == norm(F.lit(c))).cast("double"), F.lit(0.0)).alias(f"{s.name}_{c}") for c in s.categories[1:]]
        else:
            m, d = stats[s.name]
            out.append(F.coalesce((x.cast("double") - m) / d, F.lit(0.0)).alias(f"{s.name}_normalized"))
        out.append(missing.cast("double").alias(f"{s.name}_missing"))
    return out


def extraction_summary(df: DataFrame, columns: list[str], top: int = 8) -> DataFrame:
    """feature, value, n, coverage: the most frequent values of each column, ties by value."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    cover = counts.groupBy("feature").agg((F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"))
    rank = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), "value"))
    return counts.where("value is not null").withColumn("rank", rank).where(F.col("rank") <= top).join(cover, "feature").select("feature", "value", "n", "coverage")


def imputation(df: DataFrame, continuous: list[str], categorical: list[str]) -> DataFrame:
    """feature, value: exact median, or the most frequent value, the first in order of equals."""
    medians = None
    for c in continuous:
        one = quantiles(df, c, [0.5]).select(F.lit(c).alias("feature"), F.get("q", 0).cast("string").alias("value"))
        medians = one if medians is None else medians.unionByName(one)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in categorical])).alias("x")).select("x.*").where("value is not null")
    modes = long.groupBy("feature", "value").agg(F.count("*").alias("n")).groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))
    return modes if medians is None else medians.unionByName(modes)


def parsed_json(text: Column, schema: str) -> Column:
    """The first flat {...} of a response as a struct; null where it doesn't parse."""
    return F.from_json(F.regexp_extract(text, r"\{[^{}]*\}", 0), schema)
