"""Where results live: result documents, logs, artefacts, generated datasets, vector caches and job grids, through Spark's readers and writers."""

from __future__ import annotations

import hashlib
import json
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.hashrand import uniform
from causeway.operators import embedding, reports
from causeway.sources.tables import exists


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def load_results(spark: SparkSession, folder: str) -> DataFrame:
    """One wide row for each result document under the folder that wasn't skipped: config and metrics side by side, keys of all documents together."""
    return reports.result_rows(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder))


def save_result(spark: SparkSession, result: dict, folder: str, keys: list[str]) -> None:
    """One document under a folder that its keys name; written again it takes the earlier one's place."""
    name = "/".join(f"{k}={result[k]}" for k in keys)
    spark.createDataFrame([(json.dumps(result, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


def finished(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame | None:
    """The keys of the documents of save_result(), or None before the first."""
    if not exists(spark, folder):
        return None
    return spark.read.text(folder, recursiveFileLookup=True).select(*[F.get_json_object("value", f"$.{k}").alias(k) for k in keys]).distinct()


def remaining(spark: SparkSession, grid: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """The jobs of a grid without a document yet: what a resumed run has to do."""
    done = finished(spark, folder, keys)
    if done is None:
        return grid
    return reports.open_jobs(grid, done.select(*[F.col(k).cast(grid.schema[k].dataType).alias(k) for k in keys]), keys)


def job_grid(spark: SparkSession, options: dict[str, list], without: str | None = None) -> DataFrame:
    """job (from 0) and a column for each option: every combination but those that the SQL condition `without` describes. Option lists are short."""
    names = list(options)
    rows = [tuple(None if v is None else str(v) for v in combination) for combination in product(*options.values())]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ", ".join(["job int", *[f"`{n}` string" for n in names]]))
    return df.where(~F.coalesce(F.expr(without), F.lit(False))) if without else df


def config_hash(*columns: str) -> Column:
    """Twelve digits of the md5 of the columns as JSON with sorted keys."""
    return F.substring(F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})), 1, 12)


def execution_order(jobs: DataFrame, cache_columns: list[str], size: str, seed: int = 42) -> DataFrame:
    """jobs with cache_key and turn: jobs that share a cache stand together, small caches first, groups of one size and jobs of one group in a seeded order."""
    key = config_hash(*cache_columns)
    return jobs.withColumn("cache_key", key).withColumn("turn", F.struct(F.col(size).cast("double").alias("size"), uniform(F.lit(seed), F.col("cache_key")).alias("group"), uniform(F.lit(seed), F.col("job")).alias("job")))


def fold_log(rows: list[DataFrame], path: str | None = None) -> DataFrame:
    """The folds' metric rows as one table, missing columns null; as CSV with a header under path."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    if path:
        out.write.mode("overwrite").csv(path, header=True)
    return out


def aggregate(results: DataFrame, groups: list[str], metric: str, folder: str) -> DataFrame:
    """All results as parquet and CSV, and as summary.csv the groups' means without groups of a null key."""
    summary = reports.strict_group_summary(results, groups, metric)
    results.write.mode("overwrite").parquet(f"{folder}/all_results.parquet")
    results.write.mode("overwrite").csv(f"{folder}/all_results.csv", header=True)
    summary.write.mode("overwrite").csv(f"{folder}/summary.csv", header=True)
    return summary


def write_dataset(df: DataFrame, folder: str, equations: dict, specs: list, treatment: str, outcome: str, text: str) -> dict:
    """dataset.parquet and metadata: equations, features by role, and statistics of what was written. Returns the metadata."""
    df.write.mode("overwrite").parquet(f"{folder}/dataset.parquet")
    saved = df.sparkSession.read.parquet(f"{folder}/dataset.parquet")
    statistics = dataset_statistics(saved, treatment, outcome, text).first().asDict()
    feature = lambda s: {"name": s.name, "type": s.kind, "categories": list(s.categories), "roles": list(s.roles), "description": s.description}
    metadata = {"equations": equations, "features": [feature(s) for s in specs], "confounders": [feature(s) for s in specs if "confounder" in s.roles], "effect_modifiers": [feature(s) for s in specs if "effect_modifier" in s.roles], "statistics": statistics}
    df.sparkSession.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")
    return metadata


def read_metadata(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/metadata").first()[0])


def dataset_statistics(df: DataFrame, treatment: str, outcome: str, text: str, notes: str | None = None) -> DataFrame:
    """One row: n, rates, mean and spread (sample) of the texts' lengths, and with `notes` (a count) their mean."""
    n = F.char_length(text).cast("double")
    more = [F.avg(notes).alias("mean_notes")] if notes else []
    return df.agg(F.count("*").alias("n"), F.avg(treatment).alias("treatment_rate"), F.avg(outcome).alias("outcome_rate"), F.avg(n).alias("mean_chars"), F.stddev_samp(n).alias("std_chars"), *more)


class VectorCache:
    """Ragged vectors of texts under a key of what decides them: rows of embedding.embedded() as parquet, each valid for the text whose hash it holds.

    Filled in waves by hash of the key, each a job of its own that takes only texts without vectors, so a run that broke off goes on where it
    stopped. A changed text is embedded again; vectors of texts that are gone stay and are not read.
    """

    def __init__(self, spark: SparkSession, folder: str, embedder: embedding.Embedder, size: int = 256, overlap: int = 32):
        self.spark, self.embedder, self.size, self.overlap = spark, embedder, size, overlap
        decides = json.dumps({"embedder": embedder.name, "width": embedder.width, "size": size, "overlap": overlap}, sort_keys=True)
        self.path = f"{folder.rstrip('/')}/{hashlib.md5(decides.encode()).hexdigest()[:12]}"

    def _stored(self, df: DataFrame, key: str) -> DataFrame:
        kind = df.schema[key].dataType.simpleString()
        schema = f"__key {kind}, __content string, offsets array<int>, block binary"
        return self.spark.read.schema(schema).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], schema)

    def _with(self, df: DataFrame, key: str, text: str, stored: DataFrame, how: str) -> DataFrame:
        own = df.withColumn("__own", embedding.text_hash(F.col(text)))
        return own.join(stored, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__own") == F.col("__content")), how).drop("__own", "__key", "__content")

    def missing(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """The rows of df whose text has no vectors yet."""
        return self._with(df, key, text, self._stored(df, key).select("__key", "__content"), "left_anti")

    def fill(self, df: DataFrame, key: str, text: str, waves: int = 8) -> None:
        given = df.select(key, text).dropDuplicates()
        for w in range(waves):
            todo = self.missing(given.where(F.pmod(F.xxhash64(key), F.lit(waves)) == w), key, text)
            made = embedding.embedded(todo, key, text, self.embedder, self.size, self.overlap)
            made.withColumnsRenamed({key: "__key", "content": "__content"}).write.mode("append").parquet(self.path)

    def load(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """df with offsets and block, null where the store lacks the text."""
        return self._with(df, key, text, self._stored(df, key).dropDuplicates(["__key", "__content"]), "left")

    def valid(self, df: DataFrame, key: str, text: str) -> bool:
        """Whether every text, as it is now, has its vectors."""
        return self.missing(df, key, text).isEmpty()
