"""The registered query of each operator, with production parameters over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import embedding_join, fingerprints, hard_negatives, language_model, licenses, mixing, ngram_join, oracles, packing, pivot_search, repeats, secrets, source_divergence, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_winnowed_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.compare_with_next(table(spark, sf_dir, "documents"))
    hashes = {c: F.transform(c, lambda g: g["hash"]) for c in ("grams", "next_grams", "edited_grams")}
    sets = {c: F.array_distinct(h) for c, h in hashes.items()}
    shown = lambda c: F.array_join(F.transform(c, lambda g: F.hex(g["hash"])), ",")
    return pairs.select(
        F.col("id").alias("doc_id"), F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), shown("grams").alias("fingerprint"), shown("edited_grams").alias("edited_fingerprint"),
        fingerprints.likeness(sets["grams"], sets["edited_grams"]).alias("near_edited"), fingerprints.likeness(sets["grams"], sets["next_grams"]).alias("near_next"), F.transform("grams", lambda g: g["place"]).alias("places"),
    )


def op2_license_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform(F.array_sort("found"), lambda m: F.concat_ws(":", m["name"], m["first"].cast("string"), m["last"].cast("string"))), ",")
    return found.select("doc_id", F.size("found").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda m: m["name"]))), ",").alias("licenses"), spans.alias("spans"))


def op3_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda name: F.size(F.filter("strong", lambda p: p["kind"] == [k[0] for k in secrets.KINDS].index(name))).cast("long").alias(f"n_{name}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.joined(F.col("strong")), 256).alias("base_sha256"), secrets.joined(F.concat("strong", "linked")).alias("spans"))


def op4_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_model.stupid_backoff(table(spark, sf_dir, "documents"))
    return found.withColumn("log_score", F.round("log_score", 4)).withColumn("mean_log", F.round("mean_log", 6))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_embedding_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_join.embedding_links(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(packing.TOKENIZER))


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their prompts in sequences of at most 1024 tokens, 16 segments and 512 tokens that bear loss."""
    import public_tokenizers

    given = packing.answers(table(spark, sf_dir, "conversations")).withColumn("example", F.col("conv_id") * 1000 + F.col("turn"))
    return packing.pack(given, public_tokenizers.path(packing.TOKENIZER), "example", tokens=1024, segments=16, loss=512, prompt_col="prompt").withColumnRenamed("doc_id", "example")


def op9_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_links(table(spark, sf_dir, "documents"))


def op10_exact_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["last"] - s["first"]))
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"), F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["first"].cast("string"), s["last"].cast("string"))), ",").alias("spans"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.search(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_winnowed_fingerprints, op2_license_matches, op3_secret_spans, op4_toxicity_scores, op5_backoff_scores, op6_source_mix, op7_embedding_components, op8_packed_pieces, packed_conversations, op9_jaccard_components, op9_jaccard_links, op10_exact_repeats, op11_source_divergence, op12_pivot_search, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    """The other operators' results come from hashes, a classifier, regular expressions or a tokenizer that DuckDB lacks; tests hold them against brute force."""
    return {"op5_backoff_scores": oracles.OP5, "op6_source_mix": oracles.OP6, "op7_embedding_components": oracles.OP7, "op9_jaccard_components": oracles.OP9, "op10_exact_repeats": oracles.OP10, "op11_source_divergence": oracles.OP11, "op12_pivot_search": oracles.OP12, "op13_hard_negatives": oracles.OP13}
