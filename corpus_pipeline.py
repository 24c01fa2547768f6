"""Documents to training sequences: stages that each apply one operator to what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causeway.llm import mixing, ngram_join, packing, secrets, toxicity
from causeway.llm.common import checkpointed


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on `labels`, scores 0.5 or more.

    Null and empty texts score as the intercept does; rows without an id and repeated rows are judged each by itself; without labels of both
    classes every score is the share of label 1; an empty table stays empty.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of documents that five-word shingles at Jaccard 0.75 link.

    Null and empty texts link with nothing and stay; of equal rows (id and text) one stays, of unlike texts under one id each in a component of
    its own; rows without an id all stay; an empty table stays empty.
    """
    return ngram_join.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents and replaces the secrets in them; n_chars becomes the new length. Null texts stay null, other rows without secrets as they were."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources have their target shares, in a global order by hash.

    A null source is a source, null and empty texts weigh one character, equal ids have equal draws; an empty table stays empty. Columns of
    the names that the operator adds keep what they held.
    """
    return mixing.mix_sources(docs, keep=True).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens at most. A null or empty text is its end token alone; an empty table gives no piece."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier, the components and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
