"""Cohorts over the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.sources.tables import table


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: urgent or high priority is the treatment, the total price the outcome, the propensity a smoothed share within segment and balance band."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    units = o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("unit_id"), "c_acctbal", "c_mktsegment", "c_nationkey", F.col("o_totalprice").alias("y"), (F.col("o_totalprice") > 150000).cast("int").alias("y_high"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("t"), F.floor((F.col("c_acctbal") + 1000) / 2200).cast("int").alias("band"), F.col("o_orderstatus").alias("status"),
    )
    shares = units.groupBy("c_mktsegment", "band").agg(((F.sum("t") + 1) / (F.count("*") + 2)).alias("share"))
    jitter = F.pmod("unit_id", F.lit(97)) / 970.0  # so that propensities differ within a cell
    return units.join(shares, ["c_mktsegment", "band"]).withColumn("e", F.col("share") * 0.8 + jitter).drop("share")


ORDERS_SQL = """
units0 AS (SELECT o_orderkey AS unit_id, c_acctbal, c_mktsegment, c_nationkey, o_totalprice AS y, CAST(o_totalprice > 150000 AS INTEGER) AS y_high,
  CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS t, CAST(floor((c_acctbal + 1000) / 2200) AS INTEGER) AS band, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey),
shares AS (SELECT c_mktsegment AS seg, band AS b, (sum(t) + 1) / (count(*) + 2) AS share FROM units0 GROUP BY ALL),
units AS (SELECT units0.*, share * 0.8 + (unit_id % 97) / 970.0 AS e FROM units0 JOIN shares ON seg = c_mktsegment AND b = band)
"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels: toxic is the treatment, quality the outcome."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select("doc_id", "text", "lang", "source", F.col("toxic").alias("t"), F.col("quality").alias("y"))


LABELLED_SQL = "labelled AS (SELECT d.doc_id, text, lang, source, toxic AS t, quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
