"""The driver's tables under the names of the legal domain.

nation stands for statutes, supplier for their articles, lineitem for passages that cite an article, orders with customer for passages
that cite a statute only, orders for judgments, part for tagged titles, events for the ingestion feed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurispark.session import table


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("act_id"), F.col("n_name").alias("title"), F.col("n_regionkey").alias("year"))


def provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("s_acctbal") >= 0, "article").otherwise("annex")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("provision_id"), F.col("s_nationkey").alias("act_id"), F.col("s_name").alias("label"), kind.alias("kind"))


def provision_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("provision_id"), F.col("l_linenumber").alias("char_offset"))


def act_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return orders.join(customers, "o_custkey").select(F.col("o_orderkey").alias("document_id"), F.col("c_nationkey").alias("act_id"))


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("source"), F.col("o_orderdate").alias("date"),
        F.year("o_orderdate").alias("year"), F.format_string("E-%d/%d", F.col("o_orderkey"), F.year("o_orderdate")).alias("case_number"),
        F.col("o_orderpriority").alias("subject"),
    )


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("document_id"), F.split("p_name", " ").alias("tags"))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")
