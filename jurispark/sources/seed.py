"""A first version of the tables for trying things out: four sources and a made-up judgment of each, marked as samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurispark.operators.merge import text_hash

# The sources' keys, names and groups.
SOURCES = [("haestirettur", "Hæstiréttur Íslands", "courts"), ("landsrettur", "Landsréttur", "courts"), ("heradsdomar", "Héraðsdómstólar", "courts"), ("eftacourt", "EFTA Court", "international")]


def seed_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """sources (source, name, group, status) and documents (document_id, source, case_number, case_name, title, date, year, tags, text, text_hash,
    citation_scan_hash, is_sample), for `Store.seed`."""
    sources = spark.createDataFrame([(*s, "live") for s in SOURCES], "source string, name string, group string, status string")
    samples = spark.createDataFrame([(n, key, name) for n, (key, name, _) in enumerate(SOURCES, 1)], "document_id long, source string, court string")
    number = F.concat(F.lit("E-"), F.col("document_id").cast("string"), F.lit("/2020"))
    text = F.concat(F.lit("Dómur\n"), "court", F.lit(" tók málið fyrir. Krafan byggist á 57. gr. laga nr. 46/1980 og er tekin til greina."))
    documents = samples.select("document_id", "source", number.alias("case_number"), F.lit("Sýnishorn").alias("case_name"), F.concat(F.lit("Mál "), number).alias("title"), F.lit("2020-01-01").cast("date").alias("date"),
        F.lit(2020).alias("year"), F.array(F.lit("sýnishorn")).alias("tags"), text.alias("text"))
    return {"sources": sources, "documents": documents.withColumns({"text_hash": text_hash(F.col("text")), "citation_scan_hash": F.lit(None).cast("string"), "is_sample": F.lit(True)})}
