"""Trigram postings stored in the order of trigrams, so that one query reads the pages of its own trigrams and of sets that can be large enough.

A row is (gram, size, id): a text's trigram and how many it has. How many trigrams a text shares with the query is counted from the query's
postings alone, and with both sizes that is the similarity itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurispark.operators.fuzzy import THRESHOLD, trigrams, type_ahead
from jurispark.session import spread

BUCKETS = 16
PAGE_ROWS = 4096
TASK_TEXTS = 100_000  # whose trigrams a task makes, sorts and writes


@dataclass(frozen=True)
class TrigramIndex:
    """The trigrams of one text column. Texts without any, and nulls, are in no posting: they are similar to nothing."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def build(self, rows: DataFrame, key: str, text: str) -> TrigramIndex:
        """Postings of a row an id; a common trigram's are spread over the buckets by id."""
        texts = spread(rows.select(F.col(key).alias("id"), F.col(text).alias("text")), "id", max(self.buckets, -(-rows.count() // TASK_TEXTS)))
        sets = texts.select("id", trigrams(F.col("text")).alias("grams"))
        found = sets.select("id", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
        found = found.sortWithinPartitions("gram", "size", "id")
        found.write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(self.path)
        return self

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def similar(self, query: str, threshold: float = THRESHOLD) -> DataFrame:
        """(id, similarity) of the texts that are similar to the query.

        Of sets of m and n pieces that are similar at t, m lies between t n and n / t, and t (m + n) / (1 + t) pieces at least are shared.
        """
        grams = self.grams_of(query)
        n = len(grams)
        fits = F.col("gram").isin(grams) & F.col("size").between(ceil(n * threshold - 1e-9), floor(n / threshold + 1e-9))
        met = self.postings().where(fits if grams else F.lit(False)).groupBy("id", "size").agg(F.count("*").alias("shared"))
        found = met.withColumn("similarity", F.col("shared") / (F.col("size") + n - F.col("shared")))
        return found.where(F.col("similarity") >= threshold).select("id", "similarity")

    def may_contain(self, query: str) -> DataFrame | None:
        """(id) of all texts that can hold the query whatever its case, and some that do not: those with all trigrams inside its words. None if it has no word
        of three letters, for which there are no postings to ask."""
        words = self._one(F.filter(F.split(F.lower(F.lit(query)), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2))
        grams = sorted({w[i : i + 3] for w in words for i in range(len(w) - 2)})
        if not grams:
            return None
        met = self.postings().where(F.col("gram").isin(grams)).groupBy("id").agg(F.count("*").alias("n"))
        return met.where(F.col("n") == len(grams)).select("id")

    def grams_of(self, query: str) -> list[str]:
        """The query's trigrams, by the engine that made those of the texts."""
        return self._one(trigrams(F.lit(query)))

    def _one(self, value) -> list[str]:
        return self.spark.sql("SELECT 1").select(value.alias("v")).first()["v"]


def type_ahead_indexed(acts: DataFrame, titles: TrigramIndex, names: TrigramIndex, query: str, most: int = 10, number: str = "act_id", key: str = "act_id", **columns: str) -> DataFrame:
    """type_ahead from indexes of titles and of aliases joined by blanks: only rows that an index gives, or that have the number typed, are looked at.
    A query without a word of three letters looks at all rows."""
    q, acts = query.strip(), spread(acts, key)
    held = [index.may_contain(q) for index in (titles, names)]
    if any(h is None for h in held):
        return type_ahead(acts, query, most, number, **columns)
    met = titles.similar(q).select("id").union(names.similar(q).select("id"))
    for h in held:
        met = met.union(h)
    met = met.union(acts.where(F.col(number).cast("string") == q).select(key))
    return type_ahead(acts.join(met.distinct().withColumnRenamed("id", key), key, "left_semi"), query, most, number, **columns)
