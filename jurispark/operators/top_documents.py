"""The first documents for any of some words, without reading what cannot be among them.

What a term weighs in a document is stored in the order of terms and, for a term, of bands of that weight, the heaviest first, with the number of documents
in each band. A search reads the first bands of its terms, knows from them what every document weighs at least and, from the bands it has not read, at most,
and reads on until no document that is still out could come among the first.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jurispark.operators.fulltext import WEIGHTS, rank
from jurispark.session import stored

BUCKETS = 16
PAGE_ROWS = 4096
BANDS = 200  # to a weight of 1
MOST = max(WEIGHTS.values()) * 1.65  # no term weighs more: the sum of 1 / k^2 is below 1.645
CLOSE = 1e-9  # what sums in another order may differ by
LISTED = 1000
TASK_ROWS = 2_000_000  # weights that a task sorts and writes


def band(weight: Column) -> Column:
    """0 for the heaviest; the weight of a band's documents is at most `heaviest` of it."""
    return F.floor((MOST - weight) * BANDS).cast("int")


def heaviest(number: int) -> float:
    return MOST - number / BANDS


@dataclass(frozen=True)
class TopDocuments:
    """Weights by term and band next to an index's postings."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    read: dict = field(default_factory=dict, compare=False, repr=False)  # what the last search read

    def build(self, postings: DataFrame) -> TopDocuments:
        tasks = max(self.buckets, -(-postings.count() // TASK_ROWS))  # what a task sorts does not grow with the documents
        weight = F.create_map(*(F.lit(x) for k, w in WEIGHTS.items() for x in (k, w)))
        each = F.array_repeat(F.element_at(weight, F.col("weight")), F.size("positions"))
        found = postings.groupBy("document_id", "term").agg(F.sort_array(F.flatten(F.collect_list(each)), asc=False).alias("w"))
        found = found.select("document_id", "term", F.aggregate(F.transform("w", lambda x, k: x / ((k + 1) * (k + 1))), F.lit(0.0), lambda a, b: a + b).alias("weight"))
        found = found.withColumn("band", band(F.col("weight"))).repartition(tasks, "document_id").sortWithinPartitions("term", "band", "document_id")
        found.write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.path}/weights")
        counts = self.weights().groupBy("term", "band").agg(F.count("*").alias("n"))
        counts.repartition(tasks, "term").sortWithinPartitions("term", "band").write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.path}/counts")
        return self

    def weights(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/weights")

    def search(self, words: list[str], first: int, postings: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
        """(document_id, rank) of documents with any of the words, every one among them whose rank is one of the `first` largest, ties included; of `allowed` (document_id) only.

        The rank is that of `fulltext.rank`. Where many documents weigh alike all of them are read, as each may be among the first by what orders equal ranks.
        """
        words = list(dict.fromkeys(words))
        ladder: dict[str, list[tuple[int, int]]] = {w: [] for w in words}
        counts = self.spark.read.parquet(f"{self.path}/counts").where(F.col("term").isin(words))
        for r in sorted(counts.collect()):  # at most MOST * BANDS rows a word
            ladder[r["term"]].append((r["band"], r["n"]))
        wanted = dict.fromkeys(words, first)
        while True:
            limits, rest, rows = {}, {}, 0
            for w in words:
                held = 0
                for k, (number, n) in enumerate(ladder[w]):
                    held += n
                    limits[w], rest[w] = number, heaviest(ladder[w][k + 1][0]) if k + 1 < len(ladder[w]) else 0.0
                    if held >= wanted[w]:
                        break
                rows += held
            seen = self._seen(limits, rest, allowed)
            best = seen.orderBy(F.desc("low")).limit(first).agg(F.count("*").alias("n"), F.min("low").alias("low")).first()
            least = best["low"] if best["n"] == first else float("-inf")
            out = sum(rest.values())
            self.read.update(rows=rows, rounds=self.read.get("rounds", 0) + 1)
            if not out or out < least - CLOSE:
                break
            widest = max(rest, key=rest.get)
            wanted[widest] = 2 * max(wanted[widest], sum(n for number, n in ladder[widest] if number <= limits[widest]))
        met = seen.where(F.col("high") >= least - CLOSE)
        whole = met.where(F.col("high") <= F.col("low") + CLOSE).select("document_id", (F.col("low") / len(words)).alias("rank"))
        parts = stored(met.where(F.col("high") > F.col("low") + CLOSE).select("document_id"))
        ids = [r["document_id"] for r in parts.limit(LISTED + 1).collect()]
        if not ids:
            return whole
        own = postings.where(F.col("document_id").isin(ids)) if len(ids) <= LISTED else postings.join(parts, "document_id", "left_semi")
        return whole.unionByName(rank(own, words))

    def _seen(self, limits: dict[str, int], rest: dict[str, float], allowed: DataFrame | None) -> DataFrame:
        """(document_id, low, high) of the documents in the bands up to the limits: what their words weigh at least, and at most."""
        if not limits:
            return self.weights().where("false").select("document_id", F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
        inside = reduce(lambda a, b: a | b, ((F.col("term") == w) & (F.col("band") <= n) for w, n in limits.items()))
        rows = self.weights().where(inside)
        if allowed is not None:
            rows = rows.join(allowed.select("document_id"), "document_id", "left_semi")
        known = F.create_map(*(F.lit(x) for w, r in rest.items() for x in (w, r)))
        sums = rows.groupBy("document_id").agg(F.sum("weight").alias("low"), F.sum(F.element_at(known, F.col("term"))).alias("met"))
        return stored(sums.select("document_id", "low", (F.col("low") + F.greatest(F.lit(sum(rest.values())) - F.col("met"), F.lit(0.0))).alias("high")))
