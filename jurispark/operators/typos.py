"""Terms that a mistyped word may stand for.

A dictionary holds, for every term of an index, what is left of its beginning when up to as many letters are dropped as may be wrong. Two words
within so many edits of each other have such a rest in common, so a word's few rests find all candidates; the edit distance of the whole words decides.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jurispark.functions.query import Node
from jurispark.session import stored

# From how many letters on a word may have one typo, and two.
ONE_TYPO, TWO_TYPOS = 5, 9
BEGINNING = 7
BUCKETS = 16
PAGE_ROWS = 4096
TASK_TERMS = 100_000  # of up to 29 rests each, that a task sorts and writes


def allowed(word: str) -> int:
    return 2 if len(word) >= TWO_TYPOS else 1 if len(word) >= ONE_TYPO else 0


def _dropped(words: Column) -> Column:
    """Each of an array of words without each of its letters in turn."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > 0), one))


def rests(word: str, edits: int) -> list[str]:
    """What is left of a word's beginning when up to `edits` letters are dropped."""
    begin = word[:BEGINNING]
    kept = (c for n in range(edits + 1) if n <= len(begin) for c in combinations(range(len(begin)), len(begin) - n))
    return sorted({"".join(begin[i] for i in c) for c in kept})


@dataclass(frozen=True)
class Dictionary:
    """(rest, term, documents), in the order of rests; a term of a length that no typo may lead to is left out."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def build(self, postings: DataFrame) -> Dictionary:
        """The dictionary of an index's terms with the number of documents that have each. A rest of few letters is common: its rows are spread by their terms."""
        terms = stored(postings.groupBy("term").agg(F.count_distinct("document_id").alias("documents")))
        tasks = max(self.buckets, -(-terms.count() // TASK_TERMS))
        begin, size = F.array(F.substring("term", 1, BEGINNING)), F.length("term")
        one, two = F.when(size >= ONE_TYPO - 1, _dropped(begin)), F.when(size >= TWO_TYPOS - 2, _dropped(_dropped(begin)))
        none = F.array().cast("array<string>")
        found = terms.where(size >= ONE_TYPO - 1).select("term", "documents", F.explode(F.array_distinct(F.concat(begin, F.coalesce(one, none), F.coalesce(two, none)))).alias("rest"))
        found = found.repartition(tasks, "term").sortWithinPartitions("rest", "term")
        found.write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(self.path)
        return self

    def near(self, word: str, edits: int | None = None) -> DataFrame:
        """(term, documents, distance) of the terms within `edits` of a word, by default as many as its length allows; itself too if it is one."""
        edits = allowed(word) if edits is None else edits
        met = self.spark.read.parquet(self.path).where(F.col("rest").isin(rests(word, edits)) & F.length("term").between(len(word) - edits, len(word) + edits))
        distance = F.levenshtein("term", F.lit(word), edits)
        return met.select("term", "documents").distinct().withColumn("distance", distance).where(F.col("distance") >= 0)

    def expanded(self, query: Node | None) -> Node | None:
        """A query in which each word may be any term near to it. Words of phrases and of negations stay as they are."""
        if query is None or query.kind in ("phrase", "not"):
            return query
        if query.kind == "term":
            terms = sorted({query.term} | {r["term"] for r in self.near(query.term).select("term").collect()}) if allowed(query.term) else [query.term]
            return query if len(terms) == 1 else Node("or", nodes=tuple(Node("term", t) for t in terms))
        return Node(query.kind, nodes=tuple(self.expanded(n) for n in query.nodes))
