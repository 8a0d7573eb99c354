"""The citation graph: judgments, the articles and statutes they cite, and counts of distinct judgments.

One link row is one citing passage, so every count says what it counts. Links are the large side; statutes and articles are joined
to pre-aggregated counts, so their size decides nothing about the plan: Spark broadcasts them where its own statistics allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judgments_per_provision(links: DataFrame) -> DataFrame:
    """(provision_id, judgments): distinct judgments that cite the article."""
    return links.groupBy("provision_id").agg(F.count_distinct("document_id").alias("judgments"))


def provision_badges(links: DataFrame, provisions: DataFrame) -> DataFrame:
    """Every article with its distinct judgments and passages, zero where none cites it."""
    counts = links.groupBy("provision_id").agg(F.count_distinct("document_id").alias("judgments"), F.count("*").alias("passages"))
    found = provisions.join(counts, "provision_id", "left")
    return found.select("provision_id", "act_id", "label", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("judgments", "passages")))


def act_documents(provision_links: DataFrame, provisions: DataFrame, act_links: DataFrame) -> DataFrame:
    """Distinct (act_id, document_id) over both kinds of links. Article links become distinct pairs before they meet the articles."""
    via = provision_links.select("provision_id", "document_id").distinct().join(provisions.select("provision_id", "act_id"), "provision_id")
    return via.select("act_id", "document_id").union(act_links.select("act_id", "document_id")).distinct()


def judgments_per_act(provision_links: DataFrame, provisions: DataFrame, act_links: DataFrame) -> DataFrame:
    return act_documents(provision_links, provisions, act_links).groupBy("act_id").agg(F.count("*").alias("judgments"))


def articles_per_act(provisions: DataFrame) -> DataFrame:
    return provisions.where("kind = 'article'").groupBy("act_id").agg(F.count("*").alias("articles"))




def catalogue(acts: DataFrame, provision_links: DataFrame, provisions: DataFrame, act_links: DataFrame, sort: str = "cases", cited_only: bool = False) -> DataFrame:
    """Every statute with its judgments and articles; sort is title, number, cases or provisions, each with a total order."""
    out = acts.join(judgments_per_act(provision_links, provisions, act_links), "act_id", "left").join(articles_per_act(provisions), "act_id", "left")
    out = out.select(*acts.columns, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("judgments", "articles")))
    if cited_only:
        out = out.where("judgments > 0")
    orders = {
        "title": [F.asc("title"), F.asc("act_id")],
        "number": [F.desc("year"), F.desc("act_id")],
        "cases": [F.desc("judgments"), F.asc("title"), F.asc("act_id")],
        "provisions": [F.desc("articles"), F.asc("title"), F.asc("act_id")],
    }
    if sort not in orders:
        raise ValueError(f"sort must be one of {', '.join(orders)}")
    return out.orderBy(*orders[sort])


def corpus_totals(acts: DataFrame, provisions: DataFrame, links: DataFrame) -> DataFrame:
    """One row: statutes, articles, and articles that some judgment cites."""
    a = acts.agg(F.count("*").alias("acts"))
    b = provisions.agg(F.count_if(F.col("kind") == "article").alias("articles"))
    c = links.agg(F.count_distinct("provision_id").alias("linked_provisions"))
    one = F.lit(1).alias("one")
    return a.select(one, "*").join(b.select(one, "*"), "one").join(c.select(one, "*"), "one").drop("one")


def citing_all_provisions(links: DataFrame, provision_ids: list) -> DataFrame:
    """Judgments that cite every one of the articles: one pass over the links of these articles."""
    wanted = list(dict.fromkeys(provision_ids))
    if not wanted:
        raise ValueError("provision_ids must not be empty")
    found = links.where(F.col("provision_id").isin(wanted)).groupBy("document_id").agg(F.count_distinct("provision_id").alias("n"))
    return found.where(F.col("n") == len(wanted)).select("document_id")


def citing_act(act_id, provision_links: DataFrame, provisions: DataFrame, act_links: DataFrame) -> DataFrame:
    """Judgments that cite the statute, through an article or by itself."""
    own = provisions.where(F.col("act_id") == act_id).select("provision_id")
    via = provision_links.join(own, "provision_id", "left_semi").select("document_id")
    return via.unionAll(act_links.where(F.col("act_id") == act_id).select("document_id")).distinct()


def with_citations(judgments: DataFrame, provision_ids: list, act_ids: list, provision_links: DataFrame, provisions: DataFrame, act_links: DataFrame) -> DataFrame:
    """Judgments that cite all the articles and all the statutes."""
    out = judgments
    if provision_ids:
        out = out.join(citing_all_provisions(provision_links, provision_ids), "document_id", "left_semi")
    for act_id in dict.fromkeys(act_ids):
        out = out.join(citing_act(act_id, provision_links, provisions, act_links), "document_id", "left_semi")
    return out


def provision_cases(provision_id, links: DataFrame, judgments: DataFrame) -> DataFrame:
    """Judgments that cite the article, newest first (undated ones before), with their passages in order."""
    own = links.where(F.col("provision_id") == provision_id)
    passages = own.groupBy("document_id").agg(F.count("*").alias("passages"), F.array_sort(F.collect_list("char_offset")).alias("offsets"))
    found = judgments.join(passages, "document_id")
    return found.orderBy(F.desc_nulls_first("date"), F.asc_nulls_last("case_number"), "document_id")


def collapse_passages(passages: DataFrame, by: list[str]) -> DataFrame:
    """Passages with equal excerpts of one judgment as one: the first in text order, with the number of occurrences.

    Blank excerpts never collapse.
    """
    key = F.when(F.trim(F.coalesce("excerpt", F.lit(""))) == "", F.concat(F.lit("@"), F.col("char_offset").cast("string"))).otherwise(F.concat(F.lit("="), F.col("excerpt")))
    found = passages.withColumn("__key", key).groupBy(*by, "__key").agg(F.min(F.struct("char_offset", "excerpt")).alias("first"), F.count("*").alias("occurrences"))
    return found.select(*by, F.col("first.char_offset").alias("char_offset"), F.col("first.excerpt").alias("excerpt"), "occurrences")


def related_cases(cited: DataFrame, judgments: DataFrame, most_cited: int = 25, most: int = 10) -> DataFrame:
    """(document_id, related_id, place): judgments whose case number is among the first `most_cited` of a document's `case_numbers`."""
    wanted = cited.select("document_id", F.explode(F.slice("case_numbers", 1, most_cited)).alias("case_number")).distinct()
    found = wanted.join(judgments.select("case_number", F.col("document_id").alias("related_id"), "date"), "case_number").where("document_id <> related_id")
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc_nulls_last("date"), "related_id"))
    return found.select("document_id", "related_id", place.alias("place")).where(F.col("place") <= most)


def adjacent_groups(rows: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """rows with group_no: 1, 2, ... for runs of rows with equal values, nulls equal, in order within `by`."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    return rows.withColumn("__changed", changed.cast("int")).withColumn("group_no", F.sum("__changed").over(w)).drop("__changed")
