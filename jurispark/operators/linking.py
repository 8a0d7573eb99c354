"""Citation links: from texts to resolved articles and statutes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jurispark.functions import citations as C
from jurispark.functions.judgment import sentence_around


def link(documents: DataFrame, acts: DataFrame, provisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links to articles, links to statutes, and all mentions of statutes, of documents (document_id, text)."""
    return resolve(scan(documents), acts, provisions)


def scan(documents: DataFrame) -> DataFrame:
    """(document_id, found, bare): the citations of articles and of statutes in each text, with the sentences around them."""
    text = C.plain_spaces(F.coalesce("text", F.lit("")))
    docs = documents.select("document_id", text.alias("text")).withColumns({"found": C.provision_citations(F.col("text")), "bare": C.act_citations(F.col("text"))})
    return docs.withColumns({"found": _with_excerpts("found"), "bare": _with_excerpts("bare")}).drop("text")


def resolve(docs: DataFrame, acts: DataFrame, provisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links to articles, links to statutes, and all mentions of statutes, of what scan has found.

    Citations resolve to statutes by (act_number, year) and to articles by number and letter; of several articles with equal keys the one
    that comes last by `ordering` counts. Unresolved articles are dropped; statutes cited inside an article's citation are not linked again.
    Each passage counts once. Which statutes lie inside an article's citation is decided within the document, where both lists are at
    hand; the joins are by equal keys, and only citations are shuffled.
    """
    found = docs.select("document_id", F.inline("found"))
    targets = provisions.where("kind = 'article' AND article_number IS NOT NULL").groupBy("act_id", F.col("article_number").alias("article"), F.coalesce("article_letter", F.lit("")).alias("key"))
    targets = targets.agg(F.max_by("provision_id", F.struct("ordering", "provision_id")).alias("provision_id"))
    known = acts.select("act_id", "act_number", "year")
    resolved = found.join(known, ["act_number", "year"], "left").withColumn("key", F.coalesce("letter", F.lit("")))
    to_provisions = resolved.join(targets, ["act_id", "article", "key"])
    to_provisions = to_provisions.select("document_id", "provision_id", F.col("offset").alias("char_offset"), F.lit("explicit").alias("match_type"), F.col("paragraph").alias("paragraph_number"), F.col("point").alias("point_number"), F.col("text").alias("citation_text"), "excerpt")
    to_provisions = to_provisions.dropDuplicates(["document_id", "provision_id", "char_offset"])
    covered = F.transform("bare", lambda a: F.struct(a.alias("c"), F.exists("found", lambda p: (a["offset"] >= p["offset"]) & (a["offset"] < p["offset"] + p["length"])).alias("covered")))
    mentions = docs.select("document_id", F.inline(covered)).select("document_id", "c.*", "covered").join(known, ["act_number", "year"], "left")
    to_acts = mentions.where("NOT covered AND act_id IS NOT NULL")
    to_acts = to_acts.select("document_id", "act_id", F.col("offset").alias("char_offset"), F.lit("explicit").alias("match_type"), "excerpt").dropDuplicates(["document_id", "act_id", "char_offset"])
    return to_provisions, to_acts, mentions.select("document_id", "act_number", "year", "act_id", "offset", "alias")


def _with_excerpts(citations: str):
    """The citations with the sentences around them, so that no text has to travel with each."""
    return F.transform(citations, lambda c: c.withField("excerpt", sentence_around(F.col("text"), c["offset"])))
