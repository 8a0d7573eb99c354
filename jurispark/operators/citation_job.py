"""The incremental citation job over whole tables: documents that are new or changed are scanned, once, and their links and marks replaced. `link_store` keeps the tables in buckets and writes only some."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jurispark.operators import ingest, linking, merge
from jurispark.operators.link_store import BROADCAST_ROWS
from jurispark.session import stored


@dataclass(frozen=True)
class Scan:
    """What a run leaves: the whole link tables, documents with their marks, statutes with their aliases, one row of statistics, unknown statutes."""

    provision_links: DataFrame
    act_links: DataFrame
    documents: DataFrame
    acts: DataFrame
    stats: DataFrame
    unknown: DataFrame


def run(documents: DataFrame, acts: DataFrame, provisions: DataFrame, provision_links: DataFrame, act_links: DataFrame, most: int | None = None) -> Scan:
    """One run over documents (document_id, text, text_hash, citation_scan_hash, ...).

    Documents whose mark is not their text's hash are scanned, at most `most` of them in the order of ids. Their links of both kinds are
    replaced and their marks move; all else stays. A document without a text cannot be scanned: it counts as an error and keeps its mark
    and links, so that the next run tries it again. Statutes that the scanned documents name get the short names used twice and more; others keep theirs.
    A run after which nothing changed scans nothing. Without statutes there is nothing to link to: ValueError.
    """
    if acts.isEmpty():
        raise ValueError("no statutes yet: load them before citations are linked")
    due = merge.changed(documents)
    due = due.orderBy("document_id").limit(most) if most is not None else due
    due = due.select("document_id", "text", "text_hash")
    scanned = due.where("text IS NOT NULL")
    found = stored(linking.scan(scanned))  # once for all that follows from it
    to_provisions, to_acts, mentions = linking.resolve(found, acts, provisions)
    own = ["document_id", "provision_id", "char_offset"], ["document_id", "act_id", "char_offset"]
    links = merge.replace_links(provision_links, scanned, to_provisions.select(*provision_links.columns), own[0])
    bare = merge.replace_links(act_links, scanned, to_acts.select(*act_links.columns), own[1])
    marks = stored(scanned.select("document_id", F.col("text_hash").alias("__mark")))
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks  # the marks go to the documents, with their texts, not these to them
    marked = documents.join(marks, "document_id", "left").withColumn("citation_scan_hash", F.coalesce("__mark", "citation_scan_hash")).drop("__mark")
    named = ingest.harvest_aliases(mentions.where("act_id IS NOT NULL").select("act_id", "alias")).withColumnRenamed("aliases", "__found")
    with_names = acts.join(named, "act_id", "left").withColumn("aliases", F.coalesce("__found", "aliases")).drop("__found")
    stats = due.agg(F.count("text").alias("indexed"), F.count_if(F.col("text").isNull()).alias("errors"), F.min(F.when(F.col("text").isNull(), F.concat(F.col("document_id").cast("string"), F.lit(": no text")))).alias("error_sample"))
    return Scan(links, bare, marked, with_names, stats, ingest.unknown_acts(mentions, acts))
