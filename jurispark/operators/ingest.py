"""Ingestion feeds: where to stop, what each run did, how far each source is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jurispark.session import stored


def until_known(feed: DataFrame, order: str, run: int = 40) -> DataFrame:
    """Feed items before the sweep stops: at the end of the first `run` known items in a row; items without a court do not count.

    The feed has `known` and `relevant` (booleans). Runs are told apart by the number of new items before them. That number and the
    places in the feed come from sums over ranges of it, so no task holds the feed.
    """
    counted = feed.where("relevant").select(order, F.col("known"))
    fresh = running_sum(counted, order, (~F.col("known")).cast("long"), "fresh")
    met = fresh.where("known").groupBy("fresh").agg(F.count("*").alias("n"), F.min(order).alias("begin"))
    first = met.where(F.col("n") >= run).agg(F.min("fresh").alias("fresh"))
    inside = fresh.where("known").join(first, "fresh").orderBy(order).limit(run).agg(F.max(order).alias("last"))
    return feed.join(F.broadcast(inside), F.col("last").isNull() | (F.col(order) <= F.col("last"))).drop("last")


def running_sum(rows: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """rows with the sum of value up to each in the order of a column. Rows are dealt by ranges of it, so ranges hold like numbers of rows
    whatever its values; only one sum a range meets in one task."""
    ranged = stored(rows.withColumn("__v", value).repartitionByRange(order).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy("__range").agg(F.sum("__v").alias("__s"))
    before = sums.select("__range", (F.sum("__s").over(Window.orderBy("__range")) - F.col("__s")).alias("__before"))
    within = F.sum("__v").over(Window.partitionBy("__range").orderBy(order))
    return ranged.withColumn("__within", within).join(F.broadcast(before), "__range").withColumn(name, F.col("__within") + F.col("__before")).drop("__range", "__v", "__within", "__before")


def run_log(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """One row a run: how many items it indexed, skipped or failed on, its state and its first error."""
    n = lambda kind: F.count_if(F.col("outcome") == kind)
    first = F.min_by(F.when(F.col("outcome") == "error", F.col("message")), F.when(F.col("outcome") == "error", F.col("seq")))
    state = F.when(n("error") == F.count("*"), "failed").otherwise("success")
    return outcomes.groupBy(*by).agg(n("indexed").alias("indexed"), n("skipped").alias("skipped"), n("error").alias("errors"), first.alias("error_sample"), state.alias("status"))


def progress(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """Each source with its documents, zero where it has none."""
    counts = documents.groupBy("source").agg(F.count("*").alias("documents"))
    return sources.join(counts, "source", "left").withColumn("documents", F.coalesce("documents", F.lit(0)).cast("long"))


def all_or_null(column: str) -> Column:
    """The sum, or null if any value is unknown."""
    return F.when(F.count(column) == F.count("*"), F.sum(column))


def remaining(total: str, parts: list[str]) -> Column:
    """A total less its parts, never below zero; null if any of them is."""
    left = F.col(total) - sum(F.col(p) for p in parts)
    return F.when(left.isNotNull(), F.greatest(F.lit(0), left))


def harvest_aliases(mentions: DataFrame, least: int = 2, most: int = 6) -> DataFrame:
    """(act_id, aliases): the short names used at least `least` times, the commonest first, over all mentions."""
    counts = mentions.where("alias IS NOT NULL").groupBy("act_id", "alias").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    place = F.row_number().over(Window.partitionBy("act_id").orderBy(F.desc("n"), "alias"))
    top = counts.withColumn("place", place).where(F.col("place") <= most)
    names = F.transform(F.array_sort(F.collect_list(F.struct("place", "alias"))), lambda x: x["alias"])
    return top.groupBy("act_id").agg(names.alias("aliases"))


def unknown_acts(mentions: DataFrame, acts: DataFrame, most: int = 10) -> DataFrame:
    """Statutes that are cited but not known, by the number of documents that cite them."""
    missing = mentions.join(acts, ["act_number", "year"], "left_anti")
    counts = missing.groupBy("act_number", "year").agg(F.count_distinct("document_id").alias("documents"))
    return counts.orderBy(F.desc("documents"), "year", "act_number").limit(most)
