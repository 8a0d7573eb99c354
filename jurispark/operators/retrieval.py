"""Filters, pages and counts of document retrieval."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_SIZE, MOST_PER_PAGE = 15, 50
COUNT_CAP = 10_000


def in_sources(sources: list[str]) -> Column:
    """Membership in a non-empty list of sources."""
    if not sources:
        raise ValueError("at least one source is needed")
    return F.col("source").isin(list(dict.fromkeys(sources)))


def in_dates(first: str | None = None, last: str | None = None) -> Column:
    """From and up to the midnight that begins these days; later times of the last day are out."""
    found = F.lit(True)
    if first:
        found = found & (F.col("date") >= F.lit(first).cast("timestamp_ntz"))
    if last:
        found = found & (F.col("date") <= F.lit(last).cast("timestamp_ntz"))
    return found


def in_year(year: int | None) -> Column:
    return F.col("year") == year if year else F.lit(True)


def has_all(tags: list[str], column: str = "tags") -> Column:
    """Exact containment of every tag."""
    found = F.lit(True)
    for tag in tags:
        found = found & F.array_contains(column, tag)
    return found


ORDERS = {
    "newest": lambda: [F.desc_nulls_last("date"), F.asc("document_id")],
    "oldest": lambda: [F.asc_nulls_last("date"), F.asc("document_id")],
    "relevance": lambda: [F.desc("rank"), F.desc_nulls_last("date"), F.asc("document_id")],
}


def page(rows: DataFrame, order: str = "newest", number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page in a total order; number and size are clamped to what is allowed."""
    number, size = max(1, int(number)), min(MOST_PER_PAGE, max(1, int(size)))
    return rows.orderBy(*ORDERS[order]()).offset((number - 1) * size).limit(size)


def total_pages(total: int, size: int = PAGE_SIZE) -> int:
    return max(1, ceil(total / size))


def capped_count(rows: DataFrame, cap: int | None = COUNT_CAP) -> DataFrame:
    """One row: total, at most cap, and whether there are more; no more than cap + 1 rows are looked at. Without a cap all rows are counted."""
    if cap is None:
        return rows.agg(F.count("*").alias("total")).withColumn("capped", F.lit(False))
    n = rows.limit(cap + 1).agg(F.count("*").alias("n"))
    return n.select(F.least(F.col("n"), F.lit(cap).cast("long")).alias("total"), (F.col("n") > cap).alias("capped"))


def newest_without(rows: DataFrame, featured, newest: int = 9, kept: int = 8) -> DataFrame:
    """The newest rows without the featured one."""
    first = rows.orderBy(*ORDERS["newest"]()).limit(newest)
    return first.where(F.col("document_id") != featured).orderBy(*ORDERS["newest"]()).limit(kept)


def random_row(rows: DataFrame, seed: int, prefer: Column | None = None) -> DataFrame:
    """One row in a seeded pseudo-random order, preferred ones before others."""
    return rows.orderBy(*([F.desc(prefer)] if prefer is not None else []), F.xxhash64(F.lit(seed), "document_id"), "document_id").limit(1)


def per_group(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def case_number_is(number: str) -> Column:
    """Equality without regard to case; % and _ are ordinary characters."""
    return F.lower("case_number") == number.lower()


def containing(column: str, query: str) -> Column:
    """Substring without regard to case; % and _ are ordinary characters."""
    return F.contains(F.lower(F.col(column)), F.lit(query.lower()))
