"""Walks over what a source lists, a budget at a time: each run takes up where the last one's cursor stands, and round again when the end is reached."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jurispark.operators.ingest import running_sum
from jurispark.session import stored

FIRST_YEAR = 1900


@dataclass(frozen=True)
class Walk:
    """due are the entries to fetch, with all columns of the index; skipped how many were passed over as known; cursor where the next run begins, None for the start."""

    due: DataFrame
    skipped: int
    cursor: int | None


def walk(index: DataFrame, known: DataFrame, keys: list[str], budget: int, cursor: int | None = None, order: str = "position", version: str = "version") -> Walk:
    """One run along an index (keys, position, version, ...) from the cursor on, until `budget` entries are to be fetched or the index ends.

    An entry whose key is known with the version listed costs nothing; one that is new, that has another version, or that is listed without one has to be fetched. The run ends right behind
    the entry that uses up the budget; at the end of the index the cursor goes back to the start, so that scheduled runs go on refreshing. A cursor past the end starts over. What is due follows
    from the index, the known versions and the cursor alone: a run that broke off is walked again as it was. Costs are added up by ranges of the index; positions are one an entry.
    """
    if budget < 1:
        raise ValueError("a budget is 1 at least")
    if cursor is not None and index.where(F.col(order) >= cursor).isEmpty():
        cursor = None
    rows = index if cursor is None else index.where(F.col(order) >= cursor)
    held = known.select(*keys, F.col(version).alias("__known")).dropDuplicates(keys)
    costs = F.col("__known").isNull() | F.col(version).isNull() | (F.col("__known") != F.col(version))
    rows = rows.join(held, keys, "left").withColumn("__cost", costs.cast("long")).drop("__known")
    summed = stored(running_sum(rows, order, F.col("__cost"), "__spent").withColumn("__before", F.col("__spent") - F.col("__cost")))
    met = summed.where(F.col("__before") < budget)
    found = summed.agg(F.count_if((F.col("__before") < budget) & (F.col("__cost") == 0)).alias("skipped"), F.min(F.when(F.col("__before") >= budget, F.col(order))).alias("next")).first()
    return Walk(met.where("__cost = 1").select(*index.columns), found["skipped"], found["next"])


@dataclass(frozen=True)
class YearCursor:
    year: int
    page: int = 1


def walk_years(items: DataFrame, budget: int, cursor: YearCursor, first_year: int = FIRST_YEAR) -> tuple[DataFrame, YearCursor]:
    """The items (year, page, ...) of the next `budget` pages from the cursor on, years going down and pages up, and where the next run begins.

    A year's pages are read up to the first one that is missing; a year without more pages costs nothing. Below first_year nothing is looked for: a cursor there stays there.
    Only pages are counted and put in order, and of these at most `budget`.
    """
    if budget < 1:
        raise ValueError("a budget is 1 at least")
    pages = items.where((F.col("year") >= first_year) & (F.col("year") <= cursor.year)).select("year", "page").distinct()
    row = F.row_number().over(Window.partitionBy("year").orderBy("page"))
    pages = pages.withColumn("__n", row).where(F.col("__n") == F.col("page")).drop("__n")
    ahead = pages.where((F.col("year") < cursor.year) | (F.col("page") >= cursor.page))
    taken = stored(ahead.orderBy(F.desc("year"), "page").limit(budget))
    last = taken.groupBy().agg(F.count("*").alias("n"), F.min_by(F.struct("year", "page"), F.struct("year", -F.col("page"))).alias("last")).first()
    ended = last["n"] < budget
    found = items.join(F.broadcast(taken) if budget <= 1_000_000 else taken, ["year", "page"], "left_semi")
    return found, YearCursor(first_year - 1) if ended else YearCursor(last["last"]["year"], last["last"]["page"] + 1)

