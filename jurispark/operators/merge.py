"""Incremental, idempotent merging of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(store: DataFrame, incoming: DataFrame, keys: list[str], content: str = "text_hash") -> DataFrame:
    """store after the incoming rows, with outcome: inserted, updated, skipped (equal content hash) or kept (not in the feed).

    A skipped row keeps everything as stored, other columns too. Both sides have equal columns and one row a key.
    """
    cols = [c for c in store.columns if c not in keys]
    old = store.select(*keys, F.struct(*cols).alias("old"))
    new = incoming.select(*keys, F.struct(*cols).alias("new"))
    both = old.join(new, keys, "full_outer")
    outcome = (
        F.when(F.col("new").isNull(), "kept")
        .when(F.col("old").isNull(), "inserted")
        .when(F.col(f"old.{content}").eqNullSafe(F.col(f"new.{content}")), "skipped")
        .otherwise("updated")
    )
    both = both.withColumn("outcome", outcome)
    row = F.when(F.col("outcome").isin("inserted", "updated"), F.col("new")).otherwise(F.col("old"))
    return both.withColumn("row", row).select(*keys, *(F.col(f"row.{c}").alias(c) for c in cols), "outcome")


def unknown(candidates: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that the store does not have yet."""
    return candidates.join(store.select(*keys), keys, "left_anti")


def merge_anchors(store: DataFrame, parsed: DataFrame, new_id: Column, read: DataFrame | None = None) -> DataFrame:
    """Articles of re-read statutes on (act_id, anchor), so that links to them live on: an anchor met again keeps its id,
    a new one gets new_id, a vanished one goes. Statutes that were not re-read, those of `read` or else of parsed, stay as they are."""
    keys = ["act_id", "anchor"]
    cols = [c for c in parsed.columns if c not in keys]
    untouched = store.join((parsed if read is None else read).select("act_id").distinct(), "act_id", "left_anti").select("id", *keys, *cols, F.lit("kept").alias("outcome"))
    met = parsed.join(store.select("id", *keys), keys, "left")
    outcome = F.when(F.col("id").isNull(), "inserted").otherwise("updated")
    met = met.select(F.coalesce("id", new_id).alias("id"), *keys, *cols, outcome.alias("outcome"))
    return untouched.unionByName(met)


def vanished(store: DataFrame, parsed: DataFrame) -> DataFrame:
    """Stored articles of re-read statutes whose anchor is gone."""
    own = store.join(parsed.select("act_id").distinct(), "act_id", "left_semi")
    return own.join(parsed.select("act_id", "anchor"), ["act_id", "anchor"], "left_anti")


def changed(documents: DataFrame, content: str = "text_hash", scanned: str = "citation_scan_hash") -> DataFrame:
    """Documents never scanned or changed since."""
    return documents.where(~F.col(content).eqNullSafe(F.col(scanned)))


def replace_links(links: DataFrame, rescanned: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """links with those of rescanned documents replaced by fresh ones, one a key."""
    kept = links.join(rescanned.select("document_id").distinct(), "document_id", "left_anti")
    return kept.unionByName(fresh.dropDuplicates(keys))


def act_hash(provisions: DataFrame, title: str = "title", run: int = 4096) -> DataFrame:
    """(act_id, source_hash) over the title and the articles in order: each article is hashed by itself, then the hashes of each range of `run`
    places, then those of the ranges, so that no row holds the text of a statute."""
    part = F.sha2(F.concat_ws("\u0000", *(F.coalesce(c, F.lit("")) for c in ("anchor", "label", "heading", "full_text"))), 256)
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["hash"]), "")
    rows = provisions.select("act_id", F.col(title).alias("title"), F.floor(F.col("ordering") / run).alias("range"), F.struct("ordering", part.alias("hash")).alias("line"))
    ranges = rows.groupBy("act_id", "title", "range").agg(F.sha2(joined("line"), 256).alias("hash"))
    found = ranges.groupBy("act_id", "title").agg(joined(F.struct("range", "hash")).alias("all"))
    return found.select("act_id", F.sha2(F.concat("title", F.lit("\u0001"), "all"), 256).alias("source_hash"))


def keep_ids(stored: DataFrame, fresh: DataFrame, within: str, content: list[str], name: str) -> DataFrame:
    """fresh (within, ordering, ...) with the ids of stored rows that say the same: of rows of one parent with equal content the first ones meet, then the second ones, in their order.

    So a row keeps its id wherever it moves in its parent and whatever is put in, taken out or changed beside it. Others get an id from their parent, content and count.
    """
    place = F.row_number().over(Window.partitionBy(within, *content).orderBy("ordering"))
    known = stored.select("id", within, *content, place.alias("__n"))
    same = [known[c].eqNullSafe(F.col(f"f.{c}")) for c in (within, *content, "__n")]
    met = fresh.withColumn("__n", place).alias("f").join(known, same, "left")
    new = F.xxhash64(F.lit(name), f"f.{within}", *(F.coalesce(F.col(f"f.{c}").cast("string"), F.lit("\u0000")) for c in content), "f.__n")
    return met.select(F.coalesce(known["id"], new).alias("id"), *(F.col(f"f.{c}") for c in fresh.columns))


CHAPTER = ["numeral", "letter", "label", "title"]


def merge_statutes(acts: DataFrame, provisions: DataFrame, chapters: DataFrame, paragraphs: DataFrame, parsed: DataFrame, fetched_at: Column) -> dict[str, DataFrame]:
    """The statutes, articles, chapters and paragraphs after re-reading some statutes, each table whole: what belongs to other statutes stays as it is.

    parsed has a row a statute: act_number, year, title, codex_version, source_hash, chapters (array<struct<numeral, letter, label, title>>) and
    provisions (array<struct<anchor, kind, article_number, article_letter, label, heading, full_text, is_repealed, chapter, paragraphs>>). A statute is
    known by number and year and keeps its id and aliases; of one read twice the row with the larger source_hash counts. Articles are merged
    on (act_id, anchor), so links to them live on. Chapters (id, act_id, numeral, letter, label, title, ordering) and paragraphs (id, provision_id, ordering, text) have no names
    of their own: those that say what they said keep their ids (`keep_ids`). Ids of new rows come from what they are, so a job that is run again gives the same.
    """
    key = ["act_number", "year"]
    read = first_of(parsed, key, [F.desc("source_hash")])
    fresh_id = F.xxhash64(F.lit("act"), "act_number", "year")
    known = acts.select(*key, F.col("act_id").alias("known_id"), F.col("title").alias("known_title"), "aliases")
    read = read.join(known, key, "left").withColumn("act_id", F.coalesce("known_id", fresh_id))
    read = read.withColumn("outcome", F.when(F.col("known_id").isNull(), "inserted").otherwise("updated"))
    title = F.coalesce(F.nullif("title", F.lit("")), F.col("known_title"), F.lit("")).alias("title")
    updated = read.select("act_id", *key, title, "codex_version", "source_hash", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), fetched_at.alias("fetched_at"), "outcome")
    untouched = acts.join(read.select("act_id"), "act_id", "left_anti").withColumn("outcome", F.lit("kept"))
    named = read.select("act_id", F.posexplode("chapters").alias("ordering", "c")).select("act_id", *(F.col(f"c.{c}") for c in CHAPTER), "ordering")
    named = keep_ids(chapters, named, "act_id", CHAPTER, "chapter")
    all_chapters = chapters.join(read.select("act_id"), "act_id", "left_anti").unionByName(named)
    parts = read.select("act_id", F.posexplode("provisions").alias("ordering", "p")).select("act_id", "ordering", "p.*")
    parts = first_of(parts, ["act_id", "anchor"], [F.desc("ordering")])
    parts = parts.join(named.select("act_id", F.col("ordering").alias("chapter"), F.col("id").alias("chapter_id")), ["act_id", "chapter"], "left")
    cols = ["kind", "article_number", "article_letter", "label", "heading", "full_text", "is_repealed", "ordering", "chapter_id"]
    met = merge_anchors(provisions.select("id", "act_id", "anchor", *cols), parts.select("act_id", "anchor", *cols), F.xxhash64(F.lit("provision"), "act_id", "anchor"), read)
    texts = met.where("outcome <> 'kept'").select("id", "act_id", "anchor").join(parts.select("act_id", "anchor", "paragraphs"), ["act_id", "anchor"])
    texts = texts.select(F.col("id").alias("provision_id"), F.posexplode("paragraphs").alias("ordering", "text"))
    reread = provisions.join(read.select("act_id"), "act_id", "left_semi").select(F.col("id").alias("provision_id"))
    all_paragraphs = paragraphs.join(reread, "provision_id", "left_anti").unionByName(keep_ids(paragraphs, texts, "provision_id", ["text"], "paragraph"))
    return {"acts": untouched.unionByName(updated, allowMissingColumns=True), "provisions": met, "chapters": all_chapters, "paragraphs": all_paragraphs}


def reset_watermarks(documents: DataFrame, merged_acts: DataFrame, scanned: str = "citation_scan_hash") -> DataFrame:
    """documents to be scanned again, all of them, if a statute is new: none has been scanned for links to it."""
    new = F.broadcast(merged_acts.agg(F.count_if(F.col("outcome") == "inserted").alias("__new")))
    return documents.join(new).withColumn(scanned, F.when(F.col("__new") == 0, F.col(scanned))).drop("__new")


def move_cursor(cursors: DataFrame, moved: DataFrame) -> DataFrame:
    """cursors (key, next_page, year) with the moved ones in place of theirs."""
    return cursors.join(moved.select("key"), "key", "left_anti").unionByName(moved)
