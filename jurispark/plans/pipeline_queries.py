"""Queries on incremental merging, ingestion state and harvesting, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurispark.operators import backfill as B
from jurispark.operators import ingest as I
from jurispark.operators import merge as M
from jurispark.operators import retrieval as R
from jurispark.plans import views as V
from jurispark.plans.graph_queries import JUDGMENTS_SQL
from jurispark.session import stored, table


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text"), F.col("lang").alias("title"))
    store = docs.where("doc_id % 3 <> 0").withColumn("title", F.lit("old"))
    new = docs.where("doc_id % 4 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return tuple(d.select("doc_id", "source", "title", M.text_hash(F.col("text")).alias("text_hash")) for d in (store, new))


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, new = _snapshots(spark, sf_dir)
    return M.upsert(store, new, ["source", "doc_id"])


def known_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, new = _snapshots(spark, sf_dir)
    return M.unknown(new, store, ["source", "doc_id"]).select("doc_id")


def _anchors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("act_id"), F.concat(F.lit("G"), F.floor(F.col("s_suppkey") / 25).cast("int")).alias("anchor"), "s_name")
    parsed = rows.where("act_id < 12 AND id % 4 <> 1").select("act_id", "anchor", F.lower("s_name").alias("s_name")).union(spark.range(0, 6).select(F.col("id").cast("int"), F.lit("X0"), F.lit("annex")))
    return M.first_of(rows, ["act_id", "anchor"], [F.asc("id")]), M.first_of(parsed, ["act_id", "anchor"], [F.asc("s_name")])


def anchor_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, parsed = _anchors(spark, sf_dir)
    return M.merge_anchors(store, parsed, 1_000_000 + F.col("act_id").cast("long"))


def _merged_tree(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All statutes after some were read again. Stored articles have two chapters a statute and their label's parts as paragraphs, one of which is there twice."""
    store, parsed = _anchors(spark, sf_dir)
    acts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("act_id"), F.col("n_nationkey").alias("act_number"), F.lit(2000).alias("year"), F.col("n_name").alias("title"),
        F.lit("1a").alias("codex_version"), F.lit("old").alias("source_hash"), F.array(F.lit("short")).alias("aliases"), F.lit(None).cast("timestamp").alias("fetched_at"))
    none = F.lit(None).cast("string")
    provisions = store.select("id", "act_id", "anchor", F.lit("article").alias("kind"), F.lit(1).alias("article_number"), none.alias("article_letter"), F.col("s_name").alias("label"), none.alias("heading"), none.alias("full_text"),
        F.lit(False).alias("is_repealed"), F.lit(0).alias("ordering"), F.lit(None).cast("long").alias("chapter_id"))
    part = F.struct("anchor", F.lit("article").alias("kind"), F.lit(1).alias("article_number"), none.alias("article_letter"), F.col("s_name").alias("label"), none.alias("heading"), none.alias("full_text"), F.lit(False).alias("is_repealed"),
        F.when(F.col("anchor") != "X0", 0).alias("chapter"), F.filter(F.split(F.concat("s_name", F.lit("#sami#viðbót#sami")), "#"), lambda t: t != "").alias("paragraphs"))
    chapter = F.struct(F.lit("I").alias("numeral"), none.alias("letter"), F.lit("I. kafli").alias("label"), F.lit("Almennt").alias("title"))
    read = parsed.groupBy(F.col("act_id").alias("act_number")).agg(F.array_sort(F.collect_list(part)).alias("provisions"))
    read = read.select("act_number", F.lit(2000).alias("year"), F.lit("").alias("title"), F.lit("1b").alias("codex_version"), F.lit("new").alias("source_hash"), F.array(chapter).alias("chapters"), "provisions")
    held = acts.select((F.col("act_id") * 10).cast("long").alias("id"), "act_id", F.lit("I").alias("numeral"), none.alias("letter"), F.lit("I. kafli").alias("label"), F.lit("Almennt").alias("title"), F.lit(0).alias("ordering"))
    held = held.unionByName(held.withColumns({"id": F.col("id") + 1, "numeral": F.lit("II"), "label": F.lit("II. kafli"), "title": F.lit("Annað"), "ordering": F.lit(1)}))
    texts = F.filter(F.split(F.concat("s_name", F.lit("#sami#sami")), "#"), lambda t: t != "")
    texts = store.select(F.col("id").alias("provision_id"), F.posexplode(texts).alias("ordering", "text")).select((F.col("provision_id") * 10 + F.col("ordering")).cast("long").alias("id"), "provision_id", "ordering", "text")
    return M.merge_statutes(acts, provisions, held, texts, read, F.lit(None).cast("timestamp"))


def statute_tree_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chapters and paragraphs after some statutes were read again, with the ids that unchanged ones keep."""
    out = _merged_tree(spark, sf_dir)
    owner = out["provisions"].select(F.col("id").alias("provision_id"), "act_id", "anchor")
    kept = F.when((F.col("id") >= 0) & (F.col("id") < 10_000_000), F.col("id"))  # new ids are hashes
    rows = out["paragraphs"].join(owner, "provision_id").select(F.lit("paragraph").alias("kind"), kept.alias("id"), "act_id", "anchor", F.col("ordering").cast("int").alias("ordering"), "text")
    none = F.lit(None).cast("string")
    return rows.union(out["chapters"].select(F.lit("chapter"), kept, "act_id", none, F.col("ordering").cast("int"), "title")).union(out["acts"].select(F.lit("act"), F.lit(None).cast("long"), "act_id", none, F.lit(0), "outcome"))


def statute_tree_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statutes read again, whole: their articles after merging, with how many paragraphs each now has and which chapter it is in."""
    out = _merged_tree(spark, sf_dir)
    counts = out["paragraphs"].groupBy(F.col("provision_id").alias("id")).agg(F.count("*").alias("paragraphs"))
    met = out["provisions"].join(counts, "id", "left").join(out["chapters"].select(F.col("id").alias("chapter_id"), F.col("numeral").alias("chapter")), "chapter_id", "left")
    titles = out["acts"].select("act_id", "title", "codex_version")
    return met.join(titles, "act_id").select(F.when(F.col("outcome") != "inserted", F.col("id")).alias("id"), "act_id", "anchor", "outcome", "label", "chapter", F.coalesce("paragraphs", F.lit(0)).cast("long").alias("paragraphs"), "title", "codex_version")


def watermark_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are due again where a statute is new, none where all were known."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("h").alias("text_hash"), F.lit("h").alias("citation_scan_hash"))
    acts = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") == 3, "inserted").otherwise("kept").alias("outcome"))
    new, old = (M.changed(M.reset_watermarks(docs, acts.where(c))) for c in ("true", "outcome = 'kept'"))
    return new.select("doc_id", F.lit("new").alias("case")).union(old.select("doc_id", F.lit("known").alias("case")))


def vanished_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.vanished(*_anchors(spark, sf_dir)).select("id", "act_id", "anchor")


def changed_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", M.text_hash(F.col("text")).alias("text_hash"))
    scanned = F.when(F.col("doc_id") % 3 == 0, F.col("text_hash")).when(F.col("doc_id") % 3 == 1, F.lit("stale"))
    return M.changed(docs.withColumn("citation_scan_hash", scanned)).select("doc_id")


def replaced_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = V.provision_links(spark, sf_dir)
    again = V.judgments(spark, sf_dir).where("document_id % 10 = 0")
    fresh = links.where("document_id % 10 = 0 AND char_offset = 1").withColumn("char_offset", F.lit(99))
    return M.replace_links(links, again, fresh.union(fresh), ["document_id", "provision_id", "char_offset"])


def act_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("act_id"), F.concat(F.lit("Act "), F.col("s_nationkey")).alias("title"), F.col("s_suppkey").alias("ordering"),
        F.concat(F.lit("G"), F.col("s_suppkey")).alias("anchor"), F.col("s_name").alias("label"), F.lit(None).cast("string").alias("heading"), F.upper("s_name").alias("full_text"))
    return M.act_hash(rows)


def first_index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("number"), F.col("p_size").alias("year"), "p_name", "p_partkey")
    return M.first_of(rows, ["number", "year"], [F.asc("p_partkey")])


def cursor_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursors = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.lit(1).alias("next_page"), F.lit(None).cast("int").alias("year"))
    moved = table(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.col("n_name").alias("key"), F.lit(7).alias("next_page"), F.lit(1999).alias("year"))
    return M.move_cursor(cursors, moved)


def ingest_until_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = V.feed(spark, sf_dir).select("event_id", (F.col("value") < 30).alias("known"), (F.col("user_id") % 7 != 0).alias("relevant"))
    return I.until_known(feed, "event_id", 3).select("event_id")


def backfill_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of a budget each round an index of events, with what each fetched: what is known with its version costs nothing, a run that broke off is walked again, and a round after the last fetches nothing."""
    index = V.feed(spark, sf_dir).select("event_id", F.col("event_id").alias("position"), "event_type", F.when(F.col("user_id") % 10 != 0, F.floor("value").cast("string")).alias("version"))
    known = index.where("event_id % 3 = 0").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("version")).otherwise("old").alias("version"))
    budget, cursor, out, run = index.count() // 6 + 1, None, None, 0
    while run < 20:
        B.walk(index, known, ["event_id"], budget, cursor)  # broke off before its cursor was stored
        done = B.walk(index, known, ["event_id"], budget, cursor)
        due = done.due.select(F.lit(run).alias("run"), "event_id", "version")
        out = due if out is None else out.union(due)
        known = stored(known.join(due, "event_id", "left_anti").unionByName(due.select("event_id", "version")))
        cursor, run = done.cursor, run + 1
        if cursor is None:
            break
    after = B.walk(index.where("version IS NOT NULL"), known, ["event_id"], budget)
    return out.select("run", "event_id").union(after.due.select(F.lit(99), "event_id"))


def backfill_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of a budget of pages each over judgments by year, the newest first, as (run, year, page, items)."""
    rows = V.judgments(spark, sf_dir).where("year IS NOT NULL").select("year", "document_id", F.struct("year", "document_id").alias("place"))
    placed = I.running_sum(rows, "place", F.lit(1).cast("long"), "n")  # by ranges, of which a year has many
    ends = placed.groupBy((F.col("year") + 1).alias("next")).agg(F.max("n").alias("end"))
    others = ends.agg(F.array_sort(F.collect_list(F.struct(F.col("next"), F.col("end")))).alias("ends"))  # a struct a year
    before = F.coalesce(F.array_max(F.transform(F.filter("ends", lambda e: e["next"] <= F.col("year")), lambda e: e["end"])), F.lit(0))
    items = stored(placed.crossJoin(F.broadcast(others)).select("year", "document_id", F.ceil((F.col("n") - before) / 500).cast("int").alias("page")))
    pages = items.select("year", "page").distinct().count()
    budget, cursor, out, run = pages // 5 + 1, B.YearCursor(2100), None, 0
    while cursor.year >= B.FIRST_YEAR:
        found, cursor = B.walk_years(items, budget, cursor)
        counts = found.groupBy("year", "page").agg(F.count("*").alias("items")).select(F.lit(run).alias("run"), "year", "page", "items")
        out, run = counts if out is None else out.union(counts), run + 1
    return out


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("value") < 10, "error").when(F.col("value") < 40, "skipped").otherwise("indexed")
    rows = V.feed(spark, sf_dir).select("event_type", F.col("event_id").alias("seq"), outcome.alias("outcome"), F.col("props").alias("message"))
    return I.run_log(rows, ["event_type"])


def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.feed(spark, sf_dir).select("event_type", "event_id", "user_id")
    return R.per_group(rows, ["event_type"], [F.desc("event_id")], 5)


def progress_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "nation").select(F.col("n_name").alias("source"), F.when(F.col("n_nationkey") != 3, F.col("n_nationkey") * 10).alias("total_available"), "n_regionkey")
    return known.groupBy("n_regionkey").agg(I.all_or_null("total_available").alias("total_available"))


def source_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(f"src{k}",) for k in range(25)], "source string")
    return I.progress(known, table(spark, sf_dir, "documents").select("source"))


def remaining_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(F.col("p_size") % 10 != 0, F.lit(20)).alias("a"), F.lit(5).alias("b"))
    return rows.select("p_partkey", I.remaining("p_size", ["a", "b"]).cast("long").alias("other_courts"))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("document_id"), (F.col("l_suppkey") % 30).cast("int").alias("act_number"), (F.col("p_size") % 4).alias("year"),
        (F.col("l_suppkey") % 30).alias("act_id"), F.when(F.col("p_size") > 10, F.concat_ws(" ", F.split("p_name", " ")[0], "p_brand")).alias("alias"))


def alias_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.harvest_aliases(_mentions(spark, sf_dir)).select("act_id", F.array_join("aliases", ",").alias("aliases"))


def unknown_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = V.acts(spark, sf_dir).select(F.col("act_id").alias("act_number"), "year")
    return I.unknown_acts(_mentions(spark, sf_dir), acts)


QUERIES = {f.__name__: f for f in (
    upsert_merge, known_skip, anchor_merge, statute_tree_merge, statute_tree_whole, watermark_reset, vanished_anchors, changed_watermark, replaced_links, act_content_hash, first_index_entries, cursor_moves, ingest_until_known, backfill_walk, backfill_years, run_status,
    recent_runs, progress_totals, source_progress, remaining_totals, alias_harvest, unknown_acts,
)}

OLD = "(SELECT doc_id, source, 'old' AS title, sha256(text) AS text_hash FROM documents WHERE doc_id % 3 <> 0)"
NEW = "(SELECT doc_id, source, lang AS title, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS text_hash FROM documents WHERE doc_id % 4 <> 0)"
ANCHORS = """r AS (SELECT s_suppkey AS id, s_nationkey AS act_id, 'G' || CAST(floor(s_suppkey / 25) AS INT) AS anchor, s_name FROM supplier),
store AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY act_id, anchor ORDER BY id) = 1),
parsed AS (SELECT act_id, anchor, min(s_name) AS s_name FROM (SELECT act_id, anchor, lower(s_name) AS s_name FROM r WHERE act_id < 12 AND id % 4 <> 1 UNION ALL SELECT CAST(i AS INT), 'X0', 'annex' FROM range(0, 6) t(i)) GROUP BY act_id, anchor)"""
MENTIONS = """m AS (SELECT l_orderkey AS document_id, CAST(l_suppkey % 30 AS INT) AS act_number, p_size % 4 AS year, l_suppkey % 30 AS act_id,
CASE WHEN p_size > 10 THEN split_part(p_name, ' ', 1) || ' ' || p_brand END AS alias FROM lineitem JOIN part ON l_partkey = p_partkey)"""

ORACLES = {
    "upsert_merge": f"""SELECT coalesce(o.source, n.source) AS source, coalesce(o.doc_id, n.doc_id) AS doc_id,
CASE WHEN n.doc_id IS NULL OR o.text_hash = n.text_hash THEN o.title ELSE n.title END AS title, CASE WHEN n.doc_id IS NULL OR o.text_hash = n.text_hash THEN o.text_hash ELSE n.text_hash END AS text_hash,
CASE WHEN n.doc_id IS NULL THEN 'kept' WHEN o.doc_id IS NULL THEN 'inserted' WHEN o.text_hash = n.text_hash THEN 'skipped' ELSE 'updated' END AS outcome
FROM {OLD} o FULL OUTER JOIN {NEW} n ON o.doc_id = n.doc_id AND o.source = n.source""",
    "known_skip": f"SELECT doc_id FROM {NEW} n WHERE NOT EXISTS (SELECT 1 FROM {OLD} o WHERE o.doc_id = n.doc_id AND o.source = n.source)",
    "anchor_merge": f"""WITH {ANCHORS} SELECT id, act_id, anchor, s_name, 'kept' AS outcome FROM store WHERE act_id NOT IN (SELECT act_id FROM parsed)
UNION ALL SELECT coalesce(s.id, 1000000 + p.act_id), p.act_id, p.anchor, p.s_name, CASE WHEN s.id IS NULL THEN 'inserted' ELSE 'updated' END FROM parsed p LEFT JOIN store s USING (act_id, anchor)""",
    "statute_tree_merge": f"""WITH {ANCHORS} SELECT id, act_id, anchor, 'kept' AS outcome, s_name AS label, NULL AS chapter, len(list_filter(string_split(s_name, '#'), lambda t: t <> '')) + 2 AS paragraphs, n_name AS title, '1a' AS codex_version FROM store JOIN nation ON n_nationkey = act_id WHERE act_id NOT IN (SELECT act_id FROM parsed)
UNION ALL SELECT s.id, p.act_id, p.anchor, CASE WHEN s.id IS NULL THEN 'inserted' ELSE 'updated' END, p.s_name, CASE WHEN p.anchor <> 'X0' THEN 'I' END, len(list_filter(string_split(p.s_name, '#'), lambda t: t <> '')) + 3, n_name, '1b'
FROM parsed p LEFT JOIN store s USING (act_id, anchor) JOIN nation ON n_nationkey = p.act_id""",
    "statute_tree_whole": f"""WITH {ANCHORS}, o AS (SELECT id, act_id, anchor, unnest(t) AS text, unnest(range(0, len(t))) AS k FROM (SELECT *, list_filter(string_split(s_name || '#sami#sami', '#'), lambda x: x <> '') AS t FROM store)),
f AS (SELECT act_id, anchor, unnest(t) AS text, unnest(range(0, len(t))) AS k FROM (SELECT *, list_filter(string_split(s_name || '#sami#viðbót#sami', '#'), lambda x: x <> '') AS t FROM parsed)),
p AS (SELECT id * 10 + k AS id, act_id, anchor, k, text, row_number() OVER (PARTITION BY act_id, anchor, text ORDER BY k) AS n FROM o), q AS (SELECT *, row_number() OVER (PARTITION BY act_id, anchor, text ORDER BY k) AS n FROM f),
a AS (SELECT n_nationkey AS act_id, n_nationkey IN (SELECT act_id FROM parsed) AS again FROM nation)
SELECT 'paragraph' AS kind, id, act_id, anchor, k::INT AS ordering, text FROM p WHERE act_id NOT IN (SELECT act_id FROM parsed)
UNION ALL SELECT 'paragraph', p.id, q.act_id, q.anchor, q.k, q.text FROM q LEFT JOIN p USING (act_id, anchor, text, n)
UNION ALL SELECT 'chapter', act_id * 10, act_id, NULL, 0, 'Almennt' FROM a UNION ALL SELECT 'chapter', act_id * 10 + 1, act_id, NULL, 1, 'Annað' FROM a WHERE NOT again
UNION ALL SELECT 'act', NULL, act_id, NULL, 0, CASE WHEN again THEN 'updated' ELSE 'kept' END FROM a""",
    "watermark_reset": "SELECT doc_id, 'new' AS case FROM documents",
    "vanished_anchors": f"WITH {ANCHORS} SELECT id, act_id, anchor FROM store s WHERE act_id IN (SELECT act_id FROM parsed) AND NOT EXISTS (SELECT 1 FROM parsed p WHERE p.act_id = s.act_id AND p.anchor = s.anchor)",
    "changed_watermark": "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0",
    "replaced_links": """SELECT l_orderkey AS document_id, l_suppkey AS provision_id, l_linenumber AS char_offset FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0)
UNION ALL SELECT DISTINCT l_orderkey, l_suppkey, 99 FROM lineitem WHERE l_orderkey % 10 = 0 AND l_linenumber = 1""",
    "act_content_hash": """WITH r AS (SELECT s_nationkey, s_suppkey // 4096 AS r, sha256(string_agg(sha256('G' || s_suppkey || chr(0) || s_name || chr(0) || chr(0) || upper(s_name)), '' ORDER BY s_suppkey)) AS h FROM supplier GROUP BY ALL)
SELECT s_nationkey AS act_id, sha256('Act ' || s_nationkey || chr(1) || string_agg(h, '' ORDER BY r)) AS source_hash FROM r GROUP BY s_nationkey""",
    "first_index_entries": "SELECT p_partkey % 40 AS number, p_size AS year, p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey % 40, p_size ORDER BY p_partkey) = 1",
    "cursor_moves": "SELECT n_name AS key, CASE WHEN n_nationkey < 5 THEN 7 ELSE 1 END AS next_page, CASE WHEN n_nationkey < 5 THEN 1999 END AS year FROM nation",
    "ingest_until_known": """WITH c AS (SELECT event_id, value < 30 AS known, user_id % 7 <> 0 AS relevant FROM events),
f AS (SELECT event_id, known, sum(CASE WHEN known THEN 0 ELSE 1 END) OVER (ORDER BY event_id) AS fresh FROM c WHERE relevant),
k AS (SELECT event_id, row_number() OVER (PARTITION BY fresh ORDER BY event_id) AS n FROM f WHERE known)
SELECT event_id FROM events WHERE event_id <= coalesce((SELECT min(event_id) FROM k WHERE n = 3), 1e18)""",
    "backfill_walk": """WITH i AS (SELECT event_id, CASE WHEN user_id % 10 <> 0 THEN CAST(floor(value) AS BIGINT)::VARCHAR END AS version FROM events),
c AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n FROM i WHERE event_id % 3 <> 0 OR event_id % 2 <> 0 OR version IS NULL)
SELECT CAST(n // ((SELECT count(*) FROM events) // 6 + 1) AS INT) AS run, event_id FROM c""",
    "backfill_years": f"""WITH p AS (SELECT year, CAST(ceil(row_number() OVER (PARTITION BY year ORDER BY document_id) / 500) AS INT) AS page FROM {JUDGMENTS_SQL}),
g AS (SELECT year, page, count(*) AS items, row_number() OVER (ORDER BY year DESC, page) - 1 AS n, count(*) OVER () AS pages FROM p GROUP BY year, page) SELECT CAST(n // (pages // 5 + 1) AS INT) AS run, year, page, items FROM g""",
    "run_status": """SELECT event_type, count(*) FILTER (WHERE value >= 40) AS indexed, count(*) FILTER (WHERE value >= 10 AND value < 40) AS skipped, count(*) FILTER (WHERE value < 10) AS errors,
min_by(props, event_id) FILTER (WHERE value < 10) AS error_sample, CASE WHEN count(*) FILTER (WHERE value < 10) = count(*) THEN 'failed' ELSE 'success' END AS status FROM events GROUP BY event_type""",
    "recent_runs": "SELECT event_type, event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 5",
    "progress_totals": """SELECT n_regionkey, CAST(CASE WHEN bool_and(n_nationkey <> 3) THEN sum(n_nationkey * 10) END AS BIGINT) AS total_available FROM nation GROUP BY n_regionkey""",
    "source_progress": "SELECT 'src' || i AS source, count(d.doc_id) AS documents FROM range(0, 25) t(i) LEFT JOIN documents d ON d.source = 'src' || i GROUP BY i",
    "remaining_totals": "SELECT p_partkey, CAST(CASE WHEN p_size % 10 <> 0 THEN greatest(0, p_size - 25) END AS BIGINT) AS other_courts FROM part",
    "alias_harvest": f"""WITH {MENTIONS}, c AS (SELECT act_id, alias, count(*) AS n FROM m WHERE alias IS NOT NULL GROUP BY act_id, alias HAVING count(*) >= 2),
t AS (SELECT *, row_number() OVER (PARTITION BY act_id ORDER BY n DESC, alias) AS place FROM c) SELECT act_id, string_agg(alias, ',' ORDER BY place) AS aliases FROM t WHERE place <= 6 GROUP BY act_id""",
    "unknown_acts": f"""WITH {MENTIONS} SELECT act_number, year, count(DISTINCT document_id) AS documents FROM m WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = act_number AND n_regionkey = year)
GROUP BY act_number, year ORDER BY documents DESC, year, act_number LIMIT 10""",
}
