"""Queries on what connectors land and on the structure of pages and texts, and their SQL. Pages and texts are made of the tables' whole rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurispark.functions import judgment as J
from jurispark.functions import statute as S
from jurispark.session import spread, table
from jurispark.sources import landing

SENTENCE = "Setning sem er nokkuð löng og endar hér."


def judgment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page whose data holds its lines as rich text, read back."""
    line = lambda x: F.struct(F.lit("paragraph").alias("nodeType"), F.array(F.struct(F.lit("text").alias("nodeType"), x.alias("value"))).alias("content"))
    tree = F.struct(F.lit("document").alias("nodeType"), F.transform(F.split("text", "\n"), line).alias("content"))
    item = F.struct(F.lit("WebVerdictByIdItem").alias("__typename"), F.struct(tree.alias("document")).alias("richText"))
    html = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), F.to_json(F.struct(F.lit(1).alias("build"), F.array(item).alias("props"))), F.lit("</script></html>"))
    pages = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", landing.judgment_text(html).alias("t"))
    return pages.select("doc_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("sha"))


def court_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["Hæstiréttur Íslands", "LANDSRÉTTUR", "Héraðsdómur Reykjavíkur", "heradsdomur sudurlands", "Félagsdómur"]
    court = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", landing.source_key(court).alias("source"))


def statute_index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    link = F.concat(F.lit('<a class="x" href="/lagas/154b/'), (1900 + k % 40).cast("string"), F.lpad((k % 7).cast("string"), 3, "0"), F.lit('.html">'), "s_name", F.lit("</a> "))
    pages = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("page")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", link.alias("a")))).alias("links"))
    html = F.concat(F.lit("Útgáfa 154b. "), F.array_join(F.transform("links", lambda x: x["a"]), ""))
    return landing.statute_index(pages.select("page", html.alias("html")), "page", "html").select("page", "number", "year", "title", "version")


def case_link_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    html = F.concat(F.lit('<p><a href="/x">none</a><a href="/case/'), (k % 50).cast("string"), F.lit('">'), "p_name", F.lit(" E-"), (k % 90 + 1).cast("string"), F.lit("/2"), (k % 8).cast("string"), F.lit("</a></p>"))
    return landing.case_links(table(spark, sf_dir, "part").select(k.alias("page"), html.alias("html")), "page", "html")


def english_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, ("English", "Judgment", "Icelandic", "German"))), (F.col("p_size") % 4 + 1).cast("int"))
    candidates = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("case"), F.concat(F.lit("/d/"), F.col("p_partkey").cast("string")).alias("href"), label.alias("text"), F.col("p_partkey").alias("position"))
    return landing.english_document(candidates, "case")


def statute_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for every statute with an article for each of its rows, parsed: one row a provision."""
    k, text = F.col("s_suppkey"), lambda c: c.cast("string")
    anchor = F.concat(F.lit("G"), text(k), F.when(k % 3 == 0, "A").otherwise(""))
    label = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("<b>"), text(k), F.lit(". gr.</b> ")))
    mark = lambda n: F.concat(F.lit('<img id="'), anchor, F.lit(f'M{n}" src="/a/hk.jpg"> '))
    body = F.when(k % 5 == 0, F.concat(mark(1), F.lit(" … "))).otherwise(F.concat(mark(1), F.lit("Fyrri&nbsp;grein <b>um</b>  "), "s_name", F.lit("."), mark(2), F.lit("Önnur<br>lína.<sup>2)</sup> "), mark(3)))
    article = F.concat(F.lit('<span id="'), anchor, F.lit('"></span><img src="/a/sk.jpg">'), label, F.lit("<em>"), "s_name", F.lit(".</em><br>"), body, F.lit("<i><small><sup>1)</sup>L. 1/2005.</small></i>\n"))
    own = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", article.alias("a")))).alias("articles"))
    acts = table(spark, sf_dir, "nation").join(own, "n_nationkey")
    n = F.col("n_nationkey")
    html = F.concat(
        F.lit('<html><body><div class="article box">x</div><div class="article box login"><div class="boxbody"><h2>Lög um ['), "n_name", F.lit("]<sup>1)</sup></h2><p><strong>"), text(1990 + n % 6), F.lit(" nr. "), text(n * 7 + 1),
        F.lit(" 9. júní</strong></p> Útgáfa 154b. <b>I. kafli.</b> <b>Almennt.</b><br>"), F.array_join(F.transform("articles", lambda x: x["a"]), ""),
        F.lit('<b>Ákvæði til bráðabirgða.</b><img src="/sk.jpg"><img id="B0M1" src="/hk.jpg"> Tímabundið.<img src="/sk.jpg"><b>Viðauki.</b></div></div></body></html>'),
    )
    parsed = acts.select("n_nationkey", S.parsed_act(html).alias("a")).select("n_nationkey", "a.title", "a.act_number", "a.year", "a.codex_version", "a.chapters", F.inline("a.provisions"))
    chapter = F.element_at("chapters", F.col("chapter") + 1)
    return parsed.select("n_nationkey", "title", "act_number", "year", "codex_version", "anchor", "kind", "article_number", "article_letter", chapter["label"].alias("chapter"), chapter["title"].alias("chapter_title"), "label", "heading",
        F.size("paragraphs").alias("paragraphs"), "full_text", "is_repealed", F.array_join("footnotes", "|").alias("footnotes"))


def _parts(spark: SparkSession, sf_dir: str, *pieces) -> DataFrame:
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey")  # the short rows, before texts are made of them
    return rows.select("p_partkey", F.concat(*pieces).alias("text"))


def judgment_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, F.lit("Dómur Landsréttar\r\n\nII.\nNiður\u00adstaða:\n- 2 -\na) Krafa um "), "p_name", F.lit(" er tekin til greina.\n3. Málsástæður aðila\nSTUTT FYRIRSÖGN\n„"), F.repeat(F.lit("orð "), F.lit(50)),
        F.lit("“\nGrein um\u00a0"), "p_type", F.lit(" með hluta-\norði.\nbls. 12"))
    return rows.select("p_partkey", F.posexplode(J.text_blocks(F.col("text"))).alias("place", "b")).select("p_partkey", "place", "b.kind", "b.marker", "b.text")


def long_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, F.lit("Niðurstaða Fallist er á kröfu um "), "p_name", F.lit(" sbr. 2. mgr. 70. gr. laga. "), F.repeat(F.lit(SENTENCE + " "), F.lit(40)))
    blocks = rows.select("p_partkey", J.text_blocks(F.col("text")).alias("b"))
    return blocks.select("p_partkey", F.get("b", F.lit(0))["kind"].alias("first"), F.substring_index(F.get("b", F.lit(1))["text"], "laga.", 1).alias("second"), F.size("b").alias("blocks"))


def reflowed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, F.lit("Þetta er fyrsta lína málsgreinar um "), "p_name", F.lit(" sem heldur áfram á næs-\ntu línu og endar hér.\n- 2 -\n1. Fyrsti liður.\n    Inndregin lína hefur nýja málsgrein.\n"))
    return rows.select("p_partkey", J.reflowed(F.col("text")).alias("text"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, F.lit("Ágrip:\nÁgreiningur var um "), "p_name", F.lit(" og fallist var á kröfuna að fullu.\nb) Liður um "), "p_brand", F.lit(".\nDómur\nannað"))
    return rows.select("p_partkey", J.summary_of(F.col("text")).alias("summary"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of whole documents around a planted word: its place decides what is shown."""
    words = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.concat(F.lit("o"), k.cast("string")))
    rows = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", F.array_join(F.array_insert(words, (F.col("p_partkey") % 50 + 1).cast("int"), F.lit("Leitarorð")), " ").alias("text"))
    return rows.select("p_partkey", J.snippet(F.col("text"), ["leitarorð"]).alias("snippet"))


QUERIES = {f.__name__: f for f in (
    judgment_pages, court_sources, statute_index_pages, case_link_pages, english_documents, statute_pages, judgment_blocks, long_paragraphs, reflowed_pages, summaries, snippets,
)}

ORACLES = {
    "judgment_pages": r"""SELECT doc_id, CASE WHEN t <> '' THEN length(t) END AS n_chars, CASE WHEN t <> '' THEN sha256(t) END AS sha
FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\n{2,}', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL)""",
    "court_sources": "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'haestirettur' WHEN 1 THEN 'landsrettur' WHEN 4 THEN NULL ELSE 'heradsdomar' END AS source FROM documents",
    "statute_index_pages": """SELECT s_nationkey AS page, s_suppkey % 7 AS number, 1900 + s_suppkey % 40 AS year, s_name AS title, '154b' AS version FROM supplier
QUALIFY row_number() OVER (PARTITION BY s_suppkey % 7, s_suppkey % 40 ORDER BY s_nationkey, s_suppkey) = 1""",
    "case_link_pages": """SELECT '/case/' || p_partkey % 50 AS href, 'E-' || (p_partkey % 90 + 1) || '/2' || p_partkey % 8 AS case_number, p_name || ' E-' || (p_partkey % 90 + 1) || '/2' || p_partkey % 8 AS text FROM part
QUALIFY row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) = 1""",
    "english_documents": """SELECT p_name || ' ' || p_brand AS case, '/d/' || p_partkey AS href, CASE WHEN p_size % 4 = 0 THEN 'English' ELSE 'Judgment' END AS text FROM part WHERE p_size % 4 < 2
QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_size % 4, p_partkey) = 1""",
    "statute_pages": """WITH a AS (SELECT n_nationkey, 'Lög um ' || n_name AS title, n_nationkey * 7 + 1 AS act_number, 1990 + n_nationkey % 6 AS year, '154b' AS codex_version FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)),
f AS (SELECT s_nationkey AS n_nationkey, s_suppkey AS k, s_name FROM supplier)
SELECT a.*, 'G' || k || CASE WHEN k % 3 = 0 THEN 'A' ELSE '' END AS anchor, 'article' AS kind, CAST(k AS INT) AS article_number, CASE WHEN k % 3 = 0 THEN 'a' END AS article_letter, 'I. kafli.' AS chapter, 'Almennt' AS chapter_title,
CASE WHEN k % 3 = 0 AND k % 5 > 0 THEN 'um' WHEN k % 3 = 0 THEN k || '. gr. a.' ELSE k || '. gr.' END AS label, s_name AS heading, CASE WHEN k % 5 = 0 THEN 1 ELSE 2 END AS paragraphs,
CASE WHEN k % 5 = 0 THEN '…' ELSE 'Fyrri grein ' || CASE WHEN k % 3 = 0 THEN '' ELSE 'um ' END || s_name || '.' || chr(10) || chr(10) || 'Önnur' || chr(10) || 'lína.' END AS full_text, k % 5 = 0 AS is_repealed, '1)L. 1/2005.' AS footnotes FROM a JOIN f USING (n_nationkey)
UNION ALL SELECT a.*, 'B0', 'temporary', NULL, NULL, 'Ákvæði til bráðabirgða', NULL, 'B0', NULL, 1, 'Tímabundið.', false, '' FROM a
UNION ALL SELECT a.*, 'X0', 'annex', NULL, NULL, 'Ákvæði til bráðabirgða', NULL, 'Viðauki.', NULL, 0, '', true, '' FROM a""",
    "judgment_blocks": """SELECT p_partkey, CAST(b.place AS INT) AS place, b.kind, b.marker, b.text FROM (SELECT p_partkey, unnest([
{place: 0, kind: 'heading', marker: NULL, text: 'Dómur Landsréttar'}, {place: 1, kind: 'heading', marker: NULL, text: 'II.'}, {place: 2, kind: 'heading', marker: NULL, text: 'Niðurstaða:'},
{place: 3, kind: 'list-item', marker: 'a)', text: 'Krafa um ' || p_name || ' er tekin til greina.'}, {place: 4, kind: 'heading', marker: NULL, text: '3. Málsástæður aðila'}, {place: 5, kind: 'heading', marker: NULL, text: 'STUTT FYRIRSÖGN'},
{place: 6, kind: 'quote', marker: NULL, text: '„' || repeat('orð ', 50) || '“'}, {place: 7, kind: 'paragraph', marker: NULL, text: 'Grein um ' || p_type || ' með hlutaorði.'}]) AS b FROM part)""",
    "long_paragraphs": f"""SELECT p_partkey, 'heading' AS first, 'Fallist er á kröfu um ' || p_name || ' sbr. 2. mgr. 70. gr. ' AS second,
CAST(2 + ceil((40 - ceil((600 - length('Fallist er á kröfu um ' || p_name || ' sbr. 2. mgr. 70. gr. laga.')) / {len(SENTENCE) + 1}.0)) / {-(-(600 - len(SENTENCE)) // (len(SENTENCE) + 1)) + 1}.0) AS INT) AS blocks FROM part""",
    "reflowed_pages": """SELECT p_partkey, 'Þetta er fyrsta lína málsgreinar um ' || p_name || ' sem heldur áfram á næstu línu og endar hér.' || chr(10) || '1. Fyrsti liður.' || chr(10) || 'Inndregin lína hefur nýja málsgrein.' AS text FROM part""",
    "summaries": """SELECT p_partkey, 'Ágreiningur var um ' || p_name || ' og fallist var á kröfuna að fullu.' || chr(10) || chr(10) || 'b) Liður um ' || p_brand || '.' AS summary FROM part""",
    "snippets": """WITH p AS (SELECT p_partkey, p_partkey % 50 AS k, greatest(p_partkey % 50 - 14, 0) AS b FROM part), w AS (SELECT *, CASE WHEN 61 - b - 28 < 8 THEN 61 ELSE b + 28 END AS e FROM p)
SELECT p_partkey, array_to_string(list_transform(range(b, e), lambda i: CASE WHEN i < k THEN 'o' || (i + 1) WHEN i = k THEN '<mark>Leitarorð</mark>' ELSE 'o' || i END), ' ') AS snippet FROM w""",
}
