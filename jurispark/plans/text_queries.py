"""Queries on citations, statute pages and judgments' texts, and their SQL. Citations are planted in every whole document by its id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurispark import api
from jurispark.functions import citations as C
from jurispark.functions import judgment as J
from jurispark.functions import statute as S
from jurispark.functions.query import parse_query, query_tree
from jurispark.operators import citation_job as J2
from jurispark.operators import fulltext as X
from jurispark.operators import linking as L
from jurispark.operators import merge as M
from jurispark.operators import retrieval as R
from jurispark.operators.link_store import LinkStore
from jurispark.plans import views as V
from jurispark.plans.search_queries import _index
from jurispark.session import remove_at_end, shared_path, table
from jurispark.sources import landing

MOST_BUCKETS = 64  # of links: more documents make larger buckets, not more folders
UNKNOWN = 28  # statutes are planted by a number modulo this, of which 25 are in the tables


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, case_number, text) of all documents, each with citations that its id gives before and behind its whole text."""
    k = F.col("doc_id")
    statute = lambda n: (F.lit(" nr. "), (n * 7 + 1).cast("string"), F.lit("/"), (1990 + n % 6).cast("string"))
    first, second, name = k % UNKNOWN, F.floor(k / 3) % UNKNOWN, F.when(k % 2 == 0, "vaxtalaga").otherwise("barnalaga")
    letter = F.when(k % 3 == 0, "b ").otherwise("")
    lead = F.concat(F.lit("Sbr. "), (k % 5 + 1).cast("string"), F.lit(". mgr. "), (k % 40 + 1).cast("string"), F.lit(". gr. "), letter, F.lit("laga um próf"), *statute(first), F.lit(", í máli nr. E-"), (k % 500).cast("string"), F.lit("/2019. "))
    tail = F.concat(F.lit(" Byggt er á: "), name, *statute(second), F.lit(", og enn á: "), name, *statute(second), F.lit(". Mál nr. E-"), (k % 1000).cast("string"), F.lit("/2020."))
    own = F.when(k % 4 == 0, F.concat(F.lit("E-"), (k % 1000).cast("string"), F.lit("/2020")))
    return table(spark, sf_dir, "documents").select(k.alias("document_id"), own.alias("case_number"), F.concat(lead, "text", tail).alias("text"))


def _acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.alias("act_id"), (n * 7 + 1).cast("int").alias("act_number"), (1990 + n % 6).cast("int").alias("year"), F.col("n_name").alias("title"), F.array(F.lower("n_name")).alias("aliases"))


def _provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("provision_id"), F.col("s_nationkey").alias("act_id"), F.when(F.col("s_acctbal") >= 0, "article").otherwise("annex").alias("kind"),
        (k % 40 + 1).cast("int").alias("article_number"), F.when(k % 3 == 0, "b").alias("article_letter"), k.alias("ordering"))


def _linked(spark: SparkSession, sf_dir: str):
    return L.link(_planted(spark, sf_dir).select("document_id", "text"), _acts(spark, sf_dir), _provisions(spark, sf_dir))


def cited_case_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _planted(spark, sf_dir).where("text IS NOT NULL")
    return found.select("document_id", F.array_join(C.cited_cases(F.col("text"), F.col("case_number")), ",").alias("cited"))


def act_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planted(spark, sf_dir).select("document_id", F.inline(C.act_citations(F.col("text")))).select("document_id", "act_number", "year", "alias", "offset")


def provision_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _planted(spark, sf_dir).select("document_id", F.inline(C.provision_citations(F.col("text"))))
    return found.select("document_id", "paragraph", "article", "letter", "act_number", "year", "offset", "text")


def citation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir)[0].select("document_id", "provision_id", "char_offset", "paragraph_number")


def citation_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole excerpts of citations planted before and behind each document's text, in sentences with abbreviations and ordinals in them."""
    k = F.col("doc_id")
    number = F.concat((k % 25 * 7 + 1).cast("string"), F.lit("/"), (1990 + k % 25 % 6).cast("string"))
    lead = F.concat(F.lit("Upphaf var. Krafan er reist á 2. mgr. "), (k % 40 + 1).cast("string"), F.lit(". gr. laga um próf nr. "), number, F.lit(", sbr. dóm hans o.fl. atriði hér. Síðan segir: "))
    tail = F.concat(F.lit(" Endir kom. Vísað er, skv. bls. 3. hér, til vaxtalaga nr. "), number, F.lit(",\u00a0þ.e. þeirra. Lok."))
    docs = table(spark, sf_dir, "documents").select(k.alias("document_id"), F.concat(lead, "text", tail).alias("text"))
    to_provisions, to_acts, _ = L.link(docs, _acts(spark, sf_dir), _provisions(spark, sf_dir).withColumn("article_letter", F.lit(None).cast("string")))
    links = to_provisions.select(F.lit("article").alias("kind"), "document_id", "char_offset", "citation_text", "excerpt")
    return links.union(to_acts.select(F.lit("statute"), "document_id", "char_offset", F.lit(None).cast("string"), "excerpt"))


def masked_legislation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case numbers of whole documents in which constitutions, regulations and statutes, with blanks of several kinds, have numbers that look like theirs."""
    k = F.col("doc_id")
    year = (1950 + k % 50).cast("string")
    lead = F.concat(F.lit("Stjórnarskrá lýðveldisins\u00a0Íslands nr.\u202f33/"), year, F.lit(", dómur í máli nr. "), (k % 900 + 1).cast("string"), F.lit("/"), year, F.lit(" og reglugerð um próf (ESB), nr. 12/"), year, F.lit(". "))
    tail = F.concat(F.lit(" Auglýsingu nr. 5/"), year, F.lit(", sbr. lögum um ávana- og fíkniefni\u00a0nr. 65/"), year, F.lit("; Mál nr. E-"), (k % 70).cast("string"), F.lit("/2021 og rg. nr. 7/"), year, F.lit("."))
    cited = C.cited_cases(F.concat(lead, "text", tail))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(cited, ",").alias("cited"))


def citation_act_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.col("excerpt").rlike("(vaxta|barna)laga nr")
    return _linked(spark, sf_dir)[1].select("document_id", "act_id", "char_offset", named.alias("excerpt_names_it"))


def citation_unknown_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir)[2].where("act_id IS NULL").select("document_id", "act_number", "year").distinct()


def corpus_cited_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited numbers of all texts, with how many documents cite each."""
    found = _planted(spark, sf_dir).select(F.explode(C.cited_cases(F.col("text"))).alias("cited"))
    return found.groupBy("cited").agg(F.count("*").alias("documents"))


def _scan(spark: SparkSession, sf_dir: str) -> J2.Scan:
    """A run of the citation job: a third of the documents is up to date, a third changed, a third new; all have an old link of each kind."""
    docs = _planted(spark, sf_dir).withColumn("text_hash", M.text_hash(F.col("text")))
    mark = F.when(F.col("document_id") % 3 == 0, F.col("text_hash")).when(F.col("document_id") % 3 == 1, "stale")
    old = docs.select("document_id", F.lit(0).alias("target"), F.lit(77).alias("char_offset"))
    return J2.run(docs.withColumn("citation_scan_hash", mark), _acts(spark, sf_dir), _provisions(spark, sf_dir), old.withColumnRenamed("target", "provision_id"), old.withColumnRenamed("target", "act_id"))


def citation_job_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _scan(spark, sf_dir)
    links = done.provision_links.select(F.lit("article").alias("kind"), "document_id", F.col("provision_id").alias("target"), "char_offset")
    return links.union(done.act_links.select(F.lit("statute").alias("kind"), "document_id", F.col("act_id").alias("target"), "char_offset"))


def citation_job_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).acts.select("act_id", F.array_join("aliases", ",").alias("aliases"))


def citation_job_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _scan(spark, sf_dir)
    due = M.changed(done.documents).agg(F.count("*").alias("still_due"))
    return done.stats.select("indexed", "errors").join(F.broadcast(due))


def citation_job_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).unknown


def _kept_links(spark: SparkSession, sf_dir: str) -> LinkStore:
    """A store after three runs: all documents; then a quarter without their citations and a tenth gone; then half of that quarter as it was."""
    path = shared_path(spark, "links")
    remove_at_end(spark, path)
    acts, provisions = _acts(spark, sf_dir), _provisions(spark, sf_dir)
    first = _planted(spark, sf_dir).select("document_id", "text")
    last = first.agg(F.max("document_id").alias("last")).first()["last"] or 0
    store = LinkStore(spark, path, span=max(200, last // MOST_BUCKETS + 1))
    gone, bare = first.where("document_id % 10 <> 1"), F.col("document_id") % 4 == 0
    plain = F.when(F.col("text").isNotNull(), F.lit("Engar tilvitnanir."))
    second = gone.withColumn("text", F.when(bare, plain).otherwise(F.col("text")))
    third = gone.withColumn("text", F.when(bare & (F.col("document_id") % 8 != 0), plain).otherwise(F.col("text")))
    for docs in (first, second, third):
        store.run(docs.withColumn("text_hash", M.text_hash(F.col("text"))), acts, provisions)
    return store


def link_store_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links that a store of buckets holds after three runs over documents that were edited between them."""
    store = _kept_links(spark, sf_dir)
    links = store.provision_links().select(F.lit("article").alias("kind"), "document_id", F.col("provision_id").alias("target"), "char_offset")
    return links.union(store.act_links().select(F.lit("statute").alias("kind"), "document_id", F.col("act_id").alias("target"), "char_offset"))


def maintained_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct judgments and passages as the store keeps them up, over the same three runs."""
    store = _kept_links(spark, sf_dir)
    counts = store.provision_counts().select(F.lit("article").alias("kind"), F.col("provision_id").alias("target"), "judgments", "passages")
    return counts.union(store.act_counts().select(F.lit("statute").alias("kind"), F.col("act_id").alias("target"), "judgments", F.lit(None).cast("long")))


def act_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = _acts(spark, sf_dir)
    return api.filter_acts(acts, " Nation_1").union(api.filter_acts(acts, "8/1991")).union(api.filter_acts(acts, "nr. 15/")).select("act_id", "title")


def act_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.with_addresses(_acts(spark, sf_dir)).select("act_id", "citation", "path", "official_url")


def provision_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("label"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("heading"), F.array(F.col("p_type"), F.lit("Fastur texti")).alias("paragraphs"))
    return api.filter_provisions(rows, "Small ").union(api.filter_provisions(rows, "brand#2")).union(api.filter_provisions(rows, "SMALL")).select("p_partkey", "label")


def hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", api.hit_count(F.col("text"), '"the and" thing').cast("long").alias("hits"))


def highlighted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with a query's phrases and words marked and all else escaped."""
    text = F.concat(F.lit("<i>The & and</i> "), "text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(api.highlighted(text, '"of the" AND thing -the x'), 256).alias("sha"))


def decoded_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as they were before they were stored in several encodings, told by their response headers, some of which name none."""
    k = F.col("page_id") % 4
    raw = F.when(k == 0, F.encode("html", "UTF-16BE")).when(k == 1, F.encode("html", "UTF-16LE")).otherwise(F.encode("html", "UTF-8"))
    kind = F.when(k == 0, "text/html; charset=utf-16be").when(k == 1, 'text/html; charset="UTF-16LE"').when(k == 2, "text/html; charset=hex").otherwise("text/html; charset=utf-8")
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(landing.decoded(raw, kind), 256).alias("sha"))


def html_title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    title = F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))
    return pages.select("page_id", F.nullif(title, F.lit("")).alias("title"), F.size(F.regexp_extract_all("html", F.lit(r"(?i)<a [^>]*?href="), 0)).cast("long").alias("anchors"))


def html_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.parsed_act(F.col("html")).alias("a")).select("page_id", "a.title", F.size("a.provisions").alias("provisions"))


def html_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", S.page_text(F.col("html")).alias("page_text"), F.lit(None).cast("string").alias("pdf_text"))
    return landing.gate(pages, "pdf_text", "page_text").select("page_id", F.length("text").alias("n_chars"), "reason")


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(landing.links(F.col("html"))).alias("a")).select("page_id", "a.href", "a.text")


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks of each kind a text has, counted within its row."""
    rows = table(spark, sf_dir, "documents").select("doc_id", J.text_blocks(F.col("text")).alias("blocks"))
    kinds = F.transform(F.array(*map(F.lit, sorted({k for k, _ in J.KINDS} | {"paragraph"}))), lambda k: F.struct(k.alias("kind"), F.size(F.filter("blocks", lambda b: b["kind"] == k)).cast("long").alias("n")))
    return rows.select("doc_id", F.inline(kinds)).where("n > 0")


def summary_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Útdráttur\n"), F.col("text")).alias("text"))
    return docs.select("doc_id", F.length(J.summary_of(F.substring("text", 1, J.SUMMARY_WINDOW))).alias("n_chars"))


def reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(J.reflowed(F.col("text")), 256).alias("sha"))


def snippet_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page from the stored index; only its rows' texts are read for snippets."""
    index, docs = _index(spark, sf_dir)
    query = query_tree(parse_query("thing AND the").web)
    page = R.page(X.search(index, docs.select("document_id", F.lit(None).cast("date").alias("date")), query), "relevance", 1, 15)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    found = texts.join(F.broadcast(page.select("document_id", F.round("rank", 6).alias("rank"))), "document_id")
    return found.select("document_id", "rank", J.snippet(F.col("text"), query.positive_items()).alias("snippet"))


def snippet_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of whole documents whose first hit is not where the query's words stand together, with signs that HTML would read."""
    text = F.concat(F.lit("Fjara stendur ein. "), "text", F.lit(" Loks mætast fjara og svartur <steinn> & haf við sjó."))
    items = query_tree('fjara "svartur steinn" -haf').positive_items()
    return table(spark, sf_dir, "documents").select("doc_id", J.snippet(text, items).alias("snippet"))


def official_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = V.judgments(spark, sf_dir)
    name = F.when(F.col("document_id") % 2 == 0, F.col("subject"))
    return j.select("document_id", C.official_citation(F.lit("Landsréttur"), F.col("date"), F.col("case_number"), name, F.lit("")).alias("citation"))


QUERIES = {f.__name__: f for f in (
    cited_case_numbers, act_citations, provision_citations, citation_links, citation_excerpts, masked_legislation, citation_act_links, citation_unknown_acts, corpus_cited_cases, citation_job_links, citation_job_aliases, citation_job_stats,
    citation_job_unknown, link_store_links, maintained_counts, act_filter, act_addresses, provision_filter, hit_counts, highlighted_texts, decoded_html, html_title_links, html_structure, html_page_text, html_links, text_blocks, summary_extract, reflow, snippet_page, snippet_covers, official_citations,
)}

MONTHS = "['janúar', 'febrúar', 'mars', 'apríl', 'maí', 'júní', 'júlí', 'ágúst', 'september', 'október', 'nóvember', 'desember']"
PLANTED = f"""k AS (SELECT doc_id AS document_id, doc_id % {UNKNOWN} AS a, (doc_id // 3) % {UNKNOWN} AS b, doc_id % 5 + 1 AS paragraph, doc_id % 40 + 1 AS article, CASE WHEN doc_id % 3 = 0 THEN 'b' END AS letter,
CASE WHEN doc_id % 2 = 0 THEN 'vaxtalaga' ELSE 'barnalaga' END AS name, 'E-' || doc_id % 500 || '/2019' AS first_case, 'E-' || doc_id % 1000 || '/2020' AS second_case, length(text) AS n_text FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, 'laga um próf nr. ' || (a * 7 + 1) || '/' || (1990 + a % 6) AS first_act, name || ' nr. ' || (b * 7 + 1) || '/' || (1990 + b % 6) AS second_act,
paragraph || '. mgr. ' || article || '. gr. ' AS place, coalesce(letter || ' ', '') AS gap FROM k),
p AS (SELECT *, 5 + length(place) AS o1, length('Sbr. ' || place || gap || first_act || ', í máli nr. ' || first_case || '. ') + n_text + length(' Byggt er á: ') AS o2 FROM l),
c AS (SELECT document_id, a AS n, NULL AS alias, o1 AS o, true AS covered FROM p UNION ALL SELECT document_id, b, name, o2, false FROM p UNION ALL SELECT document_id, b, name, o2 + length(second_act || ', og enn á: '), false FROM p),
t AS (SELECT s_nationkey AS act_id, s_suppkey % 40 + 1 AS article, CASE WHEN s_suppkey % 3 = 0 THEN 'b' ELSE '' END AS letter, max(s_suppkey) AS provision_id FROM supplier WHERE s_acctbal >= 0 GROUP BY ALL)"""
LINKS = "(SELECT document_id, provision_id, 5 AS char_offset, paragraph FROM p JOIN t ON t.act_id = p.a AND t.article = p.article AND t.letter = coalesce(p.letter, ''))"
KNOWN = "n IN (SELECT n_nationkey FROM nation)"
LEFT = "document_id % 10 <> 1 AND (document_id % 4 <> 0 OR document_id % 8 = 0)"
ORACLES = {
    "cited_case_numbers": f"WITH {PLANTED} SELECT document_id, first_case || CASE WHEN document_id % 4 = 0 THEN '' ELSE ',' || second_case END AS cited FROM p",
    "act_citations": f"WITH {PLANTED} SELECT document_id, CAST(n * 7 + 1 AS INT) AS act_number, CAST(1990 + n % 6 AS INT) AS year, alias, CAST(o AS INT) AS \"offset\" FROM c",
    "provision_citations": f"""WITH {PLANTED} SELECT document_id, paragraph, article, letter, a * 7 + 1 AS act_number, 1990 + a % 6 AS year, 5 AS "offset", place || gap || first_act AS text FROM p""",
    "citation_links": f"WITH {PLANTED} SELECT document_id, provision_id, char_offset, paragraph AS paragraph_number FROM {LINKS}",
    "citation_excerpts": """WITH d AS (SELECT doc_id AS document_id, doc_id % 25 AS a, doc_id % 40 + 1 AS g, (doc_id % 25 * 7 + 1) || '/' || (1990 + doc_id % 25 % 6) AS n, length(text) AS size FROM documents WHERE text IS NOT NULL),
x AS (SELECT *, '2. mgr. ' || g || '. gr. laga um próf nr. ' || n AS cited FROM d), t AS (SELECT DISTINCT s_nationkey AS a, s_suppkey % 40 + 1 AS g FROM supplier WHERE s_acctbal >= 0)
SELECT 'article' AS kind, document_id, CAST(length('Upphaf var. Krafan er reist á ') AS INT) AS char_offset, cited AS citation_text, 'Krafan er reist á ' || cited || ', sbr. dóm hans o.fl. atriði hér.' AS excerpt FROM x JOIN t USING (a, g)
UNION ALL SELECT 'statute', document_id, length('Upphaf var. Krafan er reist á ' || cited || ', sbr. dóm hans o.fl. atriði hér. Síðan segir:  Endir kom. Vísað er, skv. bls. 3. hér, ') + size, NULL, 'Vísað er, skv. bls. 3. hér, til vaxtalaga nr. ' || n || ', þ.e. þeirra.' FROM x""",
    "masked_legislation": """SELECT doc_id, (doc_id % 900 + 1) || '/' || (1950 + doc_id % 50) || ',E-' || (doc_id % 70) || '/2021' AS cited FROM documents WHERE text IS NOT NULL""",
    "citation_act_links": f"WITH {PLANTED} SELECT document_id, n AS act_id, o AS char_offset, true AS excerpt_names_it FROM c WHERE NOT covered AND {KNOWN}",
    "citation_unknown_acts": f"WITH {PLANTED} SELECT DISTINCT document_id, n * 7 + 1 AS act_number, 1990 + n % 6 AS year FROM c WHERE NOT {KNOWN}",
    "corpus_cited_cases": f"WITH {PLANTED} SELECT cited, count(*) AS documents FROM (SELECT first_case AS cited FROM p UNION ALL SELECT second_case FROM p) GROUP BY cited",
    "citation_job_links": f"""WITH {PLANTED} SELECT 'article' AS kind, document_id, provision_id AS target, char_offset FROM {LINKS} WHERE document_id % 3 > 0
UNION ALL SELECT 'statute', document_id, n, o FROM c WHERE NOT covered AND {KNOWN} AND document_id % 3 > 0
UNION ALL SELECT v.kind, doc_id, 0, 77 FROM documents, (VALUES ('article'), ('statute')) v(kind) WHERE doc_id % 3 = 0 OR text IS NULL""",
    "citation_job_aliases": f"""WITH {PLANTED}, u AS (SELECT n, alias, count(*) AS f FROM c WHERE document_id % 3 > 0 AND alias IS NOT NULL GROUP BY n, alias HAVING count(*) >= 2),
g AS (SELECT n, string_agg(alias, ',' ORDER BY f DESC, alias) AS aliases FROM u GROUP BY n) SELECT n_nationkey AS act_id, coalesce(aliases, lower(n_name)) AS aliases FROM nation LEFT JOIN g ON n = n_nationkey""",
    "citation_job_stats": """SELECT count(text) AS indexed, count(*) FILTER (WHERE text IS NULL) AS errors, count(*) FILTER (WHERE text IS NULL) AS still_due FROM documents WHERE doc_id % 3 > 0""",
    "citation_job_unknown": f"""WITH {PLANTED} SELECT n * 7 + 1 AS act_number, 1990 + n % 6 AS year, count(DISTINCT document_id) AS documents FROM c WHERE document_id % 3 > 0 AND NOT {KNOWN}
GROUP BY n ORDER BY documents DESC, year, act_number LIMIT 10""",
    "link_store_links": f"""WITH {PLANTED} SELECT 'article' AS kind, document_id, provision_id AS target, char_offset FROM {LINKS} WHERE {LEFT} UNION ALL SELECT 'statute', document_id, n, o FROM c WHERE NOT covered AND {KNOWN} AND {LEFT}""",
    "maintained_counts": f"""WITH {PLANTED}, x AS (SELECT * FROM {LINKS} WHERE {LEFT}) SELECT 'article' AS kind, provision_id AS target, count(DISTINCT document_id) AS judgments, count(*) AS passages FROM x GROUP BY provision_id
UNION ALL SELECT 'statute', act, count(DISTINCT document_id), NULL FROM (SELECT document_id, s_nationkey AS act FROM x JOIN supplier ON s_suppkey = provision_id UNION ALL SELECT document_id, n FROM c WHERE NOT covered AND {KNOWN} AND {LEFT}) GROUP BY act""",
    "act_filter": """WITH a AS (SELECT n_nationkey AS act_id, n_name AS title, (n_nationkey * 7 + 1) || '/' || (1990 + n_nationkey % 6) AS number FROM nation)
SELECT act_id, title FROM a WHERE contains(lower(title), 'nation_1') UNION ALL SELECT act_id, title FROM a WHERE contains(number, '8/1991') UNION ALL SELECT act_id, title FROM a WHERE contains('lög nr. ' || number, 'nr. 15/')""",
    "act_addresses": """SELECT n_nationkey AS act_id, 'lög nr. ' || n || '/' || y AS citation, '/log/' || n || '-' || y AS path, 'https://www.althingi.is/lagas/nuna/' || y || lpad(n::VARCHAR, 3, '0') || '.html' AS official_url
FROM (SELECT n_nationkey, n_nationkey * 7 + 1 AS n, 1990 + n_nationkey % 6 AS y FROM nation)""",
    "provision_filter": """WITH f AS (SELECT p_partkey, p_name AS label, lower(p_name) AS x, lower(CASE WHEN p_size > 5 THEN p_brand ELSE '' END) AS y, lower(p_type) AS z FROM part)
SELECT p_partkey, label FROM f, (VALUES ('small'), ('brand#2'), ('small')) v(q) WHERE contains(x, q) OR contains(y, q) OR contains(z, q)""",
    "hit_counts": "SELECT doc_id, coalesce(len(regexp_extract_all(text, '(?i)the|and|thing')), 0) AS hits FROM documents",
    "highlighted_texts": """SELECT doc_id, sha256(regexp_replace(replace(replace(replace('<i>The & and</i> ' || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)(of the|thing|the)', '<mark>\\1</mark>', 'g')) AS sha FROM documents""",
    "decoded_html": "SELECT page_id, sha256(html) AS sha FROM pages",
    "html_links": r"""SELECT page_id, u.h AS href, trim(regexp_replace(regexp_replace(u.t, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS text
FROM (SELECT page_id, unnest(list_zip(regexp_extract_all(html, '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>', 1), regexp_extract_all(html, '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>', 2))) AS x FROM pages) y,
LATERAL (SELECT x[1] AS h, x[2] AS t) u WHERE u.h <> ''""",
    "html_title_links": r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '') AS title, len(regexp_extract_all(html, '(?i)<a [^>]*?href=')) AS anchors FROM pages""",
    "snippet_covers": r"""WITH t AS (SELECT doc_id, string_split(trim(regexp_replace('Fjara stendur ein. ' || text || ' Loks mætast fjara og svartur <steinn> & haf við sjó.', '\s+', ' ', 'g')), ' ') AS t FROM documents),
b AS (SELECT *, len(t) AS size, greatest(len(t) - 8 - 12, 0) AS b FROM t), s AS (SELECT *, CASE WHEN b > 0 THEN least(b, CASE WHEN size - 28 < 8 THEN size ELSE 28 END) ELSE 0 END AS e FROM b),
x AS (SELECT doc_id, CASE WHEN e > 0 THEN array_to_string(t[1:e], ' ') END AS first, array_to_string(t[b + 1:size], ' ') AS last FROM s),
y AS (SELECT doc_id, first, replace(replace(replace(coalesce(first || ' … ', '') || last, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM x WHERE last IS NOT NULL)
SELECT doc_id, replace(regexp_replace(html, '^Fjara', '<mark>Fjara</mark>'), 'fjara og svartur &lt;steinn', '<mark>fjara</mark> og <mark>svartur &lt;steinn</mark>') AS snippet FROM y UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL""",
    "official_citations": f"""SELECT o_orderkey AS document_id, 'Landsréttur ' || day(o_orderdate) || '. ' || ({MONTHS})[month(o_orderdate)] || ' ' || year(o_orderdate) || ', mál nr. E-' || o_orderkey || '/' || year(o_orderdate)
|| CASE WHEN o_orderkey % 2 = 0 THEN ', ' || o_orderpriority ELSE '' END AS citation FROM orders""",
}
