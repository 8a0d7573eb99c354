"""Queries through the public functions, over documents with planted citations, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurispark import api
from jurispark.plans import text_queries as Q
from jurispark.operators import fulltext as X
from jurispark.operators import linking as L
from jurispark.plans.search_queries import TERMS, WORDS, _grams, _index, _sim
from jurispark.session import stored, table

SOURCES = {f"src{k}": (f"Source {k}", "courts", "pilot" if k % 3 == 0 else "live") for k in range(20)}


def _library(spark: SparkSession, sf_dir: str, linked: bool = True, indexed: bool = False) -> api.Library:
    """What is asked for: links, for which all texts are gone through once and what was found is stored, as each use would go through them again; and the index."""
    k = F.col("doc_id")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (k % 700).cast("int"))
    docs = table(spark, sf_dir, "documents").select(k.alias("document_id"), "source", F.concat(F.lit("E-"), k.cast("string"), F.lit("/2020")).alias("case_number"), F.substring_index("text", "\n", 1).alias("title"),
        F.lit(None).cast("string").alias("case_name"), day.alias("date"), F.year(day).alias("year"), F.array("lang", F.concat(F.lit("t"), (k % 4).cast("string"))).alias("tags"), "text")
    acts, provisions = Q._acts(spark, sf_dir), Q._provisions(spark, sf_dir).withColumns({"label": F.col("article_number").cast("string"), "heading": F.lit(None).cast("string")})
    none = lambda columns: spark.createDataFrame([], columns)
    to_provisions, to_acts = none("document_id long, provision_id long, char_offset int, excerpt string"), none("document_id long, act_id long")
    if linked:
        to_provisions, to_acts, _ = L.resolve(stored(L.scan(Q._planted(spark, sf_dir).select("document_id", "text")), "citations"), Q._acts(spark, sf_dir), Q._provisions(spark, sf_dir))
    index = _index(spark, sf_dir)[0] if indexed else none("document_id long, term string, weight string, positions array<int>")
    return api.Library(docs, acts, provisions, to_provisions, to_acts, index, index, SOURCES)


def api_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = api.SearchRequest("thing AND the", ("src1", "src2", "src3", "unknown"), date_from="2020-02-01", tags=("t1",), sort="newest", page=1)
    page = api.search_documents(_library(spark, sf_dir, linked=False, indexed=True), asked)
    return page.rows.select("document_id", "date", F.lit(page.total).cast("long").alias("total"), F.lit(page.pages).alias("pages"))


def api_search_by_case_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = api.search_documents(_library(spark, sf_dir, linked=False, indexed=True), api.SearchRequest("mál e-77/2020", tuple(SOURCES)))
    return page.rows.select("document_id", "case_number")


def api_act_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    act, articles = api.act_detail(_library(spark, sf_dir), "8-1991")
    return articles.select("provision_id", "judgments", "passages", F.lit(act["judgments"]).cast("long").alias("act_judgments"), F.lit(act["cited_provisions"]).cast("long").alias("cited_provisions"))


def api_provision_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, page = api.provision_cases(_library(spark, sf_dir), 1)
    return page.select("document_id", "case_number", F.size("collapsed").alias("passages"), F.lit(counts["total"]).cast("long").alias("total"), F.lit(counts["citations"]).cast("long").alias("citations"))


ASKED = ("4. gr. nation_12", "2. mgr. 9. gr. b laga nation_7", "17. gr.", "nation_2", "x")


def api_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What citation-like queries mean: (q, label, needs_act, kind, id, place)."""
    lib = _library(spark, sf_dir, linked=False)
    rows = []
    for q in ASKED:
        found = api.lookup(lib, q)
        hits = [("article", r["provision_id"], k) for k, r in enumerate(found["provisions"])] + [("statute", r["act_id"], k) for k, r in enumerate(found["acts"])]
        rows += [(q, found["label"], found["needs_act"], *hit) for hit in hits or [(None, None, None)]]
    return spark.createDataFrame(rows, "q string, label string, needs_act boolean, kind string, id long, place long")


def api_provision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by words, by number, and by number within a statute; the first page of each."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(k.alias("provision_id"), (k % 25).alias("act_id"), F.lit("article").alias("kind"), F.col("p_size").alias("article_number"), F.when(k % 3 == 0, "b").alias("article_letter"),
        F.col("p_name").alias("label"), F.col("p_brand").alias("heading"), F.col("p_type").alias("full_text"), k.alias("ordering"))
    lib = _library(spark, sf_dir, linked=False)
    lib = replace(lib, provisions=parts, provision_postings=X.postings(parts, {"label": "A", "heading": "B", "full_text": "D"}, "provision_id"))
    out = None
    for q, act in (("steel bolt", None), ("7. gr. b", None), ("7", 3)):
        found = api.search_provisions(lib, q, act).select(F.lit(q).alias("q"), "provision_id", "by_number", F.round("rank", 6).alias("rank"))
        out = found if out is None else out.union(found)
    return out


def api_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.progress(_library(spark, sf_dir, linked=False))


QUERIES = {f.__name__: f for f in (api_search_page, api_search_by_case_number, api_act_detail, api_provision_cases, api_lookup, api_provision_search, api_progress)}

DATED = "DATE '2020-01-01' + CAST(document_id % 700 AS INT)"
ORACLES = {
    "api_search_page": f"""WITH {WORDS}, m AS (SELECT document_id, {DATED} AS date FROM w WHERE list_has_all(list_concat(t, h), ['thing', 'the']) AND source IN ('src1', 'src2', 'src3') AND document_id % 4 = 1 AND {DATED} >= DATE '2020-02-01')
SELECT document_id, date, count(*) OVER () AS total, CAST(greatest(1, ceil(count(*) OVER () / 15.0)) AS INT) AS pages FROM m ORDER BY date DESC NULLS LAST, document_id LIMIT 15""",
    "api_search_by_case_number": "SELECT doc_id AS document_id, 'E-77/2020' AS case_number FROM documents WHERE doc_id = 77 AND source IN (SELECT 'src' || i FROM range(20) r(i))",
    "api_act_detail": f"""WITH {Q.PLANTED}, x AS (SELECT * FROM {Q.LINKS}), d AS (SELECT document_id FROM x JOIN supplier ON s_suppkey = provision_id WHERE s_nationkey = 1 UNION SELECT document_id FROM c WHERE NOT covered AND n = 1)
SELECT s_suppkey AS provision_id, count(DISTINCT document_id) AS judgments, count(document_id) AS passages, (SELECT count(*) FROM d) AS act_judgments,
(SELECT count(DISTINCT provision_id) FROM x JOIN supplier ON s_suppkey = provision_id WHERE s_nationkey = 1) AS cited_provisions FROM supplier LEFT JOIN x ON provision_id = s_suppkey WHERE s_nationkey = 1 GROUP BY s_suppkey""",
    "api_provision_cases": f"""WITH {Q.PLANTED}, x AS (SELECT * FROM {Q.LINKS} WHERE provision_id = 1) SELECT document_id, 'E-' || document_id || '/2020' AS case_number, 1 AS passages, (SELECT count(DISTINCT document_id) FROM x) AS total, (SELECT count(*) FROM x) AS citations
FROM x ORDER BY {DATED} DESC, case_number, document_id LIMIT 15""",
    "api_lookup": f"""WITH q AS (SELECT q, a, g, {_grams('a')} AS grams FROM (VALUES ('4. gr. nation_12', 'nation_12', 4), ('2. mgr. 9. gr. b laga nation_7', 'nation_7', 9), ('nation_2', 'nation_2', NULL)) v(q, a, g)),
a AS (SELECT n_nationkey AS act_id, n_name AS title, lower(n_name) AS flat, n_nationkey * 7 + 1 AS number, 1990 + n_nationkey % 6 AS year, {_grams('n_name')} AS x FROM nation),
s AS (SELECT *, {_sim('x', 'grams')} AS s FROM a, q), b AS (SELECT *, CASE WHEN number::VARCHAR = a THEN 0 WHEN contains(lower(title), a) THEN 1 WHEN contains(flat, a) THEN 2 WHEN s >= 0.3 THEN 3 END AS bucket FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY bucket, s DESC, year DESC, number) AS n FROM b WHERE bucket IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY bucket, s DESC, year DESC) - 1 AS place FROM r WHERE n <= 10),
p AS (SELECT q, s_suppkey AS id, row_number() OVER (PARTITION BY q ORDER BY place, s_suppkey) - 1 AS place FROM t JOIN supplier ON s_nationkey = act_id WHERE s_acctbal >= 0 AND s_suppkey % 40 + 1 = g AND CASE WHEN s_suppkey % 3 = 0 THEN 'b' ELSE '' END = CASE WHEN g = 9 THEN 'b' ELSE '' END),
l AS (SELECT q, CASE g WHEN 4 THEN '4. gr.' WHEN 9 THEN '2. mgr. 9. gr. b' ELSE '' END AS label FROM q)
SELECT q, label, false AS needs_act, 'article' AS kind, id, place FROM p JOIN l USING (q) UNION ALL SELECT t.q, label, false, 'statute', act_id, place FROM t JOIN l USING (q) WHERE g IS NULL OR t.q NOT IN (SELECT q FROM p) AND place < 3
UNION ALL SELECT '17. gr.', '17. gr.', true, NULL, NULL, NULL UNION ALL SELECT 'x', '', false, NULL, NULL, NULL""",
    "api_provision_search": f"""WITH w AS (SELECT p_partkey, p_size, p_partkey % 25 AS act, p_partkey % 3 = 0 AS b, {TERMS.format('p_name')} AS x, {TERMS.format('p_brand')} AS y, {TERMS.format('p_type')} AS z FROM part),
c AS (SELECT w.*, term, len(list_filter(x, lambda t: t = term)) AS i, len(list_filter(y, lambda t: t = term)) AS j, len(list_filter(z, lambda t: t = term)) AS k, q FROM w, (VALUES ('steel bolt', 'steel'), ('steel bolt', 'bolt'), ('7. gr. b', '7'), ('7. gr. b', 'gr'), ('7. gr. b', 'b')) v(q, term)),
s AS (SELECT q, p_partkey, p_size, act, b, count(*) FILTER (WHERE i + j + k > 0) AS met, count(*) AS terms, sum(coalesce(list_sum(list_transform(range(1, i + j + k + 1), lambda n: CASE WHEN n <= i THEN 1.0 WHEN n <= i + j THEN 0.4 ELSE 0.1 END / (n * n))), 0)) AS x FROM c GROUP BY ALL),
f AS (SELECT q, p_partkey, act, CASE WHEN q = '7. gr. b' AND p_size <> 7 THEN 1 ELSE 0 END AS by_number, x / terms AS rank FROM s WHERE met = terms OR q = '7. gr. b' AND p_size = 7 AND b
UNION ALL SELECT '7', p_partkey, act, 0, 0.0 FROM w WHERE act = 3 AND p_size = 7 AND NOT b)
SELECT q, p_partkey AS provision_id, by_number::INT AS by_number, round(rank, 6) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY q ORDER BY by_number, rank DESC, 1990 + act % 6 DESC, p_partkey) <= 20""",
    "api_progress": """SELECT 'src' || i AS source, 'Source ' || i AS name, 'courts' AS group, count(doc_id) AS documents FROM range(20) r(i) LEFT JOIN documents ON source = 'src' || i WHERE i % 3 > 0 GROUP BY i""",
}
