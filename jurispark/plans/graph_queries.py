"""Queries on the citation graph, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurispark.operators import citation_graph as G
from jurispark.plans import views as V

PROVISIONS_SQL = "(SELECT s_suppkey AS provision_id, s_nationkey AS act_id, s_name AS label, CASE WHEN s_acctbal >= 0 THEN 'article' ELSE 'annex' END AS kind FROM supplier)"
ACT_LINKS_SQL = "(SELECT o_orderkey AS document_id, c_nationkey AS act_id FROM orders JOIN customer ON c_custkey = o_custkey)"
ACT_DOCS_SQL = f"(SELECT p.act_id, l.l_orderkey AS document_id FROM lineitem l JOIN {PROVISIONS_SQL} p ON p.provision_id = l.l_suppkey UNION SELECT act_id, document_id FROM {ACT_LINKS_SQL})"
CATALOGUE_SQL = f"""
SELECT n.n_nationkey AS act_id, n.n_name AS title, n.n_regionkey AS year,
       (SELECT count(*) FROM {ACT_DOCS_SQL} d WHERE d.act_id = n.n_nationkey) AS judgments,
       (SELECT count(*) FROM {PROVISIONS_SQL} p WHERE p.act_id = n.n_nationkey AND p.kind = 'article') AS articles
FROM nation n"""
JUDGMENTS_SQL = """(SELECT o_orderkey AS document_id, o_orderstatus AS source, o_orderdate AS date, CAST(year(o_orderdate) AS INT) AS year,
  'E-' || o_orderkey || '/' || year(o_orderdate) AS case_number, o_orderpriority AS subject FROM orders)"""


def act_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.catalogue(V.acts(spark, sf_dir), V.provision_links(spark, sf_dir), V.provisions(spark, sf_dir), V.act_links(spark, sf_dir))


def catalogue_cited_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = V.acts(spark, sf_dir).withColumn("title", F.upper("title"))
    return G.catalogue(acts, V.provision_links(spark, sf_dir), V.provisions(spark, sf_dir), V.act_links(spark, sf_dir), "title", cited_only=True)


def catalogue_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.catalogue(V.acts(spark, sf_dir), V.provision_links(spark, sf_dir), V.provisions(spark, sf_dir), V.act_links(spark, sf_dir), "number").limit(10)


def catalogue_by_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.catalogue(V.acts(spark, sf_dir), V.provision_links(spark, sf_dir), V.provisions(spark, sf_dir), V.act_links(spark, sf_dir), "provisions").limit(10)


def provision_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.provision_badges(V.provision_links(spark, sf_dir), V.provisions(spark, sf_dir))


def act_citing_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.judgments_per_act(V.provision_links(spark, sf_dir), V.provisions(spark, sf_dir), V.act_links(spark, sf_dir))


def articles_per_act(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.articles_per_act(V.provisions(spark, sf_dir))


def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.corpus_totals(V.acts(spark, sf_dir), V.provisions(spark, sf_dir), V.provision_links(spark, sf_dir))


def cases_citing_all_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.citing_all_provisions(V.provision_links(spark, sf_dir), [3, 7])


def cases_citing_act_any_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.citing_act(5, V.provision_links(spark, sf_dir), V.provisions(spark, sf_dir), V.act_links(spark, sf_dir))


def cases_with_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.with_citations(V.judgments(spark, sf_dir), [3], [5, 6], V.provision_links(spark, sf_dir), V.provisions(spark, sf_dir), V.act_links(spark, sf_dir))


def provision_cases_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.provision_cases(7, V.provision_links(spark, sf_dir), V.judgments(spark, sf_dir))
    return found.select("document_id", "case_number", "passages", F.array_join("offsets", ",").alias("offsets")).offset(15).limit(15)


def provision_case_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = V.provision_links(spark, sf_dir).where("provision_id = 7")
    return own.agg(F.count_distinct("document_id").alias("total"), F.count("*").alias("citation_count"))


def collapsed_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    excerpt = F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).otherwise("")
    rows = lines.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("char_offset"), excerpt.alias("excerpt"))
    return G.collapse_passages(rows, ["document_id"])


def related_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = V.judgments(spark, sf_dir)
    cited = judged.where("document_id % 50 = 0").select("document_id", F.array(
        *(F.format_string("E-%d/%d", F.col("document_id") + k, F.col("year")) for k in (1, 2, 32, 33))).alias("case_numbers"))
    return G.related_cases(cited, judged)


def chapter_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.provisions(spark, sf_dir).select("act_id", "provision_id", "kind")
    return G.adjacent_groups(rows, ["act_id"], "kind", ["provision_id"])


QUERIES = {f.__name__: f for f in (
    act_catalogue, catalogue_cited_only, catalogue_by_number, catalogue_by_provisions, provision_badges, act_citing_cases, articles_per_act, corpus_totals,
    cases_citing_all_provisions, cases_citing_act_any_route, cases_with_citations, provision_cases_page, provision_case_counts, collapsed_passages,
    related_cases, chapter_islands,
)}

ORACLES = {
    "act_catalogue": CATALOGUE_SQL,
    "catalogue_cited_only": f"""
WITH d AS (SELECT act_id, document_id FROM {ACT_DOCS_SQL})
SELECT n_nationkey AS act_id, upper(n_name) AS title, n_regionkey AS year, count(DISTINCT d.document_id) AS judgments,
  (SELECT count(*) FROM {PROVISIONS_SQL} p WHERE p.act_id = n_nationkey AND p.kind = 'article') AS articles
FROM nation JOIN d ON d.act_id = n_nationkey GROUP BY n_nationkey, n_name, n_regionkey""",
    "catalogue_by_number": f"SELECT * FROM ({CATALOGUE_SQL}) ORDER BY year DESC, act_id DESC LIMIT 10",
    "catalogue_by_provisions": f"SELECT * FROM ({CATALOGUE_SQL}) ORDER BY articles DESC, title, act_id LIMIT 10",
    "provision_badges": f"""SELECT p.provision_id, p.act_id, p.label, count(DISTINCT l_orderkey) AS judgments, count(l_orderkey) AS passages
FROM {PROVISIONS_SQL} p LEFT JOIN lineitem ON l_suppkey = p.provision_id GROUP BY ALL""",
    "act_citing_cases": f"SELECT act_id, count(*) AS judgments FROM {ACT_DOCS_SQL} GROUP BY act_id",
    "articles_per_act": f"SELECT act_id, count(*) AS articles FROM {PROVISIONS_SQL} WHERE kind = 'article' GROUP BY act_id",
    "corpus_totals": "SELECT (SELECT count(*) FROM nation) AS acts, (SELECT count(*) FROM supplier WHERE s_acctbal >= 0) AS articles, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS linked_provisions",
    "cases_citing_all_provisions": "SELECT l_orderkey AS document_id FROM lineitem WHERE l_suppkey = 3 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7",
    "cases_citing_act_any_route": f"SELECT DISTINCT document_id FROM {ACT_DOCS_SQL} WHERE act_id = 5",
    "cases_with_citations": f"""SELECT j.* FROM {JUDGMENTS_SQL} j WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = j.document_id AND l_suppkey = 3)
AND EXISTS (SELECT 1 FROM {ACT_DOCS_SQL} d WHERE d.document_id = j.document_id AND d.act_id = 5) AND EXISTS (SELECT 1 FROM {ACT_DOCS_SQL} d WHERE d.document_id = j.document_id AND d.act_id = 6)""",
    "provision_cases_page": f"""SELECT j.document_id, j.case_number, count(*) AS passages, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS offsets
FROM {JUDGMENTS_SQL} j JOIN lineitem ON l_orderkey = j.document_id WHERE l_suppkey = 7 GROUP BY j.document_id, j.case_number, j.date
ORDER BY j.date DESC NULLS FIRST, j.case_number ASC NULLS LAST, j.document_id LIMIT 15 OFFSET 15""",
    "provision_case_counts": "SELECT count(DISTINCT l_orderkey) AS total, count(*) AS citation_count FROM lineitem WHERE l_suppkey = 7",
    "collapsed_passages": """SELECT document_id, min(char_offset) AS char_offset, any_value(excerpt) AS excerpt, count(*) AS occurrences
FROM (SELECT l_orderkey AS document_id, l_linenumber AS char_offset, CASE WHEN l_linestatus = 'O' THEN l_returnflag ELSE '' END AS excerpt FROM lineitem)
GROUP BY document_id, CASE WHEN trim(excerpt) = '' THEN '@' || char_offset ELSE '=' || excerpt END""",
    "related_cases": f"""WITH j AS {JUDGMENTS_SQL},
c AS (SELECT DISTINCT document_id, 'E-' || (document_id + k) || '/' || year AS case_number FROM j, (VALUES (1), (2), (32), (33)) t(k) WHERE document_id % 50 = 0),
f AS (SELECT c.document_id, j.document_id AS related_id, CAST(row_number() OVER (PARTITION BY c.document_id ORDER BY j.date DESC NULLS LAST, j.document_id) AS INT) AS place
      FROM c JOIN j USING (case_number) WHERE c.document_id <> j.document_id)
SELECT * FROM f WHERE place <= 10""",
    "chapter_islands": f"""WITH c AS (SELECT act_id, provision_id, kind, CASE WHEN lag(kind) OVER w IS NOT DISTINCT FROM kind AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS changed
FROM {PROVISIONS_SQL} WINDOW w AS (PARTITION BY act_id ORDER BY provision_id))
SELECT act_id, provision_id, kind, CAST(sum(changed) OVER (PARTITION BY act_id ORDER BY provision_id) AS BIGINT) AS group_no FROM c""",
}
