"""Work is spread over tasks whose number grows with cores or with the input, and whole at every size."""

import random

import pytest
from pyspark.sql import functions as F

from jurispark import api
from jurispark.operators import fulltext, search_index, top_documents, trigram_index, typos
from jurispark.operators import fuzzy as Z
from jurispark.operators import retrieval
from jurispark.functions import citations
from jurispark.plans import api_queries, registry, text_queries
from jurispark.sources import landing

SMOKE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["long_paragraphs", "judgment_blocks", "summaries", "reflowed_pages", "snippets"])
def test_texts_made_of_a_small_table_are_read_by_all_cores(spark, name):
    assert registry.QUERIES[name](spark, SMOKE).rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_exact_count_goes_past_the_cap(spark, tmp_path):
    rows = retrieval.COUNT_CAP + 5
    spark.range(rows).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    assert registry.QUERIES["exact_count_below_cap"](spark, str(tmp_path)).collect() == [(rows, False)]
    assert retrieval.capped_count(spark.range(rows)).collect() == [(retrieval.COUNT_CAP, True)]


@pytest.mark.parametrize("most_in_twos", [64, 0])
def test_similar_rows_are_those_of_all_comparisons(spark, monkeypatch, most_in_twos):
    monkeypatch.setattr(Z, "MOST_IN_TWOS", most_in_twos)
    r = random.Random(5)
    words = ["a", "b", "ab", "abab", "ababab", "lög", "laga", "um vexti", "0101", "01010", "barnalaga", ""]
    rows = lambda n: spark.createDataFrame([(k, " ".join(r.choices(words, k=r.randint(1, 4)))) for k in range(n)], "id long, t string")
    left, right = rows(60), rows(50)
    for threshold in (0.3, 0.4, 0.8):
        found = {(x, y, round(z, 6)) for x, y, z in Z.similar_rows(left, right, "id", "t", "id", "t", threshold).collect()}
        a, b = (d.select(F.col("id").alias(n), Z.trigrams(F.col("t")).alias(f"{n}_grams")).where(F.size(f"{n}_grams") > 0) for d, n in ((left, "a"), (right, "b")))
        every = a.crossJoin(b).select("a", "b", Z.similarity(F.col("a_grams"), F.col("b_grams")).alias("s")).where(F.col("s") >= threshold)
        assert found == {(x, y, round(z, 6)) for x, y, z in every.collect()}


def test_different_titles_with_equal_trigrams_are_all_linked(spark, tmp_path):
    spark.createDataFrame([(1, "Supplier#ababab", "X"), (2, "Supplier#abab", "X")], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(7, "Supplier#ababab"), (8, "Supplier#abab")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    found = registry.QUERIES["similar_titles"](spark, str(tmp_path)).select("left_id", "right_id").collect()
    assert sorted(map(tuple, found)) == [(1, 7), (1, 8), (2, 7), (2, 8)]


def _files(path):
    return [f for f in path.rglob("*.parquet")]


def test_what_a_task_of_an_index_writes_does_not_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "TASK_CHARS", 100)
    monkeypatch.setattr(top_documents, "TASK_ROWS", 100)
    monkeypatch.setattr(typos, "TASK_TERMS", 20)
    monkeypatch.setattr(trigram_index, "TASK_TEXTS", 4)
    docs = spark.createDataFrame([(k, " ".join(f"word{k * j % 71}" for j in range(20))) for k in range(80)], "document_id long, text string")
    key = lambda rows: sorted((r["document_id"], r["term"], r["weight"], tuple(r["positions"])) for r in rows.collect())
    expected = key(fulltext.postings(docs, {"text": "D"}))
    index = search_index.SearchIndex(spark, f"{tmp_path}/i", {"text": "D"}, 2).build(docs)
    assert len(_files(tmp_path / "i" / "postings")) > 10 and key(index.postings()) == expected
    index.refresh(docs.where("document_id > 3"))
    index.refresh(docs)
    assert sorted(index.compact()) == [0, 1] and key(index.postings()) == expected
    assert len(_files(tmp_path / "i" / "postings")) > 10
    top_documents.TopDocuments(spark, f"{tmp_path}/t", 2).build(index.postings())
    assert len(_files(tmp_path / "t" / "weights")) > 10
    typos.Dictionary(spark, f"{tmp_path}/d", 2).build(index.postings())
    assert len(_files(tmp_path / "d")) > 2
    trigram_index.TrigramIndex(spark, f"{tmp_path}/g", 2).build(docs, "document_id", "text")
    assert len(_files(tmp_path / "g")) > 12


def test_no_year_is_numbered_by_one_task(spark):
    plan = registry.QUERIES["backfill_years"](spark, SMOKE)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def test_more_documents_do_not_make_more_buckets_of_links(spark, monkeypatch):
    monkeypatch.setattr(text_queries, "_planted", lambda spark, sf_dir: spark.createDataFrame([(k * 1000, "Sbr. 1. gr. laga um próf nr. 8/1991.") for k in range(100)], "document_id long, text string"))
    store = text_queries._kept_links(spark, SMOKE)
    assert store.marks(bucket=True).select("bucket").distinct().count() <= text_queries.MOST_BUCKETS


def test_texts_without_wide_blanks_are_not_gone_through(spark):
    rows = spark.createDataFrame([("a b",), ("a\u00a0b\u2007c\u202fd\u0001e",), (None,), ("",)], "t string")
    found = rows.select(citations.plain_spaces(F.col("t")).alias("t"))
    assert [r["t"] for r in found.collect()] == ["a b", "a b c d e", None, ""]
    assert "CASE WHEN" in found._jdf.queryExecution().optimizedPlan().toString()


def test_rich_text_reads_batches_in_slices(spark, monkeypatch):
    text = '{"__typename": "V", "richText": {"document": {"nodeType": "document", "content": [{"nodeType": "text", "value": "v%d"}]}}}'
    rows = spark.createDataFrame([(k, text % k if k % 10 else None) for k in range(3 * landing.SLICE + 1)], "k int, t string").coalesce(1)
    found = {r["k"]: r["x"] for r in rows.select("k", landing.rich_text(F.col("t"), "V").alias("x")).collect()}
    assert {k: x.strip() if x else x for k, x in found.items()} == {k: f"v{k}" if k % 10 else None for k in range(3 * landing.SLICE + 1)}


def test_texts_behind_a_statute_are_gone_through_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def text(k):
        seen.add(1)
        return "Sbr. 1. gr. laga um próf nr. 8/1991."

    texts = spark.range(10).select(F.col("id").alias("document_id"), F.udf(text, "string").asNondeterministic()("id").alias("text"))
    monkeypatch.setattr(text_queries, "_planted", lambda spark, sf_dir: texts)
    monkeypatch.setattr(api_queries, "_index", None)  # not built where nothing is searched
    registry.QUERIES["api_act_detail"](spark, SMOKE).collect()
    assert seen.value == 10


def test_a_search_counts_all_it_finds(spark):
    rows = retrieval.COUNT_CAP + 5
    docs = spark.range(rows).select(F.col("id").alias("document_id"), F.lit("a").alias("source"), F.lit("E-1/2020").alias("case_number"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("case_name"),
        F.lit("2020-01-01").cast("timestamp_ntz").alias("date"), F.lit(2020).alias("year"), F.array(F.lit("x")).alias("tags"), F.lit("texti").alias("text"))
    lib = api.Library(docs, *[docs.limit(0)] * 6)
    found = api.search_documents(lib, api.SearchRequest("", ("a",)))
    assert (found.total, found.capped, found.pages) == (rows, False, -(-rows // retrieval.PAGE_SIZE))
    capped = api.search_documents(lib, api.SearchRequest("", ("a",), count_cap=100))
    assert (capped.total, capped.capped) == (100, True)


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_pairs_of_rows_with_equal_titles_are_made_by_all_cores(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(Z, "BROADCAST_ROWS", broadcast_rows, raising=False)
    left = spark.range(90).select("id", F.when(F.col("id") % 10 > 0, F.concat(F.lit("Lög um vexti "), F.col("id") % 3)).otherwise(" .-").alias("t"))
    right = spark.range(40).select("id", F.concat(F.lit("lög, um vexti "), F.col("id") % 2).alias("t"))
    found = Z.similar_rows(left, right, "id", "t", "id", "t", 0.9)
    assert found.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
    assert sorted((x, y, z) for x, y, z in found.collect()) == [(x, y, 1.0) for x in range(90) for y in range(40) if x % 10 and x % 3 == y % 2]
