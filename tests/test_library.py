import json
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from jurispark import api
from jurispark.functions import citations as C
from jurispark.functions.query import query_tree
from jurispark.operators import citation_job
from jurispark.operators import fulltext as X
from jurispark.operators import linking as L
from jurispark.operators import merge as M
from jurispark.operators.runner import Pipeline, Store
from jurispark.sources import landing
from jurispark.sources.seed import seed_tables
from jurispark.streaming import arrival


@pytest.fixture(scope="module")
def lib(spark):
    texts = {
        1: "Útdráttur\nÁgreiningur var um bætur samkvæmt 57. gr. laga nr. 46/1980 og þær dæmdar stefnanda að hluta.\nDómur\nSjá E-2/2020 um rauða bílinn.",
        2: "Rauði bíllinn var seldur, sbr. 57. gr. laga nr. 46/1980 og hegningarlaga nr. 19/1940.",
        3: "Blái bíllinn var ekki seldur.",
    }
    docs = spark.createDataFrame(
        [(k, "a" if k < 3 else "b", f"E-{k}/2020", f"Mál {k}", f"Dómur {k}", datetime(2020, 1, k), 2020, ["bætur", "bílar"][: k % 2 + 1], t) for k, t in texts.items()],
        "document_id int, source string, case_number string, case_name string, title string, date timestamp_ntz, year int, tags array<string>, text string",
    )
    acts = spark.createDataFrame([("a2", 46, 1980, "Lög um aðbúnað", ["vinnuverndarlaga"]), ("a3", 19, 1940, "Almenn hegningarlög", ["hegningarlaga"])], "act_id string, act_number int, year int, title string, aliases array<string>")
    provisions = spark.createDataFrame([("p2", "a2", "article", 57, None, "57. gr.", "Bætur", 1), ("p3", "a3", "article", 211, None, "211. gr.", None, 1)],
        "provision_id string, act_id string, kind string, article_number int, article_letter string, label string, heading string, ordering int")
    to_provisions, to_acts, _ = L.link(docs.select("document_id", "text"), acts, provisions)
    index = X.postings(docs, {"title": "A", "case_name": "A", "text": "D"})
    return api.Library(docs, acts, provisions, to_provisions, to_acts, index, X.postings(provisions, {"label": "A", "heading": "B"}, "provision_id"), {"a": ("A", "g", "live"), "b": ("B", "g", "pilot")})


def ids(df, column="document_id"):
    return [r[column] for r in df.collect()]


def test_search(lib):
    found = api.search_documents(lib, api.SearchRequest("bíllinn seldur", ("a", "b")))
    assert ids(found.rows) == [3, 2]  # equal ranks, the newer first
    assert (found.total, found.capped, found.pages) == (2, False, 1)
    assert ids(api.search_documents(lib, api.SearchRequest("bíllinn -ekki", ("a", "b"))).rows) == [2]
    first = api.search_documents(lib, api.SearchRequest("bætur", ("a",), act_ids=("a2",))).rows.first()
    assert first["document_id"] == 1 and "<mark>bætur</mark>" in first["snippet"] and first["summary"].startswith("Ágreiningur")
    assert ids(api.search_documents(lib, api.SearchRequest("e-3/2020", ("b",))).rows) == [3]
    assert ids(api.search_documents(lib, api.SearchRequest("Dómru 3", ("a", "b"))).rows)
    assert ids(api.search_documents(lib, api.SearchRequest("", ("a", "b"), sort="oldest", tags=("bílar",))).rows) == [1, 3]
    for bad in (api.SearchRequest("x"), api.SearchRequest("x", ("zz",)), api.SearchRequest("x", ("a",), sort="best")):
        with pytest.raises(ValueError):
            api.search_documents(lib, bad)


def test_acts_and_provisions(lib):
    assert ids(api.search_acts(lib, "hegningarlaga"), "act_id")[0] == "a3" and api.search_acts(lib, " ").count() == 0
    act, articles = api.act_detail(lib, "46-1980")
    assert act["judgments"] == 2 and articles.first()["judgments"] == 2
    with pytest.raises(KeyError):
        api.act_detail(lib, "1-1999")
    with pytest.raises(ValueError):
        api.act_detail(lib, "x")
    assert ids(api.search_provisions(lib, "57. gr.", "a2"), "provision_id") == ["p2"] and ids(api.search_provisions(lib, "bætur"), "provision_id") == ["p2"]
    counts, page = api.provision_cases(lib, "p2")
    assert counts == {"total": 2, "citations": 2} and ids(page) == [2, 1]
    assert api.lookup(lib, "57. gr.")["needs_act"] and api.lookup(lib, "57. gr. laga um aðbúnað")["provisions"][0]["provision_id"] == "p2"
    assert api.lookup(lib, "9. gr. almennra hegningarlaga")["provisions"] == [] and api.lookup(lib, "x")["acts"] == []
    assert ids(api.list_acts(lib, cited_only=True), "act_id") == ["a3", "a2"]


def test_documents_tags_home(lib):
    doc, related = api.document_with_related(lib, 1, C.cited_cases)
    assert doc["case_number"] == "E-1/2020" and ids(related, "related_id") == [2]
    assert ids(api.search_tags(lib, "Bæ"), "tag") == ["bætur"]
    kept = replace(lib, vocabulary=lib.documents.sparkSession.createDataFrame([("bæklingur", 3), ("Ba\u0304ll", 2), ("šőčñ", 1)], "tag string, n long"))
    assert ids(api.search_tags(kept, "BAE"), "tag") == ["bæklingur"] and ids(api.search_tags(kept, "bal"), "tag") == ["Ba\u0304ll"] and ids(api.search_tags(kept, "ocn"), "tag") == ["šőčñ"]
    spark = lib.documents.sparkSession
    counts = spark.createDataFrame([("the The cat (x)",)], "t string").select(*(api.hit_count(F.col("t"), q).alias(f"c{k}") for k, q in enumerate(('"the" cat', "(?P<x>the)", "(", "(x)", " ")))).first()
    assert tuple(counts) == (3, 0, 0, 1, 0)
    assert landing.decode("þ".encode("latin-1"), "text/html; charset=iso-8859-1") == "þ" and landing.decode(b'<meta charset="latin-1">\xfe', "text/html") == '<meta charset="latin-1">þ'
    assert landing.decode(b'<meta charset="hex">ab', None) == '<meta charset="hex">ab' and landing.decode("þ".encode(), "text/html; charset=rot13") == "þ" and landing.decode(None) is None
    featured, newest = api.home_cases(lib, 3)
    assert featured["document_id"] not in ids(newest) and newest.count() == 2
    assert [r["documents"] for r in api.progress(lib).collect()] == [2]


def test_landing(spark):
    page = '<a href="/lagas/154b/1991091.html">Lög um meðferð einkamála</a> Útgáfa 154b. <a href="/lagas/154b/1991091.html">aftur</a><a href="x/1874000.html">Stjórnarskrá</a>'
    found = landing.statute_index(spark.createDataFrame([("p", page)], "page string, html string"), "page", "html").orderBy("year").collect()
    assert [(r["number"], r["year"], r["title"], r["version"]) for r in found] == [(0, 1874, "Stjórnarskrá", "154b"), (91, 1991, "Lög um meðferð einkamála", "154b")]
    links = landing.case_links(spark.createDataFrame([("p", '<a href="/c/1">Case E-1/24</a><a href="/c/1">E-1/24 again</a><a href="/x">none</a>')], "page string, html string"), "page", "html")
    assert [(r["href"], r["text"]) for r in links.collect()] == [("/c/1", "Case E-1/24")]
    docs = spark.createDataFrame([("c", 0, "/a.pdf", "Icelandic"), ("c", 1, "/b.pdf", "Judgment"), ("c", 2, "/c.pdf", "English"), ("d", 0, "/d.pdf", "one"), ("d", 1, "/e.pdf", "two")], "case string, position int, href string, text string")
    assert {r["case"]: r["href"] for r in landing.english_document(docs, "case").collect()} == {"c": "/c.pdf", "d": "/d.pdf"}
    payload = json.dumps({"a": [{"__typename": "Html", "document": {"nodeType": "document", "content": [{"nodeType": "paragraph", "content": [{"nodeType": "text", "value": "one"}]}, {"nodeType": "paragraph", "content": [{"nodeType": "text", "value": "two"}]}]}}]})
    rows = spark.createDataFrame([(payload,), ("{",), (None,)], "p string").select(landing.rich_text(F.col("p"), "Html").alias("t")).collect()
    assert [r["t"] for r in rows] == ["one\ntwo", None, None]
    keys = spark.createDataFrame([("Hæstiréttur Íslands",), ("Landsréttur",), ("Héraðsdómur Reykjavíkur",), ("Annað",)], "c string").select(landing.source_key(F.col("c")).alias("k")).collect()
    assert [r["k"] for r in keys] == ["haestirettur", "landsrettur", "heradsdomar", None]


def test_decoded_pages(spark, tmp_path):
    (tmp_path / "a.html").write_bytes('<meta charset="iso-8859-1">þæö'.encode("latin-1"))
    (tmp_path / "b.html").write_bytes('<meta charset="nonsense">þæö'.encode())
    assert all("þæö" in r["text"] for r in landing.decoded_pages(spark, str(tmp_path)).collect())


def test_merging_twice_is_merging_once(spark):
    store = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2")], "k int, t string, text_hash string")
    new = spark.createDataFrame([(1, "z", "h1"), (2, "y", "h9"), (3, "c", "h3")], "k int, t string, text_hash string")
    once = M.upsert(store, new, ["k"])
    assert {r["k"]: (r["t"], r["outcome"]) for r in once.collect()} == {1: ("a", "skipped"), 2: ("y", "updated"), 3: ("c", "inserted")}
    again = M.upsert(once.drop("outcome"), new, ["k"])
    assert {r["outcome"] for r in again.collect()} == {"skipped"} and sorted(again.drop("outcome").collect()) == sorted(once.drop("outcome").collect())


def test_arrival_stream(spark, tmp_path):
    landing_dir, store = tmp_path / "in", str(tmp_path / "store")
    landing_dir.mkdir()
    schema = "source string, url string, text string, seq int"

    def arrive(name, rows):
        (landing_dir / name).write_text("\n".join(json.dumps(r) for r in rows))
        arrival.start(spark, str(landing_dir), schema, store, str(tmp_path / "cp"), ["source", "url"], "seq").awaitTermination()

    arrive("1.json", [{"source": "a", "url": "u", "text": "one", "seq": 1}, {"source": "a", "url": "u", "text": "two", "seq": 2}])
    arrive("2.json", [{"source": "a", "url": "u", "text": "two", "seq": 3}, {"source": "a", "url": "v", "text": "new", "seq": 4}])
    assert sorted((r["url"], r["text"], r["seq"]) for r in arrival.current(spark, store).collect()) == [("u", "two", 2), ("v", "new", 4)]
    for k in (5, 6, 7):
        arrive(f"{k}.json", [{"source": "a", "url": "u", "text": f"text {k}", "seq": k}])
    assert sorted((r["url"], r["text"]) for r in arrival.current(spark, store).collect()) == [("u", "text 7"), ("v", "new")]
    assert all(len(v) <= 2 for v in arrival._versions(spark, store).values())
    assert {p.name for p in (tmp_path / "store").iterdir() if p.is_dir()} == {f"v{n}" for v in arrival._versions(spark, store).values() for n, _ in v}
    again = spark.createDataFrame([("a", "u", "text 7", 7)], schema)
    arrival.merge_batch(store, ["source", "url"], "seq")(again, 4)  # a batch that is run again
    assert sorted((r["url"], r["text"], r["seq"]) for r in arrival.current(spark, store).collect()) == [("u", "text 7", 7), ("v", "new", 4)]


CITED = [
    (1, "E-1/2020", "Sbr. 2. mgr. 175. gr. a laga um meðferð einkamála nr. 91/1991, og 57. gr. laga nr. 46/1980. Í máli nr. E-2/2020 var það sama, sbr. 57. gr. laga nr. 46/1980."),
    (2, "415/2018", "Samkvæmt 211. gr. almennra hegningarlaga nr. 19/1940 og vaxtalaga nr. 38/2001. Sjá mál nr. 415/2018 og dóm í máli nr. 12595/2024."),
    (3, "22/2023", "Í stjórnarskrá lýðveldisins Íslands nr. 33/1944 og reglugerð Evrópusambandsins nr. 2024/2642 er annað, sbr. l. 46/1980."),
    (4, "E-9/2021", "laga um meðferð einkamála í máli nr. 415/2018"),
    (5, "E-3/2019", "Hegningarlaga nr. 19/1940 er getið. Hegningarlaga nr. 19/1940 er aftur getið, og 9. gr. laga nr. 1/1999."),
    (6, "E-4/2019", None),
]


@pytest.fixture(scope="module")
def cited(spark):
    docs = spark.createDataFrame(CITED, "document_id int, case_number string, text string")
    acts = spark.createDataFrame([("a1", 91, 1991), ("a2", 46, 1980), ("a3", 19, 1940), ("a4", 38, 2001)], "act_id string, act_number int, year int").withColumn("aliases", F.array(F.lit("old")))
    provisions = spark.createDataFrame([("p1", "a1", "article", 175, "a", 3), ("p2", "a2", "article", 57, None, 1), ("p3", "a2", "article", 57, None, 2), ("p4", "a3", "article", 211, None, 1), ("p5", "a3", "annex", None, None, 9)],
        "provision_id string, act_id string, kind string, article_number int, article_letter string, ordering int")
    return docs, acts, provisions


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_citations(cited):
    docs, acts, provisions = cited
    numbers = {r["document_id"]: r["c"] for r in docs.select("document_id", C.cited_cases(F.col("text"), F.col("case_number")).alias("c")).collect()}
    assert numbers == {1: ["E-2/2020"], 2: ["12595/2024"], 3: [], 4: ["415/2018"], 5: [], 6: None}
    found = docs.select("document_id", F.inline(C.act_citations(F.col("text"))), "text").select("document_id", "act_number", "year", "alias", F.expr("substring(text, offset + 1, length)"))
    assert tuples(found) == sorted([
        (1, 91, 1991, None, "a laga um meðferð einkamála nr. 91/1991"), (1, 46, 1980, None, "laga nr. 46/1980"), (1, 46, 1980, None, "laga nr. 46/1980"), (2, 19, 1940, "hegningarlaga", "almennra hegningarlaga nr. 19/1940"),
        (2, 38, 2001, "vaxtalaga", "og vaxtalaga nr. 38/2001"), (3, 46, 1980, None, "l. 46/1980"), (5, 19, 1940, "hegningarlaga", "Hegningarlaga nr. 19/1940"), (5, 19, 1940, "hegningarlaga", "Hegningarlaga nr. 19/1940"), (5, 1, 1999, None, "laga nr. 1/1999"),
    ], key=repr)
    found = docs.select("document_id", F.inline(C.provision_citations(F.col("text")))).select("document_id", "paragraph", "article", "letter", "act_number", "year", "offset", "text")
    assert tuples(found) == sorted([
        (1, 2, 175, "a", 91, 1991, 5, "2. mgr. 175. gr. a laga um meðferð einkamála nr. 91/1991"), (1, None, 57, None, 46, 1980, 66, "57. gr. laga nr. 46/1980"), (1, None, 57, None, 46, 1980, 131, "57. gr. laga nr. 46/1980"),
        (2, None, 211, None, 19, 1940, 9, "211. gr. almennra hegningarlaga nr. 19/1940"), (5, None, 9, None, 1, 1999, 81, "9. gr. laga nr. 1/1999"),
    ], key=repr)
    to_provisions, to_acts, mentions = L.link(docs.select("document_id", "text"), acts, provisions)
    assert tuples(to_provisions.select("document_id", "provision_id", "char_offset", "paragraph_number")) == [(1, "p1", 5, 2), (1, "p3", 131, None), (1, "p3", 66, None), (2, "p4", 9, None)]
    assert tuples(to_acts.select("document_id", "act_id", "char_offset", "excerpt")) == sorted([
        (2, "a4", 53, "Samkvæmt 211. gr. almennra hegningarlaga nr. 19/1940 og vaxtalaga nr. 38/2001. Sjá mál nr. 415/2018 og dóm í máli nr. 12595/2024."),
        (3, "a2", 108, "Í stjórnarskrá lýðveldisins Íslands nr. 33/1944 og reglugerð Evrópusambandsins nr. 2024/2642 er annað, sbr. l."),
        (5, "a3", 0, "Hegningarlaga nr. 19/1940 er getið."), (5, "a3", 36, "Hegningarlaga nr. 19/1940 er aftur getið, og 9. gr. laga nr. 1/1999."),
    ], key=repr)
    assert tuples(mentions.where("act_id IS NULL").select("document_id", "act_number", "year")) == [(5, 1, 1999)]


def test_citation_job_scans_what_changed(spark, cited):
    docs, acts, provisions = cited
    docs = docs.withColumns({"text_hash": M.text_hash(F.col("text")), "citation_scan_hash": F.lit(None).cast("string")})
    old = spark.createDataFrame([(1, "p9", 1), (6, "p9", 1), (9, "p9", 1)], "document_id int, provision_id string, char_offset int")
    bare = spark.createDataFrame([], "document_id int, act_id string, char_offset int")
    done = citation_job.run(docs, acts, provisions, old, bare)
    assert tuples(done.provision_links) == [(1, "p1", 5), (1, "p3", 131), (1, "p3", 66), (2, "p4", 9), (6, "p9", 1), (9, "p9", 1)]
    assert done.stats.first().asDict() == {"indexed": 5, "errors": 1, "error_sample": "6: no text"}
    assert {r["act_id"]: r["aliases"] for r in done.acts.collect()} == {"a1": ["old"], "a2": ["old"], "a3": ["hegningarlaga"], "a4": ["old"]}
    assert tuples(done.unknown) == [(1, 1999, 1)]
    again = citation_job.run(done.documents, done.acts, provisions, done.provision_links, done.act_links)
    assert again.stats.first()["indexed"] == 0 and tuples(again.provision_links) == tuples(done.provision_links) and tuples(again.act_links) == tuples(done.act_links)
    assert citation_job.run(docs, acts, provisions, old, bare, most=2).stats.first()["indexed"] == 2
    with pytest.raises(ValueError):
        citation_job.run(docs, acts.limit(0), provisions, old, bare)


def test_runner(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "source string, n int")
    assert store.tables() == {} and store.runs().count() == 0
    store.seed({"documents": rows})

    def more(tables):
        out = tables["documents"].withColumn("n", F.col("n") + 1)
        return {"documents": out}, out.agg(F.count("*").alias("indexed"), F.lit(0).cast("long").alias("skipped"))

    def broken(tables):
        raise RuntimeError("no network")

    store.pipelines |= {"more": Pipeline(more, ("a",)), "broken": Pipeline(broken, ("b",))}
    assert tuples(api.run_pipeline(store, "more", dry_run=True)["documents"]) == [("a", 2), ("b", 3)] and store.runs().count() == 1
    assert tuples(api.run_pipeline(store, "more")["documents"]) == [("a", 2), ("b", 3)]
    with pytest.raises(RuntimeError):
        store.run("broken")
    with pytest.raises(KeyError):
        store.run("none")
    log = {r["run_id"]: (r["pipeline"], r["status"], r["indexed"], r["error_sample"]) for r in store.runs().collect()}
    assert log == {1: ("seed", "success", 0, None), 2: ("more", "success", 2, None), 3: ("broken", "failed", 0, "no network")}
    assert tuples(store.tables()["documents"]) == [("a", 2), ("b", 3)] and [r["source"] for r in store.source_stamps().collect()] == ["a"]
    known = spark.createDataFrame([("a", "A"), ("b", "B")], "source string, name string")
    status = {r["source"]: (r["documents"], r["last_ingested_at"] is None, [x["status"] for x in r["recent_runs"]]) for r in store.ingestion_status(known, rows).collect()}
    assert status == {"a": (1, False, ["success"]), "b": (1, True, ["failed"])}


def test_seed_and_citation_pipeline(spark, cited, tmp_path):
    _, acts, provisions = cited
    store = Store(spark, str(tmp_path / "seeded"))
    empty = spark.createDataFrame([], "document_id long, provision_id string, char_offset int"), spark.createDataFrame([], "document_id long, act_id string, char_offset int")
    store.seed(seed_tables(spark) | {"acts": acts, "provisions": provisions, "provision_links": empty[0], "act_links": empty[1]})

    def link(t):
        done = citation_job.run(t["documents"], t["acts"], t["provisions"], t["provision_links"], t["act_links"])
        return {"documents": done.documents, "provision_links": done.provision_links, "act_links": done.act_links, "acts": done.acts}, done.stats

    store.pipelines["citations"] = Pipeline(link, tuple(r["source"] for r in store.tables()["sources"].collect()))
    assert store.run("citations")["provision_links"].count() == 4
    store.run("citations")
    assert [r["indexed"] for r in store.runs().orderBy("run_id").collect()] == [0, 4, 0] and store.source_stamps().count() == 4


def test_filters_and_addresses(spark, lib):
    assert ids(api.filter_acts(lib.acts, "HEGNINGAR"), "act_id") == ["a3"] and ids(api.filter_acts(lib.acts, "46/19"), "act_id") == ["a2"] and api.filter_acts(lib.acts, " ").count() == 2
    row = api.with_addresses(lib.acts.where("act_id = 'a3'")).first()
    assert (row["citation"], row["path"], row["official_url"]) == ("lög nr. 19/1940", "/log/19-1940", "https://www.althingi.is/lagas/nuna/1940019.html")
    parts = lib.provisions.withColumn("paragraphs", F.array(F.lit("Um Bætur og fleira")))
    assert api.filter_provisions(parts, "bætur og").count() == 2 and ids(api.filter_provisions(parts, "211"), "provision_id") == ["p3"]
    count = lambda q: spark.createDataFrame([("Bætur og bætur, að bíl",)], "t string").select(api.hit_count(F.col("t"), q).alias("n")).first()["n"]
    assert (count('"bætur að"'), count(" "), count("(")) == (3, 0, 0)
    assert [r["source"] for r in api.sources(lib).collect()] == ["a", "b"]


def test_judgment_pages_and_feeds(spark, tmp_path):
    data = json.dumps({"props": [{"__typename": "WebVerdictByIdItem", "richText": {"document": {"nodeType": "document", "content": [{"nodeType": "paragraph", "content": [{"nodeType": "text", "value": "Dómur"}]}, {"nodeType": "paragraph", "content": [{"nodeType": "text", "value": "Texti"}]}]}}}]})
    page = f'<html><script id="__NEXT_DATA__" type="application/json">{data}</script></html>'
    rows = spark.createDataFrame([(page, None), (page, "Lína sem end-\nar hér"), ("<html></html>", None), (None, None)], "html string, pdf string")
    assert [r["t"] for r in rows.select(landing.judgment_text(F.col("html"), F.col("pdf")).alias("t")).collect()] == ["Dómur\nTexti", "Lína sem endar hér", None, None]
    (tmp_path / "feed.json").write_text('{"id": "1", "court": "Landsréttur", "caseNumber": "E-1/2020", "keywords": ["a"]}\n')
    assert landing.feed_items(spark, str(tmp_path / "feed.json")).first()["caseNumber"] == "E-1/2020"
    links = spark.createDataFrame([("<a class='x' href='/a?b=1&amp;c=2'>One <b>two</b></a><a name='n'>none</a><A HREF=/c >\n Three&nbsp;</A>",)], "h string").select(F.inline(landing.links(F.col("h"))))
    assert tuples(links) == [("/a?b=1&c=2", "One two"), ("/c", "Three")]


def test_phrases_stay_within_fields(spark):
    docs = spark.createDataFrame([(1, "a b", "c d"), (2, "x", "b c")], "document_id int, title string, text string")
    index = X.postings(docs, {"title": "A", "text": "D"})
    assert ids(X.matching(index, query_tree('"b c"'))) == [2] and ids(X.matching(index, query_tree('"c d"'))) == [1]
