import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from jurispark.functions.query import Node, query_tree
from jurispark.operators import fulltext as X
from jurispark.operators import fuzzy as Z
from jurispark.operators import search_index
from jurispark.operators.search_index import SearchIndex
from jurispark.operators.trigram_index import TrigramIndex, type_ahead_indexed
from jurispark.operators.typos import Dictionary, allowed, rests
from jurispark.session import built_once

FIELDS = {"title": "A", "text": "D"}


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "document_id long, title string, text string")


def matched(index, query):
    return sorted(r["document_id"] for r in X.matching(index.postings(), query_tree(query)).collect())


def plain_postings(rows):
    out = set()
    for i, title, text in rows:
        begin = 0
        for weight, value in (("A", title), ("D", text)):
            words = [w for w in "".join(c if c.isalnum() else " " for c in (value or "").lower()).split()]
            for w in set(words):
                out.add((i, w, weight, tuple(begin + k for k, x in enumerate(words) if x == w)))
            begin += len(words) + 1
    return out


ROWS = [(1, "One title", "the cat, the dog; THE end"), (2, None, "cat"), (3, "", ""), (4, "Þór ærð", None), (5, "a a a", "b a b"), (None, "no id", "cat")]


def test_postings_are_gathered_in_their_rows(spark):
    found = {(r["document_id"], r["term"], r["weight"], tuple(r["positions"])) for r in X.postings(docs_of(spark, ROWS).coalesce(1), FIELDS).collect()}
    assert found == plain_postings(ROWS)
    assert X.postings(docs_of(spark, []), FIELDS).count() == 0
    named = X.postings(spark.createDataFrame([("x", "t u")], "document_id string, text string"), {"text": "D"})
    assert sorted(r["document_id"] for r in named.collect()) == ["x", "x"]


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def buckets(paths):
    return {f.split("bucket=")[1].split("/")[0] for f in paths}


def test_index_follows_its_documents(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = {i: (i, f"title{i % 3}", f"word{i % 5} common text{i}") for i in range(40)}
    index = SearchIndex(spark, f"file://{path}", FIELDS, 8).build(docs_of(spark, list(rows.values())))
    assert matched(index, "word1") == list(range(1, 40, 5)) and len(matched(index, "common")) == 40
    before = files(path)
    assert index.refresh(docs_of(spark, list(rows.values()))) == {"inserted": 0, "updated": 0, "deleted": 0} and files(path) == before
    rows[1], rows[99] = (1, "title1", "changed words"), (99, None, "a new one, common")
    del rows[6]
    assert index.refresh(docs_of(spark, list(rows.values()))) == {"inserted": 1, "updated": 1, "deleted": 1}
    written = set(files(path)) - set(before)
    assert all(files(path)[f] == t for f, t in before.items()) and len(buckets(f for f in written if "/postings/" in f)) <= 2 and len(buckets(written)) <= 3
    assert matched(index, "word1") == list(range(11, 40, 5)) and matched(index, "changed") == [1] and 99 in matched(index, "common") and 6 not in matched(index, "common")
    rows[6] = (6, "title0", "back again")
    del rows[99]
    index.refresh(docs_of(spark, list(rows.values())))
    assert matched(index, "back") == [6] and matched(index, "new") == []
    live = {(r["document_id"], r["term"], r["weight"], tuple(r["positions"])) for r in index.postings().collect()}
    assert live == plain_postings(list(rows.values()))
    before = files(path)
    touched = index.compact()
    after = files(path)
    assert touched and set(map(str, touched)) == buckets(set(after) - set(before))
    assert {f for f in before if f.split("bucket=")[1].split("/")[0] not in map(str, touched)} <= set(after)
    assert index.compact() == []
    again = SearchIndex(spark, f"file://{path}", FIELDS, 8)
    assert {(r["document_id"], r["term"], r["weight"], tuple(r["positions"])) for r in again.postings().collect()} == live
    assert {r["document_id"] for r in again.documents().collect()} == set(rows)


def test_a_segment_that_was_not_listed_is_not_read(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/index", FIELDS, 4).build(docs_of(spark, [(1, "t", "old words")]))
    index._write(X.postings(docs_of(spark, [(1, "t", "broken off")]), FIELDS), 1)  # as a run leaves it that ended before its list was written
    assert matched(index, "broken") == [] and matched(index, "old") == [1]
    index.refresh(docs_of(spark, [(1, "t", "whole words")]))
    assert matched(index, "broken") == [] and matched(index, "whole") == [1] and matched(index, "old") == []


def test_a_table_written_anew_is_built_anew(spark, tmp_path):
    source, built = f"file://{tmp_path}/t.parquet", []
    for n in (3, 3, 4):
        if n != len(built) + 2:
            spark.range(n).write.mode("overwrite").parquet(source)
        path = built_once(spark, f"test {tmp_path}", source, lambda path: (built.append(path), spark.read.parquet(source).write.parquet(path)))
        assert spark.read.parquet(path).count() == n
    assert len(built) == 2


@pytest.fixture(scope="module")
def titles(spark, tmp_path_factory):
    draw = random.Random(3)
    words = "standard anodized steel copper economy small tin brushed lög um meðferð sakamála".split()
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(1, 4))), i % 30) for i in range(300)] + [(900, None, 1), (901, "", 1), (902, "!?", 1), (903, "ab", 1)]
    df = spark.createDataFrame(rows, "act_id long, title string, year int").withColumn("aliases", F.array(F.reverse("title")))
    path = tmp_path_factory.mktemp("grams")
    made = [TrigramIndex(spark, f"file://{path}/{k}", 4).build(df.select("act_id", F.expr(c).alias("t")), "act_id", "t") for k, c in enumerate(("title", "array_join(aliases, ' ')"))]
    return df, made


@pytest.mark.parametrize("query", ["standrd anodised steel", "lög um", "tin", "ab", "", "zzz", "meðferd"])
@pytest.mark.parametrize("threshold", [0.3, 0.6])
def test_similar_from_the_index_equals_a_scan(titles, query, threshold):
    df, (index, _) = titles
    scan = {(r["act_id"], round(r["similarity"], 9)) for r in Z.similar(df, "title", query, threshold).collect() if r["similarity"] > 0}
    assert {(r["id"], round(r["similarity"], 9)) for r in index.similar(query, threshold).collect()} == scan


def test_only_the_querys_pages_are_asked_for(titles):
    _, (index, _) = titles
    plan = index.similar("steel tin")._jdf.queryExecution().toString()
    assert "In(gram, [" in plan and "GreaterThanOrEqual(size" in plan


@pytest.mark.parametrize("query", ["anodized st", "7", "tin", "copper", "xyzzy", "small tinn", "leets"])
def test_type_ahead_from_indexes_equals_a_scan(titles, query):
    df, made = titles
    rows = lambda found: [(r["act_id"], r["bucket"], round(r["similarity"], 9)) for r in found.collect()]
    assert rows(type_ahead_indexed(df, *made, query, 25)) == rows(Z.type_ahead(df, query, 25))


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_dictionary_finds_all_terms_within_the_distance(spark, tmp_path):
    draw = random.Random(9)
    terms = {"".join(draw.choices("abþ", k=draw.randint(1, 14))) for _ in range(1500)} | {"hæstiréttur", "héraðsdómur"}
    rows = [(k, "", t) for k, t in enumerate(sorted(terms))]
    words = Dictionary(spark, f"file://{tmp_path}/d", 4).build(X.postings(docs_of(spark, rows), FIELDS))
    for query in [*draw.sample(sorted(terms), 12), "hæstirettru", "abababa", "aaaab", "bbb", "", "þþþþþþþþþþþþ"]:
        k = allowed(query)
        want = {(t, _distance(query, t)) for t in terms if _distance(query, t) <= k and len(t) >= 4} if query else set()
        assert {(r["term"], r["distance"]) for r in words.near(query).collect()} == want
    assert "" in rests("ab", 2) and rests("", 1) == [""]


def test_queries_are_expanded_word_by_word(spark, tmp_path):
    rows = [(1, "", "hestamaður og kýr"), (2, "", "hestamaðir"), (3, "", "kýr"), (4, "", "hestamður kýr")]
    postings = X.postings(docs_of(spark, rows), FIELDS)
    words = Dictionary(spark, f"file://{tmp_path}/d", 4).build(postings)
    found = lambda q: sorted(r["document_id"] for r in X.matching(postings, words.expanded(query_tree(q)), docs_of(spark, rows)).collect())
    assert found("hestamaður kýr") == [1, 4] and found("hestamaður -kýr") == [2] and found('"hestamaður og"') == [1] and found("kyr") == []
    assert words.expanded(None) is None and words.expanded(Node("term", "og")) == Node("term", "og")


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_buckets_are_compacted_one_after_another(spark, tmp_path, monkeypatch, broadcast_rows):
    monkeypatch.setattr(search_index, "BROADCAST_ROWS", broadcast_rows)
    path = tmp_path / "index"
    rows = [(k, f"title{k % 3}", f"word{k % 5} common text{k}") for k in range(60)]
    index = SearchIndex(spark, f"file://{path}", FIELDS, 4).build(docs_of(spark, rows))
    index.refresh(docs_of(spark, rows[5:]))
    rows = [(k, title, f"{text} again" if k % 2 else text) for k, title, text in rows]
    index.refresh(docs_of(spark, rows))
    expected, seen, write = plain_postings(rows), [], index._write
    found = lambda: [(r["document_id"], r["term"], r["weight"], tuple(r["positions"])) for r in SearchIndex(spark, f"file://{path}", FIELDS, 4).postings().collect()]

    def watched(self, made, *rest, **more):
        assert len(found()) == len(expected) and set(found()) == expected  # also while it is compacted
        write(made, *rest, **more)
        seen.append(len({r[0] for r in made.select(self._bucket()).distinct().collect()}))

    monkeypatch.setattr(SearchIndex, "_write", watched)
    assert index.compact() == [0, 1, 2, 3] and seen == [1, 1, 1, 1]
    assert len(found()) == len(expected) and set(found()) == expected and index.compact() == []
    assert len([f for f in path.glob("postings/segment=*/bucket=*")]) == 4
