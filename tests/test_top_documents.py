import random

import pytest
from pyspark.sql import functions as F

from jurispark.functions import citations as C
from jurispark.operators import fulltext as X
from jurispark.operators.search_index import SearchIndex
from jurispark.operators.top_documents import TopDocuments


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    draw = random.Random(4)
    rows = []
    for k in range(3000):
        words = ["common"] * draw.choice([1, 1, 1, 2, 5]) + ["often"] * draw.choice([0, 0, 1, 3]) + [f"u{k}"] + (["rare"] if k % 500 == 7 else [])
        draw.shuffle(words)
        rows.append((k, "common title" if k % 211 == 0 else "often" if k % 307 == 0 else None, " ".join(words)))
    docs = spark.createDataFrame(rows, "document_id long, title string, text string")
    path = f"file://{tmp_path_factory.mktemp('top')}"
    index = SearchIndex(spark, f"{path}/index", {"title": "A", "text": "D"}, 4).build(docs).postings()
    return docs, index, TopDocuments(spark, f"{path}/weights", 4).build(index)


def plain(index, words, first, allowed=None):
    rows = X.rank(index, words)
    if allowed is not None:
        rows = rows.join(allowed, "document_id", "left_semi")
    rows = sorted(((r["rank"], r["document_id"]) for r in rows.collect()), reverse=True)
    least = rows[first - 1][0] if len(rows) >= first else 0
    return {(i, round(r, 9)) for r, i in rows if r >= least - 1e-9}


@pytest.mark.parametrize(("words", "first"), [(["common"], 5), (["common"], 40), (["common", "often"], 10), (["rare", "common", "often"], 8), (["rare"], 50), (["u77", "nothing"], 3), (["common", "u9"], 3000), (["nothing"], 5)])
@pytest.mark.parametrize("some", [False, True])
def test_no_document_among_the_first_is_missed(made, words, first, some):
    docs, index, top = made
    allowed = docs.where("document_id % 3 <> 0").select("document_id") if some else None
    found = {(r["document_id"], round(r["rank"], 9)) for r in top.search(words, first, index, allowed).collect()}
    want = plain(index, words, first, allowed)
    assert want <= found and len(found) == len({i for i, _ in found})
    assert found <= {(i, round(r, 9)) for i, r in ((x["document_id"], x["rank"]) for x in X.rank(index, words).collect())}


def test_fewer_rows_are_read_for_a_smaller_page(made):
    _, index, top = made
    read = []
    for first in (5, 14, 600, 3000):
        top.search(["common"], first, index).count()
        read.append(top.read["rows"])
    assert read[0] < 50 and read == sorted(read) and read[-1] == 3000


def test_the_plan_asks_for_bands(made):
    _, index, top = made
    plan = top.weights().where((F.col("term") == "common") & (F.col("band") <= 20))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,common)" in plan and "LessThanOrEqual(band,20)" in plan


def test_citations_are_seen_however_long(spark):
    long = "sbr. laga um " + " ".join("x" * 200 for _ in range(7)) + " nr. 12/2001 og reglugerðar um " + "y" * 2000 + " nr. 77/2002, mál nr. 5/2003"
    row = spark.createDataFrame([(long,)], "t string").select(C.act_citations(F.col("t")).alias("a"), C.cited_cases(F.col("t")).alias("c")).first()
    assert [(a["act_number"], a["year"]) for a in row["a"]] == [(12, 2001)] and row["c"] == ["5/2003"]
