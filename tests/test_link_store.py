import glob
import os

import pytest
from pyspark.sql import functions as F

from jurispark.operators import merge as M
from jurispark.operators.link_store import LinkStore


@pytest.fixture(scope="module")
def law(spark):
    acts = spark.createDataFrame([(1, 46, 1980), (2, 19, 1940)], "act_id long, act_number int, year int")
    provisions = spark.createDataFrame([(10, 1, "article", 57, None, 1), (20, 2, "article", 211, None, 1)], "provision_id long, act_id long, kind string, article_number int, article_letter string, ordering int")
    return acts, provisions


def docs_of(spark, rows):
    df = spark.createDataFrame(list(rows.items()), "document_id long, text string")
    return df.withColumns({"text_hash": M.text_hash(F.col("text")), "n_chars": F.length("text")})


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/bucket=*/*.parquet", recursive=True)}


def links(store):
    return {(r["document_id"], r["provision_id"]) for r in store.provision_links().collect()}, {(r["document_id"], r["act_id"]) for r in store.act_links().collect()}


ARTICLE, ACT = "sbr. 57. gr. laga nr. 46/1980", "sbr. hegningarlaga nr. 19/1940"


def test_a_run_writes_the_buckets_of_what_changed(spark, law, tmp_path):
    path = str(tmp_path / "links")
    store = LinkStore(spark, f"file://{path}", span=10)
    rows = {k: f"Texti {k} {ARTICLE} og {ACT}." for k in range(1000)} | {7: None}
    done = store.run(docs_of(spark, rows), *law)
    assert (done.indexed, done.errors, done.gone, len(done.buckets)) == (999, 1, 0, 100)
    assert links(store) == ({(k, 10) for k in rows if k != 7}, {(k, 2) for k in rows if k != 7})
    before = files(path)
    again = store.run(docs_of(spark, rows), *law)
    assert (again.indexed, again.errors, again.buckets, again.mentions) == (0, 1, [], None) and files(path) == before
    for k in range(500, 510):  # one in a hundred, in one bucket
        rows[k] = f"Nýr texti {k} {ACT}"
    done = store.run(docs_of(spark, rows), *law)
    assert (done.indexed, done.buckets) == (10, [50])
    after = files(path)
    assert {f for f, t in after.items() if before.get(f) != t} == {f for f in after if "/bucket=50/" in f} and set(before) - set(after) == {f for f in before if "/bucket=50/" in f}
    assert links(store) == ({(k, 10) for k in rows if k != 7 and not 500 <= k < 510}, {(k, 2) for k in rows if k != 7})
    assert {r["provision_id"]: (r["judgments"], r["passages"]) for r in store.provision_counts().collect()} == {10: (989, 989)}
    assert {r["act_id"]: r["judgments"] for r in store.act_counts().collect()} == {1: 989, 2: 999}
    for k in range(20, 30):
        del rows[k]
    done = store.run(docs_of(spark, rows), *law)
    assert (done.gone, done.buckets) == (10, [2]) and not [k for k, _ in links(store)[0] | links(store)[1] if 20 <= k < 30]
    assert {r["act_id"]: r["judgments"] for r in store.act_counts().collect()} == {1: 979, 2: 989}


def test_no_text_is_shuffled(spark, law, tmp_path):
    store = LinkStore(spark, f"file://{tmp_path}/links", span=10)
    docs_of(spark, {k: f"Texti {k}" for k in range(50)}).write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    due, _ = store.due(docs)
    texts = store.texts(docs, due)
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Exchange range" not in plan
    slim = docs.select("document_id", "text_hash").join(store.marks(), "document_id", "full_outer")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<document_id:bigint,text_hash:string>" in slim


def test_a_run_that_broke_off_is_done_again(spark, law, tmp_path, monkeypatch):
    store = LinkStore(spark, f"file://{tmp_path}/links", span=10)
    rows = {k: f"{ARTICLE} {k}" for k in range(30)}
    store.run(docs_of(spark, rows), *law)
    rows[3], rows[25] = f"{ACT} 3", f"{ACT} 25"
    write = LinkStore._write

    def breaking(self, name, *rest):
        if name == "act_links":
            raise RuntimeError("lost")
        write(self, name, *rest)

    monkeypatch.setattr(LinkStore, "_write", breaking)
    with pytest.raises(RuntimeError):
        store.run(docs_of(spark, rows), *law)
    monkeypatch.setattr(LinkStore, "_write", write)
    done = store.run(docs_of(spark, rows), *law)
    assert done.indexed == 2 and links(store) == ({(k, 10) for k in rows if k not in (3, 25)}, {(3, 2), (25, 2)})
    assert {r["provision_id"]: r["judgments"] for r in store.provision_counts().collect()} == {10: 28}


def test_budget_repeats_and_nothing(spark, law, tmp_path):
    store = LinkStore(spark, f"file://{tmp_path}/links", span=10)
    rows = {k: f"{ARTICLE} {ARTICLE} {k}" for k in range(12)}
    assert [store.run(docs_of(spark, rows), *law, most=5).indexed for _ in range(4)] == [5, 5, 2, 0]
    assert {r["provision_id"]: (r["judgments"], r["passages"]) for r in store.provision_counts().collect()} == {10: (12, 24)}
    done = store.run(docs_of(spark, rows).limit(0), *law)
    assert done.gone == 12 and links(store) == (set(), set()) and store.act_counts().count() == store.provision_counts().count() == store.marks().count() == 0
    with pytest.raises(ValueError):
        store.run(docs_of(spark, rows), law[0].limit(0), law[1])
    assert LinkStore(spark, f"file://{tmp_path}/none").provision_links().count() == 0
