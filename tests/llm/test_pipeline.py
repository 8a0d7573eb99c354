"""The corpus pipeline's stages, and the whole of it on the smallest tables."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from jurispark.llm import langid, pieces, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(12)
    words = [f"word{k}" for k in range(400)]
    long = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    data = [(k, t, "en", "a" if k % 2 else None, len(t)) for k, t in enumerate(long)]
    data += [(20, long[0] + " more", "en", "a", 1), (21, long[0], None, "b", 1), (None, long[0], "en", "a", 1), (None, long[1][::-1], "en", "a", 1), (None, long[1][::-1], "en", "a", 1)]
    data += [(3, long[3], "en", "a", 5), (4, "another text under the same id " + long[2][::-1], "en", "a", 5), (30, None, "en", "a", 0), (31, "", "en", "a", 0), (32, "12 34 !!", "en", "b", 8)]
    return spark.createDataFrame(data, SCHEMA)


def test_language_stage(spark, docs):
    out = rows(corpus_pipeline.language_id(spark, docs, SF))
    assert {r["doc_id"] for r in out} == {*range(12), 20, 21, None} and all(r["lang"] == "en" for r in out)
    unlabelled = docs.withColumn("lang", langid.F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, unlabelled, SF).count() == docs.count()
    assert rows(corpus_pipeline.language_id(spark, docs.where("doc_id < 0"), SF)) == []


def test_language_stage_reads_each_text_once(spark, docs):
    """A second evaluation would keep a second worker a task, which lies idle through the stages to come."""
    plan = corpus_pipeline.language_id(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_near_dedup_stage(spark, docs):
    out = rows(corpus_pipeline.near_dedup(spark, docs, SF))
    source = rows(docs)
    kept = Counter((r["doc_id"], r["text"]) for r in out)
    assert max(kept.values()) <= 2 and kept[3, source[3]["text"]] == 1  # rows that repeat are one, unless they have no id
    texts = [r["text"] for r in source]
    prints = dict(zip(texts, map(int, simhash.fingerprints(texts))))
    for r in source:  # what goes is near something that stays, and what has an id stays where it is the smallest
        near = [k for k, t in kept if ((prints[r["text"]] ^ prints[t]) & (2**64 - 1)).bit_count() <= 3]
        assert near
        if (r["doc_id"], r["text"]) not in kept:
            assert any(k is not None and (r["doc_id"] is None or k <= r["doc_id"]) for k in near)
    assert {k for k, _ in kept if k is not None} == {*range(12), 30, 32} and sum(k == 4 for k, _ in kept) == 2
    assert rows(corpus_pipeline.near_dedup(spark, docs.where("doc_id < 0"), SF)) == []


def test_mixing_stage(spark, docs):
    out = rows(corpus_pipeline.source_mixing(spark, docs, SF))
    read, given = Counter((r["doc_id"], r["source"], r["text"]) for r in out), Counter((r["doc_id"], r["source"], r["text"]) for r in rows(docs))
    assert set(read) == set(given) and all(given[k] <= read[k] <= 2 * given[k] for k in given)
    assert rows(corpus_pipeline.source_mixing(spark, docs.where("doc_id < 0"), SF)) == []


def test_substring_and_encoding_stages_on_odd_rows(spark, docs):
    odd = docs.where("doc_id >= 30 OR doc_id IS NULL")
    kept = Counter((r["doc_id"], r["text"]) for r in rows(corpus_pipeline.substring_dedup(spark, odd, SF)))
    assert kept[30, None] + kept[30, ""] == 1 and kept[31, ""] == 1 and kept[32, "12 34 !!"] == 1
    found = rows(corpus_pipeline.sentencepiece(spark, docs, SF))
    assert len(found) == docs.count() and all(r["round_trip"] in (True, None) for r in found)
    assert rows(corpus_pipeline.sentencepiece(spark, docs.where("doc_id < 0"), SF)) == []


def test_the_whole_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "source_mixing", "sentencepiece"]
    source = {r["doc_id"]: r for r in rows(spark.read.parquet(f"{SF}/documents.parquet"))}
    out = rows(corpus_pipeline.run(spark, SF))
    p = pieces.Pieces(pieces.model_bytes())
    assert out and all(r["round_trip"] for r in out) and {r["doc_id"] for r in out} <= set(source)
    prints = {k: int(f) & (2**64 - 1) for k, f in zip(source, simhash.fingerprints([r["text"] for r in source.values()]))}
    left = sorted({r["doc_id"] for r in out})
    for i, a in enumerate(left):  # no two of what is left were near-copies
        assert all((prints[a] ^ prints[b]).bit_count() > 3 for b in left[:i])
    copies = Counter(r["doc_id"] for r in out)
    assert set(copies.values()) <= {1, 2}
    windows = Counter()
    for r in {r["doc_id"]: r for r in out}.values():
        w = p.decode(r["ids"]).split()
        text = source[r["doc_id"]]["text"].split()
        assert len(w) <= len(text)
        windows.update({tuple(w[i : i + 35]) for i in range(len(w) - 34)})
    before = Counter()
    for k in left:
        w = source[k]["text"].split()
        before.update({tuple(w[i : i + 35]) for i in range(len(w) - 34)})
    twice = {w for w, n in before.items() if n > 1}
    assert all(windows[w] >= 1 for w in twice) and sum(windows[w] for w in twice) <= 1.1 * len(twice) + 1
