"""One text of 300 000 words, whose time has to grow with it and not with its square, through each operator and stage on texts."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from jurispark.llm import collocations, langid, merkle, mixing, ordinal, pieces, repeats, rules, simhash, toxicity

WORDS = 300_000
MODELS = {}


@pytest.fixture(scope="module")
def long_docs(spark):
    passage = " ".join(f"Passage{i}" for i in range(80))
    text = " ".join(f"word{i % 977} b4dword{i % 13}" for i in range(WORDS // 2 - 80)) + f" {passage} {passage}"
    rows = [(1, text, "en", "a", len(text)), (2, "one short text that is clean and nice to read", "en", "a", 45), (3, None, "en", "b", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"score": F.lit("x"), "n_words": F.lit("y")}).repartition(2)


def _toxicity(docs):
    entries = {f" badword{i} ": 4.0 for i in range(13)} | {" word1": 3.0}
    return toxicity.toxicity(docs, toxicity.Lexicon(entries, frozenset(f"badword1 word{i}" for i in range(977))))


def _language(docs):
    rows = [(k, f"{w} {w}s and {w}" if k % 2 else f"der {w} und die {w}en", "en" if k % 2 else "de") for k, w in enumerate("house tree water night stone bread".split() * 20)]
    return langid.detect(docs, langid.train(docs.sparkSession.createDataFrame(rows, "doc_id long, text string, lang string")))


def _grades(docs):
    rows = docs.sparkSession.createDataFrame([(k, f"good text number {k}" if k % 3 else f"bad junk {k}") for k in range(60)], "doc_id long, text string")
    grades = rows.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("grade"))
    return ordinal.graded(docs, ordinal.train(rows, grades))


OPERATORS = {
    "substring": repeats.remove_repeats, "pieces": pieces.encode_documents, "rules": rules.quality_rules, "simhash": simhash.near_duplicates, "toxicity": _toxicity, "grades": _grades, "language": _language,
    "mixing": lambda docs: mixing.plan(docs)[0], "collocations": collocations.collocations, "merkle": lambda docs: merkle.proofs(docs.sparkSession, merkle.manifest(docs)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(long_docs, name):
    began = time.perf_counter()
    assert OPERATORS[name](long_docs).count() >= 1
    assert time.perf_counter() - began < 90


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES if n != "sentencepiece"])
def test_stage(spark, long_docs, name):
    began = time.perf_counter()
    out = dict(corpus_pipeline.STAGES)[name](spark, long_docs.withColumn("component_id", F.lit("z")), "")
    assert out.columns == list(corpus_pipeline.COLUMNS)
    assert 1 <= out.select(F.count_distinct("doc_id")).first()[0] <= 3
    assert time.perf_counter() - began < 90


def test_toxicity_is_learned_from_a_long_text(spark, long_docs):
    bad = "you are a nasty vilewretch and a"
    rows = [(k, f"{bad} w{k} vilewretch x{k} at home", 1) for k in range(40)] + [(k, f"a fine day w{k} at home", 0) for k in range(40, 80)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string").union(long_docs.select("doc_id", "text").where("doc_id = 1").withColumn("doc_id", F.lit(99)))
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(99, 1)], "doc_id long, toxic int")
    began = time.perf_counter()
    lexicon = toxicity.learn(docs, labels)
    assert time.perf_counter() - began < 60 and any(e.startswith(" vile") for e in lexicon.weights)
    small = toxicity.learn(docs, labels, most=2)
    assert len(small.weights) <= 2


def test_hits_in_one_pass_are_those_of_all_pairs():
    lexicon = toxicity.Lexicon({" aa ": 2.0, " aa": 1.0, " bb ": 3.0, " cc": 1.5}, frozenset({"aa bb", "bb cc aa", "xx aa"}))
    folded = toxicity.fold("xx aa bb cc aa aab ccd bb aa bb bb cc xx aa")
    spans, words = [], {}
    for end, (w, size, exception) in lexicon.automaton().iter(folded):
        begin = end - size + 1
        if exception:
            spans.append((begin, end))
        elif w > words.get(begin, (0.0, 0))[0]:
            words[begin] = (w, end)
    assert toxicity.hits(folded, lexicon) == [(b, e, w) for b, (w, e) in sorted(words.items()) if not any(x <= b < y for x, y in spans)]
    assert toxicity.neighbours(" a bb c ", 2) == ("a", "bb", "c") and toxicity.neighbours(" a ", 0) == ("", "a", "") and toxicity.neighbours(" ", 0) == ("", "", "")
