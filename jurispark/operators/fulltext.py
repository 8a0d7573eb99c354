"""Full-text search over weighted postings: boolean and phrase matching, and rank.

Terms are lower-cased runs of letters and digits; nothing is stemmed or dropped. Postings are one row a document, field and term with the
positions; `search_index` stores them in the order of terms, so that a query reads the pages of its terms only, and keeps them up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jurispark.functions.query import Node

# What a term in a field of class A, B, C or D weighs.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
ROWS = 100_000
SEPARATOR = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """The terms of a text in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), lambda t: t != "")


def postings(docs: DataFrame, fields: dict[str, str], doc_id: str = "document_id") -> DataFrame:
    """(document_id, term, weight, positions) for columns and their classes, one row a document, field and term. Positions of a later field follow the earlier ones', with
    one left out between, so that no phrase runs from field to field. A document's occurrences lie in its row and are gathered there, a batch of documents at once;
    documents have an id of their own each."""
    rows = docs.select(F.col(doc_id).alias("document_id"), *(terms(F.col(c)).alias(f"terms{k}") for k, c in enumerate(fields)))
    kind = next(f.dataType.simpleString() for f in rows.schema.fields if f.name == "document_id")
    return rows.mapInArrow(_gathered(list(fields.values())), f"document_id {kind}, term string, weight string, positions array<int>")


def _gathered(weights: list[str]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            begin = np.zeros(part.num_rows, np.int64)
            for k, weight in enumerate(weights):
                lists = part.column(k + 1)
                offsets, coded = lists.offsets.to_numpy().astype(np.int64), lists.values.dictionary_encode()
                sizes = np.diff(offsets)
                row = np.repeat(np.arange(part.num_rows), sizes)
                coded = coded.slice(offsets[0], offsets[-1] - offsets[0])
                place = np.arange(len(row)) + offsets[0] - offsets[:-1][row] + begin[row]
                key = row * len(coded.dictionary) + coded.indices.to_numpy()
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(order) else order
                found, ends = order[first], np.append(first, len(order)).astype(np.int32)
                for i in range(0, len(found), ROWS):
                    own = found[i : i + ROWS]
                    at = ends[i : i + len(own) + 1]
                    positions = pa.ListArray.from_arrays(pa.array(at - at[0]), pa.array(place[order[at[0] : at[-1]]].astype(np.int32)))
                    term = coded.dictionary.take(coded.indices.take(pa.array(own)))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[own])), term, pa.array([weight] * len(own)), positions], names=["document_id", "term", "weight", "positions"])
                begin += sizes + 1

    return run


def matching(index: DataFrame, query: Node, documents: DataFrame | None = None) -> DataFrame:
    """Distinct document_id of the documents that match; a query of negations alone needs the documents to choose from."""
    if query.kind == "term":
        return index.where(F.col("term") == query.term).select("document_id").distinct()
    if query.kind == "phrase":
        return _phrase(index, query.terms)
    if query.kind == "or":
        return reduce(DataFrame.union, [matching(index, n, documents) for n in query.nodes]).distinct()
    if query.kind == "not":
        if documents is None:
            raise ValueError("a query of negations alone needs the documents")
        return documents.select("document_id").join(matching(index, query.nodes[0], documents), "document_id", "left_anti")
    wanted, barred = [n for n in query.nodes if n.kind != "not"], [n.nodes[0] for n in query.nodes if n.kind == "not"]
    plain = [n.term for n in wanted if n.kind == "term"]
    found = _all_terms(index, plain) if plain else None
    for n in (n for n in wanted if n.kind != "term"):
        more = matching(index, n, documents)
        found = more if found is None else found.join(more, "document_id", "left_semi")
    if found is None:
        if documents is None:
            raise ValueError("a query of negations alone needs the documents")
        found = documents.select("document_id").distinct()
    for n in barred:
        found = found.join(matching(index, n, documents), "document_id", "left_anti")
    return found


def _all_terms(index: DataFrame, wanted: list[str]) -> DataFrame:
    wanted = list(dict.fromkeys(wanted))
    found = index.where(F.col("term").isin(wanted)).groupBy("document_id").agg(F.count_distinct("term").alias("n"))
    return found.where(F.col("n") == len(wanted)).select("document_id")


def _phrase(index: DataFrame, words: list[str]) -> DataFrame:
    """Documents with the words side by side: the places where a phrase would begin, as each word sees them, agree."""
    shifts = reduce(lambda c, k: c.when(F.col("term") == words[k], k), range(1, len(words)), F.when(F.col("term") == words[0], 0))
    if len(set(words)) < len(words):
        shifts = None
    rows = index.where(F.col("term").isin(list(dict.fromkeys(words))))
    if shifts is not None:
        begins = rows.select("document_id", F.explode(F.transform("positions", lambda p: p - shifts)).alias("begin"))
    else:
        at = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(k).alias("k")) for k, w in enumerate(words)))
        own = F.filter(at, lambda x: x["w"] == F.col("term"))
        begins = rows.select("document_id", F.explode(F.flatten(F.transform("positions", lambda p: F.transform(own, lambda x: p - x["k"])))).alias("begin"))
    return begins.groupBy("document_id", "begin").agg(F.count("*").alias("n")).where(F.col("n") == len(words)).select("document_id").distinct()


def rank(index: DataFrame, words: list[str]) -> DataFrame:
    """(document_id, rank): for each query term its occurrences, the heaviest first, weigh w / k^2; summed, over the number of terms."""
    words = list(dict.fromkeys(words))
    rows = index.where(F.col("term").isin(words))
    weight = F.create_map(*(F.lit(x) for k, w in WEIGHTS.items() for x in (k, w)))
    each = F.array_repeat(F.element_at(weight, F.col("weight")), F.size("positions"))
    per_term = rows.groupBy("document_id", "term").agg(F.sort_array(F.flatten(F.collect_list(each)), asc=False).alias("w"))
    score = F.aggregate(F.transform("w", lambda x, k: x / ((k + 1) * (k + 1))), F.lit(0.0), lambda a, b: a + b)
    return per_term.groupBy("document_id").agg((F.sum(score) / len(words)).alias("rank"))


def search(index: DataFrame, documents: DataFrame, query: Node | None) -> DataFrame:
    """documents that match with their rank; all of them with rank 0 for an empty query."""
    if query is None:
        return documents.withColumn("rank", F.lit(0.0))
    found = documents.join(matching(index, query, documents), "document_id", "left_semi")
    words = query.positive_terms()
    if not words:
        return found.withColumn("rank", F.lit(0.0))
    return found.join(rank(index, words), "document_id", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
