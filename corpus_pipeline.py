"""The corpus pipeline: stages that each take the documents kept so far and return documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurispark.llm import langid, mixing, pieces, repeats, simhash
from jurispark.llm.shared import remove, remove_at_end, shared_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


LEAST_CONFIDENCE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose likeliest language is less than half likely, go; a null lang gets the prediction.

    Null and empty texts have no letters. Copies are judged alike, and rows that repeat stay as often as they are. A model is learned from the
    documents' own labels; without any all documents stay. An empty table stays empty.
    """
    model = langid.train(docs.where(~langid.held_out()))
    if model is None:
        return docs.select(*COLUMNS)
    found = langid.detect(docs.select(*COLUMNS), model)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_CONFIDENCE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays: that with the smallest doc_id, once if its row repeats.

    Rows of one id with different texts are told apart: each stays unless it is a near-copy of another that does. Of rows with equal ids
    and fingerprints the one with the least text hash stays. Rows without a doc_id stay unless they are near-copies of a document that
    has one; null and empty texts are near-copies of each other. An empty table stays empty.
    """
    docs = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    groups = simhash.near_duplicates(docs, carry=("text_hash",))
    kept = groups.where("doc_id = component_id").groupBy("doc_id", "fingerprint").agg(F.min("text_hash").alias("text_hash"))
    named = docs.join(kept.select("doc_id", "text_hash").distinct(), ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    nameless = docs.join(groups.where("doc_id IS NULL AND component_id IS NULL").select("text_hash").distinct(), "text_hash", "left_semi").where("doc_id IS NULL")
    return named.unionByName(nameless).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that occur twice stay at one place and are cut out of the others; a document of which nothing is left goes.

    Documents without words stay; rows that repeat are occurrences of their own; an empty table stays empty.
    """
    out = repeats.remove_repeats(docs, keep_space=True, keep_one=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    left = out.where("n_words = 0 OR n_removed < n_words").withColumn("text", text)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document once at least, those of smaller sources up to twice.

    A null source is a source of its own; documents without words are read once. Rows of one source and id are read equally often. An empty table stays empty.
    """
    _, mix = mixing.plan(docs)
    return mixing.realise(docs.select(*COLUMNS), mix)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as ids, and whether decoding gives the text back. A null text has null ids, an empty one none; an empty table stays empty."""
    return pieces.encode_documents(docs).select("doc_id", "lang", "source", "n_chars", "ids", "n_ids", "round_trip")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each result written to the shared folder and read back; one that the next stage has read is removed, the last one when the application ends."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, name)
        remove_at_end(spark, path)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
