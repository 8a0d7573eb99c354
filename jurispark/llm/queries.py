"""The queries of the operators, by name, and the SQL that checks them where SQL can."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurispark.llm import collocations, langid, merkle, mixing, ordinal, pieces, repeats, rules, simhash, token_files, toxicity, vectors, warc
from jurispark.llm.oracles import ORACLES


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pieces.encode_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_ids", F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.quality_rules(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = langid.held_out(parts=3, part=1)
    lexicon = toxicity.learn(docs.where(~out), _read(spark, sf_dir, "labels").where(~out))
    return toxicity.toxicity(docs, lexicon).select("doc_id", out.alias("held_out"), "score", "predicted")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = langid.held_out(parts=3, part=1)
    model = ordinal.train(docs.where(~out), ordinal.document_grades(_read(spark, sf_dir, "labels").where(~out)))
    return ordinal.graded(docs, model).select("doc_id", out.alias("held_out"), "expected_grade", "tail_probability", F.col("selected").alias("kept"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.held_out()
    model = langid.train(docs.where(~out))
    return langid.detect(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned, mix = mixing.plan(_read(spark, sf_dir, "documents"))
    return mixing.reads(planned, mix).select("doc_id", "source", "n_words", F.round("weight", 9).alias("weight"), "copies", "block", "reads")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(_read(spark, sf_dir, "pages"))
    out = warc.read(spark.read.parquet(path))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents").select("text", "lang"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, and what verification says of rows a fifth of which are altered afterwards."""
    docs = _read(spark, sf_dir, "documents")
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", ascii_uppercase, ascii_lowercase)).otherwise(F.col("text"))
    fields = (*(merkle.encoded(F.col(c)) for c in merkle.FIELDS[:-1]), merkle.encoded(altered))
    made = merkle.manifest(docs, carry={"doc_id": F.col("doc_id"), "altered": merkle.digest(*fields)})
    out = merkle.proofs(spark, made).withColumns({"proof_sha256": merkle.proof_digest(), "folded_root": merkle.folded(F.col("altered"))})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = token_files.write(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, by_word=True)
    out = token_files.read_documents(spark, files)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_sentencepiece, op3_quality_rules, op4_simhash, op5_toxicity, op6_quality_classifier, op7_language_id,
        op8_source_mixing, op9_warc, op10_embedding_near_dedup, op11_collocations, op12_merkle_manifest, op13_token_files,
    )
}