"""Links between documents and statutes in tables by ranges of documents, and the counts that follow from them.

A bucket holds the links, the marks and the counts of one range of document ids. A run scans the documents whose mark is not their hash, keeps what it
found once, and writes the buckets of these documents anew; no text is moved. Each judgment lies in one bucket, so a bucket's counts of distinct judgments
add up over buckets, and only those of buckets that were written are counted again. Marks are written last: a run that broke off is done again by the next.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jurispark.operators import ingest, linking
from jurispark.session import stored, version_of

BROADCAST_ROWS = 1_000_000  # of some 16 bytes; more documents than that are met by a shuffle
PROVISION_LINKS = "document_id {id}, provision_id {target}, char_offset int, match_type string, paragraph_number int, point_number int, citation_text string, excerpt string, bucket long"
ACT_LINKS = "document_id {id}, act_id {target}, char_offset int, match_type string, excerpt string, bucket long"


@dataclass(frozen=True)
class Run:
    """What a run did: documents scanned, without a text, gone; the buckets it wrote; what it read of statutes."""

    indexed: int
    errors: int
    gone: int
    buckets: list[int]
    mentions: DataFrame | None

    def aliases(self) -> DataFrame | None:
        """(act_id, aliases) that the scanned documents use for statutes."""
        return None if self.mentions is None else ingest.harvest_aliases(self.mentions.where("act_id IS NOT NULL").select("act_id", "alias"))


@dataclass(frozen=True)
class LinkStore:
    """Tables in one folder. Documents have whole numbers as ids, `span` of them to a bucket; id types of statutes and articles are those of the keys."""

    spark: SparkSession
    path: str
    span: int = 100_000
    id_type: str = "long"
    provision_type: str = "long"
    act_type: str = "long"

    def bucket(self, document_id: str = "document_id") -> Column:
        return F.floor(F.col(document_id) / self.span).cast("long")

    def run(self, documents: DataFrame, acts: DataFrame, provisions: DataFrame, most: int | None = None) -> Run:
        """Brings the links up to documents (document_id, text, text_hash), all of those there are.

        At most `most` documents are scanned, in the order of ids. One without a text cannot be scanned: it counts as an error and keeps what it has, so that the next run tries it
        again; links of documents that are gone go. ValueError without statutes.
        """
        if acts.isEmpty():
            raise ValueError("no statutes yet: load them before citations are linked")
        due, gone = self.due(documents, most)
        scanned = stored(linking.scan(self.texts(documents, due).where("text IS NOT NULL")).join(_small(due), "document_id"))
        done = stored(scanned.select("document_id").union(gone.select("document_id")).withColumn("bucket", self.bucket()))
        touched = sorted(r["bucket"] for r in done.select("bucket").distinct().collect())  # a row a bucket
        counts = done.groupBy().agg(F.count("*").alias("n")).first()["n"], due.count(), gone.count()
        to_provisions, to_acts, mentions = linking.resolve(scanned, acts, provisions)
        if touched:
            self._replace("provision_links", self.provision_links(bucket=True), done, to_provisions, touched)
            self._replace("act_links", self.act_links(bucket=True), done, to_acts, touched)
            self._count(provisions, touched)
            self._replace("marks", self.marks(bucket=True), done, scanned.select("document_id", F.col("text_hash").alias("mark")), touched)
        return Run(counts[0] - counts[2], counts[1] - (counts[0] - counts[2]), counts[2], touched, stored(mentions) if touched else None)

    def due(self, documents: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(document_id, text_hash) of documents that are new or changed, and (document_id) of those that are gone."""
        both = documents.select("document_id", "text_hash").join(self.marks(), "document_id", "full_outer")
        both = stored(both.where(~F.col("text_hash").eqNullSafe(F.col("mark"))))
        due = both.where("text_hash IS NOT NULL").select("document_id", "text_hash")
        return stored(due.orderBy("document_id").limit(most)) if most is not None else due, both.where("text_hash IS NULL").select("document_id")

    def texts(self, documents: DataFrame, due: DataFrame) -> DataFrame:
        """(document_id, text) of the documents that are due; their ids go to the texts, not the texts to them."""
        return documents.select("document_id", "text").join(_small(due.select("document_id")), "document_id", "left_semi")

    def provision_links(self, bucket: bool = False) -> DataFrame:
        return self._read("provision_links", PROVISION_LINKS.format(id=self.id_type, target=self.provision_type), bucket)

    def act_links(self, bucket: bool = False) -> DataFrame:
        return self._read("act_links", ACT_LINKS.format(id=self.id_type, target=self.act_type), bucket)

    def marks(self, bucket: bool = False) -> DataFrame:
        return self._read("marks", f"document_id {self.id_type}, mark string, bucket long", bucket)

    def provision_counts(self) -> DataFrame:
        """(provision_id, judgments, passages), distinct judgments and all passages of every article that is cited."""
        counts = self._read("provision_counts", f"document_id {self.provision_type}, judgments long, passages long, bucket long")
        return counts.groupBy(F.col("document_id").alias("provision_id")).agg(F.sum("judgments").alias("judgments"), F.sum("passages").alias("passages"))

    def act_counts(self) -> DataFrame:
        """(act_id, judgments), distinct judgments that cite a statute or an article of it."""
        counts = self._read("act_counts", f"document_id {self.act_type}, judgments long, bucket long")
        return counts.groupBy(F.col("document_id").alias("act_id")).agg(F.sum("judgments").alias("judgments"))

    def _read(self, name: str, schema: str, bucket: bool = False) -> DataFrame:
        if not version_of(self.spark, f"{self.path}/{name}"):
            rows = self.spark.createDataFrame([], schema)
        else:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where("document_id IS NOT NULL")
        return rows if bucket else rows.drop("bucket")

    def _replace(self, name: str, old: DataFrame, done: DataFrame, fresh: DataFrame, touched: list[int]) -> None:
        """The touched buckets of a table without what documents that are done had, and with what they have now."""
        kept = old.where(F.col("bucket").isin(touched)).join(_small(done.select("document_id")), "document_id", "left_anti")
        fresh = fresh.withColumn("bucket", self.bucket()).select(*(F.col(f.name).cast(f.dataType) for f in old.schema.fields))
        self._write(name, kept.select(*old.columns).unionByName(fresh), touched)

    def _count(self, provisions: DataFrame, touched: list[int]) -> None:
        links, bare = (rows.where(F.col("bucket").isin(touched)) for rows in (self.provision_links(bucket=True), self.act_links(bucket=True)))
        counted = links.groupBy("bucket", F.col("provision_id").alias("document_id")).agg(F.count_distinct(links["document_id"]).alias("judgments"), F.count("*").alias("passages"))
        self._write("provision_counts", counted.select("document_id", "judgments", "passages", "bucket"), touched)
        by_article = links.join(provisions.select("provision_id", "act_id"), "provision_id").select("bucket", "document_id", F.col("act_id").cast(self.act_type).alias("act_id"))
        pairs = by_article.union(bare.select("bucket", "document_id", "act_id"))
        counted = pairs.groupBy("bucket", F.col("act_id").alias("key")).agg(F.count_distinct("document_id").alias("judgments"))
        self._write("act_counts", counted.select(F.col("key").alias("document_id"), "judgments", "bucket"), touched)

    def _write(self, name: str, rows: DataFrame, touched: list[int]) -> None:
        """Overwrites the touched buckets alone; a row without an id stands in each, so that one that is empty now is overwritten too."""
        empty = self.spark.createDataFrame([(b,) for b in touched], "bucket long").select(*(F.col("bucket") if f.name == "bucket" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields))
        whole = stored(rows.unionByName(empty))  # what is read here is about to be overwritten
        whole.repartition("bucket").sortWithinPartitions("bucket", "document_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
