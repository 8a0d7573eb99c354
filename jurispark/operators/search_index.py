"""A stored full-text index that follows its documents.

Postings are written in segments and, within a segment, by the bucket of their document, each bucket in the order of terms: a query reads the
pages of its terms in every bucket, and the postings of a common term are spread over all of them. Refreshing writes a segment with the documents
that are new or changed, and a list of those that are superseded or gone; readers take a document from its newest segment. Compacting writes the live postings of
the buckets that have several segments as one. The list is written last, so a segment of a run that broke off is never read, and folders go only when
what replaces them is listed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jurispark.operators.fulltext import postings
from jurispark.session import remove_folder, shuffles_removed, stored, version_of

BUCKETS = 16
BROADCAST_ROWS = 1_000_000  # of some 24 bytes
PAGE_ROWS = 4096
TASK_CHARS = 16_000_000  # of documents whose postings a task sorts and writes


@dataclass(frozen=True)
class SearchIndex:
    """fields are columns and their classes; documents have a `document_id` of their own each. buckets stays as it was when the index was built."""

    spark: SparkSession
    path: str
    fields: dict[str, str]
    buckets: int = BUCKETS
    kept: dict = field(default_factory=dict, compare=False, repr=False)

    def build(self, docs: DataFrame) -> SearchIndex:
        """The first segment, of all documents."""
        listed = stored(docs.select("document_id", self._hash().alias("hash"), self._chars().alias("chars")))
        self._write(docs, 0, listed, made=True)
        self._list(listed, 0)
        return self

    def refresh(self, docs: DataFrame) -> dict[str, int]:
        """Brings the index up to docs, all of the documents there are; how many were inserted, updated and deleted. Documents with equal fields cost a hash; only the
        buckets of others are written. Without any nothing is."""
        new = docs.select("document_id", self._hash().alias("hash"), self._chars().alias("chars"))
        old = self.documents().select("document_id", F.col("hash").alias("old"))
        diff = stored(new.join(old, "document_id", "full_outer").where(~F.col("hash").eqNullSafe(F.col("old"))))
        outcome = F.when(F.col("old").isNull(), "inserted").when(F.col("hash").isNull(), "deleted").otherwise("updated")
        counts = {r["outcome"]: r["n"] for r in diff.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n")).collect()}
        if counts:
            segment = max(self._segments()) + 1
            self._write(docs, segment, diff, made=True, only=diff.where("hash IS NOT NULL").select("document_id"), n=counts.get("inserted", 0) + counts.get("updated", 0))
            self._list(diff.select("document_id", "hash"), segment)
        return {k: counts.get(k, 0) for k in ("inserted", "updated", "deleted")}

    def compact(self) -> list[int]:
        """Writes buckets of several segments anew, as one, and removes what they had; the buckets. Each is a segment of its own and done before the next one begins, so
        that no more than one stands there, and is shuffled, beside what there was."""
        changes = self._changes()
        several = changes.groupBy("bucket").agg(F.count_distinct("segment").alias("n")).where("n > 1")
        buckets = sorted(r["bucket"] for r in several.select("bucket").collect())  # a row a bucket
        if not buckets:
            return []
        old, mine = self._segments(), F.col("bucket").isin(buckets)
        alive, dead = stored(self.documents().where(mine)), stored(_superseded(changes.where(mine)))
        numbers = {r["bucket"]: r["n"] for r in dead.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # a row a bucket, as is what follows
        held = self._rows(old, None, 0).where(mine).groupBy("bucket").agg(F.sum(6 * F.size("positions")).alias("n"))
        chars = {r["bucket"]: r["n"] for r in held.collect()}
        for segment, bucket in enumerate(buckets, max(old) + 1):
            mine = F.col("bucket") == bucket
            rows = self._rows(old, dead.where(mine).drop("bucket"), numbers.get(bucket, 0)).where(mine).select("document_id", "term", "weight", "positions")
            self._write(rows, segment, chars.get(bucket, 0), bucket)
            self._list(alive.where(mine).select("document_id", "hash"), segment)
            for k in old:
                remove_folder(self.spark, f"{self.path}/changes/segment={k}/bucket={bucket}")
                remove_folder(self.spark, f"{self.path}/postings/segment={k}/bucket={bucket}")
        return buckets

    def documents(self) -> DataFrame:
        """(document_id, hash, bucket) of the documents that are in the index."""
        last = self._changes().groupBy("document_id", "bucket").agg(F.max_by("hash", "segment").alias("hash"), F.max_by("gone", "segment").alias("gone"))
        return last.where("NOT gone").select("document_id", "hash", "bucket")

    def postings(self, bucket: bool = False) -> DataFrame:
        """(document_id, term, weight, positions) of the documents' newest segments."""
        version = version_of(self.spark, f"{self.path}/changes")
        if version not in self.kept:
            segments = self._segments()
            dead = stored(_superseded(self._changes()).drop("bucket")) if len(segments) > 1 else None
            self.kept.clear()
            self.kept[version] = segments, dead, dead is not None and dead.count()
        return self._rows(*self.kept[version]).select("document_id", "term", "weight", "positions", *(["bucket"] if bucket else []))

    def _rows(self, segments: list[int], dead: DataFrame | None, n: int) -> DataFrame:
        """Postings of segments without those of n (segment, document_id)."""
        rows = self.spark.read.parquet(f"{self.path}/postings").where(F.col("segment").isin(segments))
        if dead is not None:
            rows = rows.join(F.broadcast(dead) if n <= BROADCAST_ROWS else dead, ["segment", "document_id"], "left_anti")
        return rows

    def _hash(self) -> Column:
        return F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.fields)), 256)

    def _chars(self) -> Column:
        return sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in self.fields), F.lit(0).cast("long"))

    def _bucket(self) -> Column:
        """As repartition deals rows by document_id, so that a task writes one bucket, also where a bucket has several tasks."""
        return F.pmod(F.hash("document_id"), F.lit(self.buckets))

    def _write(self, rows: DataFrame, segment: int, sizes: DataFrame | int | None = None, bucket: int | None = None, made: bool = False, only: DataFrame | None = None, n: int = 0) -> None:
        """rows in tasks of about TASK_CHARS of their documents' `chars`, as many to each bucket: what a task sorts does not grow with the documents. If they are of one
        bucket, all tasks are that one's. Rows to be made are documents, of which the n in `only`, if given: texts are shuffled, not their postings of some four times the bytes."""
        chars = sizes.agg(F.sum("chars").alias("n")).first()["n"] if isinstance(sizes, DataFrame) else sizes
        chars = chars or 0
        buckets = self.buckets if bucket is None else 1
        tasks = buckets * (-(-chars // (TASK_CHARS * buckets)) or 1)
        # of one bucket's documents, the bucket's number is the remainder of all hashes, so they are dealt out by what is left of these
        key = F.col("document_id") if bucket is None else F.floor(F.hash("document_id") / self.buckets)
        if only is not None and n <= BROADCAST_ROWS:
            rows = rows.join(F.broadcast(only), "document_id", "left_semi")
        rows = rows.repartition(tasks, key)
        if only is not None and n > BROADCAST_ROWS:
            rows = rows.join(only.repartition(tasks, key).hint("shuffle_hash"), "document_id", "left_semi")
        rows = postings(rows, self.fields) if made else rows
        rows = rows.withColumn("bucket", self._bucket()).sortWithinPartitions("bucket", "term", "document_id")
        with shuffles_removed(self.spark):
            rows.write.mode("overwrite").partitionBy("bucket").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.path}/postings/segment={segment}")

    def _list(self, rows: DataFrame, segment: int) -> None:
        rows = rows.select("document_id", "hash", F.col("hash").isNull().alias("gone"), self._bucket().alias("bucket")).repartition(self.buckets, "document_id").sortWithinPartitions("bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/changes/segment={segment}")

    def _changes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/changes")

    def _segments(self) -> list[int]:
        return sorted(r["segment"] for r in self._changes().select("segment").distinct().collect())  # a row a segment


def _superseded(changes: DataFrame) -> DataFrame:
    """(segment, document_id, bucket) of documents that a later segment has, or lists as gone."""
    newest = changes.groupBy("document_id").agg(F.max("segment").alias("newest"), F.count("*").alias("n")).where("n > 1")
    return changes.join(newest, "document_id").where("segment < newest").select("segment", "document_id", "bucket")
