"""Document arrival as a stream: new files are merged into a versioned store, once each.

The store's rows are dealt into buckets by a hash of their keys. A batch rewrites the buckets that it has rows for, as a version of
its own; a bucket's newest complete version below a batch's number is what the batch merges into, so a batch that is run again after a
failure gives the same rows. Versions of a bucket that two newer ones replace are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurispark.operators.merge import first_of, text_hash, upsert

BUCKETS = 64
BUCKET = "__bucket"


def _versions(spark: SparkSession, store: str, below: int | None = None) -> dict[int, list[tuple[int, str]]]:
    """The complete versions of each bucket with their paths, the newest first."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[int, list[tuple[int, str]]] = {}
    for version in fs.listStatus(root) if fs.exists(root) else []:
        path = version.getPath()
        if not path.getName().startswith("v") or not fs.exists(path.suffix("/_SUCCESS")):
            continue
        number = int(path.getName()[1:])
        for part in fs.listStatus(path) if below is None or number < below else []:
            name, _, bucket = part.getPath().getName().partition("=")
            if name == BUCKET:
                found.setdefault(int(bucket), []).append((number, part.getPath().toString()))
    return {b: sorted(v, reverse=True) for b, v in found.items()}


def current(spark: SparkSession, store: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The newest complete version of a store's buckets, of those below a number if given; None if there is none."""
    paths = [v[0][1] for b, v in sorted(_versions(spark, store, before).items()) if buckets is None or b in buckets]
    return spark.read.parquet(*paths) if paths else None


def _remove_replaced(spark: SparkSession, store: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(store).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for versions in _versions(spark, store).values():
        for _, old in versions[2:]:
            fs.delete(path(old), True)
    for version in fs.listStatus(path(store)) if fs.exists(path(store)) else []:
        own = version.getPath()
        if fs.exists(own.suffix("/_SUCCESS")) and not any(p.getPath().getName().startswith(f"{BUCKET}=") for p in fs.listStatus(own)):
            fs.delete(own, True)  # all its buckets have been replaced


def merge_batch(store: str, keys: list[str], order: str, buckets: int = BUCKETS):
    """A foreachBatch function: the latest row of each key is upserted into its bucket."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        new = first_of(batch, keys, [F.desc(order)]).withColumn("text_hash", text_hash(F.col("text"))).persist()
        touched = [r[0] for r in new.select(bucket).distinct().collect()]  # a number a bucket
        old = current(spark, store, number, touched)
        merged = new if old is None else upsert(old, new, keys).drop("outcome")
        if touched:
            merged.withColumn(BUCKET, bucket).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{store}/v{number}")
        new.unpersist()
        _remove_replaced(spark, store)

    return run


def start(spark: SparkSession, landing: str, schema: str, store: str, checkpoint: str, keys: list[str], order: str, buckets: int = BUCKETS):
    """Merges all that has arrived and ends; run again for what comes later."""
    stream = spark.readStream.schema(schema).json(landing)
    return stream.writeStream.foreachBatch(merge_batch(store, keys, order, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
