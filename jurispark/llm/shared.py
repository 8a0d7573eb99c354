"""What several operators need: shared folders, skew-proof joins, size-checked broadcasts, connected components."""

from __future__ import annotations

import ctypes
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jurispark.session import shared_path

__all__ = ["components", "cut", "give_back", "join_heavy", "remove", "remove_at_end", "shared_path", "shuffle_partitions", "small", "text_batches"]

BROADCAST_BYTES = 32 << 20
HEAVY_SHARE = 1000
ROWS_PER_TASK = 100_000
TEXT_ROWS = 500
TEXT_BYTES = 4 << 20


def cut(df: DataFrame) -> DataFrame:
    """df computed once and stored as a table in the shared folder, so that later reads survive a lost executor; it goes when the application ends.

    Unlike a checkpoint's, a stored table's size is its files' size. A checkpoint inherits the estimate of its plan, in which each
    join multiplies, and after some rounds of joins the planner would spend its time on numbers of millions of digits.
    """
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    remove_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Removes a table when the application ends."""
    file_system, place = _hadoop(spark, path)
    file_system.deleteOnExit(place)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a table that is read no more."""
    file_system, place = _hadoop(spark, path)
    file_system.delete(place, True)


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_batches(spark: SparkSession) -> None:
    """Arrow batches of TEXT_ROWS rows and TEXT_BYTES bytes, so that a Python worker holds few whole texts at once; a session's own settings stay."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(TEXT_ROWS))
    if spark.conf.get(size) == "67108864b":
        spark.conf.set(size, str(TEXT_BYTES))


def give_back() -> None:
    """Returns a Python worker's freed memory to the system: workers live on, and what each once needed adds up on an executor.

    Blocks of 4 MB and more are mapped by themselves, so they go back as soon as they are freed, also behind a worker's last batch.
    """
    system = _system()
    pa.default_memory_pool().release_unused()
    if system is not None:
        system.malloc_trim(0)


@lru_cache(maxsize=1)
def _system():
    system = ctypes.CDLL(None)
    if not hasattr(system, "malloc_trim"):
        return None
    system.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD; a set one no longer grows with what was freed
    return system


def join_heavy(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, spread: Column, how: str = "left") -> DataFrame:
    """left joined with right, which has one row a key and in `weight` the number of left rows of that key.

    Keys with a thousandth of the rows or more are at most a thousand, so they are broadcast; the left rows of these and of null
    keys are dealt out by `spread` in the shuffle that joins the others. No key's rows have to meet in one task. The others are
    merged where there are many rows: stored columns of numbers are small in their files, by which Spark would broadcast them.
    """
    values = [c for c in right.columns if c not in (*keys, weight)]
    hot = right.where(F.col(weight) * HEAVY_SHARE >= total)
    hot = hot.select(*keys, F.struct(*values).alias("__hot"))
    # a plain 0 would be folded into the join's condition, and the salt would be no key of the shuffle
    zero = F.least(F.col(weight), F.lit(0)).cast("int")
    cold = right.where(F.col(weight) * HEAVY_SHARE < total).select(*keys, zero.alias("__salt"), F.struct(*values).alias("__cold"))
    cold = cold.hint("merge") if total > ROWS_PER_TASK else cold
    salted = left.join(F.broadcast(hot), keys, "left")
    nulls = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    salted = salted.withColumn("__salt", F.when(F.col("__hot").isNotNull() | nulls, 1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int")).otherwise(0))
    joined = salted.join(cold, [*keys, "__salt"], "left").withColumn("__found", F.coalesce("__hot", "__cold"))
    if how == "inner":
        joined = joined.where(F.col("__found").isNotNull())
    return joined.select(*left.columns, *(F.col(f"__found.{c}").alias(c) for c in values))


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within BROADCAST_BYTES; else df, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge; nodes have equal roots iff a path joins them.

    Each round every node moves to the neighbour that comes first in a pseudo-random order, itself included, and the edges
    between nodes that moved together vanish: the graph shrinks by a constant factor a round, chains too. The rounds' moves are
    then followed from the last to the first. Nodes are longs. Null ends and loops are ignored; without edges the result is empty.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = cut(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    left, rounds = e.count(), []
    while left:
        turn, width = len(rounds), left // ROWS_PER_TASK + 8
        first = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("m"))  # noqa: B023, E731
        move = e.groupBy("u").agg(F.count("*").alias("n"), F.min(first(F.col("v"))).alias("best"))
        move = cut(move.select("u", "n", F.least("best", first(F.col("u"))).getField("m").alias("m")).coalesce(width))
        ends = join_heavy(e, move, ["u"], "n", left, F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("mu"))
        ends = join_heavy(ends, move, ["u"], "n", left, F.col("mu"))
        rounds.append((move, left, width))
        e = cut(ends.select(F.col("mu").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(width))
        left = e.count()
    if not rounds:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = rounds[-1][0].select(F.col("u").alias("node"), F.col("m").alias("root"))
    for move, left, width in reversed(rounds[:-1]):
        held = move.groupBy("m").agg(F.count("*").alias("held"))
        right = cut(held.join(roots.withColumnRenamed("node", "m"), "m").coalesce(width))
        roots = join_heavy(move.select("u", "m"), right, ["m"], "held", left, F.col("u")).select(F.col("u").alias("node"), F.coalesce("root", "m").alias("root"))
    return roots
