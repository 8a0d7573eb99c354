"""A Merkle manifest of a dataset: a tree of digests over each source's rows and one over the sources, with a proof for every row.

The node store is a folder of Parquet tables, one a level. Leaves are sorted runs written once; a level's nodes are read in the order they
are stored in, every FANOUT consecutive ones of a tree become one of the next level, and what a task's boundary cuts in two is put together
by coordinate. No level is held in memory, and only digests and coordinates move. Proofs come from the top down: each level's nodes are
merged, by coordinate, with the paths of the level above.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jurispark.llm.shared import cut, remove_at_end, shared_path, shuffle_partitions, small

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """The lowercase hex sha256 of strings laid end to end."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value; no two rows of such fields have equal strings."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


@dataclass(frozen=True)
class Forest:
    """Trees of one store. Level 0 has (tree, i, n, digest, ...), the others (tree, i, n, digest, children): n nodes a level and tree, counted by i from 0."""

    path: str
    levels: int

    def level(self, spark: SparkSession, k: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/level={k}")

    def roots(self, spark: SparkSession) -> DataFrame:
        """(tree, digest), a row a tree."""
        found = self.level(spark, 0).where("n = 1").select("tree", "digest")
        for k in range(1, self.levels):
            found = found.union(self.level(spark, k).where("n = 1").select("tree", "digest"))
        return found


def _positions(leaves: DataFrame, order: list[Column]) -> DataFrame:
    """leaves (tree, digest, ...) with their place i in their tree and its size n, from sorted runs: a run's rows are numbered as they are
    written, and what earlier runs hold of a tree is added. A tree may reach over many runs, and a run may hold many trees."""
    spark = leaves.sparkSession
    runs = leaves.repartitionByRange(shuffle_partitions(spark), F.col("tree"), *order).sortWithinPartitions(F.col("tree"), *order)
    runs = cut(runs.withColumns({"run": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}))
    held = cut(runs.groupBy("tree", "run").agg(F.min("seq").alias("first"), F.count("*").alias("held")))
    before = held.selectExpr("tree", "run", "first - coalesce(sum(held) OVER (PARTITION BY tree ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift", "sum(held) OVER (PARTITION BY tree) AS n")
    found = runs.join(small(before, 96), ["tree", "run"])
    return found.select("tree", (F.col("seq") - F.col("shift")).alias("i"), "n", *(c for c in leaves.columns if c != "tree"))


RUNS = pa.schema([("tree", pa.string()), ("i", pa.int64()), ("n", pa.int64()), ("members", pa.list_(pa.struct([("place", pa.int32()), ("digest", pa.string())]))), ("whole", pa.bool_())])


def _consecutive(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes read in order as members of their parents; a parent is whole if all its members came one after another here."""
    key, held, out = None, [], []

    def close() -> None:
        if held:
            tree, i, n = key
            out.append({"tree": tree, "i": i, "n": -(-n // FANOUT), "members": held, "whole": len(held) == min(FANOUT, n - FANOUT * i)})

    for part in parts:
        for tree, i, n, node in zip(*(part[c].to_pylist() for c in ("tree", "i", "n", "digest"))):
            if key != (tree, i // FANOUT, n):
                close()
                key, held = (tree, i // FANOUT, n), []
            held.append({"place": i % FANOUT, "digest": node})
        if len(out) > 2000:
            yield pa.RecordBatch.from_pylist(out, schema=RUNS)
            out = []
    close()
    yield pa.RecordBatch.from_pylist(out, schema=RUNS)


def _parents(nodes: DataFrame) -> DataFrame:
    """The next level of nodes whose tree has several."""
    runs = cut(nodes.where("n > 1").select("tree", "i", "n", "digest").mapInArrow(_consecutive, "tree string, i long, n long, members array<struct<place int, digest string>>, whole boolean"))
    parted = runs.where("NOT whole").groupBy("tree", "i", "n").agg(F.flatten(F.collect_list("members")).alias("members"))
    children = F.transform(F.array_sort("members"), lambda m: m["digest"])
    found = runs.where("whole").drop("whole").unionByName(parted).select("tree", "i", "n", children.alias("children"))
    return found.select("tree", "i", "n", digest(F.array_join("children", "")).alias("digest"), "children")


def grow(leaves: DataFrame, order: list[Column], name: str = "merkle") -> Forest:
    """The store of the trees over leaves (tree, digest, ...), which keep their other columns; a tree's leaves stand in the order given, which has to be total but for equal leaves."""
    spark = leaves.sparkSession
    path, k = shared_path(spark, name), 0
    remove_at_end(spark, path)
    _positions(leaves, order).write.parquet(f"{path}/level=0")
    left = spark.read.parquet(f"{path}/level=0").agg(F.max("n")).first()[0] or 0
    while left > 1:
        _parents(spark.read.parquet(f"{path}/level={k}")).write.parquet(f"{path}/level={k + 1}")
        left, k = -(-left // FANOUT), k + 1
    return Forest(path, k + 1)


def paths(forest: Forest, roots: DataFrame) -> DataFrame:
    """Level 0 with `path`, the (before, behind) digests of the other members of each run on the way up, and what `roots` (tree, path, ...) has for the tree, whose path goes on."""
    spark = roots.sparkSession
    carried = [c for c in roots.columns if c not in ("tree", "path")]
    above = None
    for k in reversed(range(forest.levels)):
        rows = forest.level(spark, k)
        found = rows.where("n = 1").join(small(roots, 4096), "tree")
        if above is not None:
            own = rows.where("n > 1").withColumns({"up": F.expr(f"i div {FANOUT}"), "place": (F.col("i") % FANOUT).cast("int")}).join(above, ["tree", "up"])
            beside = F.struct(F.array_join(F.slice("siblings", F.lit(1), F.col("place")), "").alias("before"), F.array_join(F.slice("siblings", F.col("place") + 2, F.lit(FANOUT)), "").alias("behind"))
            own = own.withColumn("path", F.concat(F.array(beside), "path"))
            found = found.unionByName(own.select(*found.columns))
        if not k:
            return found
        above = cut(found.select("tree", F.col("i").alias("up"), F.col("children").alias("siblings"), "path", *carried))


@dataclass(frozen=True)
class Manifest:
    """The trees of all sources, the tree over them, and its root; `root` is null for an empty table."""

    sources: Forest
    top: Forest
    root: str | None


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, source: str = "source", doc_id: str = "doc_id", carry: dict[str, Column] | None = None) -> Manifest:
    """Writes the store of docs: a leaf a row over the encoded fields, each source's leaves by doc_id, sources by their UTF-8 bytes, null first.

    `carry` are columns to keep beside the leaves, as `<name>`. A null field counts as null, an empty text as empty; texts of any length are hashed where they
    are read and never move. Rows of one doc_id, and rows without any (first), stand in the order of their leaves, so equal rows are leaves of their own and give one
    result whatever their order. Other columns are not read. An empty table has no nodes and no root.
    """
    leaves = docs.select(encoded(F.col(source)).alias("tree"), digest(*(encoded(F.col(c)) for c in fields)).alias("digest"), F.col(doc_id).alias("__id"), *(c.alias(k) for k, c in (carry or {}).items()))
    sources = grow(cut(leaves), [F.asc_nulls_first("__id"), F.col("digest")])
    spark = docs.sparkSession
    value = F.when(F.col("tree") != "-", F.expr("substring(tree, locate(':', tree) + 1)"))
    heads = sources.roots(spark).select(F.lit("").alias("tree"), "digest", F.col("tree").alias("source_tree"), value.alias("source"))
    top = grow(cut(heads), [F.asc_nulls_first("source")])
    found = top.roots(spark).first()
    return Manifest(sources, top, found and found["digest"])


def proofs(spark: SparkSession, made: Manifest) -> DataFrame:
    """(leaf, subroot, root, path, ...) of every row, with the columns carried and `__id`."""
    start = spark.createDataFrame([("", [])], "tree string, path array<struct<before string, behind string>>")
    tops = paths(made.top, start).select(F.col("source_tree").alias("tree"), F.col("digest").alias("subroot"), "path")
    return paths(made.sources, cut(tops)).withColumnRenamed("digest", "leaf").withColumn("root", F.lit(made.root)).drop("tree", "i", "n")


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf leads to along a path."""
    return F.aggregate(path, leaf, lambda found, step: digest(step["before"], found, step["behind"]))


def proof_digest(path: str = "path") -> Column:
    """One digest over all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["behind"])), ""))
