"""SimHash near-duplicates: segment-popcount embedding, grid range-join under Manhattan distance, exact verification.

A fingerprint's 32 two-bit segments have 0, 1 or 2 bits set. Written in unary, side by side, these counts are a 64-bit code, and
the bits in which two codes differ are the Manhattan distance of the counts, which never exceeds the fingerprints' Hamming
distance. Fingerprints within 3 bits therefore have codes within distance 3, and codes within distance 3 differ in at most 3 of
7 bands: they share a cell of the grid formed by some 4 bands. Each distinct fingerprint goes to its 35 cells; cell mates are
compared by code, then by fingerprint, and only links leave the join, each once.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jurispark.llm.shared import components, cut, give_back, join_heavy, text_batches

SEED, SHINGLE, DISTANCE, BANDS = 42, 3, 3, 7
LOW_BITS = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit SimHash of each text as int64; zero for a null text or one without words."""
    hashes, sizes = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.encode().lower().split() if text else []
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        n = max(1, len(words) - shingle + 1)
        starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
        parts = map(joined.__getitem__, map(slice, starts, ends[-n:].tolist()))
        hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n))
        sizes[k] = n
    out = np.zeros(len(texts), np.int64)
    i, filled = 0, np.flatnonzero(sizes)
    while i < len(hashes):
        j, held = i, 0
        while j < len(hashes) and (j == i or held + len(hashes[j]) <= 1 << 17):
            held += len(hashes[j])
            j += 1
        n = sizes[filled[i:j]]
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        h = np.concatenate(hashes[i:j])
        bits = np.empty((j - i, 64), bool)
        for b in range(64):
            bits[:, b] = 2 * np.add.reduceat(((h >> np.uint64(b)) & np.uint64(1)).astype(np.int32), at) > n
        out[filled[i:j]] = np.packbits(bits, axis=1, bitorder="little").view(np.int64)[:, 0]
        i = j
    return out


def _fingerprint(text: pd.Series) -> pd.Series:
    give_back()
    parts = [fingerprints(text.iloc[i : i + 256].tolist()) for i in range(0, len(text), 256)]
    return pd.Series(np.concatenate(parts) if parts else np.zeros(0, np.int64))


def fingerprint(text: Column) -> Column:
    """The SimHash of a text column, as a long."""
    return F.pandas_udf(_fingerprint, T.LongType())(text)


def unary_counts(fp: Column) -> Column:
    """The popcounts of the two-bit segments, each written in unary in its segment."""
    high = F.shiftrightunsigned(fp, 1)
    low = F.lit(LOW_BITS)
    return fp.bitwiseOR(high).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(low), 1))


def grid_masks(bands: int = BANDS, distance: int = DISTANCE) -> list[int]:
    """The bits of every choice of bands that codes within the distance can share."""
    cuts = [round(32 * b / bands) * 2 for b in range(bands + 1)]
    band = [((1 << cuts[b + 1]) - 1) ^ ((1 << cuts[b]) - 1) for b in range(bands)]
    return [sum(band[b] for b in chosen) for chosen in combinations(range(bands), bands - distance)]


def links(distinct: DataFrame, fp: str = "fp", bands: int = BANDS, distance: int = DISTANCE) -> DataFrame:
    """(a, b) with a < b for all fingerprints of a column of distinct ones that differ in at most `distance` bits."""
    masks = grid_masks(bands, distance)
    cells = distinct.select(F.col(fp).alias("fp"), unary_counts(F.col(fp)).alias("code"))
    grid = F.array(*(F.struct(F.lit(k).alias("grid"), F.col("code").bitwiseAND(F.lit(_signed(m))).alias("cell")) for k, m in enumerate(masks)))
    cells = cells.select("fp", "code", F.inline(grid))
    a = cells.select("grid", "cell", F.col("fp").alias("a"), F.col("code").alias("code_a"))
    b = cells.select("grid", "cell", F.col("fp").alias("b"), F.col("code").alias("code_b"))
    differ = F.col("code_a").bitwiseXOR(F.col("code_b"))
    earliest = F.lit(len(masks))
    for k, m in reversed(list(enumerate(masks))):
        earliest = F.when(differ.bitwiseAND(F.lit(_signed(m))) == 0, k).otherwise(earliest)
    near = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= distance)
    exact = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    on = (a["grid"] == b["grid"]) & (a["cell"] == b["cell"]) & near & exact & (a["grid"] == earliest)
    # Spark takes the cells for as small as their fingerprints, though they are 35 times as many, and would broadcast them
    return a.hint("merge").join(b.hint("merge"), on).select("a", "b")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bands: int = BANDS, distance: int = DISTANCE, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a row of docs: doc_id, fingerprint (long), component_id (smallest doc_id that links reach, itself included), and the columns of `carry`.

    Null and empty texts have fingerprint zero and link like others. Copies, and rows that repeat, share a fingerprint. Rows
    with a null doc_id link others but name no component unless all of it is null, which gives null. Other columns are ignored.
    """
    text_batches(docs.sparkSession)
    prints = cut(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp"), F.struct(*(carry or (doc_id,))).alias("carried")))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    distinct = cut(distinct)
    reach = components(links(distinct, "fp", bands, distance))
    linked = cut(distinct.join(reach.withColumnRenamed("node", "fp"), "fp").select("fp", "rep", "root"))
    names = linked.groupBy("root").agg(F.min("rep").alias("name"), F.count("*").alias("held"))
    named = join_heavy(linked, names, ["root"], "held", max(1, linked.count()), F.col("fp")).select("fp", "name")
    distinct = distinct.join(named.hint("merge"), "fp", "left").select("fp", "copies", F.coalesce("name", "rep").alias("component_id"))
    total = prints.count()
    out = join_heavy(prints, cut(distinct), ["fp"], "copies", max(1, total), F.col("doc_id"))
    return out.select(F.col("doc_id").alias(doc_id), F.col("fp").alias("fingerprint"), "component_id", *(F.col("carried")[c].alias(c) for c in carry))
