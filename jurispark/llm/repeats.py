"""Substring dedup: fixed-block anchors probed by rolling windows, then extended to maximal exact repeats.

Any 35 consecutive words hold a whole aligned block of 18 (blocks start at words 0, 18, 36, ... of a row), so a 35-word passage that occurs
twice has a block that some rolling 18-word window elsewhere equals.

1. Every row belongs to a chunk by the hash of its id and text. A chunk sends the distinct hashes of all its rolling 18-word windows, with
   a mark on those of aligned blocks, in one packed row a bucket.
2. A bucket answers each chunk with the hashes that are an indexed block and occur more than once.
3. A chunk extends its hits left and right to all 35-word windows around them and sends the distinct 96-bit hashes of these.
4. A bucket answers two bits for each: whether it occurs more than once, and whether the chunk is the first that holds it. Overlapping
   windows join to maximal repeats; to keep one occurrence, the first chunk spares the window of its smallest id.

A hash crosses the shuffle once a chunk however often it occurs, so a passage in a third of all rows costs a few bytes a chunk,
and pairs are never formed. Chunks grow in number and in size with the root of the text, and there is a bucket for every two of them: a step
makes one packed row at most for every ROW_BYTES of text, whatever the session's shuffle partitions. Above 144 GiB chunks would pass
CHUNK_BYTES; there are more of them then, so that a worker's memory stays bounded, and packed rows grow faster than the text, though there
are never more than hashes in them.

The rows are shuffled once; the three steps that read them reuse that exchange. Chunks and answers depend on the rows alone, so a lost
executor's part is computed again alike. Only rows that repeat MANY times, id and text, are dealt out by their place in the table; they are
told from no others, so that table has to be a stored one.
"""

from __future__ import annotations

from itertools import compress
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jurispark.llm import words as W
from jurispark.llm.shared import give_back, small, text_batches

WINDOW = 35
CHUNK_BYTES, MOST_CHUNKS, MANY = 24 << 20, 1 << 24, 10_000
ROW_BYTES = 1 << 13  # of text for each packed row that a step makes
SLICE_BYTES = 1 << 18  # of text at a time: what a worker keeps of powers, and holds for its bytes, grows with it
KEY_BITS = 38
KEY_MASK = np.uint64((1 << KEY_BITS) - 1)
ONE = np.uint64(1)
RESULTS = {"n_words": "long", "n_removed": "long", "kept_text": "string", "removed_spans": "array<struct<begin:long,end:long>>"}


def _rows(table: pa.Table, text: str):
    """(column part, first row, last row, data, offsets) of about SLICE_BYTES each."""
    for part in W.chunks(table.column(text)):
        data, offsets = W.text_bytes(part)
        for i, j in W.slices(offsets, SLICE_BYTES):
            yield part, i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def _short(data: np.ndarray, offsets: np.ndarray, block: int):
    """Word hashes, each row's first word, and the hashes of all rolling block-word windows with their first words."""
    starts, ends, firsts = W.word_bounds(data, offsets)
    hashes = W.word_hashes(data, starts, ends)
    at = np.flatnonzero(W.whole(firsts, block))
    return hashes, firsts, at, W.rolling(hashes, block, W.ODD["short"])[at] >> ONE


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """The bucket of 63-bit hashes, in the order of the hashes."""
    return ((h >> np.uint64(31)) * np.uint64(n)) >> np.uint64(32)


def _send(chunk: int, bucket: np.ndarray, packed: np.ndarray) -> pa.Table:
    """One row a bucket of a chunk; bucket is sorted, packed has a row of bytes for each of its values."""
    found, starts = np.unique(bucket, return_index=True)
    ends = [*starts[1:].tolist(), len(bucket)]
    blobs = [packed[a:b].tobytes() for a, b in zip(starts.tolist(), ends)]
    return pa.table({"bucket": pa.array(found.astype(np.int32)), "chunk": pa.array([chunk] * len(blobs), pa.int64()), "data": pa.array(blobs, pa.binary())})


def _groups(ordered: np.ndarray) -> np.ndarray:
    """Where the groups of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def _blob(column: pa.ChunkedArray, k: int, dtype) -> np.ndarray:
    return np.frombuffer(column[k].as_buffer(), dtype)


SENT = "bucket int, chunk long, data binary"
ANSWER = "chunk long, step int, bucket int, data binary"
ANSWER_SCHEMA = pa.schema([("chunk", pa.int64()), ("step", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])


def _anchors(buckets: int, block: int, text: str, chunk: str):
    def run(table: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.uint64)]
        for *_, data, offsets in _rows(table, text):
            _, firsts, at, h = _short(data, offsets, block)
            row = np.repeat(firsts[:-1], np.diff(firsts))[at]
            found.append((h << ONE) | ((at - row) % block == 0).astype(np.uint64))
        marked = np.concatenate(found)
        marked.sort()
        h = marked >> ONE
        starts = _groups(h)
        ends = np.concatenate([starts[1:], [len(h)]]).astype(np.int64)
        once = h[starts]
        flags = (marked[ends - 1] & ONE if len(starts) else once) | ((ends - starts > 1).astype(np.uint64) << ONE)
        packed = (((once & KEY_MASK) << np.uint64(2)) | flags).view(np.uint8).reshape(-1, 8)[:, :5]
        return _send(table.column(chunk)[0].as_py(), _bucket(once, buckets), packed)

    return run


def _meet_anchors(table: pa.Table) -> pa.Table:
    chunk, data = table.column("chunk"), table.column("data")
    bucket, parts = table.column("bucket")[0].as_py(), []
    for k in range(table.num_rows):
        raw = _blob(data, k, np.uint8).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        parts.append((wide.view(np.uint64)[:, 0] << np.uint64(24)) | np.uint64(k))
    merged = np.concatenate(parts)
    merged.sort()
    key = merged >> np.uint64(26)
    starts = _groups(key)
    counts = np.diff(np.concatenate([starts, [len(key)]]))
    flags = np.bitwise_or.reduceat((merged >> np.uint64(24)) & np.uint64(3), starts)
    hot = (flags & ONE > 0) & ((counts > 1) | (flags & np.uint64(2) > 0))
    kept = np.repeat(hot, counts)
    who, keys = (merged[kept] & np.uint64((1 << 24) - 1)).astype(np.int64), (np.uint64(bucket) << np.uint64(KEY_BITS)) | key[kept]
    order = np.argsort(who, kind="stable")
    who, keys = who[order], keys[order]
    at = _groups(who)
    ends = [*at[1:].tolist(), len(who)]
    return pa.table([[chunk[k].as_py() for k in who[at].tolist()], [0] * len(at), [bucket] * len(at), [keys[a:b].tobytes() for a, b in zip(at.tolist(), ends)]], schema=ANSWER_SCHEMA)


def _candidates(table: pa.Table, hits: np.ndarray, buckets: int, block: int, window: int, text: str):
    """For each part of the rows: its place, first words, candidate windows' first words and their hashes."""
    for part, i, j, data, offsets in _rows(table, text):
        hashes, firsts, at, h = _short(data, offsets, block)
        key = (_bucket(h, buckets) << np.uint64(KEY_BITS)) | (h & KEY_MASK)
        place = np.minimum(np.searchsorted(hits, key), max(0, len(hits) - 1))
        hot = np.zeros(len(hashes) + 1, np.int32)
        hot[at + 1] = hits[place] == key if len(hits) else False
        np.cumsum(hot, out=hot)
        full = np.flatnonzero(W.whole(firsts, window))
        full = full[hot[full + window - block + 1] > hot[full]]
        longs = W.rolling(hashes, window, W.ODD["long"])[full] if len(full) else np.zeros(0, np.uint64)
        check = (W.rolling(hashes, window, W.ODD["check"])[full] >> np.uint64(32)).astype(np.uint32) if len(full) else np.zeros(0, np.uint32)
        yield part, i, j, data, offsets, firsts, full, longs >> ONE, check


def _sorted_windows(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of all candidate windows, where groups of equal ones begin, and their hashes in that order."""
    h = np.concatenate([np.zeros(0, np.uint64), *(x[-2] for x in found)])
    check = np.concatenate([np.zeros(0, np.uint32), *(x[-1] for x in found)])
    order = np.lexsort((check, h))
    h, check = h[order], check[order]
    starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])])) if len(h) else np.zeros(0, np.int64)
    return order, starts, h, check


def _hits(answers: pa.Table) -> np.ndarray:
    steps, data = answers.column("step").to_pylist(), answers.column("data")
    parts = [_blob(data, k, np.uint64) for k, s in enumerate(steps) if s == 0]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _extend(buckets: int, block: int, window: int, text: str, chunk: str):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _send(0, np.zeros(0, np.uint64), np.zeros((0, 12), np.uint8))
        found = list(_candidates(table, _hits(answers), buckets, block, window, text))
        order, starts, h, check = _sorted_windows(found)
        many = np.diff(np.concatenate([starts, [len(h)]])) > 1
        packed = np.empty((len(starts), 12), np.uint8)
        packed[:, :8] = ((h[starts] << ONE) | many.astype(np.uint64)).view(np.uint8).reshape(-1, 8)
        packed[:, 8:] = check[starts].view(np.uint8).reshape(-1, 4)
        return _send(table.column(chunk)[0].as_py(), _bucket(h[starts], buckets), packed)

    return run


def _meet_windows(table: pa.Table) -> pa.Table:
    data, bucket = table.column("data"), table.column("bucket")[0].as_py()
    raws = [_blob(data, k, np.uint8).reshape(-1, 12) for k in range(table.num_rows)]
    raw = np.concatenate(raws)
    marked = np.ascontiguousarray(raw[:, :8]).view(np.uint64)[:, 0]
    check = np.ascontiguousarray(raw[:, 8:]).view(np.uint32)[:, 0]
    h = marked >> ONE
    chunk = table.column("chunk").combine_chunks()
    order = np.lexsort((np.repeat(chunk.to_numpy(), list(map(len, raws))), check, h))
    h, check = h[order], check[order]
    starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])]))
    counts = np.diff(np.concatenate([starts, [len(h)]]))
    many = np.logical_or.reduceat((marked & ONE)[order] > 0, starts) | (counts > 1)
    repeated = np.empty(len(h), bool)
    repeated[order] = np.repeat(many, counts)
    first = np.zeros(len(h), bool)
    first[order[starts]] = True
    at = np.cumsum([0, *map(len, raws)])
    bits = [np.packbits(repeated[a:b]).tobytes() + np.packbits(first[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
    return pa.table([chunk, [1] * len(bits), [bucket] * len(bits), bits], schema=ANSWER_SCHEMA)


def _places(ids: pa.ChunkedArray, found: list) -> np.ndarray:
    """The place of each candidate window in the order of ids and, in a row, of words."""
    rank = np.empty(len(ids), np.int64)
    rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    parts, seen = [np.zeros(0, np.int64)], 0
    for _, i, j, _, _, firsts, full, *_ in found:
        row = np.searchsorted(firsts, full, side="right") - 1
        parts.append((rank[seen + row] << 32) | (full - firsts[row]))
        seen += j - i
    return np.concatenate(parts)


def _covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n words the windows that begin at starts hold."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change[:-1]) > 0


def _remove(buckets: int, block: int, window: int, text: str, doc_id: str, carry: list[str], keep_space: bool, keep_one: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        found = list(_candidates(table, _hits(answers), buckets, block, window, text)) if table.num_rows else []
        order, starts, h, _ = _sorted_windows(found)
        repeated, owned = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
        # bounds of the hashes' own type: others would have all hashes converted for each bucket
        home = np.searchsorted(_bucket(h[starts], buckets), np.arange(buckets + 1, dtype=np.uint64)).tolist()
        steps, of, data = answers.column("step").to_pylist(), answers.column("bucket").to_pylist(), answers.column("data")
        for k in (k for k, s in enumerate(steps) if s == 1):
            a, b = home[of[k]], home[of[k] + 1]
            many, first = _blob(data, k, np.uint8).reshape(2, -1)
            repeated[a:b] = np.unpackbits(many, count=b - a).astype(bool)
            owned[a:b] = np.unpackbits(first, count=b - a).astype(bool)
        counts = np.diff(np.concatenate([starts, [len(h)]]))
        windows = np.empty(len(h), bool)
        windows[order] = np.repeat(repeated, counts)
        spared = np.zeros(len(h), bool)
        if keep_one and len(h):
            place = _places(table.column(doc_id), found)[order]
            earliest = place == np.repeat(np.minimum.reduceat(place, starts), counts)
            spared[order] = earliest & np.repeat(repeated & owned, counts)
        n_words, n_removed, texts, begins, ends, spans, used = [], [], [], [], [], [0], 0
        for part, i, j, raw, offsets, firsts, full, *_ in found:
            now = slice(used, used + len(full))
            used += len(full)
            gone = _covered(full[windows[now] & ~spared[now]], window, int(firsts[-1]))
            if keep_one:
                gone &= ~_covered(full[spared[now]], window, int(firsts[-1]))
            sums = np.concatenate([[0], np.cumsum(gone)])
            n_words.append(np.diff(firsts))
            n_removed.append(sums[firsts[1:]] - sums[firsts[:-1]])
            for k in range(j - i):
                bytes_ = raw[offsets[k] : offsets[k + 1]].tobytes()
                if not n_removed[-1][k]:
                    texts.append(bytes_ if keep_space else b" ".join(bytes_.split()))
                else:
                    mask = gone[firsts[k] : firsts[k + 1]]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                    begins += edge[::2].tolist()
                    ends += edge[1::2].tolist()
                    if keep_space:
                        at, _, _ = W.word_bounds(raw[offsets[k] : offsets[k + 1]], np.array([0, len(bytes_)]))
                        to = np.append(at, len(bytes_))[np.concatenate([[0], edge, [len(mask)]])].tolist()
                        to[0] = 0 if not mask[0] else to[0]
                        texts.append(b"".join(bytes_[a:b] for a, b in zip(to[::2], to[1::2])))
                    else:
                        texts.append(b" ".join(compress(bytes_.split(), (~mask).tolist())))
                spans.append(len(begins))
        struct = pa.StructArray.from_arrays([pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], ["begin", "end"])
        out = {c: table.column(c) for c in carry}
        out["n_words"] = pa.array(np.concatenate([np.zeros(0, np.int64), *n_words]))
        out["n_removed"] = pa.array(np.concatenate([np.zeros(0, np.int64), *n_removed]))
        out["kept_text"] = pa.array(texts, pa.binary()).cast(pa.string())
        out["removed_spans"] = pa.ListArray.from_arrays(pa.array(spans, pa.int32()), struct)
        return pa.table(out)

    return run


def _trimmed(run):
    """run, a function of a group, with freed memory given back behind it too: workers that wait for their next task hold little."""

    def call(table: pa.Table) -> pa.Table:
        give_back()
        out = run(table)
        give_back()
        return out

    return call


def _trimmed_pair(run):
    """As _trimmed, for a function of two groups."""

    def call(table: pa.Table, answers: pa.Table) -> pa.Table:
        give_back()
        out = run(table, answers)
        give_back()
        return out

    return call


def _dealt(docs: DataFrame, text: str, doc_id: str, chunk: str) -> tuple[DataFrame, int]:
    """docs with their chunks, and how many there are: their square is twice the text's bytes by ROW_BYTES, or more if chunks would pass CHUNK_BYTES."""
    key = F.xxhash64(doc_id, text)
    groups = docs.groupBy(key.alias("__key")).agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("bytes"))
    total = groups.agg(F.sum("bytes").alias("bytes"), F.max("n").alias("most")).first()
    size = total["bytes"] or 0
    chunks = max(1, isqrt(2 * size // ROW_BYTES), -(-size // CHUNK_BYTES))
    if chunks >= MOST_CHUNKS:
        raise ValueError(f"{chunks} chunks of text, more than {MOST_CHUNKS - 1}: raise CHUNK_BYTES")
    salt = F.lit(0).cast("long")
    if (total["most"] or 0) >= MANY:
        many = small(groups.where(F.col("n") >= MANY).select("__key", F.lit(True).alias("__many")), 16)
        docs = docs.withColumn("__key", key).join(many, "__key", "left").withColumn("__place", F.monotonically_increasing_id())
        salt = F.when(F.col("__many"), F.col("__place")).otherwise(0)
    rows = docs.withColumn(chunk, F.pmod(F.xxhash64(F.col(doc_id), F.col(text), salt), F.lit(chunks)))
    return rows.drop("__key", "__many", "__place"), chunks


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, keep_space: bool = False, keep_one: bool = False) -> DataFrame:
    """docs with n_words, n_removed, kept_text and removed_spans (word positions, end excluded).

    Removed is every word covered by a window of `window` words that also starts anywhere else, in the same text included. With keep_one
    the first occurrence of each such window, in the order of chunks and then of ids, stays whole, also where others overlap it. kept_text
    has the other words, joined by one space, or with the white space behind each if keep_space. A null or empty text has no
    words and gives an empty kept_text; rows that repeat count as occurrences of their own; an empty table gives an empty
    table. Columns of docs named like results are replaced, other columns are carried along.
    """
    text_batches(docs.sparkSession)
    block = (window + 1) // 2
    carry = [c for c in docs.columns if c not in RESULTS]
    chunk = "__chunk"
    rows, chunks = _dealt(docs.select(*carry), text, doc_id, chunk)
    parts = max(1, chunks // 2)
    sent = rows.groupBy(chunk).applyInArrow(_trimmed(_anchors(parts, block, text, chunk)), SENT)
    hits = sent.groupBy("bucket").applyInArrow(_trimmed(_meet_anchors), ANSWER)
    grown = rows.groupBy(chunk).cogroup(hits.groupBy("chunk")).applyInArrow(_trimmed_pair(_extend(parts, block, window, text, chunk)), SENT)
    answers = hits.unionByName(grown.groupBy("bucket").applyInArrow(_trimmed(_meet_windows), ANSWER))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema] + [f"{k} {v}" for k, v in RESULTS.items()])
    return rows.groupBy(chunk).cogroup(answers.groupBy("chunk")).applyInArrow(_trimmed_pair(_remove(parts, block, window, text, doc_id, carry, keep_space, keep_one)), schema)
