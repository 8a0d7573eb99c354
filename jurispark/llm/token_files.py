"""Token ids as Arrow files: equal-length sequences with masks, in batches of fixed-size lists that are read without copying.

Documents are dealt out by ranges of their ids, and each task writes one shard: its documents' ids laid end to end and cut every `length`
ids, the last sequence padded and masked, and beside it where each document begins. A shard is named by its task's attempt, and only
shards whose task has come through are listed in the manifest, so work that is done again leaves no file that is read. What a shard
begins at is the sum of those before it. Any sequence is found by its number, any document by its span, in a memory map where the
folder is local.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jurispark.llm.shared import cut, remove_at_end, shared_path, shuffle_partitions, text_batches

LENGTH = 2048
ROWS = 64
MEMO = 500_000
SLICE = 4 << 20
READ_BYTES = 4 << 20


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; every store that pyarrow knows, or a shared folder."""
    parsed = urlparse(uri)
    return (fs.LocalFileSystem(), parsed.path) if parsed.scheme in ("", "file") else fs.FileSystem.from_uri(uri)


WHITE = bytes.maketrans(b"\n\t\r", b"   ")
LETTER, MARK, SECOND, CAPITAL = (np.zeros(256, bool) for _ in range(4))
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK[list(string.punctuation.encode())] = True
SECOND[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = True  # behind a byte C3: the letters from U+00C0 to U+00FF
CAPITAL[[*range(0x80, 0x97), *range(0x98, 0x9F)]] = True  # those of them that are capitals; the small ones are 32 on
LETTERS = re.compile(b"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")  # a to z, and the small letters from U+00DF to U+00FF
COMBINING = (b"\xcc", b"\xcd")  # what combining marks of Latin letters begin with


class Encoder:
    """Texts as bytes of ids.

    `by_word` is for tokenizers that drop blanks, lower-case, and cut letters from marks: text between blanks is then encoded by itself and remembered, as is a word in front
    of a mark. The words met last are kept in two generations, so frequent ones stay and memory is bounded."""

    def __init__(self, model: str, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_str(model)
        self.kind = np.dtype(id_type(self.tokenizer.get_vocab_size(with_added_tokens=True)))
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.by_word, self.memo, self.older = by_word, {b"": b""}, {}
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        bytewise = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelt = {c: bytewise.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}  # how a model over bytes spells these letters

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _known(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words. Words of small letters are left as they are by all that stands before the model but for their bytes' spelling, so the model alone reads them."""
        if len(self.memo) > MEMO:
            self.memo, self.older = {b"": b""}, self.memo
        memo, older, others, spelt = self.memo, self.older, [], self.spelt
        tokenize, code, letters = self.tokenizer.model.tokenize, self.code, LETTERS.fullmatch
        out = list(map(memo.get, words))
        for k, found in enumerate(out):
            if found is None:
                w = words[k]
                found = older.get(w)
                if found is None and letters(w):
                    word = w.decode() if w.isascii() else w.decode().translate(spelt)
                    found = array(code, [t.id for t in tokenize(word)]).tobytes()
                if found is None:
                    others.append(k)
                else:
                    out[k] = memo[w] = found
        for k, found in zip(others, self._ids([words[k].decode() for k in others])):
            out[k] = memo[words[k]] = found
        return out

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text; a null text is an empty one."""
        if not self.by_word:
            yield from self._ids([t or "" for t in texts])
            return
        for some in _few(texts):
            words = pa.compute.split_pattern(pa.array([parted(t or "", self.special) for t in some], pa.large_binary()), b" ")
            coded = words.values.dictionary_encode()
            known = self._known(coded.dictionary.to_pylist())
            values, sizes = np.frombuffer(b"".join(known), self.kind), np.fromiter(map(len, known), np.int64, len(known)) // self.kind.itemsize
            which = coded.indices.to_numpy()
            n = sizes[which]
            ends = np.append(0, np.cumsum(n))
            out = values[np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], n) + np.arange(ends[-1])]
            rows = ends[words.offsets.to_numpy()]
            for begin, end in zip(rows[:-1], rows[1:]):
                yield out[begin:end].tobytes()


def parted(text: str, special: list[bytes]) -> bytes:
    """The text with blanks for line ends, and a blank between a letter up to U+00FF and an ASCII mark behind it; these letters as small ones unless a combining mark, which may
    join with one case alone, can be in it. A text that holds a special token, in whatever case, has its line ends replaced only."""
    data = text.encode("utf-8", "replace").translate(WHITE)
    lowered = data.lower()
    if len(data) < 2 or any(s in lowered for s in special):
        return data
    values = np.frombuffer(data, np.uint8)
    two = (values[:-1] == 0xC3) & SECOND[values[1:]]
    ends = LETTER[values]
    ends[1:] |= two
    if not any(c in data for c in COMBINING):
        values = np.frombuffer(lowered, np.uint8).copy()
        values[1:][two & CAPITAL[values[1:]]] += 32
    at = np.flatnonzero(ends[:-1] & MARK[values[1:]]) + 1
    out = np.full(len(values) + len(at), 32, np.uint8)
    kept = np.ones(len(out), bool)
    kept[at + np.arange(len(at))] = False
    out[kept] = values
    return out.tobytes()


@lru_cache(maxsize=1)
def _encoder(model: str, by_word: bool) -> Encoder:
    """A worker's encoder, which lives on from task to task."""
    return Encoder(model, by_word)


def _few(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in groups of about SLICE characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size > SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def id_type(size: int) -> str:
    """The narrowest unsigned type that holds a vocabulary's ids."""
    return "<u2" if size <= 1 << 16 else "<u4"


def _schema(kind: np.dtype, length: int) -> pa.Schema:
    ids = pa.uint16() if kind.itemsize == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))], metadata={"rows": str(ROWS)})


class ShardWriter:
    """Writes ids as batches of ROWS sequences of `length`; mask is true where an id is a document's."""

    def __init__(self, uri: str, kind: np.dtype, length: int):
        system, path = _place(uri)
        system.create_dir(os.path.dirname(path), recursive=True)
        self.kind, self.length, self.schema = kind, length, _schema(kind, length)
        self.file = system.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.file, self.schema)
        self.held, self.n, self.sequences = bytearray(), 0, 0

    def add(self, ids: bytes) -> int:
        """Appends a document's ids and gives how many they are."""
        self.held += ids
        n = len(ids) // self.kind.itemsize
        self.n += n
        full = ROWS * self.length * self.kind.itemsize
        at = 0
        while len(self.held) - at >= full:
            self._batch(bytes(self.held[at : at + full]))
            at += full
        del self.held[:at]
        return n

    def _batch(self, data: bytes) -> None:
        values = np.frombuffer(data, self.kind)
        rows = -(-len(values) // self.length)
        padded, mask = np.zeros(rows * self.length, self.kind), np.zeros(rows * self.length, bool)
        padded[: len(values)], mask[: len(values)] = values, True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x, t.value_type), self.length) for x, t in zip((padded, mask), self.schema.types)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.sequences += rows

    def close(self) -> None:
        if self.held:
            self._batch(bytes(self.held))
        self.writer.close()
        self.file.close()


class SequenceFile:
    """A shard, opened: sequences by number and ids by span, as views of a memory map where the file is local."""

    def __init__(self, uri: str):
        system, path = _place(uri)
        self.source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.rows = int(self.reader.schema.metadata[b"rows"])
        self.length = self.reader.schema.field("ids").type.list_size
        self.kind = np.dtype(self.reader.schema.field("ids").type.value_type.to_pandas_dtype())
        self.batch = lru_cache(maxsize=2)(self.reader.get_batch)

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return (n - 1) * self.rows + self.batch(n - 1).num_rows if n else 0

    def _values(self, k: int) -> np.ndarray:
        return self.batch(k)["ids"].values.to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of a sequence; the ids are a view of the file."""
        k, row = divmod(i, self.rows)
        mask = self.batch(k)["mask"].values.slice(row * self.length, self.length)
        return self._values(k)[row * self.length : (row + 1) * self.length], mask.to_numpy(zero_copy_only=False)

    def span(self, begin: int, n: int) -> np.ndarray:
        """n ids from one on, over as many batches as they reach; a view where they lie in one."""
        full, parts, end = self.rows * self.length, [], begin + n
        while begin < end:
            k, at = divmod(begin, full)
            parts.append(self._values(k)[at : at + end - begin])
            begin = (k + 1) * full
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, self.kind)

    def close(self) -> None:
        self.batch.cache_clear()
        self.source.close()


@dataclass(frozen=True)
class TokenFiles:
    """A folder of shards and the table that lists them: (shard, file, documents, n_ids, n_sequences, n_documents, start)."""

    path: str

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/manifest")


def write(docs: DataFrame, model: str, end_id: int | None = None, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, by_word: bool = False, path: str | None = None) -> TokenFiles:
    """Encodes docs with the tokenizer of a JSON file and writes their ids in ascending doc_id order.

    A null text is an empty one, which has the end id alone. Rows of one doc_id stand next to each other in the order of their texts' hashes, rows without one come first;
    repeated rows are written as often as they are. Texts of any length may reach over many sequences. An empty table has an empty manifest.
    The tokenizer's special tokens inside a text are read as the library reads them.
    """
    spark = docs.sparkSession
    text_batches(spark)
    if path is None:
        path = shared_path(spark, "tokens")
        remove_at_end(spark, path)
    with open(model, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def shard(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, begin, n = None, None, 0, 0
        context = TaskContext.get()
        name = f"{path}/data/part-{context.partitionId():05d}-{context.taskAttemptId()}"
        for part in parts:
            if not part.num_rows:
                continue
            if writer is None:
                encoder = _encoder(shared.value, by_word)
                end = b"" if end_id is None else np.array([end_id], encoder.kind).tobytes()
                writer = ShardWriter(f"{name}.arrow", encoder.kind, length)
                schema = pa.schema([("doc_id", part.schema.field(0).type), ("begin", pa.int64()), ("n_tokens", pa.int64())])
                file = _open(f"{name}.docs.arrow")
                listed = pa.ipc.new_file(file, schema)
            sizes = np.fromiter((writer.add(ids + end) for ids in encoder.encode(part["text"].to_pylist())), np.int64, part.num_rows)
            begins = begin + np.concatenate(([0], np.cumsum(sizes)[:-1]))
            begin, n = begin + int(sizes.sum()), n + part.num_rows
            listed.write_batch(pa.RecordBatch.from_arrays([part.column(0), pa.array(begins), pa.array(sizes)], schema=schema))
        if writer is not None:
            writer.close(), listed.close(), file.close()
            yield pa.RecordBatch.from_pydict({"shard": [context.partitionId()], "file": [f"{name}.arrow"], "documents": [f"{name}.docs.arrow"], "n_ids": [writer.n], "n_sequences": [writer.sequences], "n_documents": [n]})

    parts = shuffle_partitions(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    rows = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie").drop("tie")
    shards = cut(rows.mapInArrow(shard, "shard long, file string, documents string, n_ids long, n_sequences long, n_documents long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over one row a file
    shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{path}/manifest")
    return TokenFiles(path)


def _open(uri: str):
    system, path = _place(uri)
    return system.open_output_stream(path)


def read_documents(spark: SparkSession, files: TokenFiles, doc_id_type: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, read back from the shards, each by a task of its own; ids are bytes of little-endian unsigned 32-bit integers."""
    listed = files.manifest(spark)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                shard = SequenceFile(row["file"])
                system, path = _place(row["documents"])
                with system.open_input_file(path) as source:
                    reader = pa.ipc.open_file(source)
                    for k in range(reader.num_record_batches):
                        yield from _documents(reader.get_batch(k), shard, row["start"])
                shard.close()

    spread = listed.repartitionByRange(shuffle_partitions(spark), "shard")
    return spread.mapInArrow(read, f"doc_id {doc_id_type}, start long, n_tokens long, ids binary")


def _documents(batch: pa.RecordBatch, shard: SequenceFile, start: int) -> Iterator[pa.RecordBatch]:
    """A batch's documents with their ids, about READ_BYTES at once."""
    begins, sizes = batch["begin"].to_numpy(), batch["n_tokens"].to_numpy()
    i, ends = 0, np.cumsum(sizes * 4)
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + READ_BYTES, "right")))
        ids = [shard.span(int(b), int(n)).astype("<u4").tobytes() for b, n in zip(begins[i:j], sizes[i:j])]
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(begins[i:j] + start), pa.array(sizes[i:j]), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
        i = j
