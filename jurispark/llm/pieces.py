"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text once. At each position it reports, along its output links, every piece that ends there, and each
relaxes the best score of that position; a character that no piece spells alone falls back to its UTF-8 bytes. The result is
the segmentation of the highest summed score, whatever kind of model the scores come from: for a byte-pair model it is the
best-scored one, not always that of the merges.

Where no piece of the vocabulary has two characters side by side, a text can be cut between them: its best segmentation is that of
the parts. Texts are cut before blanks and behind letters if the vocabulary allows it, and the parts are kept in bounded memos.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jurispark.llm.shared import give_back, text_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
UNKNOWN_PENALTY = 10.0
MEMO, WORD_MEMO = 80_000, 30_000  # of parts between marks and of whole words


class Pieces:
    """The pieces of a model with their scores, and the automaton over them."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size, self.unknown = sp.get_piece_size(), sp.unk_id()
        kinds = [(sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i), sp.is_byte(i)) for i in range(self.size)]
        names = [sp.id_to_piece(i) for i in range(self.size)]
        self.bytes = {int(names[i][3:5], 16): i for i, (_, byte) in enumerate(kinds) if byte}
        plain = {names[i]: (sp.get_score(i), i) for i, k in enumerate(kinds) if not any(k)}
        self.single = {p for p in plain if len(p) == 1}
        self.fallback = min((s for s, _ in plain.values()), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, (score, i) in plain.items():
            self.automaton.add_word(piece, (len(piece), score, i))
        if plain:
            self.automaton.make_automaton()
        self.text = [b"" if gone else bytes([int(n[3:5], 16)]) if byte else n.replace(BLANK, " ").encode() for n, (gone, byte) in zip(names, kinds)]
        self.sizes = [len(n) for n in names]
        self.newline = _packed((self.bytes.get(10, self.unknown),)) if "\n" not in "".join(plain) else None
        pairs = {x for p in plain for x in zip(p, p[1:])}
        blank_inside = any(b == BLANK != a for a, b in pairs)
        letter_before = any(a.isalpha() and not b.isalpha() for a, b in pairs)
        letters, others = r"[^\W\d_]", r"[\W\d_]"
        self.parts = re.compile("(?s).+" if blank_inside else f"(?s){BLANK}*[^{BLANK}]+|{BLANK}+" if letter_before else f"{others}*{letters}+|{others}+")
        self.part = Memo(lambda s: _packed(self.segment(s)), MEMO)
        self.word = Memo(lambda w: self.whole(BLANK + w), WORD_MEMO)
        self.bare = Memo(self.whole, WORD_MEMO)
        self.simple = not blank_inside and self.newline is not None

    def segment(self, s: str) -> tuple[int, ...]:
        """The best-scored pieces of a string in which blanks are BLANK."""
        n = len(s)
        best, back = [0.0] + [-np.inf] * n, [-1] * (n + 1)
        if self.single.issuperset(s):
            for end, (size, score, i) in self.automaton.iter(s):
                total = best[end + 1 - size] + score
                if total > best[end + 1]:
                    best[end + 1], back[end + 1] = total, i
        else:
            self._with_fallback(s, best, back)
        out, at = [], n
        while at:
            i = back[at]
            if i >= 0:
                out.append(i)
                at -= self.sizes[i]
            else:
                out += [self.bytes.get(b, self.unknown) for b in reversed(s[at - 1].encode("utf-8", "replace"))] if self.bytes else [self.unknown]
                at -= 1
        return tuple(reversed(out))

    def _with_fallback(self, s: str, best: list[float], back: list[int]) -> None:
        """As segment, where a character that is no piece may stand for itself; a position is settled before pieces begin there."""
        done = 0

        def settle(upto: int) -> None:
            nonlocal done
            while done < upto:
                done += 1
                if s[done - 1] not in self.single and best[done - 1] + self.fallback > best[done]:
                    best[done], back[done] = best[done - 1] + self.fallback, -1

        for end, (size, score, i) in self.automaton.iter(s):
            settle(end)
            total = best[end + 1 - size] + score
            if total > best[end + 1]:
                best[end + 1], back[end + 1] = total, i
        settle(len(s))

    def whole(self, s: str) -> bytes:
        """The pieces of a string, part by part: no piece reaches over where parts meet."""
        return b"".join(map(self.part.__getitem__, self.parts.findall(s)))

    def encode(self, text: str) -> list[tuple[int, ...]]:
        """The pieces of a text in order, word by word."""
        return [tuple(array("i", span)) for span in self.spans(text)]

    def spans(self, text: str) -> list[bytes]:
        """The pieces of a text, word by word, as bytes of 32-bit numbers; a BLANK that stands in the text itself is spelt in bytes, so that decoding is exact."""
        if not text:
            return []
        if BLANK in text and self.bytes:
            spelt = _packed(self.bytes.get(b, self.unknown) for b in BLANK.encode())
            out, (first, *rest) = [], text.split(BLANK)
            out.append(self.whole(BLANK + first.replace(" ", BLANK)))
            for part in rest:
                out += [spelt, self.whole(part.replace(" ", BLANK))]
            return out
        if not self.simple:
            return [self.whole(BLANK + text.replace(" ", BLANK))]
        out = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.newline)
            first, *rest = line.split(" ")
            if "" in rest or not first:
                out.append(self.whole((BLANK if not k else "") + line.replace(" ", BLANK)))
            else:
                out.append(self.bare[first] if k else self.word[first])
                out += map(self.word.__getitem__, rest)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of pieces, without the blank that encoding puts in front; ids that do not exist are left out."""
        if ids and (min(ids) < 0 or max(ids) >= self.size):
            ids = [i for i in ids if 0 <= i < self.size]
        return b"".join(map(self.text.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


def _packed(ids: Iterable[int]) -> bytes:
    return array("i", ids).tobytes()


class Memo(dict):
    """Results of a function of strings: the latest `most` and as many before them; those of long strings are not kept."""

    def __init__(self, f, most: int):
        super().__init__()
        self.f, self.before, self.most = f, {}, most

    def __missing__(self, key: str) -> bytes:
        found = self.before.get(key)
        if found is None:
            found = self.f(key)
        if len(key) <= 48:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[key] = found
        return found


@lru_cache(maxsize=2)
def pieces(model: bytes) -> Pieces:
    """The pieces of a model file's content, built once a worker."""
    return Pieces(model)


def model_bytes(path: str = MODEL) -> bytes:
    """A tokenizer file of the driver's machine; its few hundred kB are broadcast, so executors need no such file."""
    with open(path, "rb") as f:
        return f.read()


def encode(spark: SparkSession, text: Column, path: str = MODEL) -> Column:
    """The ids of a text column as array<int>: null for null, empty for an empty text."""
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model_bytes(path))

    def run(texts: pa.Array) -> pa.Array:
        p, parts, sizes = pieces(shared.value), [], [0]
        for t in texts:
            parts.append(np.frombuffer(b"".join(p.spans(t.as_py() or "")), np.int32))
            sizes.append(len(parts[-1]))
        offsets = pa.array(np.cumsum(sizes).astype(np.int32), mask=np.append(texts.is_null().to_numpy(False), False))
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))

    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))(text)


def decode(spark: SparkSession, ids: Column, path: str = MODEL) -> Column:
    """The text of a column of ids: null for null; ids that are null or do not exist are left out."""
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model_bytes(path))

    def run(rows: pa.Array) -> pa.Array:
        p, rows = pieces(shared.value), rows.cast(pa.list_(pa.int32()))
        values, offsets = rows.values.fill_null(-1).to_numpy(), rows.offsets.to_numpy()
        gone = rows.is_null().to_pylist()
        return pa.array([None if g else p.decode(values[a:b].tolist()) for a, b, g in zip(offsets, offsets[1:], gone)], pa.string())

    return F.arrow_udf(run, T.StringType())(ids)


def round_trips(spark: SparkSession, text: Column, path: str = MODEL) -> Column:
    """struct<ids, round_trip>: the ids of a text, and whether decoding them gives the text back; null and empty as in encode.

    One pass of a worker encodes and decodes, so neither ids nor texts travel a second time.
    """
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model_bytes(path))

    def run(texts: pa.Array) -> pa.Array:
        p, parts, same, sizes = pieces(shared.value), [], [], [0]
        for t in texts:
            plain = t.as_py() or ""
            ids = np.frombuffer(b"".join(p.spans(plain)), np.int32)
            same.append(p.decode(ids.tolist()) == plain)
            parts.append(ids)
            sizes.append(len(ids))
        give_back()
        offsets = pa.array(np.cumsum(sizes).astype(np.int32), mask=np.append(texts.is_null().to_numpy(False), False))
        ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))
        return pa.StructArray.from_arrays([ids, pa.array(same, pa.bool_())], ["ids", "round_trip"])

    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])
    return F.arrow_udf(run, kind)(text)


def encode_documents(docs: DataFrame, text: str = "text", path: str = MODEL) -> DataFrame:
    """docs with ids, n_ids (0 for null) and round_trip; columns of these names are replaced. Copies get equal ids; empty tables stay empty."""
    out = docs.withColumn("__coded", round_trips(docs.sparkSession, F.col(text), path))
    ids = F.col("__coded.ids")
    return out.withColumns({"ids": ids, "n_ids": F.coalesce(F.size(ids), F.lit(0)).cast("long"), "round_trip": F.col("__coded.round_trip")}).drop("__coded")
