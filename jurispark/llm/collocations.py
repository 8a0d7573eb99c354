"""Phrase collocations: suffix-sigma counting of all phrases up to a length, and how closely their parts keep together.

Each place of a piece of text gives the suffix that begins there, cut to max_n words and at words too rare for any phrase. Suffixes are
shuffled by language and first word and sorted in reverse lexicographic order; one stack a language then counts all their beginnings in a
single pass, and what a phrase's parts count is joined afterwards.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jurispark.llm.shared import cut, give_back, join_heavy, shuffle_partitions, small

MAX_N, LEAST, KEEP, ABSORBED_PERCENT = 3, 10, 2000, 50
UNKNOWN = "und"
FILTER_BITS = 1 << 25
HELD = 6_000_000  # words that a worker holds as numbers before it counts their suffixes and hands them on
SLICE = 1 << 20
BREAK = b"\n"
# What ends a piece of text.
ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", BREAK * 9)


def slices(text: str) -> Iterator[list[bytes]]:
    """The words of a text, breaks and empty ones among them, in slices of about SLICE bytes; a word is never cut."""
    data, at = text.encode("utf-8", "replace").lower().translate(ENDS).replace(b"\t", b" "), 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].replace(BREAK, b" \n ").split(b" ")
        at = end


class Codes(dict):
    """Words as numbers in the order in which they are met: 0 for a break and for a word that is surely rare, 1 for no word.

    Which words of a language are rare is told by a bitmap of hashes: a rare word may pass, but no frequent one is lost. Without one all pass."""

    def __init__(self, lang: str, bitmap: bytes | None = None):
        super().__init__({BREAK: 0, b"": 1})
        self.words, self.seed, self.bitmap = [BREAK, b""], xxhash.xxh64_intdigest(lang.encode(), 42), bitmap

    def __missing__(self, word: bytes) -> int:
        found = 0
        if self.bitmap is not None:
            at = xxhash.xxh64_intdigest(word, self.seed) % FILTER_BITS
        if self.bitmap is None or self.bitmap[at >> 3] >> (at & 7) & 1:
            found = len(self.words)
            self.words.append(word)
        self[word] = found
        return found

    def of(self, text: str) -> Iterator[np.ndarray]:
        """The numbers of a text's words, breaks among them, in slices."""
        for words in slices(text):
            codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
            yield codes[codes != 1]

    def in_order(self) -> tuple[np.ndarray, list[bytes]]:
        """For each number the word's place in the order of bytes, 0 and 1 staying as they are, and the words in that order."""
        order = np.append([0, 1], pa.compute.sort_indices(pa.array(self.words[2:], pa.binary())).to_numpy().astype(np.int64) + 2)
        places = np.empty(len(order), np.int64)
        places[order] = np.arange(len(order))
        return places, [self.words[k] for k in order]


def _texts(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    for part in parts:
        for lang, text in zip(part["lang"].to_pylist(), part["text"]):
            text = text.as_py()
            if text:
                yield lang, text


def _batches(lang: str, n: int, columns: Callable[[slice], list[pa.Array]], names: list[str]) -> Iterator[pa.RecordBatch]:
    for i in range(0, n, 50_000):
        arrays = [a.cast(pa.string()) if pa.types.is_binary(a.type) else a for a in columns(slice(i, min(n, i + 50_000)))]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(arrays[0])), *arrays], names=["lang", *names])


def _words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of a part of the texts."""
    found: dict[str, Counter] = {}

    def table() -> Iterator[pa.RecordBatch]:
        for lang, own in found.items():
            own.pop(b"", None), own.pop(BREAK, None)
            words, n = pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())
            yield from _batches(lang, len(own), lambda rows: [words[rows], n[rows]], ["word", "n"])  # noqa: B023
        found.clear()
        give_back()

    for lang, text in _texts(parts):
        own = found.setdefault(lang, Counter())
        for words in slices(text):
            own.update(words)
        if sum(map(len, found.values())) > HELD // 4:
            yield from table()
    yield from table()


def _suffixes(shared, max_n: int, salts: int):
    """(lang, suffix, n, salt): the suffixes of a part of the texts with how many there are of each; every word ends in a blank."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hot = shared.value
        coded: dict[str, Codes] = {}
        found: dict[str, list[np.ndarray]] = {}

        def table() -> Iterator[pa.RecordBatch]:
            for lang in list(found):
                codes = coded[lang]
                places, names = codes.in_order()
                words, n = _distinct(places[np.concatenate([*found.pop(lang), np.zeros(max_n - 1, np.int64)])], max_n, len(names))
                words, n, column = [w[::-1] for w in words], n[::-1], pa.array(names, pa.binary())  # the order of the sort to come, which then has sorted runs to merge
                heavy = np.array([places[codes[w]] for w in sorted(hot.get(lang, ())) if w in codes], np.int64)
                salt = _salts(words, heavy[heavy > 0], names, salts)

                def columns(rows: slice) -> list[pa.Array]:
                    own = [column.take(pa.array(w[rows])) for w in words]  # noqa: B023
                    ended = [pa.compute.if_else(pa.array(w[rows] > 0), pa.compute.binary_join_element_wise(c, b"", b" "), b"") for w, c in zip(words, own)]  # noqa: B023
                    return [pa.compute.binary_join_element_wise(*ended, b""), pa.array(n[rows]), pa.array(salt[rows])]  # noqa: B023

                yield from _batches(lang, len(n), columns, ["suffix", "n", "salt"])
            coded.clear()
            give_back()

        size = 0
        for lang, text in _texts(parts):
            if lang not in coded:
                coded[lang] = Codes(lang, bitmap)
            for own in coded[lang].of(text):
                found.setdefault(lang, []).append(own)
                size += len(own)
            found.setdefault(lang, []).append(np.zeros(max_n - 1, np.int64))
            if size > HELD or sum(map(len, coded.values())) > HELD // 4:
                yield from table()
                size = 0
        yield from table()

    return run


def _distinct(codes: np.ndarray, max_n: int, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct suffixes of a run of words as a column a word, 0 behind the end, and how many there are of each."""
    columns = [codes[k : len(codes) - max_n + 1 + k] for k in range(max_n)]
    columns = [c[columns[0] > 0] for c in columns]
    for k in range(1, max_n):
        columns[k] = np.where(columns[k - 1] > 0, columns[k], 0)
    bits = max(1, int(size - 1).bit_length())
    if bits * max_n > 63:
        rows, n = np.unique(np.stack(columns, 1), axis=0, return_counts=True)
        return list(rows.T), n
    packed = columns[0]
    for c in columns[1:]:
        packed = packed << bits | c
    packed.sort()
    first = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])) if len(packed) else np.zeros(0, bool))
    n, packed = np.diff(np.append(first, len(packed))), packed[first]
    return [packed >> bits * (max_n - 1 - k) & ((1 << bits) - 1) for k in range(max_n)], n


def _salts(words: list[np.ndarray], hot: np.ndarray, names: list[bytes], salts: int) -> np.ndarray:
    """0 unless the first word is hot; then by the second word, or by it and the third if the second is hot too. Numbers are a worker's own, so names are hashed."""
    out = np.zeros(len(words[0]), np.int32)
    rows = np.flatnonzero(np.isin(words[0], hot))
    if len(rows) and len(words) > 1:
        hashes = np.fromiter(map(xxhash.xxh32_intdigest, names), np.int64, len(names))
        spread = hashes[words[1][rows]]
        if len(words) > 2:
            spread = np.where(np.isin(words[1][rows], hot), spread * 31 + hashes[words[2][rows]], spread)
        out[rows] = 1 + (spread >> 3) % salts
    return out


class Stack:
    """What the beginnings of the last suffix count so far, one number a depth, while suffixes of a language come in order.

    A batch is taken in at once: where neighbours' first words agree is where their beginnings go on, so a depth's counts are sums between places where they do not."""

    def __init__(self, max_n: int, hot: set[str]):
        self.hot, self.max_n = pa.array(sorted(hot), pa.string()), max_n
        self.last, self.open = None, [0] * max_n

    def push(self, suffixes: pa.Array, n: np.ndarray, least: int, end: bool = False) -> tuple[list[str], list[int], list[int]]:
        """Takes in the next suffixes; (phrases, sizes, counts) of the beginnings that are complete: those that count enough, and those of hot words that other parts count too."""
        if self.last is not None:
            suffixes, n = pa.concat_arrays([pa.array([self.last], suffixes.type), suffixes]), np.append(0, n)
        if not len(suffixes):
            return [], [], []
        split = pa.compute.split_pattern(suffixes, " ")
        offsets, words = split.offsets.to_numpy(), split.values
        sizes = np.diff(offsets) - 1
        goes_on, hot = np.ones(len(n) - 1, bool), np.ones(len(n), bool)
        phrases, depths, counts = [], [], []
        for d in range(self.max_n):
            both = np.flatnonzero(goes_on & (sizes[1:] > d) & (sizes[:-1] > d))
            same = pa.compute.equal(words.take(pa.array(offsets[both + 1] + d)), words.take(pa.array(offsets[both] + d))).to_numpy(zero_copy_only=False)
            goes_on = np.zeros(len(n) - 1, bool)
            goes_on[both[same]] = True
            first = np.flatnonzero(np.append(True, ~goes_on))
            total = np.add.reduceat(n, first)
            total[0] += self.open[d] if self.last is not None else 0
            self.open[d] = int(total[-1])
            keep = sizes[first] > d
            hot = hot & (sizes > d) & pa.compute.is_in(words.take(pa.array(offsets[:-1] + np.minimum(d, sizes))), value_set=self.hot).to_numpy(zero_copy_only=False) if d < 2 else hot & False
            keep &= (total >= least) | hot[first]
            if not end:
                keep[-1] = False
            for s, t in zip(suffixes.take(pa.array(first[keep])).to_pylist(), total[keep].tolist()):
                phrases.append(" ".join(s.split(" ", d + 1)[: d + 1]))
                depths.append(d + 1)
                counts.append(t)
        self.last = suffixes[-1].as_py()
        return phrases, depths, counts


def _joined(parts: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at least, in order."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += part.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _counted(shared, max_n: int, least: int):
    """(lang, phrase, size, n) of the beginnings of suffixes in reverse order. Beginnings of one or two words that are all hot may lie in several parts: they are given whatever they count."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = {lang: {w.decode() for w in words} for lang, words in shared.value[1].items()}
        stacks: dict[str, Stack] = {}

        def table(lang: str, suffixes: pa.Array, n: np.ndarray, end: bool = False) -> pa.RecordBatch:
            phrases, sizes, counts = stacks[lang].push(suffixes, n, least, end)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(sizes, pa.int32()), pa.array(counts, pa.int64())], names=["lang", "phrase", "size", "n"])

        for part in _joined(parts):
            for lang in pa.compute.unique(part["lang"]).to_pylist():
                own = part.filter(pa.compute.equal(part["lang"], lang))
                if lang not in stacks:
                    stacks[lang] = Stack(max_n, hot.get(lang, set()))
                yield table(lang, own["suffix"], own["n"].to_numpy())
        for lang in stacks:
            yield table(lang, pa.array([], pa.string()), np.zeros(0, np.int64), True)

    return run


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", max_n: int = MAX_N, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of up to max_n words that occur `least` times, and (lang, n) of all words; both stored.

    Words are counted first. A word below `least` is in no such phrase, so suffixes end there; which words these are is told by a bitmap of
    FILTER_BITS bits, of one size whatever the data's, that lets no frequent word go. Words with a thousandth of all occurrences, at most a thousand, are
    hot: their suffixes are dealt out by the words behind, and what short beginnings count in each part is summed.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    words = cut(rows.mapInArrow(_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") > 0))
    sizes = cut(words.groupBy("lang").agg(F.sum("n").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot: dict[str, set[bytes]] = {}
    for r in words.where(F.col("n") * 1000 >= total).collect():
        hot.setdefault(r["lang"], set()).add(r["word"].encode())
    place = F.pmod(F.xxhash64("lang", "word"), F.lit(FILTER_BITS)) + 1
    bits = words.where(F.col("n") >= least).groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bitmap = bytearray(FILTER_BITS >> 3)
    for r in bits.collect():  # at most FILTER_BITS / 32768 rows of 4096 bytes
        bitmap[(r["b"] - 1) * 4096 : r["b"] * 4096] = r["bits"]
    shared = spark.sparkContext.broadcast((bytes(bitmap), hot))
    parts = shuffle_partitions(spark)
    suffixes = rows.mapInArrow(_suffixes(shared, max_n, parts), "lang string, suffix string, n long, salt int")
    suffixes = suffixes.repartition(parts, "lang", F.substring_index("suffix", " ", 1), "salt").sortWithinPartitions(F.desc("suffix"))
    counted = suffixes.mapInArrow(_counted(shared, max_n, least), "lang string, phrase string, size int, n long")
    return cut(counted.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f")).where(F.col("f") >= least)), sizes


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", max_n: int = MAX_N, least: int = LEAST, keep: int = KEEP, absorbed: int = ABSORBED_PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `keep` phrases of 2 to max_n words.

    A phrase of a occurrences, cut into a beginning of l and a rest of r, scores floor(10^6 a^2 / (l r)); its lowest-scoring cut counts, of equal ones
    the first. A phrase goes if a longer one, of `least` occurrences too, holds its words side by side and has `absorbed` percent of its occurrences.
    Null texts have no words, null languages are `und`; copies and rows that repeat are counted as often as they are; equal scores rank by
    occurrences, then by the phrase's bytes. Long texts are read in slices. An empty table gives no rows. Counts are exact at any size.
    """
    counts, sizes = phrase_counts(docs, text, lang, max_n, least)
    words = F.split("phrase", " ")
    part = lambda begin, n: F.array_join(F.slice("words", begin, n), " ")
    candidates = counts.where("size > 1").withColumn("words", words)
    cuts = F.array(*(F.when(F.col("size") > k, F.struct(F.lit(k).alias("k"), F.lit(left).alias("left"), (part(1, k) if left else part(k + 1, F.col("size") - k)).alias("part"))) for k in range(1, max_n) for left in (True, False)))
    asked = cut(candidates.select("lang", "phrase", F.col("f").alias("a"), F.inline(F.filter(cuts, lambda c: c.isNotNull()))))
    weights = asked.groupBy("lang", "part").agg(F.count("*").alias("w"))
    known = weights.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    met = join_heavy(asked, known, ["lang", "part"], "w", asked.count(), F.col("phrase"))
    sides = met.groupBy("lang", "phrase", "a").agg(*(F.max(F.when((F.col("k") == k) & (F.col("left") == left), F.col("f"))).alias(f"{'l' if left else 'r'}{k}") for k in range(1, max_n) for left in (True, False)))
    best = F.array_min(F.filter(F.array(*(F.when(F.col(f"l{k}").isNotNull(), F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, max_n))), lambda c: c.isNotNull()))
    scored = sides.select("lang", "phrase", "a", best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))))
    longer = candidates.where("size > 2").select("lang", "f", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * absorbed)).drop("longer")
    left = cut(left)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = isqrt(left.count() // keep) + 1  # each language's rows are ranked in parts first, so that no task sorts all of them
    first = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(dealt)))
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= keep)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= keep)
    return ranked.join(small(sizes, 64), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (l r)) in whole numbers of up to 38 digits; counts are below 10^15."""
    whole = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", whole(a) * whole(a) * F.lit(1_000_000).cast("decimal(7,0)"), whole(left) * whole(right))
