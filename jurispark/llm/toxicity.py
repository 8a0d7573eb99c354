"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton after folding, normalised by length, with exception phrases.

Folding lower-cases, maps look-alike letters and digit or sign substitutions to plain letters inside words, drops accents, and turns
all else into blanks. Entries are whole words, and beginnings of words that stand for their compounds; both are learned from
labelled rows with smoothed log odds as weights. A hit inside an exception phrase does not count. The score is the logistic
function of the summed weights over the logarithm of the text's length.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jurispark.llm.shared import cut, small, text_batches

MIN_PREFIX, MAX_PREFIX = 4, 12
MIN_DOCUMENTS = 5
MIN_LOG_ODDS = 3.0
EXCEPTION_LOG_ODDS = 0.0
SAMPLE_ROWS = 20_000
MOST = 200_000

# Signs and digits read as letters between letters, and look-alike letters of other scripts.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "ι": "i", "κ": "k", "ı": "i", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d",
}

SIGN = re.compile(b"[0134578@$!|+]")
MARKS = re.compile(b"\xcc[\x80-\xbf]|\xcd[\x80-\xaf]")
FOREIGN = re.compile("[^\x00-\x7f]")
UNUSUAL = re.compile("[^\x00-\u024f]")
KEPT = bytes(c if c > 127 or chr(c).isalnum() or chr(c) in SUBSTITUTES else 32 for c in range(256))
PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


@lru_cache(maxsize=None)
def _letters() -> dict[int, str]:
    """Plain letters for accented, full-width and look-alike ones."""
    table: dict[int, str | None] = {}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B)]:
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
        if plain.isascii() and plain.isalnum():
            table[c] = plain
    table.update(dict.fromkeys(range(0x300, 0x370)))
    return table | {ord(k): v for k, v in LOOKALIKES.items()} | INVISIBLE


def _letter(m: re.Match) -> str:
    c = m.group()
    return _letters().get(ord(c), c) or ""


def _without_signs(data: bytes) -> bytes:
    """Substitutes read as letters in tokens that have two letters at least and nothing but letters and substitutes."""
    parts, done = [], 0
    for m in SIGN.finditer(data):
        if m.start() < done:
            continue
        begin, end = data.rfind(b" ", 0, m.start()) + 1, data.find(b" ", m.start())
        end = len(data) if end < 0 else end
        token = data[begin:end].strip(b"!|+")
        if SIGN.search(token):
            plain = token.decode()
            if sum(map(str.isalpha, plain)) > 1 and all(c.isalpha() or c in SUBSTITUTES for c in plain):
                parts += [data[done:begin], b" ", "".join(SUBSTITUTES.get(c, c) for c in plain).encode(), b" "]
                done = end
                continue
        parts.append(data[done:end])
        done = end
    return b"".join(parts) + data[done:]


def fold(text: str) -> str:
    """The text as plain lower-case words between single blanks, with a blank at either end."""
    text = text.lower()
    if text.isascii():
        data = text.encode()
    else:
        if UNUSUAL.search(text):
            text = FOREIGN.sub(_letter, text)
        for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("ł", "l"), ("đ", "d"), ("ı", "i"), ("\xad", "")):
            text = text.replace(a, b)
        data = MARKS.sub(b"", unicodedata.normalize("NFD", text).encode("utf-8", "replace"))
    data = data.translate(KEPT)
    if SIGN.search(data):
        data = _without_signs(data)
    return f" {b' '.join(data.translate(PLAIN).split()).decode()} "


def entries(folded: str) -> set[str]:
    """What of a folded text may stand in a lexicon: " word " and " beginning"."""
    words = set(folded.split())
    starts = {w[:k] for w in words if len(w) > MIN_PREFIX for k in range(MIN_PREFIX, min(MAX_PREFIX, len(w) - 1) + 1)}
    return {f" {w} " for w in words if len(w) > 2} | {f" {s}" for s in starts}


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    slope: float = 1.0
    bias: float = -4.0
    built: dict = field(default_factory=dict, compare=False, repr=False)

    def automaton(self) -> ahocorasick.Automaton:
        if "a" not in self.built:
            a = ahocorasick.Automaton()
            for e, w in self.weights.items():
                a.add_word(e, (w, len(e), False))
            for e in self.exceptions:
                a.add_word(f" {e} ", (0.0, len(e) + 2, True))
            a.make_automaton()
            self.built["a"] = a
        return self.built["a"]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "built"} | {"built": {}}


def hits(folded: str, lexicon: Lexicon) -> list[tuple[int, int, float]]:
    """(begin, end, weight) of the words hit, the heaviest entry of a word counting; none inside an exception phrase."""
    if not lexicon.weights:
        return []
    words: dict[int, tuple[float, int]] = {}
    spared = []
    for end, (weight, size, exception) in lexicon.automaton().iter(folded):
        begin = end - size + 1
        if exception:
            spared.append((begin, end))
        elif weight > words.get(begin, (0.0, 0))[0]:
            words[begin] = (weight, end)
    spared.sort()
    out, k, reach = [], 0, -1
    for b, (w, e) in sorted(words.items()):
        while k < len(spared) and spared[k][0] <= b:
            reach, k = max(reach, spared[k][1]), k + 1
        if b >= reach:
            out.append((b, e, w))
    return out


def neighbours(folded: str, begin: int) -> tuple[str, str, str]:
    """The word before the blank at begin, the one behind it, and the next; "" where there is none."""
    end = folded.find(" ", begin + 1)
    end = len(folded) if end < 0 else end
    last = folded.find(" ", end + 1)
    return folded[folded.rfind(" ", 0, begin) + 1 : begin], folded[begin + 1 : end], folded[end + 1 : len(folded) if last < 0 else last]


def density(text: str | None, lexicon: Lexicon) -> float:
    """The summed weights over the logarithm of the number of words."""
    folded = fold(text) if text else " "
    found = hits(folded, lexicon)
    return sum(w for *_, w in found) / np.log(np.e + folded.count(" ")) if found else 0.0


def _counts(text: str, label: str):
    """In how many toxic and clean texts each entry occurs."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = {1: Counter(), 0: Counter()}
        for part in parts:
            for t, y in zip(part[text], part[label]):
                if t:
                    found[int(y)].update(entries(fold(t)))
            if len(found[1]) + len(found[0]) > 300_000:
                yield from table(found)
                found = {1: Counter(), 0: Counter()}
        yield from table(found)

    def table(found: dict[int, Counter]) -> Iterator[pd.DataFrame]:
        for y, own in found.items():
            n, none = np.fromiter(own.values(), np.int64, len(own)), np.zeros(len(own), np.int64)
            yield pd.DataFrame({"entry": pd.Series(list(own), dtype="object"), "bad": n if y else none, "good": none if y else n})

    return run


def without_implied(entries: DataFrame) -> DataFrame:
    """(entry, w, ...) without entries that never count: a shorter beginning of the same word has as large a weight."""
    shorter = F.filter(F.transform(F.sequence(F.lit(1 + MIN_PREFIX), F.lit(1 + MAX_PREFIX)), lambda k: F.when(k < F.length("entry"), F.substring("entry", F.lit(1), k))), lambda e: e.isNotNull())
    asked = entries.select("entry", "w", F.explode(shorter).alias("shorter"))
    implied = asked.join(entries.select(F.col("entry").alias("shorter"), F.col("w").alias("v")), "shorter").where("v >= w").select("entry").distinct()
    return entries.join(implied, "entry", "left_anti")


def _contexts(text: str, lexicon: Lexicon):
    """For each entry that hits, the words before and behind it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = set()
            for t in part[text]:
                folded = fold(t) if t else " "
                for end, (_, size, _) in lexicon.automaton().iter(folded) if lexicon.weights else ():
                    begin = end - size + 1
                    before, _, behind = neighbours(folded, begin)
                    found.add((folded[begin : end + 1], f"{before} {behind}"))
            yield pd.DataFrame(sorted(found), columns=["entry", "context"])

    return run


def _phrases(text: str, label: str, lexicon: Lexicon):
    """In how many toxic and clean texts each two-word phrase with a hit occurs."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = {1: Counter(), 0: Counter()}
            for t, y in zip(part[text], part[label]):
                folded, own = fold(t) if t else " ", set()
                for begin, *_ in hits(folded, lexicon):
                    before, hit, behind = neighbours(folded, begin)
                    own.update(f"{a} {b}" for a, b in ((before, hit), (hit, behind)) if a and b)
                found[int(y)].update(own)
            every = sorted(found[1].keys() | found[0].keys())
            yield pd.DataFrame({"phrase": every, "bad": [found[1][p] for p in every], "good": [found[0][p] for p in every]}).astype({"phrase": "object", "bad": "int64", "good": "int64"})

    return run


def _log_odds(bad: Column, good: Column, totals: tuple[int, int]) -> Column:
    """The smoothed log of how much commoner something is in toxic than in clean texts; totals are of clean and toxic ones."""
    return F.log((bad + 0.5) / (totals[1] + 1)) - F.log((good + 0.5) / (totals[0] + 1))


def _commonest(rows: DataFrame, n: str, name: str, most: int) -> dict[str, float]:
    """{name: w} of at most `most` rows, those with the largest n first."""
    return {r[name]: r["w"] for r in rows.orderBy(F.desc(n), name).limit(most).select(name, "w").collect()}


def attach(docs: DataFrame, labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """docs with the labels of their ids, the largest of several; a broadcast only if the counted labels are small."""
    one = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias(label))
    return docs.join(small(one, 16), doc_id)


def distinct_texts(rows: DataFrame, text: str, label: str) -> DataFrame:
    """(text, label), a row for each distinct text of a label; copies are told by a content hash and leave before the shuffle."""
    return cut(rows.select(text, label, F.sha2(text, 256).alias("__hash")).dropDuplicates(["__hash", label]).select(text, label))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", exceptions: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS, most: int = MOST) -> Lexicon:
    """A lexicon of all labelled rows: entries of at least MIN_DOCUMENTS toxic texts and log odds of MIN_LOG_ODDS.

    An entry must also stand between MIN_DOCUMENTS different pairs of neighbours, at any size of the data. Counts cover all labelled rows,
    a text and its copies counting once a label, and only entries with these odds leave Spark. Two-word phrases with a hit in MIN_DOCUMENTS clean texts, and no larger
    a share of the toxic than of the clean ones, become exceptions, next to those given. Slope and bias are
    fitted to about `sample_rows` distinct labelled texts drawn by a hash of the text. Without toxic or without clean rows, as with an
    empty table, the lexicon is empty. Rows without a text, label or id are not learned from; a text of any length is read whole, in time that grows with it. The lexicon is sent to every worker, so
    `most` bounds its entries and its exceptions each: of more, those in the most texts stand in it, of equal ones the first by their letters. Entries are whole words of any length, and
    beginnings of MIN_PREFIX to MAX_PREFIX letters.
    """
    text_batches(docs.sparkSession)
    rows = distinct_texts(attach(docs.select(doc_id, text), labels.select(doc_id, label), doc_id, label), text, label)
    rows = rows.where(F.col(label).isin(0, 1))
    sizes = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    totals = sizes.get(0, 0), sizes.get(1, 0)
    if not totals[0] or not totals[1]:
        return Lexicon({})
    counted = rows.mapInPandas(_counts(text, label), "entry string, bad long, good long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = counted.where(F.col("bad") >= MIN_DOCUMENTS).select("entry", "bad", _log_odds(F.col("bad"), F.col("good"), totals).alias("w"))
    strong = cut(without_implied(cut(odds.where(F.col("w") >= MIN_LOG_ODDS))))  # a shorter beginning stands in all contexts of a longer one
    likely = _commonest(strong, "bad", "entry", most)
    bad = rows.where(F.col(label) == 1).select(text)
    met = bad.mapInPandas(_contexts(text, Lexicon(likely)), "entry string, context string").groupBy("entry").agg(F.count_distinct("context").alias("n"))
    varied = {r["entry"] for r in met.where(F.col("n") >= MIN_DOCUMENTS).select("entry").collect()}  # a row an entry at most
    weights = {e: w for e, w in likely.items() if e in varied}
    lexicon = Lexicon(weights, frozenset(" ".join(fold(e).split()) for e in exceptions))
    share = min(1 << 20, (sample_rows << 20) // max(1, sum(totals)) + 1)
    around = rows.mapInPandas(_phrases(text, label, lexicon), "phrase string, bad long, good long")
    around = around.groupBy("phrase").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    spared = around.where((F.col("good") >= MIN_DOCUMENTS) & (_log_odds(F.col("bad"), F.col("good"), totals) <= EXCEPTION_LOG_ODDS)).select("phrase", "good", F.lit(0.0).alias("w"))
    lexicon = Lexicon(weights, lexicon.exceptions | set(_commonest(spared, "good", "phrase", most)))

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"x": [density(t, lexicon) for t in part[text]], "y": part[label].astype("int64")})

    drawn = rows.where(F.pmod(F.xxhash64(text, F.lit(2)), F.lit(1 << 20)) < share).select(text, label)
    pairs = np.array(sorted((r["x"], r["y"]) for r in drawn.mapInPandas(measure, "x double, y long").collect())).reshape(-1, 2)
    slope, bias = logistic(pairs[:, 0], pairs[:, 1])
    return Lexicon(weights, lexicon.exceptions, slope, bias)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> tuple[float, float]:
    """Slope and bias of a logistic regression, the rarer label weighing more by the root of its rarity, by Newton steps."""
    n = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    weight = np.sqrt(0.5 / n[y.astype(int)] * len(y)) if len(y) else y
    a, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + penalty * w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + penalty * np.eye(2)
        w = w - np.linalg.solve(hess, grad)
    return float(w[0]), float(w[1])


def score(text: Column, docs: DataFrame, lexicon: Lexicon) -> Column:
    """The toxicity of a text column, 0 to 1; null and empty texts have the score of a text without hits."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(texts: pd.Series) -> pd.Series:
        lexicon = shared.value
        x = np.array([density(t, lexicon) for t in texts], float)
        return pd.Series(1 / (1 + np.exp(-np.clip(lexicon.slope * x + lexicon.bias, -30, 30))))

    return F.pandas_udf(run, T.DoubleType())(text)


def toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score and predicted (1 if score >= threshold); columns of these names are replaced, others kept.

    Null and empty texts score as a text without hits, copies and rows that repeat score alike; an empty table stays empty. Long texts are read whole. Of several entries that begin
    one word the heaviest counts; a score equal to the threshold is predicted 1.
    """
    out = docs.withColumn("score", score(F.col(text), docs, lexicon))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
