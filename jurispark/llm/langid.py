"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, trained with follow-the-regularised-leader.

Texts are lower-cased, runs of other characters than letters become one blank, and 1- to 3-grams are hashed into buckets. A
bucket's value is its share of the text's n-grams times its inverse document frequency over all training rows. Weights are
fitted under an elastic-net penalty on a bounded sample, a temperature on a held-out fifth of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jurispark.llm.shared import give_back, text_batches

BUCKETS, ORDERS = 1 << 16, (1, 2, 3)
BATCH_CHARS, BATCH_ROWS = 1 << 19, 128
EDGE = 0x10FFFF
SAMPLE_PER_LANGUAGE = 800
UNKNOWN = "und"


@lru_cache(maxsize=None)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter(map(str.isalpha, map(chr, range(EDGE + 1))), bool, EDGE + 1)


def batches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Row ranges of bounded size; a longer text stands alone."""
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and j - i < BATCH_ROWS and (j == i or held + len(texts[j] or "") <= BATCH_CHARS):
            held += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Letters in each text, and for each order the texts' numbers and buckets, in text order."""
    edge = chr(EDGE)
    joined = "".join(f"{edge}{(t or '').replace(edge, ' ')}{edge}" for t in texts).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter, at_edge = letters()[codes], codes == EDGE
    start = np.zeros(len(codes), bool)
    start[np.flatnonzero(at_edge)[::2]] = True
    doc = np.cumsum(start) - 1
    counts = np.bincount(doc[is_letter], minlength=len(texts))
    keep = is_letter | start
    keep[1:] |= is_letter[:-1]
    doc, c = doc[keep].astype(np.int32), np.where(is_letter, codes, 32).astype(np.uint32)[keep]
    found = []
    for n in ORDERS:
        m = len(c) - n + 1
        h = np.full(max(0, m), n, np.uint32)
        for k in range(n):
            h = (h ^ c[k : k + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        ids = (h * np.uint32(0x85EBCA77)) >> np.uint32(16)
        inside = doc[:m] == doc[n - 1 : n - 1 + m] if n > 1 else c != 32
        found.append((doc[:m][inside], ids[inside]))
    return counts, found


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # languages x buckets, times the inverse document frequency
    bias: np.ndarray
    temperature: float


def probabilities(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Letters in each text, and calibrated probabilities: texts x languages."""
    all_letters, out = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(model.languages)))
    for i, j in batches(texts):
        all_letters[i:j], found = ngrams(texts[i:j])
        total = sum(np.bincount(doc, minlength=j - i) for doc, _ in found)
        for k in range(len(model.languages)):
            sums = sum(np.bincount(doc, model.weights[k][ids], j - i) for doc, ids in found)
            out[i:j, k] = sums / np.maximum(total, 1) + model.bias[k]
    return all_letters, softmax(out / model.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def document_frequencies(train: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts of all training rows each bucket occurs, and the number of rows."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = np.zeros(BUCKETS, np.int64), 0
        for part in parts:
            texts = part[text].tolist()
            rows += len(texts)
            for i, j in batches(texts):
                seen = np.zeros((j - i, BUCKETS), bool)
                for doc, ids in ngrams(texts[i:j])[1]:
                    seen[doc, ids] = True
                held += seen.sum(0)
        at = np.flatnonzero(held)
        give_back()
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(held[at], rows)})

    sums = train.select(text).mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out, rows = np.zeros(BUCKETS, np.int64), 0
    for bucket, n in sums.collect():  # a row a bucket at most
        if bucket < 0:
            rows = n
        else:
            out[bucket] = n
    return out, rows


def _features(text: str, label: str, doc_id: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, ids, shares = part[text].tolist(), [], []
            for t in texts:
                found = np.concatenate([b for _, b in ngrams([t])[1]])
                at, n = np.unique(found, return_counts=True)
                ids.append(at.astype(np.uint16).tobytes())
                shares.append((n / max(1, len(found))).astype(np.float32).tobytes())
            yield pd.DataFrame({"doc_id": part[doc_id], "label": part[label], "ids": ids, "shares": shares})

    return run


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets x classes, mostly zero) and biases after proximal updates, one example at a time."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
    zb, nb = np.zeros(classes), np.zeros(classes)

    def solve(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            ids, x, y = examples[k]
            zi, ni = z[ids], n[ids]
            w, b = solve(zi, ni, l1), solve(zb, nb, 0.0)
            error = softmax(x @ w + b)
            error[y] -= 1
            g = x[:, None] * error
            grown = ni + g * g
            z[ids] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[ids] = grown
            zb += error - (np.sqrt(nb + error**2) - np.sqrt(nb)) / alpha * b
            nb += error**2
    return solve(z, n, l1), solve(zb, nb, 0.0)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores under which the labels are likeliest."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 120))
    loss = [-np.log(softmax(scores / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(rows: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE, scale: float = 20.0) -> Model | None:
    """A model of the labels of rows, or None without labelled rows.

    Document frequencies cover all rows. The weights are fitted to a bounded sample: about `per_language` whole texts of each
    language, drawn by a hash of the id.
    """
    text_batches(rows.sparkSession)
    rows = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(label).alias("label"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    shares = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1 << 20, (per_language << 20) // counts[k] + 1))))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < F.element_at(shares, F.col("label")))
    df, n = document_frequencies(rows, "text")
    idf = np.log((1 + n) / (1 + df)) + 1
    found = drawn.mapInPandas(_features("text", "label", "doc_id"), "doc_id long, label string, ids binary, shares binary").collect()
    found.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, bytes(r["ids"])))
    examples = []
    for r in found:
        ids = np.frombuffer(bytes(r["ids"]), np.uint16).astype(np.int64)
        examples.append((ids, scale * np.frombuffer(bytes(r["shares"]), np.float32) * idf[ids], languages.index(r["label"])))
    fit, rest = [e for k, e in enumerate(examples) if k % 5], examples[::5]
    w, b = ftrl(fit or rest, len(languages))
    scores = np.array([x @ w[ids] + b for ids, x, _ in rest])
    t = temperature(scores, np.array([y for *_, y in rest]))
    return Model(languages, np.ascontiguousarray((w * idf[:, None] * scale).T.astype(np.float32)), b, t)


PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def detect(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the calibrated probability of lang_pred.

    A text that is null or has no letter is `und` with score 0, as is every text if there is no model. Of equally likely languages the first by name is taken. Long texts are read
    whole, in time that grows with them. Columns of docs with these names are replaced; copies get equal results; an empty table stays empty.
    """
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        found, p = probabilities(texts.tolist(), model)
        names = np.array([*model.languages, UNKNOWN], object)
        give_back()
        best = np.where(found > 0, p.argmax(1), len(model.languages))
        return pd.DataFrame({"lang_pred": names[best], "score": np.where(found > 0, p.max(1), 0.0)})

    # a filter on the results would otherwise be pushed below them with a second evaluation, in a second worker a task
    once = F.pandas_udf(predict, PREDICTION).asNondeterministic()
    out = docs.withColumn("__lang", once(F.col(text)))
    return out.withColumns({"lang_pred": F.col("__lang.lang_pred"), "score": F.col("__lang.score")}).drop("__lang")


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 0):
    """Rows never learned from: by the crc32 of the id as text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))
