"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) is the logistic function of threshold k less the text's score; the thresholds are ordered and the weights shared by all of
them. The score is linear in the shares of a text's words and word pairs, hashed into buckets, and in a few measures of its form. The
model gives the expected grade and the probability of reaching a grade, by which documents are selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jurispark.llm import words as W
from jurispark.llm.shared import small, text_batches

BUCKETS = 1 << 17
SHIFT = np.uint64(64 - 17)
SAMPLE_PER_GRADE = 2500
FORM = ("log_words", "word_bytes", "upper", "digits", "signs", "repeated_words", "repeated_runs", "short_lines")
RUN, GAP = 8, 1e-3


def _kinds() -> np.ndarray:
    kinds = np.zeros((4, 256), bool)
    for c in range(128):
        x = chr(c)
        kinds[:, c] = x.isupper(), x.islower(), x.isdigit(), not x.isalnum() and not x.isspace() and x not in ".,;:'\"-()?"
    return kinds


KINDS = _kinds()


def _again(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """How many values of each row equal an earlier one of the row."""
    keyed = W.mix(values ^ W.mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keyed, kind="stable")
    same = keyed[order][1:] == keyed[order][:-1]
    return np.bincount(rows[order][1:][same], minlength=n).astype(float)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For row ranges of bounded size: first and last row, each feature's row and bucket, and the measures of form."""
    data, offsets = W.text_bytes(column)
    for i, j in W.slices(offsets):
        part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n = j - i
        starts, ends, firsts = W.word_bounds(part, bounds)
        h = W.word_hashes(part, starts, ends)
        count = np.diff(firsts)
        row = np.repeat(np.arange(n), count)
        pairs = np.flatnonzero(W.whole(firsts, 2))
        runs = np.flatnonzero(W.whole(firsts, RUN))
        buckets = np.concatenate([h, W.rolling(h, 2, W.ODD["gram"])[pairs]]) >> SHIFT
        some, size = np.maximum(count, 1), np.maximum(np.diff(bounds), 1)
        sums = [np.add.reduceat(np.append(k[part], False).astype(np.int32), bounds[:-1]) * (np.diff(bounds) > 0) for k in KINDS]
        lines = np.add.reduceat(np.append(part == 10, False).astype(np.int32), bounds[:-1]) * (np.diff(bounds) > 0)
        form = np.stack([
            np.log1p(count) / 5, np.bincount(row, ends - starts, n) / some / 6, sums[0] / np.maximum(sums[0] + sums[1], 1), sums[2] / size, 10 * sums[3] / size,
            _again(h, row, n) / some, _again(W.rolling(h, RUN, W.ODD["short"])[runs], row[runs], n) / some, 5 * lines / some,
        ], 1)
        yield i, j, np.concatenate([row, row[pairs]]), buckets.astype(np.int64), form


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the buckets
    form: np.ndarray
    thresholds: np.ndarray  # ascending, one less than grades
    top: int


def scores(column: pa.Array, model: Model) -> np.ndarray:
    out = np.zeros(len(column))
    for i, j, row, bucket, form in features(column):
        n = np.bincount(row, minlength=j - i)
        out[i:j] = np.bincount(row, model.weights[bucket], j - i) / np.maximum(n, 1) + form @ model.form
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def tails(s: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > k) for each score and threshold."""
    return _sigmoid(s[:, None] - thresholds[None, :])


def slopes(s: float, y: int, theta: np.ndarray) -> tuple[float, float, np.ndarray]:
    """The loss -log P(grade = y) at a score, and its slopes by the score and by each threshold."""
    low = _sigmoid(theta[y - 1] - s) if y else 0.0
    high = _sigmoid(theta[y] - s) if y < len(theta) else 1.0
    p = max(high - low, 1e-9)
    dh, dl, by = high * (1 - high), low * (1 - low), np.zeros(len(theta))
    if y < len(theta):
        by[y] -= dh / p
    if y:
        by[y - 1] += dl / p
    return -np.log(p), (dh - dl) / p, by


def ordered(theta: np.ndarray) -> np.ndarray:
    """Thresholds of which each is above the one before by GAP at least."""
    rise = GAP * np.arange(len(theta))
    return np.maximum.accumulate(theta - rise) + rise


def fit(examples: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], top: int, epochs: int = 12, rate: float = 0.1, penalty: float = 1e-5, scale: float = 30.0, seed: int = 3) -> Model:
    """Weights and thresholds by adaptive gradient steps on single examples (buckets, shares, form, grade), each grade weighing alike."""
    w, g2 = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    v, v2 = np.zeros(len(FORM)), np.full(len(FORM), 1e-6)
    theta, t2 = np.linspace(-1, 1, top) if top > 1 else np.zeros(1), np.full(top, 1e-6)
    grades = np.array([y for *_, y in examples])
    weight = len(grades) / (top + 1) / np.maximum(1, np.bincount(grades, minlength=top + 1))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            ids, x, form, y = examples[k]
            x = scale * x
            s = x @ w[ids] + form @ v
            _, gs, by = slopes(s, y, theta)
            g = weight[y] * gs * x + penalty * w[ids]
            g2[ids] += g * g
            w[ids] -= rate * g / np.sqrt(g2[ids])
            g = weight[y] * gs * form
            v2 += g * g
            v -= rate * g / np.sqrt(v2)
            g = weight[y] * by
            t2 += g * g
            theta = ordered(theta - rate * g / np.sqrt(t2))
    return Model((scale * w).astype(np.float32), v, theta, top)


def train(docs: DataFrame, ratings: DataFrame, text: str = "text", doc_id: str = "doc_id", grade: str = "grade", per_grade: int = SAMPLE_PER_GRADE) -> Model | None:
    """A model of graded ratings 0, 1, ... of doc_ids, the lowest of several; None without ratings of at least two grades.

    It is fitted to a bounded sample: about `per_grade` rated whole texts of each grade, drawn by a hash of the id.
    """
    text_batches(docs.sparkSession)
    rated = ratings.where(F.col(grade).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.min(grade).cast("int").alias("__grade"))
    counts = {r[0]: r[1] for r in rated.groupBy("__grade").agg(F.count("*")).collect()}
    if len(counts) < 2:
        return None
    share = F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1 << 20, (per_grade << 20) // n + 1))))
    drawn = rated.where(F.pmod(F.xxhash64(doc_id, F.lit(3)), F.lit(1 << 20)) < F.element_at(share, F.col("__grade")))
    rows = docs.select(F.col(doc_id), F.col(text).alias("__text")).join(small(drawn, 16), doc_id).select("__text", F.col(doc_id).alias("__id"), "__grade")

    def collect(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, shares, forms = [], [], []
            for i, j, row, bucket, form in features(part.column("__text")):
                order = np.argsort(row, kind="stable")
                edges = np.searchsorted(row[order], np.arange(j - i + 1))
                for k in range(j - i):
                    at, n = np.unique(bucket[order[edges[k] : edges[k + 1]]], return_counts=True)
                    ids.append(at.astype(np.int32).tobytes())
                    shares.append((n / max(1, n.sum())).astype(np.float32).tobytes())
                    forms.append(form[k].astype(np.float64).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("__id").cast(pa.int64()), part.column("__grade"), pa.array(ids, pa.binary()), pa.array(shares, pa.binary()), pa.array(forms, pa.binary())], ["id", "grade", "ids", "shares", "form"])

    found = rows.mapInArrow(collect, "id long, grade int, ids binary, shares binary, form binary").collect()
    found.sort(key=lambda r: (r["id"], bytes(r["ids"])))
    examples = [(np.frombuffer(bytes(r["ids"]), np.int32), np.frombuffer(bytes(r["shares"]), np.float32), np.frombuffer(bytes(r["form"])), r["grade"]) for r in found]
    return fit(examples, max(counts))


def graded(docs: DataFrame, model: Model | None, text: str = "text", tail: int | None = None, least: float = 0.5) -> DataFrame:
    """docs with expected_grade, tail_probability of reaching grade `tail` (the highest if None) and selected (at least `least` likely).

    Null and empty texts have the score of an empty text; long ones are read whole, in time that grows with them. Without a model all three are null. Columns with these names are
    replaced; copies get equal results; a tail probability equal to `least` selects; an empty table stays empty.
    """
    names = ("expected_grade", "tail_probability", "selected")
    if model is None:
        return docs.withColumns({n: F.lit(None).cast("boolean" if n == "selected" else "double") for n in names})
    text_batches(docs.sparkSession)
    shared, reach = docs.sparkSession.sparkContext.broadcast(model), (model.top if tail is None else tail) - 1

    def run(texts: pa.Array) -> pa.Array:
        p = tails(scores(texts, shared.value), shared.value.thresholds)
        return pa.StructArray.from_arrays([pa.array(p.sum(1)), pa.array(p[:, reach])], ["e", "t"])

    kind = T.StructType([T.StructField("e", T.DoubleType()), T.StructField("t", T.DoubleType())])
    out = docs.withColumn("__grade", F.arrow_udf(run, kind)(F.col(text)))
    return out.withColumns({names[0]: F.col("__grade.e"), names[1]: F.col("__grade.t"), names[2]: F.col("__grade.t") >= least}).drop("__grade")


def document_grades(labels: DataFrame) -> DataFrame:
    """Grades of the labels table: 0 of low quality, 1 toxic, 2 neither."""
    grade: Column = F.col("quality") * (2 - F.coalesce(F.col("toxic"), F.lit(0)))
    return labels.select("doc_id", grade.cast("int").alias("grade"))
