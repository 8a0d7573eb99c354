"""Quality rules as a short-circuit cascade, in built-in column functions only.

Every rule is a column that is true for a text to reject. A document is kept if no rule rejects it, so the order of the rules
changes the cost and never the result. `plan_cascade` measures each rule's time a row on a sample, and which rules reject which of its
rows, and takes the rule that rejects most per second, then that which rejects most per second of the rows left, and so on; `cascade`
nests them so that a rule is evaluated only where the earlier ones passed.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jurispark.llm.shared import cut

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[^#*$%&|<>]+"
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SAMPLE_ROWS, REPEATS = 2000, 4


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long), which replace columns of these names.

    A null text counts as an empty one. Only array functions over one row's own words are used, so nothing is shuffled: the
    8-word windows become sorted (hash, position) pairs, and equal neighbours are the windows found twice or more.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    out = docs.withColumn("__words", F.regexp_extract_all(t, F.lit(WORD), 0)).withColumn("__lines", lines)
    n = F.size("__words")
    out = out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, SYMBOL, "")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    })
    return out.withColumn("n_repeat_words", _let(F.col("__words"), _repeat_words).cast("long")).drop("__words", "__lines")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which stands once in the plan however often body names it: filters on measures are pushed down by copying them."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """How many words lie in windows of REPEAT_WINDOW words that occur twice or more."""
    n = F.size(words)
    windows = F.when(n >= REPEAT_WINDOW, F.sequence(F.lit(0), n - REPEAT_WINDOW)).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(windows, lambda i: F.struct(F.xxhash64(F.slice(words, i + 1, REPEAT_WINDOW)).alias("h"), i.alias("i")))

    def repeated(ordered: Column) -> Column:
        def twice(x: Column, k: Column) -> Column:
            before, behind = F.get(ordered, k - 1).getField("h"), F.get(ordered, k + 1).getField("h")
            return F.coalesce(x.getField("h") == before, F.lit(False)) | F.coalesce(x.getField("h") == behind, F.lit(False))

        return F.sort_array(F.transform(F.filter(ordered, twice), lambda x: x.getField("i")))

    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda s, i: F.struct((s["n"] + i + REPEAT_WINDOW - F.greatest(i, s["to"])).alias("n"), (i + REPEAT_WINDOW).alias("to"))
    return F.aggregate(_let(F.sort_array(hashed), repeated), begin, step, lambda s: s["n"])


def base_failed() -> Column:
    """Too few words, or more than 30 % of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def default_rules(text: str = "text") -> list[Rule]:
    """Rules over the measured columns and the text: thresholds are wide, so ordinary prose of any language passes."""
    t, n = F.coalesce(F.col(text), F.lit("")), F.col("n_words")
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    upper = F.length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
    return [
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("duplicate_lines", (F.col("n_dup_lines") > 2) & (10 * F.col("n_dup_lines") > 3 * F.size(F.split(t, "\n")))),
        Rule("shouting", 2 * upper > letters),
        Rule("few_letters", 2 * letters < F.col("word_chars")),
        Rule("exclamations", 10 * F.length(F.regexp_replace(t, "[^!?]+", "")) > 3 * n),
    ]


def greedy_order(rejected: dict[tuple[bool, ...], int], costs: list[float]) -> list[int]:
    """The rules' numbers by rejections per cost among the rows that the rules before let pass; those that reject no more by cost.

    `rejected` has the number of rows for each set of rules that reject them; equal rules stay in the order given.
    """
    order, left = [], dict(rejected)
    while len(order) < len(costs):
        gain = {k: sum(n for hit, n in left.items() if hit[k]) / costs[k] for k in range(len(costs)) if k not in order}
        best = max(gain, key=lambda k: (gain[k], -costs[k] if not gain[k] else 0.0, -k))
        order.append(best)
        left = {hit: n for hit, n in left.items() if not hit[best]}
    return order


def _seconds(rows: DataFrame, flag: Column) -> float:
    """The shorter of two runs that evaluate flag on every row."""
    took = []
    for _ in range(2):
        began = time.perf_counter()
        rows.agg(F.count_if(flag)).first()
        took.append(time.perf_counter() - began)
    return min(took)


def plan_cascade(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS, repeats: int = REPEATS, seed: int = 3) -> list[Rule]:
    """rules in their greedy order, from about `sample_rows` rows drawn at random from all of docs that pass the base test.

    A rule's cost is the time a row that it takes on `repeats` readings of the sample, less that of a job which only reads the text.
    The sample sets the order alone. Without rows that pass, rules stay as they are.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = cut(measures(docs.select(text).sample(share, seed), text)).where(~base_failed())
    flags = [F.coalesce(rule.rejects, F.lit(False)) for rule in rules]
    rejected = {tuple(r["hit"]): r["count"] for r in sample.groupBy(F.array(*flags).alias("hit")).count().collect()} if rules else {}
    if not rejected:
        return rules
    often = sample.withColumn("__time", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    idle = _seconds(often, F.length(text) < 0)
    costs = [max(_seconds(often, flag) - idle, 1e-4) / (sum(rejected.values()) * repeats) for flag in flags]
    return [rules[k] for k in greedy_order(rejected, costs)]


def cascade(rules: list[Rule]) -> Column:
    """True where no rule rejects; a later rule is reached only where the earlier ones let the row pass."""
    kept = F.lit(True)
    for rule in reversed(rules):
        kept = F.when(F.coalesce(rule.rejects, F.lit(False)), False).otherwise(kept)
    return kept


def quality_rules(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with the measures, base_failed and kept.

    Null and empty texts have no words and fail; copies and ties are judged alike; an empty table gives an empty table; columns
    of docs with the names of results are replaced.
    """
    ordered = plan_cascade(docs, default_rules(text) if rules is None else rules, text, sample_rows)
    out = measures(docs, text).withColumn("base_failed", base_failed())
    return out.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(cascade(ordered)))
