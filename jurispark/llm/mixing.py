"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

A source with share p of all words gets a weight in proportion to p^a. The exponent is found by bisection, 15 cuts a round:
the flattest mix whose repetition limit holds, or the one of a target entropy. Each source's rows are dealt into BLOCKS blocks by a hash
of their ids. Every epoch reads the blocks in a pseudo-random order of its own; a source is read for as many whole epochs as its
budget holds, and of the last one up to where the budget ends. That end is found by sums over the blocks in their order, then over the
places within the block in which the budget ends, and so on, so no task sees more than BLOCKS sums of a source and no source is sorted.

A block's place in the mixed stream is how far its source then is, from 0 to 1: read in the order of places, all sources keep their weights
along the whole stream.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jurispark.llm.shared import cut, join_heavy, small

BLOCK_BITS, LEVELS, CUTS, ROUNDS = 10, 4, 15, 8
BLOCKS = 1 << BLOCK_BITS
SOURCE_BYTES = 128
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    exponent: float
    entropy: float
    budget: float  # words in all
    seed: int
    sources: DataFrame  # key, held, weight, epochs, and where the last epoch ends
    schedule: DataFrame  # key, epoch, block, n_words, place


def _measure(sources: DataFrame, exponents: list[float], read: float | None = None) -> list[tuple[float, float]]:
    """For each exponent: the entropy of the weights, and the epochs of the most-read source, where the least-read one is read once or
    `read` epochs' words are read in all."""
    p = F.col("p")
    cols = []
    for k, a in enumerate(exponents):
        cols += [F.sum(p**a).alias(f"z{k}"), F.sum(p**a * F.log(p)).alias(f"l{k}"), F.min(p ** (a - 1)).alias(f"a{k}"), F.max(p ** (a - 1)).alias(f"b{k}")]
    r = sources.agg(*cols).first()
    out = []
    for k, a in enumerate(exponents):
        z, weighted = r[f"z{k}"], r[f"l{k}"]
        entropy = log(z) - a * weighted / z
        out.append((entropy, r[f"b{k}"] / r[f"a{k}"] if read is None else r[f"b{k}"] / z * read))
    return out


def solve(sources: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 2.0, read: float | None = None) -> float:
    """The exponent in 0 to 1: that of the target entropy (in nats; the nearest if out of reach), else the smallest that keeps every
    source within max_repeats epochs, while the least-read source is read once or `read` times all words are read.

    At an exponent of 1 all sources are read equally often, so a limit below `read` cannot be met and raises ValueError.
    """
    if target_entropy is None and read is not None and read > max_repeats * (1 + 1e-9):
        raise ValueError(f"the budget is {read:g} times all words, more than max_repeats {max_repeats:g}")
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * k / (CUTS + 1) for k in range(1, CUTS + 1)]
        found = _measure(sources, grid, read)
        fits = [e <= target_entropy if target_entropy is not None else r <= max_repeats for e, r in found]
        at = fits.index(True) if True in fits else CUTS
        edges = [low, *grid, high]
        low, high = edges[at], edges[at + 1]
    return high


def _keyed(docs: DataFrame, doc_id: str, source: str, seed: int) -> dict:
    return {"key": F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null")), "h": F.xxhash64(F.lit(seed), F.col(doc_id))}


def _sources(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("key").agg(F.sum("n").alias("words"), F.count("*").alias("held"))
    total = sums.agg(F.sum("words")).first()[0] or 0
    return cut(sums.withColumn("p", F.when(F.col("words") > 0, F.col("words") / F.lit(max(1, total)))))


def plan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", budget: int | None = None, target_entropy: float | None = None, max_repeats: float = 2.0, seed: int = 11) -> tuple[DataFrame, Mix | None]:
    """(doc_id, source, n_words, weight, copies, block) of every row, and the mix.

    copies says how often the row is read; block is its place among its source's BLOCKS blocks. Without a budget the total is the
    smallest under which each source is read whole once, so nothing is lost; a budget in words may leave rows out. No source is read
    more than max_repeats times, with a budget or without; a budget that needs more raises ValueError. With a target entropy in place
    of the limit, repetitions are what that entropy asks for. Null and empty texts have no words, cost nothing and are read in whole
    epochs only, once where their source has no words at all. A null source is a source of its own. Rows with equal ids in a source have
    the same place and are read or left out together; equal ids in two sources are two rows. An empty table gives no rows and no mix.
    """
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    keyed = _keyed(docs, doc_id, source, seed)
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words.alias("n"), *(c.alias(k) for k, c in keyed.items())))
    sources = _sources(rows)
    shares = sources.where("p > 0").select("p")
    if not shares.head(1):
        return rows.select("doc_id", "source", F.col("n").alias("n_words"), F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("copies"), _bits("h", 0).alias("block")), None
    total = sources.agg(F.sum("words")).first()[0]
    a = solve(shares, target_entropy, max_repeats, None if budget is None else budget / total)
    r = shares.agg(F.sum(F.col("p") ** a), F.max(F.col("p") ** (1 - a))).first()
    z, all_words = r[0], float(budget) if budget is not None else total * r[0] * r[1]
    epochs = F.round(F.col("p") ** (a - 1) / z * all_words / total, 9)
    sources = sources.withColumns({"weight": F.coalesce(F.col("p") ** a / z, F.lit(0.0)), "epochs": F.coalesce(epochs, F.lit(1.0))})
    sources = cut(sources.withColumn("rest", F.round((F.col("epochs") - F.floor("epochs")) * F.col("words")).cast("long")))
    sums = cut(rows.groupBy("key", _bits("h", 0).alias("block")).agg(F.sum("n").alias("n_words")))
    ends = _ends(rows, sources, sums, seed)
    mix = Mix(a, _measure(shares, [a])[0][0], all_words, seed, ends, _schedule(sources, sums, seed))
    given = _with_copies(rows, F.col("n") > 0, mix)
    return given.select("doc_id", "source", F.col("n").alias("n_words"), "weight", "copies", _bits("h", 0).alias("block")), mix


def _bits(h: str, level: int):
    return F.shiftrightunsigned(F.col(h), 64 - BLOCK_BITS * (level + 1)).bitwiseAND(F.lit(BLOCKS - 1))


def _turn(seed: int, epoch, block):
    """Where a source's block stands in an epoch's order."""
    return F.xxhash64(F.lit(seed), epoch.cast("long"), F.col("key"), block)


def _schedule(sources: DataFrame, sums: DataFrame, seed: int) -> DataFrame:
    """(key, epoch, block, n_words, place) of the blocks of every epoch that is read, in part or whole."""
    reads = sources.where("words > 0 AND epochs > 0").select("key", "words", "epochs", F.explode(F.sequence(F.lit(0), F.ceil("epochs").cast("int") - 1)).alias("epoch"))
    order = Window.partitionBy("key", "epoch").orderBy(_turn(seed, F.col("epoch"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("n_words").over(order) - F.col("n_words")
    blocks = reads.join(sums, "key").withColumn("place", (F.col("epoch") * F.col("words") + before) / (F.col("epochs") * F.col("words")))
    return cut(blocks.where("place <= 1").select("key", "epoch", "block", "n_words", "place"))


def _ends(rows: DataFrame, sources: DataFrame, sums: DataFrame, seed: int) -> DataFrame:
    """sources with where each one's last epoch ends: after the blocks before (turn, block) in its order, and within that block after the
    places below `low`; the longest such prefix whose words are within `rest`."""
    asked = sources.where("rest > 0").select("key", "rest", "epochs").join(sums, "key").withColumn("turn", _turn(seed, F.floor("epochs"), F.col("block")))
    order = Window.partitionBy("key").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = asked.withColumn("upto", F.sum("n_words").over(order)).where("upto > rest")
    first = asked.groupBy("key").agg(F.min(F.struct("turn", "block", (F.col("rest") - F.col("upto") + F.col("n_words")).alias("left"))).alias("e"))
    ends = cut(sources.join(first.select("key", "e.*"), "key", "left").withColumn("low", F.lit(0).cast("long")))
    total = max(1, rows.count())
    for level in range(1, LEVELS):
        slim = ends.where("turn IS NOT NULL AND left > 0").select("key", "held", "left", "block", "low")
        inside = _given(rows, slim, total, "inner").where(_bits("h", 0) == F.col("block"))
        if level > 1:
            inside = inside.where(_within(level - 1) == F.col("low"))
        parts = inside.groupBy("key", _bits("h", level).alias("b")).agg(F.sum("n").alias("n"), F.first("left").alias("left"))
        upto = parts.withColumn("upto", F.sum("n").over(Window.partitionBy("key").orderBy("b")))
        fits = upto.where("upto <= left").groupBy("key").agg(F.max("b").alias("last"), F.max("upto").alias("used"))
        step = F.when(F.col("left") > 0, F.coalesce(F.col("last") + 1, F.lit(0))).otherwise(0)
        full = ends.join(fits, "key", "left")
        ends = cut(full.select(*(c for c in ends.columns if c not in ("left", "low")), (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"), (F.col("low") * BLOCKS + step).alias("low")))
    return ends


def _within(levels: int):
    """A row's place in its block, to so many levels."""
    return F.shiftrightunsigned(F.shiftleft(F.col("h"), BLOCK_BITS), 64 - BLOCK_BITS * levels)


def _given(rows: DataFrame, sources: DataFrame, total: int, how: str = "left") -> DataFrame:
    """rows with their sources' columns: broadcast where the counted sources are small, else their heavy ones only."""
    fit = small(sources, SOURCE_BYTES)
    return rows.join(fit.drop("held"), "key", how) if fit is not sources else join_heavy(rows, sources, ["key"], "held", total, F.col("h"), how)


def _with_copies(rows: DataFrame, has_words, mix: Mix) -> DataFrame:
    """rows (key, h, ...) with weight and copies."""
    ends = mix.sources.select("key", "held", "weight", "epochs", "rest", F.col("turn").alias("end_turn"), F.col("block").alias("end_block"), "low")
    out = _given(rows, ends, max(1, mix.sources.agg(F.sum("held")).first()[0]))
    block = _bits("h", 0)
    turn = _turn(mix.seed, F.floor("epochs"), block)
    before = (turn < F.col("end_turn")) | ((turn == F.col("end_turn")) & (block < F.col("end_block")))
    below = F.col("end_turn").isNull() | before | ((block == F.col("end_block")) & (_within(LEVELS - 1) < F.col("low")))
    copies = F.floor("epochs") + F.when((F.col("rest") > 0) & has_words & below, 1).otherwise(0)
    return out.withColumn("copies", copies.cast("long")).drop("epochs", "rest", "end_turn", "end_block", "low")


def reads(planned: DataFrame, mix: Mix | None) -> DataFrame:
    """The planned rows with `reads`, array<struct<epoch, place>>: in which epochs each is read, as often as it has copies, and where its block then stands in the mixed stream.

    A source's blocks stand elsewhere in each epoch. Rows of sources without words are read at the start. Blocks, not rows, are joined.
    """
    none = F.array(F.struct(F.lit(0).alias("epoch"), F.lit(0.0).alias("place")))
    if mix is None:
        return planned.withColumn("reads", none)
    turns = mix.schedule.groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "place"))).alias("turns"))
    keyed = planned.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")))
    placed = keyed.join(small(turns, SOURCE_BYTES), ["key", "block"], "left").drop("key")
    return placed.withColumn("reads", F.slice(F.coalesce("turns", none), F.lit(1), F.col("copies").cast("int"))).drop("turns")


def realise(docs: DataFrame, mix: Mix | None, text: str = "text", doc_id: str = "doc_id", source: str = "source", places: bool = False) -> DataFrame:
    """docs, each row as often as planned; with places also key, epoch, block and place, in whose order the mixed stream is read.

    What a row gets follows from its source, id and whether it has words, so nothing is joined but the sources. Without a mix every row
    is read once. Columns of docs are kept, whatever their names; those of results come behind them.
    """
    own = [F.col(c) for c in docs.columns]
    if mix is None:
        extra = [F.lit(None).cast("string").alias("key"), F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("block"), F.lit(0.0).alias("place")]
        return docs.select(*own, *extra) if places else docs
    keyed = _keyed(docs, doc_id, source, mix.seed)
    has_words = F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    rows = docs.select(F.struct(*own).alias("row"), has_words.alias("has_words"), *(c.alias(k) for k, c in keyed.items()))
    given = _with_copies(rows, F.col("has_words"), mix).where("copies > 0")
    given = given.select("row", "key", _bits("h", 0).alias("block"), F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("epoch"))
    if not places:
        return given.select("row.*")
    placed = given.join(small(mix.schedule, SOURCE_BYTES).drop("n_words"), ["key", "epoch", "block"], "left")
    return placed.select("row.*", "key", "epoch", "block", F.coalesce("place", F.lit(0.0)).alias("place"))
