"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Each table rotates a vector by random signs and Hadamard transforms, three times for each of its hashes, and takes the axis of the
largest coordinate with its sign. A vector is at home in one bucket a table and probes the next likeliest ones; two vectors
meet where one is at home and the other at home or probing. Buckets with one vector are dropped before any vector is moved.

Near copies by the thousand fill the same buckets, and their pairs grow with the square. So vectors of dense buckets are first gathered
into balls: each goes to a leader that a hash draws from its bucket, and stays if its angle to the ball's mean is within half the
threshold's. By the triangle inequality all members of a ball link with each other, so they are counted and never compared; a
ball stands in a bucket as one mean with a radius. A single vector or a ball near a ball either links with all of it, with none of
it, or, where angles and radii leave it open, is compared with its members.

Among single vectors all pairs that meet are verified in double precision. A pair that meets in several buckets counts in the first of
them, which the codes that travel along tell, so links are counted without forming pairs, and a bucket gives one row a
vector: its number of links and a vector of its part of the bucket's link graph. Small buckets are compared many at a time; those of more
than BLOCK entries are cut into blocks, and each pair of blocks is a task's group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jurispark.llm.shared import components, cut, join_heavy

TABLES, HASHES, PROBES = 10, 3, 8
BLOCK, SMALL, PAIRS, PACK = 1024, 64, 1 << 14, 1 << 13
DENSE, LEADERS, ROUNDS = 64, 8, 4
MARGIN = 1e-6
SEED = 5


@lru_cache(maxsize=4)
def _signs(dim: int, tables: int, hashes: int) -> np.ndarray:
    return np.random.default_rng(SEED).choice([-1.0, 1.0], (tables, hashes, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the last axis, of a power of two values, scaled to keep lengths."""
    n, h = x.shape[-1], 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], -2).reshape(x.shape)
        h *= 2
    return x / np.sqrt(n)


def codes(vectors: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """rows x tables x probes bucket numbers, the home first; a probe replaces one hash's axis by a next largest; -1 if there are no more."""
    n, d = vectors.shape
    dim = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, dim))
    padded[:, :d] = vectors
    out = np.full((n, tables, probes), -1, np.int64)
    for t in range(tables):
        tops, losses = [], []
        for k in range(hashes):
            x = padded
            for s in _signs(dim, tables, hashes)[t, k]:
                x = hadamard(x * s)
            size = np.abs(x)
            order = np.argsort(-size, axis=1, kind="stable")[:, : min(probes, dim)]
            top = np.take_along_axis(size, order, 1)
            tops.append(2 * order + (np.take_along_axis(x, order, 1) < 0))
            losses.append(top[:, :1] - top)
        places = [2 * dim] * hashes
        home = [tops[k][:, 0] for k in range(hashes)]
        joint = lambda axes: sum(a * int(np.prod(places[k + 1 :])) for k, a in enumerate(axes))
        options, costs = [joint(home)], [np.zeros(n)]
        for k in range(hashes):
            for j in range(1, tops[k].shape[1]):
                options.append(joint([tops[k][:, j] if m == k else home[m] for m in range(hashes)]))
                costs.append(losses[k][:, j])
        pick = np.argsort(np.stack(costs, 1), axis=1, kind="stable")[:, :probes]
        found = np.take_along_axis(np.stack(options, 1), pick, 1)
        out[:, t, : found.shape[1]] = found
    return out


def _unit(column: pa.Array) -> np.ndarray:
    rows = column.values.to_numpy(zero_copy_only=False)
    x = rows[column.offsets[0].as_py() : column.offsets[-1].as_py()].astype(np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _code_column(tables: int, hashes: int, probes: int):
    def run(vectors: pa.Array) -> pa.Array:
        sizes = np.diff(vectors.offsets.to_numpy())
        values = vectors.values.to_numpy(zero_copy_only=False)
        out = np.zeros((len(vectors), tables * probes), np.int64)
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            x = values[vectors.offsets.to_numpy()[at][:, None] + np.arange(d)].astype(np.float64)
            out[at] = codes(x / np.sqrt((x * x).sum(1, keepdims=True)), tables, hashes, probes).reshape(len(at), -1)
        return pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], pa.array(out.ravel()))

    return F.arrow_udf(run, T.ArrayType(T.LongType()))


def _first_meeting(x: np.ndarray, y: np.ndarray, table: int, bucket: np.ndarray) -> np.ndarray:
    """Whether vectors of these codes (pairs, tables, probes) meet in these buckets of a table first: in no earlier table, nor in a smaller bucket of it."""
    earlier = ((x[:, :table, :1] == y[:, :table]) | (y[:, :table, :1] == x[:, :table])).any((1, 2))
    x, y = x[:, table], y[:, table]
    smaller, here = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for own, other in ((x, y), (y, x)):
        home = own[:, 0]
        met = (home[:, None] == other).any(1)
        smaller |= met & (home < bucket)
        here |= met & (home == bucket)
    return here & ~smaller & ~earlier


def _pairs(x: np.ndarray, cell: np.ndarray, block: np.ndarray, apart: bool, least: np.ndarray | float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(p, q, cosine) of the pairs in each cell, of those in different blocks if apart, whose cosine is at least `least`: small cells of one size
    at a time, larger ones by slabs of a matrix. Rows are in the order of cells."""
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(cell)]]))
    for n in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
        first, second = np.triu_indices(n, 1)
        begins, step = starts[sizes == n], max(1, PAIRS // len(first))
        for k in range(0, len(begins), step):
            p, q = ((begins[k : k + step, None] + e).ravel() for e in (first, second))
            if apart:
                p, q = p[block[p] != block[q]], q[block[p] != block[q]]
            cos = np.einsum("ij,ij->i", x[p], x[q])
            near = cos >= least
            yield p[near], q[near], cos[near]
    for begin, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        end = begin + n
        for a in range(begin, end, 128):
            b = min(end, a + 128)
            cos = x[a:b] @ x[a:end].T
            near = (cos >= least) & (np.arange(b - a)[:, None] < np.arange(end - a))
            if apart:
                near &= block[a:b, None] != block[None, a:end]
            p, q = np.nonzero(near)
            for k in range(0, len(p), PAIRS):
                yield p[k : k + PAIRS] + a, q[k : k + PAIRS] + a, cos[p[k : k + PAIRS], q[k : k + PAIRS]]


def _verify(threshold: float, tables: int, probes: int):
    """Compares the entries of buckets, or of two blocks of one. Rows: kind 0, a single's links in a bucket and the first of its part of the
    graph; kind 1, a ball and a single that may link with its members, and 2, two such balls, with both numbers of vectors and whether all surely link."""
    widest = np.arccos(threshold)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        group = group.take(pa.array(np.argsort(group.column("cell").to_numpy(), kind="stable")))
        entry, copies, radius, cell, table, bucket, block = (group.column(c).to_numpy() for c in ("entry", "copies", "radius", "cell", "table", "bucket", "block"))
        apart, ball = group.column("i")[0].as_py() != group.column("j")[0].as_py(), group.column("ball").to_numpy(zero_copy_only=False)
        held, m = group.column("codes").combine_chunks(), len(entry)
        code = held.values.to_numpy()[held.offsets[0].as_py() :].reshape(m, tables, probes)
        every, least = _vectors(group.column("vector").combine_chunks()), np.cos(min(np.pi, widest + 2 * radius.max() + MARGIN)) if ball.any() else threshold
        links, pairs, sure = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)], [np.zeros(0, bool)]
        for x, at in every:
            for p, q, cos in _pairs(x, cell[at], block[at], apart, least):
                p, q = at[p], at[q]
                single = ~(ball[p] | ball[q])
                near = single & (cos >= threshold)
                u, v, t = p[near], q[near], table[p[near]]
                for k in np.unique(t):
                    a, b = u[t == k], v[t == k]
                    here = _first_meeting(code[a], code[b], int(k), bucket[a])
                    links.append(np.stack([a[here], b[here]], 1))
                if not single.all():
                    u, v, angle = p[~single], q[~single], np.arccos(np.clip(cos[~single], -1, 1))
                    wide = radius[u] + radius[v]
                    open_ = angle - wide <= widest + MARGIN
                    pairs.append(np.stack([u, v], 1)[open_])
                    sure.append((angle + wide <= widest - MARGIN)[open_])
        u, v = np.concatenate(links).T
        counted = np.bincount(u, copies[v], m) + np.bincount(v, copies[u], m)
        order = np.argsort(entry, kind="stable")
        best = np.empty(m, np.int64)
        best[order] = np.arange(m)
        while True:
            low = np.minimum(best[u], best[v])
            new = best.copy()
            np.minimum.at(new, u, low)
            np.minimum.at(new, v, low)
            if (new == best).all():
                break
            best = new
        some = np.zeros(m, bool)
        some[u] = some[v] = True
        p, q = np.concatenate(pairs).T
        swap = np.where(ball[p] & ball[q], entry[p] > entry[q], ball[q])
        p, q = np.where(swap, q, p), np.where(swap, p, q)
        kind = np.concatenate([np.zeros(some.sum(), np.int32), (1 + ball[q]).astype(np.int32)])
        both = lambda u, v: np.concatenate([u, v]).astype(np.int64)
        return pa.table({"kind": kind, "a": both(entry[some], entry[p]), "b": both(entry[order[best]][some], entry[q]), "a_copies": both(counted[some], copies[p]),
                         "b_copies": both(copies[some], copies[q]), "sure": np.concatenate([some[some], *sure])})

    return run


def _vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors and their rows, for each length of vectors."""
    sizes = np.diff(column.offsets.to_numpy())
    return [(_unit(column.take(pa.array(np.flatnonzero(sizes == n)))), np.flatnonzero(sizes == n)) for n in np.unique(sizes)]


def _nearest(reach: float):
    """For each vector of a dense bucket's block the leader within reach that comes first."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        x, leads = _unit(group.column("vector").combine_chunks()), group.column("leads").to_numpy(zero_copy_only=False)
        rep, turn = group.column("rep").to_numpy(), group.column("turn").to_numpy()
        at = np.flatnonzero(leads)
        at = at[np.lexsort((rep[at], turn[at]))]
        near = x[~leads] @ x[at].T >= reach
        found = near.any(1)
        first = at[near[found].argmax(1)] if len(at) else at
        return pa.table({"rep": rep[~leads][found], "turn": turn[first], "leader": rep[first]})

    return run


def _sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of unit vectors by leader; a worker holds at most 4096 of them."""
    held: dict[int, np.ndarray] = {}

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"leader": pa.array(list(held), pa.int64()), "total": pa.array(list(held.values()), pa.list_(pa.float64()))})

    for part in parts:
        for x, leader in zip(_units(part.column("vector")), part.column("leader").to_pylist()):
            held[leader] = held[leader] + x if leader in held else x
        if len(held) > 4096:
            yield rows()
            held.clear()
    yield rows()


def _units(column: pa.Array) -> list[np.ndarray]:
    """The unit vectors of a column whose vectors may differ in length."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    out = [values[a:b].astype(np.float64) for a, b in zip(at[:-1], at[1:])]
    return [x / np.sqrt(x @ x) for x in out]


def _mean(group: pa.Table) -> pa.Table:
    total = np.sum([np.array(x) for x in group.column("total").to_pylist()], axis=0)
    return pa.table({"leader": group.column("leader").slice(0, 1), "mean": pa.array([total / max(np.sqrt(total @ total), 1e-300)], pa.list_(pa.float64()))})


def _angles(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        angle = [np.arccos(np.clip(a @ b, -1, 1)) for a, b in zip(_units(part.column("vector")), _units(part.column("mean")))]
        yield pa.RecordBatch.from_pydict({"rep": part.column("rep"), "leader": part.column("leader"), "copies": part.column("copies"), "angle": pa.array(angle, pa.float64())})


def _compare(threshold: float):
    """Compares a block of a ball's members with a block of the entries that may link with them."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        x, member = _unit(group.column("vector").combine_chunks()), group.column("member").to_numpy(zero_copy_only=False)
        rep, copies, node = (group.column(c).to_numpy() for c in ("rep", "copies", "node"))
        m, o = np.flatnonzero(member), np.flatnonzero(~member)
        mine, theirs, met = np.zeros(len(m), np.int64), np.zeros(len(o), np.int64), np.zeros(len(o), bool)
        for k in range(0, len(o), 128):
            near = x[o[k : k + 128]] @ x[m].T >= threshold
            theirs[k : k + 128], met[k : k + 128] = near @ copies[m], near.any(1)
            mine += copies[o[k : k + 128]] @ near
        both = np.concatenate([m, o])
        return pa.table({"rep": rep[both], "links": np.concatenate([mine, theirs]), "node": node[both], "met": np.concatenate([mine < 0, met])})

    return run


def gather(distinct: DataFrame, homes: DataFrame, vectors: DataFrame, threshold: float, dense: int = DENSE) -> tuple[DataFrame, DataFrame] | None:
    """(rep, ball) of the members, and (ball, label, size, copies, members, vector, radius) of the balls of two members and more; None without.

    Leaders are drawn from every home bucket of at least `dense` vectors, LEADERS of each on average, and in further rounds from those
    where more than BLOCK vectors are still without a ball. A ball's number is its smallest member's.
    """
    cell, half, found = ["label", "size", "table", "bucket"], np.arccos(threshold) / 2 - MARGIN, []
    for turn in range(ROUNDS):
        left = reduce(lambda d, m: d.join(m, "rep", "left_anti"), [m.select("rep") for m, _ in found], homes)
        full = cut(left.groupBy(*cell).agg(F.count("*").alias("held")).where(F.col("held") >= (BLOCK + 1 if turn else dense)).withColumn("of", F.col("held")))
        total = full.agg(F.sum("held")).first()[0]
        if not total:
            break
        inside = join_heavy(left, full, cell, "held", total, F.col("rep"), how="inner")
        inside = inside.withColumns({"turn": F.shiftrightunsigned(F.xxhash64("rep", F.lit(turn)), 12), "blocks": F.ceil(F.col("of") / BLOCK).cast("int")})
        inside = cut(inside.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int")))
        cols = [*cell, "block", "rep", "turn"]
        leads = inside.where(F.col("turn").cast("double") * F.col("of") < float(LEADERS << 52)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = inside.select(*cols, F.lit(False).alias("leads")).unionByName(leads.select(*cols, F.lit(True).alias("leads")))
        near = rows.join(vectors.select("rep", "vector"), "rep").groupBy(*cell, "block").applyInArrow(_nearest(np.cos(1.5 * half)), "rep long, turn long, leader long")
        near = cut(near.groupBy("rep").agg(F.min_by("leader", F.struct("turn", "leader")).alias("leader")))
        with_vectors = near.join(vectors.select("rep", "copies", "vector"), "rep")
        kind = dict(vectors.dtypes)["vector"]
        means = with_vectors.select("leader", "vector").mapInArrow(_sums, "leader long, total array<double>").groupBy("leader").applyInArrow(_mean, "leader long, mean array<double>")
        sizes = near.groupBy("leader").agg(F.count("*").alias("of"))
        means = cut(means.join(sizes, "leader").where("of > 1").select("leader", "of", F.col("mean").cast(kind).alias("mean")))
        placed = join_heavy(with_vectors, means, ["leader"], "of", max(1, near.count()), F.col("rep"), how="inner")
        placed = cut(placed.select("rep", "leader", "copies", "vector", "mean").mapInArrow(_angles, "rep long, leader long, copies long, angle double").where(F.col("angle") <= half))
        balls = placed.groupBy("leader").agg(F.min("rep").alias("ball"), F.sum("copies").alias("copies"), F.count("*").alias("members"), F.max("angle").alias("radius")).where("members > 1")
        balls = cut(balls.join(means.select("leader", F.col("mean").alias("vector")), "leader"))
        members = cut(join_heavy(placed.select("rep", "leader"), balls.select("leader", "members", "ball"), ["leader"], "members", max(1, placed.count()), F.col("rep"), how="inner").select("rep", "ball"))
        found.append((members, balls.drop("leader")))
    if not found:
        return None
    members, balls = (reduce(DataFrame.unionByName, parts) for parts in zip(*found))
    return members, cut(balls.join(distinct.select(F.col("rep").alias("ball"), "label", "size"), "ball"))


def _open_pairs(near: DataFrame, members: DataFrame, balls: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(rep, links, node, met, ball) of members and of what was compared with them, for the pairs of entries that bounds leave open."""
    single = near.where("kind = 1 AND NOT sure").select(F.col("a").alias("ball"), F.col("b").alias("rep"), F.col("b").alias("node"))
    other = near.where("kind = 2 AND NOT sure").select(F.col("a").alias("ball"), F.col("b").alias("node"))
    other = other.join(members.withColumnRenamed("ball", "node"), "node").select("ball", "rep", "node")
    partners = cut(single.unionByName(other))
    sizes = partners.groupBy("ball").agg(F.count("*").alias("partners")).join(balls.select("ball", "members"), "ball")
    blocks = cut(sizes.select("ball", (F.col("partners") + F.col("members")).alias("held"), F.ceil(F.col("members") / BLOCK).cast("int").alias("mine"), F.ceil(F.col("partners") / BLOCK).cast("int").alias("theirs")))
    total = blocks.agg(F.sum("held")).first()[0] or 1

    def dealt(rows: DataFrame, own: str, across: str) -> DataFrame:
        rows = join_heavy(rows, blocks, ["ball"], "held", total, F.col("rep"), how="inner")
        return rows.withColumns({own: F.pmod(F.xxhash64("rep", F.lit(3)), F.col(own)).cast("int"), across: F.explode(F.sequence(F.lit(0), F.col(across) - 1))})

    mine = dealt(members.select("rep", "ball", F.col("ball").alias("node")), "mine", "theirs").withColumn("member", F.lit(True))
    theirs = dealt(partners, "theirs", "mine").withColumn("member", F.lit(False))
    rows = mine.unionByName(theirs).join(vectors.select("rep", "copies", "vector"), "rep")
    out = rows.groupBy("ball", "mine", "theirs").applyInArrow(lambda key, group: _with_ball(key, _compare(threshold)(group)), "rep long, links long, node long, met boolean, ball long")
    return out.where("links > 0")


def _with_ball(key: tuple, found: pa.Table) -> pa.Table:
    return found.append_column("ball", pa.array([key[0].as_py()] * found.num_rows, pa.int64()))


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.93,
                    tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, dense: int = DENSE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: other rows with an equal label and a cosine of at least threshold, the smallest
    vec_id that links reach, and whether that is the row's own.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label, link with nothing.
    Equal vectors of a label are one with a number of copies, and link with each other. Vectors of different lengths never link.
    Rows that repeat are copies of each other. A row with a null vec_id counts as a link of others, and is not kept. An empty table
    gives an empty table; other columns are left out, whatever their names.
    """
    v = F.col("vector")
    valid = F.col("label").isNotNull() & F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    plain = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("vector"))
    plain = cut(plain.withColumn("valid", F.coalesce(valid, F.lit(False))))
    same = ["label", "vector"]
    distinct = plain.where("valid").groupBy(*same).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    distinct = distinct.withColumns({"size": F.size("vector"), "rep": F.monotonically_increasing_id(), "codes": _code_column(tables, hashes, probes)("vector")})
    distinct = cut(distinct)
    vectors = distinct.select("rep", "copies", v.cast("array<float>").alias("vector") if dict(rows.dtypes)[embedding] == "array<float>" else "vector", "codes")
    cell = ["label", "size", "table", "bucket"]
    split = F.transform(F.sequence(F.lit(0), F.lit(tables * probes - 1)), lambda k: F.struct(
        F.floor(k / probes).cast("int").alias("table"), F.element_at("codes", k.cast("int") + 1).alias("bucket"), (k % probes == 0).alias("home")))
    spots = distinct.select("label", "size", "rep", F.inline(split)).where("bucket >= 0")
    gathered = gather(distinct, spots.where("home").drop("home"), vectors, threshold, dense)
    no_ball = F.lit(None).cast("long")
    placed = distinct.withColumn("ball", no_ball) if gathered is None else distinct.join(gathered[0], "rep", "left")
    placed = cut(placed.select("label", "size", "rep", "ball", "codes")) if gathered else placed
    spots = placed.select("label", "size", "rep", "ball", F.inline(split)).where("bucket >= 0")
    entries = spots.where("ball IS NULL").select(*cell, F.col("rep").alias("entry"), F.lit(False).alias("ball"), "home")
    every = vectors.select(F.col("rep").alias("entry"), "copies", "vector", "codes", F.lit(0.0).alias("radius"))
    if gathered:
        entries = entries.unionByName(spots.where("ball IS NOT NULL").groupBy(*cell, F.col("ball").alias("entry")).agg(F.max("home").alias("home")).withColumn("ball", F.lit(True)))
        codeless = F.array_repeat(F.lit(-1).cast("long"), tables * probes)
        every = placed.where("ball IS NULL").select(F.col("rep").alias("entry")).join(every, "entry")
        every = every.unionByName(gathered[1].select(F.col("ball").alias("entry"), "copies", "vector", codeless.alias("codes"), "radius"))
    cells = entries.groupBy(*cell).agg(F.count("*").alias("held"), F.count_if("home").alias("homes"))
    cells = cut(cells.where("held > 1 AND homes > 0").withColumns({"blocks": F.ceil(F.col("held") / BLOCK).cast("int"), "cell": F.monotonically_increasing_id()}))
    total = cells.agg(F.sum("held")).first()[0] or 0
    meet = join_heavy(entries, cells.drop("homes"), cell, "held", max(1, total), F.col("entry"), how="inner")
    meet = meet.withColumn("block", F.pmod(F.xxhash64("entry", F.lit(3)), F.col("blocks")).cast("int"))
    pack = F.when(F.col("blocks") > 1, F.col("cell")).otherwise(-1 - F.pmod(F.xxhash64("cell"), F.lit(1 + total // PACK)))
    meet = meet.select("entry", "ball", "table", "bucket", "cell", "blocks", "block", pack.alias("pack"))
    whole = meet.where("blocks = 1").withColumns({"i": F.lit(0), "j": F.lit(0)})
    dealt = meet.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    found = whole.unionByName(dealt).join(every, "entry").groupBy("pack", "i", "j")
    found = cut(found.applyInArrow(_verify(threshold, tables, probes), "kind int, a long, b long, a_copies long, b_copies long, sure boolean"))
    single = found.where("kind = 0")
    links = [single.select(F.col("a").alias("rep"), F.col("a_copies").alias("links"))]
    edges = [single.where("a <> b").select("a", "b")]
    if gathered:
        members, balls = gathered
        near = cut(found.where("kind > 0").groupBy("kind", "a", "b").agg(F.max("a_copies").alias("a_copies"), F.max("b_copies").alias("b_copies"), F.min("sure").alias("sure")))
        sure = near.where("sure")
        opened = cut(_open_pairs(near, members, balls, vectors, threshold))
        links += [sure.where("kind = 1").select(F.col("b").alias("rep"), F.col("a_copies").alias("links")), opened.select("rep", "links")]
        edges += [sure.select("a", "b"), opened.where("met").select(F.col("ball").alias("a"), F.col("node").alias("b"))]
        shares = sure.select(F.col("a").alias("ball"), F.col("b_copies").alias("links")).unionByName(sure.where("kind = 2").select(F.col("b").alias("ball"), F.col("a_copies").alias("links")))
        shares = shares.groupBy("ball").agg(F.sum("links").alias("links"))
        shared = balls.select("ball", "copies", "members").join(shares, "ball", "left").select("ball", "members", (F.col("copies") + F.coalesce("links", F.lit(0))).alias("of_ball"))
    links = reduce(DataFrame.unionByName, links).groupBy("rep").agg(F.sum("links").alias("links"))
    reach = components(reduce(DataFrame.unionByName, edges))
    named = distinct.select("rep", "least", "copies", *same).join(links, "rep", "left")
    if gathered:
        named = named.join(members, "rep", "left")
        named = join_heavy(named, cut(shared), ["ball"], "members", max(1, members.count()), F.col("rep"))
        own = F.when(F.col("ball").isNotNull(), F.col("of_ball") - F.col("copies")).otherwise(0)
        named = named.withColumns({"links": F.coalesce("links", F.lit(0)) + own, "node": F.coalesce("ball", "rep")})
    else:
        named = named.withColumn("node", F.col("rep"))
    named = cut(named)
    reach = reach.withColumn("held", F.lit(1)) if not gathered else reach.join(balls.select(F.col("ball").alias("node"), F.col("members").alias("held")), "node", "left").withColumn("held", F.coalesce("held", F.lit(1)))
    named = join_heavy(named, cut(reach), ["node"], "held", max(1, named.count()), F.col("rep"))
    named = cut(named.withColumn("root", F.coalesce("root", "node")))
    names = named.groupBy("root").agg(F.min("least").alias("name"), F.count("*").alias("of"))
    named = join_heavy(named, names, ["root"], "of", max(1, named.count()), F.col("rep"))
    right = cut(named.select(*same, "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("name").alias("component_id")))
    usable = plain.withColumn("vector", F.when(F.col("valid"), v))
    out = join_heavy(usable, right, same, "copies", max(1, plain.count()), F.col("vec_id"))
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(F.col("vec_id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
