import base64
import hashlib
import random
from collections import Counter

import numpy as np

from jurispark.llm import shared, vectors, warc


def rows(df):
    return [r.asDict() for r in df.collect()]


def pages(spark):
    big = "ö" * 100_000
    data = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, "http://a/3", big), (4, None, big), (5, "u", None), (6, "u", ""), (7, "http://x", "one\r\n\r\ntwo"), (8, "http://b", "é" * 40), (9, "h", "WARC/1.1\r\n\r\n")]
    return data, spark.createDataFrame(data, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    data, df = pages(spark)
    for size in (100, 1 << 16):
        path = warc.write(df, chunk_bytes=size)
        table = spark.read.parquet(path)
        found = {r["page_id"]: r for r in rows(warc.read(table))}
        assert table.selectExpr("max(length(data))").first()[0] <= size
        for page, _, html in data:
            payload = (html or "").encode()
            best = max(p for p, _, h in data if (h or "").encode() == payload)
            r = found[page]
            assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
            assert (r["record_type"], r["refers_to"]) == (("response", None) if best == page else ("revisit", best)) and r["intact"]
        last = table.where("record_id LIKE 'urn:page:8:%'").orderBy("chunk").collect()
        assert last[-1]["digest"] == found[8]["payload_digest"] and b"".join(r["data"] for r in last).startswith(b"WARC/1.1\r\n")


def test_warc_rows_that_repeat_and_rows_without_an_id(spark):
    one, two, three = ("".join(random.Random(k).choices("abcdefghö", k=150_000)) for k in range(3))
    data = [(1, "http://a", one)] * 3 + [(None, "http://b", two), (None, "http://c", three), (None, "http://d", one), (5, "u", two), (5, "u", two), (6, "u", one), (6, "u", one), (4, "v", two)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("sha1", warc.F.lit("clash")).withColumn("copies", warc.F.lit(7))
    table = spark.read.parquet(warc.write(df))
    found = rows(warc.read(table))
    assert len(found) == len(data) and all(r["intact"] for r in found)
    assert table.select("record_id").distinct().count() == len(data)
    largest = {one: 6, two: 5, three: None}

    def expected(page, html):
        payload = html.encode()
        revisit = largest[html] not in (None, page)
        return page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", largest[html] if revisit else None

    assert Counter(expected(p, h) for p, _, h in data) == Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found)


def test_warc_least_size_damage_and_empty(spark):
    data, df = pages(spark)
    found = {r["page_id"]: r for r in rows(warc.read(spark.read.parquet(warc.write(df, min_bytes=10))))}
    assert found[1]["record_type"] == found[5]["record_type"] == "response" and found[3]["refers_to"] == 4
    table = spark.read.parquet(warc.write(df.where("page_id = 8")))
    bad = table.withColumn("data", warc.F.expr("overlay(data placing X'00' from length(data) - 10)"))
    assert not rows(warc.read(bad))[0]["intact"]
    assert rows(warc.read(spark.read.parquet(warc.write(df.where("page_id < 0"))))) == []


def test_vectors_equal_brute_force(spark, monkeypatch):
    seen, stored = Counter(), vectors.cut

    def cut(df):
        out = stored(df)
        if out.columns == ["kind", "a", "b", "a_copies", "b_copies", "sure"]:
            seen.update((r["kind"], r["sure"]) for r in out.select("kind", "sure").collect())
        return out

    monkeypatch.setattr(vectors, "cut", cut)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 32))
    near = centres[:2] + 0.12 * rng.normal(size=(2, 32))
    kinds = [(c, n, 0.15) for c, n in zip(centres, [60, 30, 20] + [3] * 9)] + [(centres[0], 40, 0.05), (near[0], 40, 0.05), (centres[1], 30, 0.22), (near[1], 25, 0.1), (centres[2] + 0.25 * rng.normal(size=32), 30, 0.03)]
    alone, aside = rng.normal(size=(2, 32))
    aside -= (aside @ alone) / (alone @ alone) * alone
    aside *= np.linalg.norm(alone) / np.linalg.norm(aside)
    kinds += [(alone, 30, 0.005), (alone * np.cos(0.32) + aside * np.sin(0.32), 30, 0.005)]
    x = np.concatenate([c + e * rng.normal(size=(n, 32)) for c, n, e in kinds] + [rng.normal(size=(40, 32))]).astype(np.float32)
    data = [(i * 3 % 1013, [float(v) for v in e], i % 2 if i % 17 else None) for i, e in enumerate(x)]
    data += [(2000, data[1][1], 1), (2001, data[1][1], 1), (2002, None, 1), (2003, [0.0] * 32, 1), (2004, [float("nan")] * 32, 1), (2005, [], 1), (2006, data[1][1][:16], 1), (2007, [None] + data[1][1][1:], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")

    def usable(r):
        return r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])

    links = {r[0]: set() for r in data}
    for a in filter(usable, data):
        for b in filter(usable, data):
            if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                p, q = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.93:
                    links[a[0]].add(b[0])
    root = {k: k for k in links}
    for _ in range(len(root)):
        new = {k: min([root[k], *(root[j] for j in links[k])]) for k in root}
        if new == root:
            break
        root = new
    for block, dense in ((16, 10**9), (1024, 8), (16, 4)):
        monkeypatch.setattr(vectors, "BLOCK", block)
        monkeypatch.setattr(vectors, "SMALL", block // 2)
        found = {r["vec_id"]: r for r in rows(vectors.near_duplicates(df, dense=dense))}
        assert {k: r["n_links"] for k, r in found.items()} == {k: len(v) for k, v in links.items()}
        assert {k: r["component_id"] for k, r in found.items()} == root
        assert all(r["kept"] == (k == root[k]) for k, r in found.items())
    assert all(seen[k] for k in ((0, True), (1, True), (1, False), (2, True), (2, False)))
    assert rows(vectors.near_duplicates(df.where("vec_id < 0").withColumn("codes", vectors.F.lit(1)).withColumn("copies", vectors.F.lit(2)))) == []


def test_probing_reaches_recall():
    rng = np.random.default_rng(1)
    for dim, least in ((64, 0.995), (384, 0.98)):
        a = rng.normal(size=(700, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        o = rng.normal(size=a.shape)
        o -= (o * a).sum(1, keepdims=True) * a
        b = 0.93 * a + np.sqrt(1 - 0.93**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
        p, q = vectors.codes(a), vectors.codes(b)
        met = ((p[:, :, :1] == q).any(2) | (q[:, :, :1] == p).any(2)).any(1)
        assert met.mean() > least


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(60)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(50)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    found = {r["node"]: r["root"] for r in rows(shared.components(spark.createDataFrame(edges, "a long, b long")))}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert set(found) == nodes
    for x in nodes:
        assert {y for y in nodes if found[y] == found[x]} == {y for y in nodes if find(y) == find(x)}


def test_join_heavy_keeps_every_row(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else (None if i % 2 else f"k{i}")) for i in range(300)], "i long, k string")
    right = left.where("k IS NOT NULL").groupBy("k").count().withColumnRenamed("count", "n").withColumn("v", shared.F.concat("k", shared.F.lit("!")))
    out = rows(shared.join_heavy(left, right, ["k"], "n", 300, shared.F.col("i")))
    assert len(out) == 300 and all(r["v"] == (r["k"] and r["k"] + "!") for r in out)


def test_join_heavy_deals_hot_rows_by_their_salt(spark):
    left = spark.createDataFrame([(i, "hot") for i in range(300)], "i long, k string")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").withColumn("v", shared.F.lit("x"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = shared.join_heavy(left, right, ["k"], "n", 300, shared.F.col("i"))._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert any("hashpartitioning(k" in line and "__salt" in line for line in plan.splitlines())
