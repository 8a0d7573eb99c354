"""Runs a query and its SQL on the same tables and compares rows, whatever their order."""

import math
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, int):
        return v
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(plain(v) for v in r) for r in df.select(*(f"`{c}`" for c in cols)).collect())


def duck_rows(sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], Counter(tuple(plain(r[k]) for k in order) for r in cur.fetchall())


def compare(df, sql, sf_dir):
    a, b = spark_rows(df), duck_rows(sql, sf_dir)
    assert a[0] == b[0], (a[0], b[0])
    missing, extra = b[1] - a[1], a[1] - b[1]
    assert not missing and not extra, (sum(missing.values()), sum(extra.values()), list(missing)[:3], list(extra)[:3])
    return sum(a[1].values())
