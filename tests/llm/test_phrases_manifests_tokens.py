import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jurispark.llm import collocations as C
from jurispark.llm import merkle as M
from jurispark.llm import queries
from jurispark.llm import token_files as K

SF = "/root/testdata/sf0.001"


# Collocations


def _pieces(text):
    for c in ".,;:!?\n\x0b\x0c\r":
        text = text.replace(c, "\n")
    for piece in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split("\n"):
        words = [w for w in piece.replace("\t", " ").split(" ") if w]
        if words:
            yield words


def brute(rows, max_n=3, least=10, keep=2000, absorbed=50):
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for w in _pieces(text or ""):
            sizes[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, max_n + 1) for i in range(len(w) - k + 1))
    found = {}
    for (lang, p), a in counts.items():
        if len(p) < 2 or a < least:
            continue
        around = [(q, n) for (x, q), n in counts.items() if x == lang and len(q) > len(p) and n >= least and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * n >= absorbed * a for _, n in around):
            continue
        score, k = min((10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, le, r, sizes[lang], -s) for lang, own in found.items() for i, (s, a, p, le, r) in enumerate(sorted(own)[:keep])}


def _texts(seed, n=60):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(9)] + ["The", "the", "é", "\x1f", "ÀB"]
    out = [(" ".join(draw.choices(words, [9, 5, 4, 3, 2, 1, 1, 1, 1, 9, 9, 3, 1, 2], k=draw.randint(0, 40))).replace("w3", "w3, w4"), draw.choice(["en", "fr", None])) for _ in range(n)]
    return [*out, (None, "en"), ("", "en"), ("\t\n .", None), ("a b " * 30, "xx"), ("a b " * 30, "xx")]


@pytest.mark.parametrize(("max_n", "least", "keep"), [(3, 10, 2000), (2, 3, 7), (5, 4, 11)])
def test_collocations_equal_brute_force(spark, monkeypatch, max_n, least, keep):
    rows = _texts(max_n)
    docs = spark.createDataFrame([(t, la, 1) for t, la in rows], "text string, lang string, rank int").repartition(5)
    out = C.collocations(docs, max_n=max_n, least=least, keep=keep)
    assert {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in out.collect()} == brute(rows, max_n, least, keep)


def test_collocations_of_nothing(spark, empty):
    assert C.collocations(empty).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_a_long_text_is_read_in_slices(spark):
    words = [f"x{i % 50}" for i in range(300_000)]
    out = C.collocations(spark.createDataFrame([(" ".join(words), "en")], "text string, lang string"), max_n=2)
    rows = {r["phrase"]: (r["a"], r["n"]) for r in out.collect()}
    assert len(rows) == 50 and rows["x0 x1"] == (6000, 300_000) and rows["x49 x0"] == (5999, 300_000)


def test_scores_are_exact_beyond_64_bits(spark):
    a, le, r = 987_654_321_012, 987_654_321_987, 1_987_654_321_001
    row = spark.createDataFrame([(a, le, r)], "a long, l long, r long").select(C._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert row["s"] == 10**6 * a * a // (le * r)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.integers(1, 4), st.integers(1, 5))
def test_distinct_suffixes_and_the_stack_count_like_counters(codes, max_n, cut):
    codes = np.array([*codes, *[0] * (max_n - 1)], np.int64)
    columns, n = C._distinct(codes, max_n, 5)
    wide, again = C._distinct(codes, max_n, 1 << 40)
    pack = lambda cols, m: Counter({tuple(r): c for r, c in zip(np.stack(cols, 1).tolist(), m.tolist())})
    want = Counter()
    for i in range(len(codes) - max_n + 1):
        s = codes[i : i + max_n].tolist()
        if s[0]:
            end = s.index(0) if 0 in s else max_n
            want[tuple(s[:end] + [0] * (max_n - end))] += 1
    assert pack(columns, n) == want == pack(wide, again)
    rows = sorted(("".join(f"{x} " for x in s if x), m) for s, m in want.items())[::-1]
    stack, got = C.Stack(max_n, set()), Counter()
    for k in range(0, len(rows), cut):
        part = rows[k : k + cut]
        for p, _, m in zip(*stack.push(pa.array([s for s, _ in part], pa.string()), np.array([m for _, m in part]), 1)):
            got[p] += m
    for p, _, m in zip(*stack.push(pa.array([], pa.string()), np.zeros(0, np.int64), 1, True)):
        got[p] += m
    every = Counter()
    for s, m in rows:
        words = s.split()
        every.update({" ".join(words[:d]): m for d in range(1, len(words) + 1)})
    assert got == every


def test_hot_words_are_dealt_out_and_summed(spark):
    rows = [("hot hot a", "en")] * 400 + [(f"hot b{i % 7} c{i}", "en") for i in range(300)] + [(f"hot hot d{i}", "en") for i in range(50)]
    out = C.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(6))
    assert {(r["phrase"], r["a"], r["l"], r["r"]) for r in out.collect()} == {(p, a, le, r) for _, _, p, a, le, r, *_ in brute(rows)}


# Merkle manifests


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _grow(nodes):
    """Levels from the leaves up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def _siblings(levels, i):
    out = []
    for level in levels[:-1]:
        g = i // 16 * 16
        out.append(("".join(level[g:i]), "".join(level[i + 1 : g + 16])))
        i //= 16
    return out


def brute_manifest(rows):
    """{(doc_id, leaf): (subroot, root, proof)} of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(((row[0] is not None, row[0] or 0), _h(*map(_field, row))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _grow([leaf for _, leaf in sorted(groups[s])]) for s in names}
    top = _grow([trees[s][-1][0] for s in names])
    out = Counter()
    for j, s in enumerate(names):
        for i, (key, leaf) in enumerate(sorted(groups[s])):
            proof = _h(*("".join(x) for x in _siblings(trees[s], i) + _siblings(top, j)))
            out[key[1] if key[0] else None, leaf, trees[s][-1][0], top[-1][0], proof] += 1
    return out


def _manifest(spark, docs):
    made = M.manifest(docs, carry={"doc_id": F.col("doc_id")})
    rows = M.proofs(spark, made).withColumns({"proof": M.proof_digest(), "folded": M.folded(F.col("leaf"))}).collect()
    assert all(r["folded"] == r["root"] for r in rows)
    return Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in rows)


def test_manifest_equals_brute_force(spark):
    draw = random.Random(5)
    rows = [(i, draw.choice(["big"] * 30 + ["b", "é", None, "Z"]), "en", i, f"text {i}") for i in range(700)] + [(999, f"s{k}", None, None, None) for k in range(40)]
    rows += [(7, "big", None, 3, ""), (7, "big", None, 3, ""), (7, "big", "de", 3, None), (None, "big", "en", 1, "no id"), (None, None, "en", 1, "x" * 400_000), (1, "", "en", 1, "empty source")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"leaf": F.lit(1), "i": F.lit(2), "tree": F.lit("t")}).repartition(7)
    assert _manifest(spark, docs) == brute_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark, empty):
    docs = spark.createDataFrame([(3, "a", "en", 1, "t")], "doc_id long, source string, lang string, n_chars long, text string")
    assert _manifest(spark, docs) == brute_manifest([(3, "a", "en", 1, "t")])
    none = M.manifest(docs.where("doc_id < 0"))
    assert none.root is None and M.proofs(spark, none).count() == 0


def test_an_altered_leaf_does_not_lead_to_the_root(spark):
    out = queries.op12_merkle_manifest(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in out:
        altered = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in docs[r["doc_id"]] or "")
        assert r["verified"] == (not altered) == (r["folded_root"] == r["root"])
    assert 0 < sum(not r["verified"] for r in out) < len(out)


# Token files


def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def _wanted(rows, tokenizer, end=2):
    at, out = 0, []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_equals_the_library(spark):
    _, tokenizer = _tokenizer()
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted(map(tuple, queries.op13_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == _wanted(rows, tokenizer)


ODD = [None, "", " ", "\n\n", "it's  THE <|endoftext|> end<|startoftext|>x", "é áb  x y\tz\x0bw\x1cq", "ΣΑΣ ΑΣ. İstanbul ǅ ß ﬁ", "'s 't'll a' s", "…—“q” ¼½ ٣٤ 中文字 한글 👩‍👩‍👧", "a" * 3000, "́ ́x", "x\r\ny z\u0085w"]


def test_odd_texts_nulls_and_equal_ids(spark):
    path, tokenizer = _tokenizer()
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "twice"), (3, "twice"), (None, "nameless")]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, start int").repartition(4)
    got = K.read_documents(spark, K.write(docs, path, end_id=2, length=16, by_word=True)).orderBy("start").collect()
    want = {(i, zlib.crc32(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for i, t in rows}
    assert {(r["doc_id"], zlib.crc32(r["ids"])) for r in got} == want and len(got) == len(rows)
    assert got[0]["doc_id"] is None and [r["doc_id"] for r in got[1:]] == sorted(i for i, _ in rows if i is not None)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    plain = K.read_documents(spark, K.write(docs, path, end_id=2, length=16)).orderBy("start").collect()
    assert plain == got


def test_files_hold_equal_sequences_that_are_read_without_copying(spark):
    path, tokenizer = _tokenizer()
    docs = spark.createDataFrame([(i, f"document number {i} says hello " * (i % 40)) for i in range(200)] + [(1000, "word " * 300_000)], "doc_id long, text string")
    files = K.write(docs, path, end_id=2, length=100)
    ids = []
    for r in files.manifest(spark).orderBy("shard").collect():
        shard = K.SequenceFile(r["file"])
        assert len(shard) == r["n_sequences"] and r["start"] == len(ids)
        for i in range(len(shard)):
            own, mask = shard.sequence(i)
            assert len(own) == len(mask) == 100 and not own.flags["OWNDATA"] and mask[: mask.sum()].all()
            assert mask.all() or i == len(shard) - 1
            ids += own[mask].tolist()
        assert shard.span(0, r["n_ids"]).tolist() == ids[r["start"] :]
    want = [x for r in docs.orderBy("doc_id").collect() for x in [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2]]
    assert ids == want


def test_token_files_of_nothing(spark, empty):
    path, _ = _tokenizer()
    files = K.write(empty, path, end_id=2)
    assert files.manifest(spark).count() == 0 and K.read_documents(spark, files).count() == 0


def test_a_shard_written_again_leaves_no_file_that_is_read(spark, tmp_path):
    path, _ = _tokenizer()
    stray = K.ShardWriter(f"file://{tmp_path}/data/part-00000-99.arrow", np.dtype("<u2"), 4)
    stray.add(np.arange(9, dtype="<u2").tobytes())
    stray.close()
    files = K.write(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), path, end_id=2, path=f"file://{tmp_path}")
    assert [tuple(r)[:3] for r in K.read_documents(spark, files).collect()] == [(1, 0, 3)]


def test_ids_are_as_narrow_as_the_vocabulary_allows():
    assert K.id_type(1 << 16) == "<u2" and K.id_type((1 << 16) + 1) == "<u4"
