import hashlib
import random
import re
from collections import Counter
from itertools import chain

import pyarrow as pa
import pytest
import xxhash

from jurispark.llm import langid, mixing, ordinal, pieces, repeats, rules, shared, simhash, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def brute_repeats(texts, window=35):
    split = [WORD.findall((t or "").encode()) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark, documents, monkeypatch):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 130))) for _ in range(60)]
    shared = " ".join(rng.choice("abcdefgh") for _ in range(50))
    texts = base + [f"{b[:50]} {shared}\n{b[50:]}" for b in base[:20]] + [base[3]] * 4 + [r["text"] for r in rows(documents)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted(rows(repeats.remove_repeats(df)), key=lambda r: r["doc_id"])
    assert [(r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in found] == brute_repeats(texts)
    for r in found:
        assert sum(s["end"] - s["begin"] for s in r["removed_spans"]) == r["n_removed"]
    monkeypatch.setattr(repeats, "MANY", 2)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 4000)
    again = df.union(df.where("doc_id IN (3, 81)")).union(df.where("doc_id = 81")).withColumn("kept_text", repeats.F.lit(1))
    expected = Counter(zip([r["doc_id"] for r in rows(again)], brute_repeats([r["text"] for r in rows(again)])))
    assert Counter((r["doc_id"], (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest())) for r in rows(repeats.remove_repeats(again))) == expected
    monkeypatch.setattr(repeats, "MOST_CHUNKS", 4)
    with pytest.raises(ValueError):
        repeats.remove_repeats(df)


def test_repeats_carry_columns_and_keep_space(documents, empty):
    out = repeats.remove_repeats(documents, keep_space=True)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_words", "n_removed", "kept_text", "removed_spans"]
    found = {r["doc_id"]: r for r in rows(out)}
    assert len(rows(out)) == 13 and found[0]["kept_text"] == "" and found[8]["kept_text"] == "Short  TEXT\there"
    assert found[4]["kept_text"] == "start end one two" and found[6]["kept_text"].split() == ["other", "tail"]
    assert rows(repeats.remove_repeats(empty)) == []


def rows_into_python(plan):
    """Rows that each node of a plan that has run sent to its Python workers."""
    name = plan.getClass().getSimpleName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().size())]
    metrics = plan.metrics()
    own = [metrics.apply("pythonNumRowsReceived").value()] if name.startswith("FlatMapGroupsInArrow") else []
    return own + list(chain.from_iterable(map(rows_into_python, inner)))


def test_packed_rows_of_repeats_grow_with_the_text(spark, monkeypatch):
    rng = random.Random(12)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(20)]
    texts = [f"{' '.join(rng.choice('abcdefgh') for _ in range(40))} {passages[i % 20]}" for i in range(800)]
    monkeypatch.setattr(repeats, "ROW_BYTES", 400)
    partitions, made = spark.conf.get("spark.sql.shuffle.partitions"), {}
    try:
        for n, parts in ((200, 4), (200, 64), (800, 4)):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            found = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string"))
            out = sorted((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in found.collect())
            assert [r[1:] for r in out] == brute_repeats(texts[:n])
            made[n, parts] = max(rows_into_python(found._jdf.queryExecution().executedPlan()))
            assert 4 < made[n, parts] <= sum(map(len, texts[:n])) / 400
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert made[200, 64] == made[200, 4] and made[800, 4] < 5 * made[200, 4]


def plain_fingerprint(text):
    w = WORD.findall((text or "").encode().lower())
    parts = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark, documents, empty):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(40)]
    texts += [t + " extra" for t in texts[:15]] + texts[:5] + ["", None, "one two"]
    df = spark.createDataFrame([(i * 7 % 1009, t) for i, t in enumerate(texts)], "doc_id long, text string")
    ids, prints = [i * 7 % 1009 for i in range(len(texts))], [plain_fingerprint(t) for t in texts]
    parent = dict(zip(ids, ids))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in zip(ids, prints):
        for j, b in zip(ids, prints):
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    found = {r["doc_id"]: r for r in rows(simhash.near_duplicates(df))}
    assert {i: found[i]["fingerprint"] & (2**64 - 1) for i in ids} == dict(zip(ids, prints))
    assert {i: found[i]["component_id"] for i in ids} == {i: find(i) for i in ids}
    special = [r for r in rows(simhash.near_duplicates(documents))]
    assert len(special) == 13 and {r["component_id"] for r in special if r["doc_id"] in (0, 1, 2)} == {0}
    assert {r["component_id"] for r in special if r["doc_id"] in (7, 8)} == {7}
    assert rows(simhash.near_duplicates(empty)) == []


def test_grid_covers_all_near_codes():
    masks, rng = simhash.grid_masks(), random.Random(3)

    def code(x):
        low = 0x5555555555555555
        return ((x | x >> 1) & low) | ((x & x >> 1) & low) << 1

    assert len(masks) == 35
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randrange(4)):
            b ^= 1 << k
        assert (code(a) ^ code(b)).bit_count() <= (a ^ b).bit_count()
        assert any((code(a) ^ code(b)) & m == 0 for m in masks)


def plain_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {k for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_quality_measures_and_order(spark, documents, empty):
    extra = spark.createDataFrame([(50, "x\nx\nx y\n" * 9), (51, "# | <a> " * 30), (52, "GOOD WORDS ARE HERE " * 3 + "one two three four five six seven eight nine ten eleven twelve")], "doc_id long, text string")
    df = documents.select("doc_id", "text").union(extra)
    found = rows(rules.quality_rules(df))
    for r in found:
        n = plain_measures(r["text"])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n
        assert r["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r["base_failed"] and r["kept"])
    every = rules.default_rules()
    for order in (every, every[::-1]):
        again = rules.measures(df).select("doc_id", rules.cascade(order).alias("k"))
        assert Counter((r["doc_id"], r["k"]) for r in rows(again)) == Counter((r["doc_id"], r["k"]) for r in rows(rules.measures(df).select("doc_id", rules.cascade(every).alias("k"))))
    assert rows(rules.quality_rules(empty)) == []
    kept = {r["doc_id"] for r in rows(rules.quality_rules(df).where("kept AND n_repeat_words = 0"))}
    assert kept == {r["doc_id"] for r in found if r["kept"] and not r["n_repeat_words"]}


def best_score(p, scores, text):
    s = pieces.BLANK + text.replace(" ", pieces.BLANK)
    best = [0.0] + [float("-inf")] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - 16), e):
            q = scores.get(s[b:e], p.fallback if e - b == 1 else None)
            if q is not None:
                best[e] = max(best[e], best[b] + q)
    return best[-1]


def test_pieces_are_the_best_and_decode_exactly(spark, documents, empty):
    import sentencepiece

    model = pieces.model_bytes()
    p, sp = pieces.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    rng = random.Random(2)
    texts = ["the  blanks ", "\n\n x\ny ", "é😀①ﬁ\r\n();\r", "ab" * 300] + ["".join(rng.choice("ab  \nThe,.é😀{}()\r;") for _ in range(40)) for _ in range(150)]
    for t in texts:
        ids = list(chain.from_iterable(p.encode(t)))
        spelt = re.findall(r"<0x", " ".join(sp.id_to_piece(i) for i in ids))
        total = sum(sp.get_score(i) for i in ids if not sp.is_byte(i))
        unknown = sum(c not in p.single for c in pieces.BLANK + t.replace(" ", pieces.BLANK) if len(c.encode()) and c not in scores)
        assert p.decode(ids) == t
        assert abs(total + unknown * p.fallback - best_score(p, scores, t)) < 1e-3, (t, spelt)
    out = pieces.encode_documents(documents).withColumn("back", pieces.decode(spark, pieces.F.col("ids")))
    for r in rows(out):
        assert r["back"] == r["text"] and r["n_ids"] == len(r["ids"] or [])
    assert rows(pieces.encode_documents(empty)) == []


def test_folding_and_hits():
    assert toxicity.fold("You 1d10t!! p@thetic, b/c3d 42nd idіot ＩＤＩＯＴ ésto") == " you idiot pathetic b ced 42nd idiot idiot esto "
    lexicon = toxicity.Lexicon({" trash ": 3.0, " idiot": 4.0}, frozenset({"trash can"}))
    assert [w for *_, w in toxicity.hits(toxicity.fold("Trash can and trash, idiots"), lexicon)] == [3.0, 4.0]
    assert toxicity.density(None, lexicon) == toxicity.density("", lexicon) == 0.0


def test_toxicity_learns(spark, documents, empty):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(200)]

    def text(bad):
        t = [rng.choice(words) for _ in range(60)]
        return " ".join(t + ["vilething", "nastyword"] if bad else t)

    rows_ = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(240)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    probe = spark.createDataFrame([(1, "plain word3 word4"), (2, "v1leth1ng word5 word6"), (3, None), (4, "")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in rows(toxicity.toxicity(probe, lexicon))}
    assert {k: r["predicted"] for k, r in found.items()} == {1: 0, 2: 1, 3: 0, 4: 0}
    assert found[3]["score"] == found[4]["score"] == found[1]["score"] < 0.7
    none = toxicity.learn(empty.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert all(r["predicted"] == 0 for r in rows(toxicity.toxicity(documents, none)))


def toxic_rows(texts, labels):
    return [(i, t, y) for i, (t, y) in enumerate(zip(texts, labels))]


def learned(spark, rows_):
    df = spark.createDataFrame(rows_, "doc_id long, text string, toxic int")
    return toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))


def test_toxic_words_of_copied_and_of_many_texts_stay(spark):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(200)]

    def around(word, before, behind):
        return " ".join([*rng.sample(words, 20), before, word, behind, *rng.sample(words, 20)])

    copied = around("vilething", "word1", "word2") + " neutralword"
    bad = [copied] * 300 + [around("vilething", rng.choice(words), rng.choice(words)) for _ in range(20)]
    bad += [around("nastyword", f"word{i % 3}", f"word{i // 3 % 3}") for i in range(60)]
    good = [" ".join(rng.sample(words, 40)) for _ in range(300)]
    lexicon = learned(spark, toxic_rows(bad + good, [1] * len(bad) + [0] * len(good)))
    assert all(toxicity.hits(f" {w} ", lexicon) for w in ("vilething", "nastyword"))
    assert not any(toxicity.hits(f" {w} ", lexicon) for w in ("neutralword", "word1"))


def test_exceptions_are_commoner_in_clean_texts(spark):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(200)]

    def with_(phrase):
        return " ".join([*rng.sample(words, 20), *phrase.split(), *rng.sample(words, 20)])

    bad = [with_("vilething people") for _ in range(60)] + [with_(f"vilething {rng.choice(words)}") for _ in range(200)]
    quoting = [with_("vilething people") for _ in range(6)] + [with_("vilething indeed " * 5)]
    spared = [with_("vilething museum") for _ in range(8)]
    good = quoting + spared + [" ".join(rng.sample(words, 40)) for _ in range(1200)]
    lexicon = learned(spark, toxic_rows(bad + good, [1] * len(bad) + [0] * len(good)))
    assert toxicity.hits(" vilething ", lexicon) and lexicon.exceptions == {"vilething museum"}
    assert toxicity.hits(toxicity.fold("vilething people"), lexicon) and not toxicity.hits(toxicity.fold("a vilething museum"), lexicon)


def test_rare_toxic_words_stay_behind_common_neutral_ones(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEXICON_SIZE", 10, raising=False)
    rng = random.Random(10)
    words = [f"word{i}" for i in range(200)]
    rare = [f"{a}{b}vile" for a in "bcdfg" for b in "aeiou"]
    bad = [" ".join([*rng.sample(words, 20), w, *rng.sample(words, 20)]) for w in rare for _ in range(6)]
    good = [" ".join(rng.sample(words, 40)) for _ in range(600)]
    lexicon = learned(spark, toxic_rows(bad + good, [1] * len(bad) + [0] * len(good)))
    assert all(toxicity.hits(f" {w} ", lexicon) for w in rare)
    assert not toxicity.hits(toxicity.fold(" ".join(words)), lexicon)


def test_implied_beginnings_leave_scores_alone(spark):
    weights = {" vile": 4.0, " vilet": 4.0, " vileth": 5.0, " vilething ": 4.5, " vile ": 3.5, " nasty ": 3.0}
    kept = {r["entry"]: r["w"] for r in toxicity.without_implied(spark.createDataFrame(list(weights.items()), "entry string, w double")).collect()}
    assert kept == {" vile": 4.0, " vileth": 5.0, " nasty ": 3.0}
    text = toxicity.fold("vile vilet vilething nasty vileness")
    a, b = (toxicity.hits(text, toxicity.Lexicon(w)) for w in (weights, kept))
    assert [(x, w) for x, _, w in a] == [(x, w) for x, _, w in b]


def windows_of(texts):
    split = [(t or "").split() for t in texts]
    return Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))


def test_pipeline_keeps_one_of_each_passage(spark):
    import corpus_pipeline

    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    passages = [" ".join(rng.sample(words, n)) for n in (35, 50, 90, 200)]
    texts = [" ".join([*rng.sample(words, 20), p, *rng.sample(words, 20)]) for p in passages for _ in range(6)]
    texts += [passages[2], passages[2], f"{passages[0]} {passages[1]} {passages[0]} {passages[1]}", "a b c " * 60, passages[3][300:] + " " + passages[1]]
    texts += [t.rsplit(" ", 3)[0] + " other end words" for t in texts[:8]]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    left = windows_of(r["text"] for r in rows(corpus_pipeline.substring_dedup(spark, df, "")))
    twice = {w for w, n in windows_of(texts).items() if n > 1}
    assert twice and not twice - set(left)
    assert sum(left[w] for w in twice) < 1.1 * len(twice)


def test_language_id(spark, documents, empty):
    rng = random.Random(6)
    kinds = {"xx": ["kato", "belu", "miro"], "yy": ["gwyn", "thorp", "yrst"], "zz": ["śćż", "łąka", "ęśń"]}
    data = [(i, " ".join(rng.choice(kinds[k]) for _ in range(30)), k) for i, k in enumerate(list(kinds) * 40)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    held = langid.held_out()
    model = langid.train(df.where(~held))
    out = rows(langid.detect(df.where(held), model))
    assert out and all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in out)
    special = {r["doc_id"]: r for r in rows(langid.detect(documents, model))}
    assert {k: special[k]["lang_pred"] for k in (0, 1, 2)} == dict.fromkeys((0, 1, 2), "und") and special[7]["lang_pred"] != "und"
    assert langid.train(empty) is None and rows(langid.detect(empty, model)) == []
    assert {r["lang_pred"] for r in rows(langid.detect(documents, None))} == {"und"}


def test_ordinal_model(spark, documents, empty):
    rng = random.Random(7)
    kinds = [["bad", "worse"], ["fair", "even"], ["good", "best"]]
    data = [(i, " ".join(rng.choice(kinds[i % 3]) for _ in range(30)), i % 3) for i in range(150)]
    df = spark.createDataFrame(data, "doc_id long, text string, grade int")
    model = ordinal.train(df.where("doc_id < 120"), df.select("doc_id", "grade"))
    assert list(model.thresholds) == sorted(model.thresholds)
    out = rows(ordinal.graded(df.where("doc_id >= 120"), model))
    assert all(round(r["expected_grade"]) == r["grade"] and r["selected"] == (r["grade"] == 2) for r in out)
    assert len(rows(ordinal.graded(documents, model))) == 13 and rows(ordinal.graded(empty, model)) == []
    assert ordinal.train(empty, df.select("doc_id", "grade").where("grade = 1")) is None
    assert ordinal.tails(ordinal.scores(pa.array([None, ""]), model), model.thresholds).shape == (2, 2)


def test_mixing_meets_weights(spark, documents, empty):
    rng = random.Random(8)
    sizes = {"a": 600, "b": 150, "c": 40}
    data = [(i, "w " * rng.randrange(5, 30), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    planned, mix = mixing.plan(df, max_repeats=3.0)
    assert mix.schedule.count()
    out = rows(planned)
    words = {s: sum(r["n_words"] for r in out if r["source"] == s) for s in sizes}
    read = {s: sum(r["n_words"] * r["copies"] for r in out if r["source"] == s) for s in sizes}
    assert min(r["copies"] for r in out) == 1 and abs(read["c"] / words["c"] - 3) < 0.02
    for s in sizes:
        weight = next(r["weight"] for r in out if r["source"] == s)
        assert abs(read[s] / sum(read.values()) - weight) < 0.01
    assert Counter(r["doc_id"] for r in rows(mixing.realise(df, mix))) == {r["doc_id"]: r["copies"] for r in out}
    half, _ = mixing.plan(df, max_repeats=3.0, budget=sum(words.values()) // 4)
    assert abs(sum(r["n_words"] * r["copies"] for r in rows(half)) / sum(words.values()) - 0.25) < 0.02
    assert mixing.realise(documents, None).count() == 13 and mixing.realise(documents, mixing.plan(documents)[1]).columns == documents.columns
    assert len(rows(mixing.plan(documents)[0])) == 13 and rows(mixing.plan(empty)[0]) == []


def mixture(spark, sizes):
    rng = random.Random(9)
    data = [(i, "w " * rng.randrange(5, 30), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(data, "doc_id long, text string, source string")


def test_mixing_keeps_its_limit_under_a_budget(spark):
    df = mixture(spark, {"a": 600, "b": 150, "c": 40})
    total = sum(len(r["text"].split()) for r in rows(df))
    for budget in (total // 2, 2 * total):
        planned, mix = mixing.plan(df, max_repeats=3.0, budget=budget)
        out = rows(planned)
        assert max(r["copies"] for r in out) <= 3
        assert abs(sum(r["n_words"] * r["copies"] for r in out) / budget - 1) < 0.01
        if budget == 2 * total:  # the limit binds: the smallest source is read three times, and a smaller exponent would read it oftener
            assert {r["copies"] for r in out if r["source"] == "c"} == {3} and 0 < mix.exponent < 1
    with pytest.raises(ValueError):
        mixing.plan(df, max_repeats=3.0, budget=4 * total)


def test_mixing_meets_an_entropy(spark):
    from math import log

    df = mixture(spark, {"a": 500, "b": 100, "c": 20})
    words = Counter()
    for r in rows(df):
        words[r["source"]] += len(r["text"].split())
    p = [n / sum(words.values()) for n in words.values()]

    def entropy(a):
        z = sum(x**a for x in p)
        return -sum(x**a / z * log(x**a / z) for x in p)

    for target in (0.7, 1.0):
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if entropy(mid) <= target else (mid, high)
        _, mix = mixing.plan(df, target_entropy=target)
        assert abs(mix.exponent - high) < 1e-6 and abs(mix.entropy - target) < 1e-6


def test_mixing_orders_blocks_anew_each_epoch(spark):
    df = mixture(spark, {"a": 3000, "b": 600})
    planned, mix = mixing.plan(df, max_repeats=2.5)
    out = rows(mixing.realise(df, mix, places=True))
    plan_ = {r["doc_id"]: r for r in rows(planned)}
    assert Counter(r["doc_id"] for r in out) == {k: r["copies"] for k, r in plan_.items()}
    ranks = {}
    for r in sorted(out, key=lambda r: r["place"]):
        if r["source"] == "b":
            ranks.setdefault(r["epoch"], []).append(r["block"])
    first, second = (list(dict.fromkeys(ranks[e])) for e in (0, 1))
    assert sorted(first) == sorted(second) and first != second and set(ranks[2]) < set(first)
    total = sum(len(r["text"].split()) for r in out)
    weight = {r["source"]: r["weight"] for r in plan_.values()}
    for low in (0.0, 0.25, 0.5, 0.75):
        part = [r for r in out if low <= r["place"] < low + 0.25]
        n = sum(len(r["text"].split()) for r in part)
        assert abs(n / total - 0.25) < 0.03 and abs(sum(len(r["text"].split()) for r in part if r["source"] == "b") / n - weight["b"]) < 0.04


def test_mixing_tells_equal_ids_of_sources_apart(spark):
    data = [(1, "a " * 50, "big"), (1, "b " * 10, "small"), (None, "c " * 20, "big"), (None, "", "small"), (2, None, None)] + [(k, "a " * 50, "big") for k in range(3, 40)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    planned, mix = mixing.plan(df, max_repeats=2.0)
    copies = {(r["doc_id"], r["source"]): r["copies"] for r in rows(planned)}
    assert copies[1, "big"] == 1 and copies[1, "small"] == 2 and copies[2, None] == 1
    assert Counter((r["doc_id"], r["source"]) for r in rows(mixing.realise(df, mix))) == copies


def test_rules_are_ordered_by_rejections_per_cost(spark):
    assert rules.greedy_order({(True, False, False): 10, (False, True, False): 9, (True, True, True): 6, (False,) * 3: 50}, [1.0, 1.0, 0.4]) == [0, 1, 2]
    assert rules.greedy_order({(True, False): 10, (False, True): 9}, [1.0, 1.0]) == [0, 1] and rules.greedy_order({(True, False): 10, (False, True): 9}, [2.0, 1.0]) == [1, 0]
    # alone rule 1 rejects 8 a unit and rule 2 rejects 7, but of the rows that rule 0 leaves rule 1 rejects none
    assert rules.greedy_order({(True, True, False): 8, (True, False, False): 4, (False, False, True): 7}, [1.0, 1.0, 1.0]) == [0, 2, 1]
    assert rules.greedy_order({(False, False): 3}, [2.0, 1.0]) == [1, 0] and rules.greedy_order({(True, True): 3}, [1.0, 1.0]) == [0, 1]
    words = "one two three four five six seven eight nine ten"
    texts = [f"{words} {k} {' '.join(words.split()[::-1])} {k + 1} {'bad' if k % 2 else 'good'}" for k in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    slow = rules.F.length(rules.F.regexp_replace(rules.F.repeat("text", 60), "[aeiou]+[^ ]*", "")) < 0
    each = [rules.Rule("slow", slow | rules.F.contains("text", rules.F.lit("bad"))), rules.Rule("never", rules.F.contains("text", rules.F.lit("#"))), rules.Rule("fast", rules.F.contains("text", rules.F.lit("bad")))]
    assert [r.name for r in rules.plan_cascade(df, each)][0] == "fast"
    assert [r.name for r in rules.plan_cascade(df.where("text = ''"), each)] == ["slow", "never", "fast"]


def test_cells_of_the_grid_and_keys_of_many_rows_are_not_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    few = spark.range(50)
    grid = plan(simhash.links(few.withColumnRenamed("id", "fp")))
    assert "SortMergeJoin" in grid and "Broadcast" not in grid
    right = few.selectExpr("id", "id + 1 AS value", "1 AS held")
    merged = plan(shared.join_heavy(few, right, ["id"], "held", shared.ROWS_PER_TASK + 1, few["id"]))
    assert "SortMergeJoin" in merged and "BroadcastHashJoin" not in merged
    found = shared.join_heavy(few, right, ["id"], "held", shared.ROWS_PER_TASK + 1, few["id"])
    assert sorted(map(tuple, found.collect())) == [(k, k + 1) for k in range(50)]
