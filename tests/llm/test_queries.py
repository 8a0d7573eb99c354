"""The registered queries that SQL cannot check, against plain Python over the same tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from jurispark.llm import langid, mixing, ordinal, pieces, queries, toxicity
from jurispark.llm import words as W

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "lang", "source"])
    return {r["doc_id"]: r for r in table.to_pylist()}


def run(spark, name):
    df = queries.QUERIES[name](spark, SF)
    return dict(df.dtypes), [r.asDict() for r in df.collect()]


def held(doc_id, parts, part):
    return zlib.crc32(str(doc_id).encode()) % parts == part


def test_op2_ids_are_those_of_the_texts(spark, texts):
    types, found = run(spark, "op2_sentencepiece")
    assert types["n_ids"] in ("int", "bigint") and {r["doc_id"] for r in found} == set(texts)
    p = pieces.Pieces(pieces.model_bytes())
    for r in found[::7]:
        t = texts[r["doc_id"]]["text"]
        assert r["n_ids"] == (0 if t is None else sum(map(len, p.encode(t)))) and r["round_trip"] in (True, None)


def test_op4_equals_brute_force(spark, texts):
    types, found = run(spark, "op4_simhash")
    assert (types["fingerprint"], types["component_id"]) == ("string", "bigint")
    prints = {}
    for k, r in texts.items():
        w = WORD.findall((r["text"] or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {k: (f"{prints[k]:016x}", find(k)) for k in ids}


def naive_hits(folded, lexicon):
    """Every entry at every place, without an automaton."""
    spared, best = [], {}
    for e in lexicon.exceptions:
        at = folded.find(f" {e} ")
        while at >= 0:
            spared.append((at, at + len(e) + 1))
            at = folded.find(f" {e} ", at + 1)
    for begin in (k for k, c in enumerate(folded) if c == " "):
        fit = [w for e, w in lexicon.weights.items() if folded.startswith(e, begin)]
        if fit and not any(x <= begin < y for x, y in spared):
            best[begin] = max(fit)
    return best


def test_op5_scores_are_those_of_a_naive_matcher(spark, texts):
    types, found = run(spark, "op5_toxicity")
    assert (types["held_out"], types["score"], types["predicted"]) == ("boolean", "double", "int")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = langid.held_out(parts=3, part=1)
    lexicon = toxicity.learn(docs.where(~out), spark.read.parquet(f"{SF}/labels.parquet").where(~out))
    for r in found:
        t = texts[r["doc_id"]]["text"]
        folded = toxicity.fold(t) if t else " "
        x = sum(naive_hits(folded, lexicon).values()) / math.log(math.e + folded.count(" "))
        assert abs(r["score"] - 1 / (1 + math.exp(-min(30, max(-30, lexicon.slope * x + lexicon.bias))))) < 1e-9
        assert r["held_out"] == held(r["doc_id"], 3, 1) and r["predicted"] == int(r["score"] >= 0.7)
    assert {r["doc_id"] for r in found} == set(texts)


def test_toxicity_of_tables_with_nothing_copies_and_clashing_names(spark, documents, empty):
    data = [(k, f"plain words number {k} and w{k * 5 % 13} {'awfulness' if k % 3 == 0 else 'kindness'} w{k * 7 % 11} here", int(k % 3 == 0)) for k in range(90)]
    df = spark.createDataFrame([*data, *data[:30]], "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert any("awfulness".startswith(e.strip()) for e in lexicon.weights)
    clashing = documents.withColumn("score", toxicity.F.lit("x")).withColumn("predicted", toxicity.F.lit(None)).withColumn("entry", toxicity.F.lit(1))
    out = toxicity.toxicity(clashing, lexicon)
    assert out.columns == clashing.columns and out.count() == 13 and dict(out.dtypes)["score"] == "double"
    assert toxicity.toxicity(empty, lexicon).count() == 0
    assert toxicity.learn(df.select("doc_id", "text"), df.where("toxic = 0").select("doc_id", "toxic")).weights == {}


def test_op6_columns_and_gradients(spark, texts, documents):
    types, found = run(spark, "op6_quality_classifier")
    assert {types[c] for c in ("expected_grade", "tail_probability")} == {"double"} and {r["doc_id"] for r in found} == set(texts)
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) and 0 <= r["tail_probability"] <= 1 and r["kept"] == (r["tail_probability"] >= 0.5) for r in found)
    rng = np.random.default_rng(1)
    for _ in range(40):
        theta = ordinal.ordered(np.sort(rng.normal(size=3)))
        s, y, step = rng.normal(), int(rng.integers(4)), 1e-6
        loss, by_score, by_theta = ordinal.slopes(s, y, theta)
        cut = [-np.inf, *theta, np.inf]
        assert abs(loss + np.log(1 / (1 + np.exp(s - cut[y + 1])) - 1 / (1 + np.exp(s - cut[y])))) < 1e-6
        assert abs((ordinal.slopes(s + step, y, theta)[0] - ordinal.slopes(s - step, y, theta)[0]) / (2 * step) - by_score) < 1e-4
        for k in range(3):
            move = step * np.eye(3)[k]
            assert abs((ordinal.slopes(s, y, theta + move)[0] - ordinal.slopes(s, y, theta - move)[0]) / (2 * step) - by_theta[k]) < 1e-4
    assert all(np.diff(ordinal.ordered(np.array(t))) .min() > 0 for t in ([0.0, 0.0, 0.0], [3.0, 1.0, 2.0], [1.0, 2.0, 2.0]))
    model = ordinal.fit([(np.array([1]), np.array([1.0]), np.zeros(len(ordinal.FORM)), k % 4) for k in range(40)], 3)
    clashing = documents.withColumn("expected_grade", ordinal.F.lit("x")).withColumn("__text", ordinal.F.lit(1))
    assert np.diff(model.thresholds).min() > 0 and ordinal.graded(clashing, model).columns == [*clashing.columns, "tail_probability", "selected"]


def naive_ftrl(examples, classes, epochs, alpha, beta, l1, l2, seed):
    z, n = {}, {}
    zb, nb = [0.0] * classes, [0.0] * classes

    def weight(zi, ni, penalty):
        return 0.0 if abs(zi) <= penalty else (math.copysign(penalty, zi) - zi) / ((beta + math.sqrt(ni)) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            ids, x, y = examples[k]
            b = [weight(zb[c], nb[c], 0.0) for c in range(classes)]
            s = [b[c] + sum(v * weight(z.get((i, c), 0.0), n.get((i, c), 0.0), l1) for i, v in zip(ids, x)) for c in range(classes)]
            e = [math.exp(v - max(s)) for v in s]
            error = [v / sum(e) - (c == y) for c, v in enumerate(e)]
            for c in range(classes):
                for i, v in zip(ids, x):
                    g, zi, ni = v * error[c], z.get((i, c), 0.0), n.get((i, c), 0.0)
                    z[i, c] = zi + g - (math.sqrt(ni + g * g) - math.sqrt(ni)) / alpha * weight(zi, ni, l1)
                    n[i, c] = ni + g * g
                zb[c] += error[c] - (math.sqrt(nb[c] + error[c] ** 2) - math.sqrt(nb[c])) / alpha * b[c]
                nb[c] += error[c] ** 2
    return {k: weight(v, n[k], l1) for k, v in z.items()}, [weight(zb[c], nb[c], 0.0) for c in range(classes)]


def test_op7_and_its_training(spark, texts):
    types, found = run(spark, "op7_language_id")
    assert (types["held_out"], types["lang_pred"], types["score"]) == ("boolean", "string", "double") and {r["doc_id"] for r in found} == set(texts)
    known = {r["lang"] for r in texts.values()} - {None}
    for r in found:
        t = texts[r["doc_id"]]["text"]
        assert r["held_out"] == held(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in known if t and any(map(str.isalpha, t)) else r["lang_pred"] == "und"
    judged = [r for r in found if r["held_out"] and texts[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == texts[r["doc_id"]]["lang"] for r in judged) >= 0.95 * len(judged)
    rng = np.random.default_rng(5)
    examples = [(np.sort(rng.choice(40, 6, replace=False)), rng.random(6), int(rng.integers(3))) for _ in range(60)]
    w, b = langid.ftrl(examples, 3, epochs=2, l1=0.3)
    expected, bias = naive_ftrl(examples, 3, 2, 0.5, 1.0, 0.3, 1e-3, 7)
    assert np.allclose(b, bias) and all(abs(w[i, c] - v) < 1e-9 for (i, c), v in expected.items()) and (w[:40] == 0).any()
    scores, labels = rng.normal(size=(400, 3)), rng.integers(3, size=400)
    scores[np.arange(400), labels] += 1.5
    t = langid.temperature(scores * 4, labels)
    losses = [-np.log(langid.softmax(scores * 4 / x)[np.arange(400), labels]).mean() for x in (0.8 * t, t, 1.25 * t)]
    assert losses[1] <= min(losses)


def test_op8_equals_brute_force(spark, texts):
    types, found = run(spark, "op8_source_mixing")
    assert types["copies"] == "bigint" and {r["doc_id"] for r in found} == set(texts)
    words = Counter()
    for k, r in texts.items():
        words[r["source"]] += len(WORD.findall((r["text"] or "").encode()))
    p = {s: n / sum(words.values()) for s, n in words.items() if n}
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        epochs = [x ** (mid - 1) for x in p.values()]
        low, high = (low, mid) if max(epochs) / min(epochs) <= 2 else (mid, high)
    z = sum(x**high for x in p.values())
    least = min(x ** (high - 1) for x in p.values())
    by_source = {}
    for r in found:
        assert r["n_words"] == len(WORD.findall((texts[r["doc_id"]]["text"] or "").encode())) and r["source"] == texts[r["doc_id"]]["source"] and 0 <= r["block"] < mixing.BLOCKS
        by_source.setdefault(r["source"], []).append(r)
    for s, own in by_source.items():
        if s in p:
            epochs = p[s] ** (high - 1) / least
            assert abs(own[0]["weight"] - p[s] ** high / z) < 1e-6
            read, longest = sum(r["copies"] * r["n_words"] for r in own), max(r["n_words"] for r in own)
            assert epochs * words[s] - longest - 1 <= read <= epochs * words[s] + 1
            assert {r["copies"] for r in own if r["n_words"]} <= {math.floor(epochs + 1e-6), math.ceil(epochs - 1e-6)}
    schedules = {}
    for r in found:
        assert len(r["reads"]) == r["copies"] and [x["epoch"] for x in r["reads"]] == list(range(r["copies"])) and all(0 <= x["place"] <= 1 for x in r["reads"])
        for x in r["reads"]:
            assert schedules.setdefault((r["source"], x["epoch"]), {}).setdefault(r["block"], x["place"]) == x["place"]
    for (s, epoch), places in schedules.items():
        if s not in p:
            continue
        total, of = words[s] * round(p[s] ** (high - 1) / least, 9), Counter()
        for r in by_source[s]:
            of[r["block"]] += r["n_words"]
        rest = {b: n for b, n in of.items() if b not in places}
        order = sorted(places, key=lambda b: (places[b], of[b] > 0))
        upto = epoch * words[s]
        if not rest:  # whole epochs: each block begins where those before it end
            for b in order:
                assert abs(places[b] - upto / total) < 1e-6
                upto += of[b]
        if epoch and len(of) > 5:
            assert order != sorted(schedules[s, 0], key=lambda b: schedules[s, 0][b])


def naive_grams(text):
    """The n-gram buckets of a text, one character at a time."""
    c = [32]
    for x in (text or "").lower():
        if x.isalpha():
            c.append(ord(x))
        elif len(c) > 1 and c[-1] != 32:
            c.append(32)
    if len(c) > 1 and c[-1] != 32:
        c.append(32)
    out = []
    for n in (1, 2, 3):
        for i in range(len(c) - n + 1):
            if n > 1 or c[i] != 32:
                h = n
                for x in c[i : i + n]:
                    h = (h ^ x) * 0x9E3779B1 % 2**32
                    h ^= h >> 15
                out.append(h * 0x85EBCA77 % 2**32 >> 16)
    return out


def test_op7_equals_brute_force(spark, texts):
    _, found = run(spark, "op7_language_id")
    grams = {k: Counter(naive_grams(r["text"])) for k, r in texts.items()}
    known = sorted(k for k, r in texts.items() if not held(k, 5, 0) and r["lang"] is not None and r["text"] is not None)
    df = Counter(b for k in known for b in grams[k])
    idf = lambda b: math.log((1 + len(known)) / (1 + df[b])) + 1
    value = lambda k: {b: n / max(1, grams[k].total()) * idf(b) for b, n in grams[k].items()}
    names = sorted({texts[k]["lang"] for k in known})
    examples = [(np.array(sorted(v)), np.array([np.float32(20.0) * np.float32(grams[k][b] / max(1, grams[k].total())) * idf(b) for b in sorted(v)]), names.index(texts[k]["lang"])) for k in known for v in [value(k)]]
    w, bias = naive_ftrl([e for k, e in enumerate(examples) if k % 5], len(names), 4, 0.5, 1.0, 1e-3, 1e-3, 7)
    score = lambda v: [sum(20 * x * w.get((b, c), 0.0) for b, x in v.items()) + bias[c] for c in range(len(names))]
    t = langid.temperature(np.array([[sum(x * w.get((b, c), 0.0) for b, x in zip(ids, xs)) + bias[c] for c in range(len(names))] for ids, xs, _ in examples[::5]]), np.array([y for *_, y in examples[::5]]))
    for r in found:
        if not grams[r["doc_id"]]:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        z = [x / t for x in score(value(r["doc_id"]))]
        e = [math.exp(x - max(z)) for x in z]
        assert abs(r["score"] - max(e) / sum(e)) < 2e-3 and names[int(np.argmax(z))] == r["lang_pred"]


M64 = 2**64


def naive_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % M64
    return x ^ x >> 31


def naive_sum(values, odd):
    return naive_mix(sum(v * pow(odd, k, M64) for k, v in enumerate(values)) % M64)


def naive_features(text):
    """The shares of a text's word and pair buckets, and the measures of its form, a word at a time."""
    data = (text or "").encode()
    words = WORD.findall(data)
    values = [int(x) for x in W.BYTE_VALUES]
    seen = {}
    h = [seen.setdefault(w, naive_sum([values[c] for c in w], W.ODD["byte"])) for w in words]
    buckets = Counter(x >> 47 for x in h) + Counter(naive_sum(p, W.ODD["gram"]) >> 47 for p in zip(h, h[1:]))
    again = lambda xs: len(xs) - len(set(xs))
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n, size, plain = max(1, len(words)), max(1, len(data)), data.decode("latin1")
    upper, lower = (sum(c < 128 and f(chr(c)) for c in data) for f in (str.isupper, str.islower))
    signs = sum(ord(c) < 128 and not c.isalnum() and not c.isspace() and c not in ".,;:'\"-()?" for c in plain)
    form = [math.log1p(len(words)) / 5, sum(map(len, words)) / n / 6, upper / max(upper + lower, 1), sum(48 <= c < 58 for c in data) / size, 10 * signs / size, again(words) / n, again(runs) / n, 5 * data.count(b"\n") / n]
    total = max(1, buckets.total())
    return {b: c / total for b, c in buckets.items()}, form


def naive_grader(examples, top):
    """Cumulative-link weights by single steps over plain dictionaries."""
    w, g2, v, v2 = {}, {}, [0.0] * 8, [1e-6] * 8
    theta, t2 = list(np.linspace(-1, 1, top)), [1e-6] * top
    per = Counter(y for *_, y in examples)
    logistic = lambda x: 1 / (1 + math.exp(-min(35, max(-35, x))))
    rng = np.random.default_rng(3)
    for _ in range(12):
        for k in rng.permutation(len(examples)):
            shares, form, y = examples[k]
            s = sum(30 * x * w.get(b, 0.0) for b, x in shares.items()) + sum(a * b for a, b in zip(form, v))
            below = [0.0] + [logistic(t - s) for t in theta] + [1.0]
            p = max(below[y + 1] - below[y], 1e-9)
            slope = [b * (1 - b) / p for b in below]
            weight = len(examples) / (top + 1) / max(1, per[y])
            gs = slope[y + 1] - slope[y]
            for b, x in shares.items():
                g = weight * gs * 30 * x + 1e-5 * w.get(b, 0.0)
                g2[b] = g2.get(b, 1e-6) + g * g
                w[b] = w.get(b, 0.0) - 0.1 * g / math.sqrt(g2[b])
            for j, x in enumerate(form):
                g = weight * gs * x
                v2[j] += g * g
                v[j] -= 0.1 * g / math.sqrt(v2[j])
            for j, sign in ((y, -1), (y - 1, 1)):
                if 0 <= j < top:
                    g = weight * sign * slope[j + 1]
                    t2[j] += g * g
                    theta[j] -= 0.1 * g / math.sqrt(t2[j])
            for j in range(1, top):
                theta[j] = max(theta[j], theta[j - 1] + 1e-3)
    return w, v, theta


def test_op6_equals_brute_force(spark, texts):
    _, found = run(spark, "op6_quality_classifier")
    own = {k: naive_features(r["text"]) for k, r in texts.items()}
    grades = {}
    for r in pq.read_table(f"{SF}/labels.parquet").to_pylist():
        if not held(r["doc_id"], 3, 1) and r["quality"] is not None and r["doc_id"] in texts:
            g = r["quality"] * (2 - (r["toxic"] or 0))
            grades[r["doc_id"]] = min(g, grades.get(r["doc_id"], g))
    order = sorted(grades, key=lambda k: (k, np.array(sorted(own[k][0]), np.int32).tobytes()))
    w, v, theta = naive_grader([(*own[k], grades[k]) for k in order], max(grades.values()))
    for r in found:
        shares, form = own[r["doc_id"]]
        s = sum(30 * x * w.get(b, 0.0) for b, x in shares.items()) + sum(a * b for a, b in zip(form, v))
        tails = [1 / (1 + math.exp(t - s)) for t in theta]
        assert abs(r["expected_grade"] - sum(tails)) < 5e-3 and abs(r["tail_probability"] - tails[-1]) < 5e-3
        assert r["held_out"] == held(r["doc_id"], 3, 1) and r["kept"] == (r["tail_probability"] >= 0.5)
