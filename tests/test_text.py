import time

import pytest
from pyspark.sql import functions as F

from jurispark.functions import citations as C
from jurispark.functions import judgment as J
from jurispark.functions import query as Q
from jurispark.functions import statute as S


@pytest.mark.parametrize(
    ("text", "web", "numbers"),
    [
        ("a AND b", "a b", ()),
        ("a NOT b", "a -b", ()),
        ("NOT b", "NOT b", ()),
        ("a or b", "a OR b", ()),
        ('"a b" E-12/2020', '"a b" E-12/2020', ("E-12/2020",)),
        ("Þ-7/2019 og 415/2018", "Þ-7/2019 og 415/2018", ("Þ-7/2019", "415/2018")),
    ],
)
def test_query_parse(text, web, numbers):
    parsed = Q.parse_query(text)
    assert (parsed.web, parsed.case_numbers) == (web, numbers)


def test_query_tree():
    tree = Q.query_tree('dog "red cat" -bird OR fish')
    assert tree.kind == "or" and tree.positive_terms() == ["dog", "red", "cat", "fish"]
    assert Q.query_tree(" - ") is None and Q.query_tree("-x").kind == "not"


@pytest.mark.parametrize(
    ("text", "expected", "label"),
    [
        ("2. mgr. 57. gr. a laga um aðbúnað", ("um aðbúnað", 57, "a", 2), "2. mgr. 57. gr. a"),
        ("57. gr. laga um vexti", ("um vexti", 57, None, None), "57. gr."),
        ("211. gr. almennra hegningarlaga", ("almennra hegningarlaga", 211, None, None), "211. gr."),
        ("hegningarlög", ("hegningarlög", None, None, None), ""),
        ("9. gr.", ("", 9, None, None), "9. gr."),
    ],
)
def test_provision_query(text, expected, label):
    q = Q.parse_provision_query(text)
    assert (q.act_query, q.article, q.letter, q.paragraph) == expected and Q.article_label(q) == label


def test_highlight_and_pager():
    assert Q.highlight_terms('"of the" AND -cat a dog') == ["of the", "cat", "dog"]
    assert Q.pages_shown(1, 3) == [1, 2, 3] and Q.pages_shown(10, 20) == [1, None, 8, 9, 10, 11, 12, None, 20]


def value(spark, column, **texts):
    """A column function's value for texts given by name."""
    from pyspark.sql import functions as F

    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in texts.items())
    return spark.createDataFrame([tuple(texts.values())], schema).select(column(*map(F.col, texts)).alias("v")).first()["v"]


def test_sentence_around(spark):
    text = "Fyrsta. Sbr. 2. mgr. 175. gr. laga nr. 91/1991 gildir það. Næsta."
    assert value(spark, J.sentence_around, t=text, k=text.index("175")) == "Sbr. 2. mgr. 175. gr. laga nr. 91/1991 gildir það."
    assert value(spark, J.sentence_around, t=text, k=2) == "Fyrsta." and value(spark, J.sentence_around, t=text, k=len(text) - 1) == "Næsta."
    assert len(value(spark, J.sentence_around, t="x" * 2000, k=1000)) == 800 and value(spark, J.sentence_around, t=None, k=1) is None


def test_snippet(spark):
    text = " ".join(f"w{k}" for k in range(100)) + " Hit " + " ".join(f"v{k}" for k in range(40))
    shown = value(spark, lambda t: J.snippet(t, ["hit", "w3"]), t=text)
    first, second = shown.split(" … ")
    assert len(first.split()) == len(second.split()) == 28 and "<mark>w3</mark>" in first and "<mark>Hit</mark>" in second and "w33" not in shown
    assert value(spark, lambda t: J.snippet(t, ["hit"]), t="a b hit c") == "a b <mark>hit</mark> c"
    assert value(spark, lambda t: J.snippet(t, ["none"]), t="x" * 300) == value(spark, lambda t: J.snippet(t, []), t="x" * 300) == "x" * 240
    long = " ".join(["hit", *(f"u{k}" for k in range(33))])
    assert value(spark, lambda t: J.snippet(t, ["hit"]), t=long) == "<mark>hit</mark> " + long[4:]


def blocks(spark, text):
    found = value(spark, J.text_blocks, t=text)
    return found if found is None else [(b["kind"], b["marker"], b["text"]) for b in found]


def test_reflow_and_blocks(spark):
    page = "Dómur\n\nÞetta er fyrsta lína málsgreinar sem heldur áfram á næs-\ntu línu og endar hér.\n- 2 -\n1. Fyrsti liður.\n    Inndregin lína hefur nýja málsgrein.\n"
    assert value(spark, J.reflowed, t=page).split("\n") == ["Dómur", "Þetta er fyrsta lína málsgreinar sem heldur áfram á næstu línu og endar hér.", "1. Fyrsti liður.", "Inndregin lína hefur nýja málsgrein."]
    body = value(spark, J.reflowed, t=page.removeprefix("Dómur\n\n"))
    assert value(spark, J.reflowed, t=body) == body
    kinds = blocks(spark, "II.\nNiðurstaða:\na) Krafan er tekin til greina.\n3. Málsástæður aðila\nSTUTT FYRIRSÖGN\n„" + "orð " * 50 + "“\nVenjuleg málsgrein.\n12")
    assert [k[0] for k in kinds] == ["heading", "heading", "list-item", "heading", "heading", "quote", "paragraph"] and kinds[2][1] == "a)"
    long = "Niðurstaða Fallist er á kröfuna sbr. 2. mgr. 70. gr. laga. " + "Setning sem er nokkuð löng og endar hér. " * 40
    blob = blocks(spark, long)
    assert blob[0] == ("heading", None, "Niðurstaða") and blob[1][2].startswith("Fallist er á kröfuna sbr. 2. mgr. 70. gr. laga.") and len(blob) > 2
    assert all(len(t) < 600 + 45 for _, _, t in blob)
    assert blocks(spark, None) is None and blocks(spark, " ") == blocks(spark, "") == []
    assert blocks(spark, "Hér er hluta-\norð sett saman en eða-ekki ekki.\nÖnnur lína") == [("paragraph", None, "Hér er hlutaorð sett saman en eða-ekki ekki."), ("paragraph", None, "Önnur lína")]


def test_summary(spark):
    summary = lambda t: value(spark, J.summary_of, t=t)
    body = "Ágreiningur var um greiðslu skuldar samkvæmt samningi aðila. Fallist var á kröfuna."
    assert summary(f"Útdráttur\n{body}\nDómur\nannað") == body
    assert summary("Dómur\nannað") is None and summary("Útdráttur\nstutt\nDómur") is None
    assert summary(f"Reifun\n{body}\n" + "x" * 12_000) == body


HTML = """<html><body><div class="article box">x</div><div class="article box login"><div class="boxbody"><h2>Lög um próf<sup>1)</sup></h2>
<p style="text-align:center"><strong>2004 nr. 81 9. júní</strong></p> Útgáfa 154b. Íslensk lög
<b>I. kafli.</b> <b>Almennt.</b><br>
<span id="G1"></span><img src="/sk.jpg"><b>1. gr.</b> <em>Gildissvið.</em><br><img id="G1M1" src="/hk.jpg"> Lög þessi [gilda]. <img id="G1M2" src="/hk.jpg"> Önnur<br>lína.<sup>2)</sup>
<i><small><sup>1)</sup>L. 1/2005.</small></i>
<span id="G2A"></span><img src="/sk.jpg"><b>2. gr. a.</b> <img id="G2AM1" src="/hk.jpg"> …
<b>Ákvæði til bráðabirgða.</b><img src="/sk.jpg"><img id="B0M1" src="/hk.jpg"> Tímabundið.
<img src="/sk.jpg"><b>Viðauki.</b></div></div></body></html>"""


def test_statute_page():
    act = S.parse(HTML)
    assert (act["title"], act["act_number"], act["year"], act["codex_version"]) == ("Lög um próf", 81, 2004, "154b")
    assert [(c["numeral"], c["title"]) for c in act["chapters"]] == [("I", "Almennt"), (None, None)]
    a, b, c, d = act["provisions"]
    assert (a["anchor"], a["label"], a["heading"], [p["text"] for p in a["paragraphs"]]) == ("G1", "1. gr.", "Gildissvið", ["Lög þessi [gilda].", "Önnur\nlína."])
    assert a["footnotes"] == ["1)L. 1/2005."] and a["chapter"] == 0 and not a["is_repealed"]
    assert (b["article_number"], b["article_letter"], b["is_repealed"]) == (2, "a", True)
    assert (c["kind"], c["anchor"], c["article_number"], c["chapter"]) == ("temporary", "B0", None, 1)
    assert (d["kind"], d["anchor"], d["label"]) == ("annex", "X0", "Viðauki.")
    assert S.parse(None) is None and S.parse("<p>x")["provisions"] == []
    deep = "<div>" * 3000 + HTML.split("<body>")[1].split("</body>")[0]
    assert [p["anchor"] for p in S.parse(deep)["provisions"]] == ["G1", "G2A", "B0", "X0"]


def test_page_text(spark):
    page = "<html><body><nav>menu</nav><main><h1>Case</h1><p>One line that\nis wrapped.</p><script>x</script><div>Two</div></main></body></html>"
    assert value(spark, S.page_text, t=page).split("\n") == ["Case", "One line that is wrapped.", "Two"]
    assert value(spark, S.page_text, t=None) is None and value(spark, S.page_text, t="") == ""


def test_citation_patterns_do_not_backtrack(spark):
    from pyspark.sql import functions as F

    from jurispark.functions import citations as C

    text = ("laga um " + "meðferðeinkamálaogfleira " * 8 + "í máli ") * 20
    df = spark.createDataFrame([(text,)] * 40, "text string")
    began = time.perf_counter()
    assert df.select(F.sum(F.size(C.act_citations(F.col("text"))) + F.size(C.provision_citations(F.col("text")))).alias("n")).first()["n"] == 0
    assert time.perf_counter() - began < 60


def test_mask_keeps_length(spark):
    from pyspark.sql import functions as F

    from jurispark.functions import citations as C

    df = spark.createDataFrame([("laga nr. 91/1991 og E-1/2020 😀 rg. 1165/2016",), ("",), ("ekkert",)], "text string")
    assert all(r["same"] for r in df.select((F.length(C.mask_legislation(F.col("text"))) == F.length("text")).alias("same")).collect())


def test_snippets_show_where_words_stand_together_and_escape(spark):
    far = " ".join(f"w{k}" for k in range(60))
    text = f"alpha {far} alpha beta <b onclick=x> {far} of the gamma {far} the of"
    shown = value(spark, lambda t: J.snippet(t, ["alpha", "beta", "of the"]), t=text)
    assert "<mark>alpha</mark> <mark>beta</mark> &lt;b onclick=x&gt;" in shown and "<mark>of the</mark> gamma" in shown and shown.count("<mark>") == 3
    assert value(spark, lambda t: J.snippet(t, ["amp"]), t="a & amp <script>") == "a &amp; <mark>amp</mark> &lt;script&gt;"
    assert value(spark, lambda t: J.snippet(t, []), t="<i>") == value(spark, lambda t: J.snippet(t, ["zz"]), t="<i>") == "&lt;i&gt;"
    assert value(spark, lambda t: J.snippet(t, ["hit"]), t=None) is None and value(spark, lambda t: J.snippet(t, ["hit"]), t="") == ""
    assert "<mark>last</mark>" in value(spark, lambda t: J.snippet(t, ["last"]), t=f"{'word ' * 60_000}last words")
    many = value(spark, lambda t: J.snippet(t, ["word", "rare"]), t=f"{'word ' * 3000}rare {'word ' * 3000}")
    assert "<mark>word</mark> <mark>rare</mark>" in many or "<mark>rare</mark> <mark>word</mark>" in many


def test_long_lines_take_time_that_grows_with_them(spark):
    took = []
    for n in (15_000, 60_000):
        began = time.perf_counter()
        blocks = value(spark, J.text_blocks, t="Dómurinn segir það vera rétt hér. " * n)
        took.append(time.perf_counter() - began)
        assert all(600 <= len(b["text"]) < 640 for b in blocks[:-1]) and sum(len(b["text"]) + 1 for b in blocks) == 34 * n
    assert took[1] < 8 * took[0] + 2
    sums = spark.createDataFrame([([1] * 1000,), ([],), ([5],), ([2] * 128,), ([3] * 129,)], "v array<int>").select(C.running_sum(F.col("v")).alias("s")).collect()
    assert [r["s"] for r in sums] == [list(range(1, 1001)), [], [5], list(range(2, 258, 2)), list(range(3, 390, 3))]
