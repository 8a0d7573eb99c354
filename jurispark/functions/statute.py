"""Statute pages: HTML to title, chapters, articles and paragraphs.

A page is flattened into events in reading order (anchors, marks of articles and paragraphs, bold and italic runs, text). The events are cut
into segments where a chapter or an article begins, and each segment is read by itself, an article's again cut where its paragraphs
begin. Python, one page at a time, run by Arrow batches; nothing recurs into a page's elements, however deep they are.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jurispark.functions.judgment import reflowed

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset(("script", "style", "form", "select"))
# Class names of the page's box and its body, images that mark articles and paragraphs, forms of anchors and headings.
BOX, BODY = {"article", "box", "login"}, "boxbody"
ARTICLE_MARK, PARAGRAPH_MARK = "sk.jpg", "hk.jpg"
ANCHOR = re.compile(r"G(\d+)([A-Z]*)")
PARAGRAPH_ID = re.compile(r"(.*)M\d+")
CHAPTER = re.compile(r"([IVXLCDM]+)\.?\s*kafli\.?\s*([A-Z]?)\.?", re.I)
TEMPORARY = re.compile(r"Ákvæði til bráðabirgða|Bráðabirgðaákvæði|Ákvæði um stundarsakir", re.I)
NUMBER = re.compile(r"\s*(\d{4})\s+nr\.\s*(\d+)(?!\w)")
VERSION = re.compile(r"Útgáfa\s+(\w+)\.")


def normal(text: str) -> str:
    text = re.sub("[\u00a0\u2007\u202f\u2009\u2002-\u2006]", " ", unicodedata.normalize("NFC", text))
    return re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t]+", " ", text)).strip()


@dataclass
class Node:
    tag: str
    attrs: dict
    children: list = field(default_factory=list)

    def text(self, without: str = "") -> str:
        parts, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x is self or x.tag != without:
                stack += reversed(x.children)
        return "".join(parts)

    def walk(self):
        """The elements inside, in reading order."""
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                yield x
                stack += reversed(x.children)

    def classes(self) -> set:
        return set((self.attrs.get("class") or "").split())


class _Tree(HTMLParser):
    """A tree of what is there: an end tag closes the nearest open element of its name, and is ignored if there is none."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs))
        if tag == "p" and self.open[-1].tag == "p":
            self.open.pop()
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def _find(root: Node, test) -> Node | None:
    return next((n for n in root.walk() if test(n)), None)


def _clean(node: Node) -> str:
    return normal(node.text("sup").replace("[", "").replace("]", ""))


# What an element stands for: its tag, what else has to hold, the event's kind and value. Without a kind it is left out; of other elements, what is inside counts.
ELEMENTS = [
    ("span", lambda n: ANCHOR.fullmatch(n.attrs.get("id") or ""), "anchor", lambda n: n.attrs["id"]),
    ("img", lambda n: ARTICLE_MARK in (n.attrs.get("src") or ""), "article", lambda n: None),
    ("img", lambda n: PARAGRAPH_MARK in (n.attrs.get("src") or "") and PARAGRAPH_ID.fullmatch(n.attrs.get("id") or ""), "paragraph", lambda n: n.attrs["id"]),
    ("i", lambda n: any(s.tag == "small" and _find(s, lambda m: m.tag == "sup") for s in n.walk()), "footnote", lambda n: normal(n.text())),
    ("b", None, "bold", lambda n: n),
    ("em", None, "italic", lambda n: n),
    ("br", None, "text", lambda n: "\n"),
    ("hr", None, "text", lambda n: "\n"),
    *((tag, None, None, None) for tag in ("img", "sup", *sorted(SKIPPED))),
]


def events(node: Node):
    """(kind, value) in reading order."""
    stack = list(reversed(node.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield "text", x
            continue
        rule = next((r for r in ELEMENTS if r[0] == x.tag and (r[1] is None or r[1](x))), None)
        if rule is None:
            stack += reversed(x.children)
        elif rule[2]:
            yield rule[2], rule[3](x)


def _segments(stream) -> list[tuple[str, str | None, list]]:
    """(kind, anchor or label, events) from one chapter's or article's beginning to the next; an anchor belongs to the article behind it."""
    out, anchor = [], None
    for kind, value in stream:
        label = _clean(value) if kind == "bold" else ""
        if kind == "anchor":
            anchor = value
        elif kind == "article":
            out.append(("article", anchor, []))
            anchor = None
        elif CHAPTER.fullmatch(label) or TEMPORARY.match(label):
            out.append(("chapter", label, []))
        elif out:
            out[-1][2].append((kind, value))
    return out


def _chapter(label: str, inside: list) -> dict:
    """A chapter; the bold run behind its numeral is its title."""
    m = CHAPTER.fullmatch(label)
    title = next((_clean(v).removesuffix(".") for k, v in inside if k == "bold"), "") if m else ""
    return {"numeral": m and m[1], "letter": (m and m[2]) or None, "label": label if m else label.removesuffix("."), "title": title or None}


def _article(anchor: str | None, inside: list, chapter: int) -> dict:
    """An article: its first bold run is the label, its first italic one before any paragraph the heading, the rest what its paragraphs hold."""
    labelled = next((k for k, (kind, v) in enumerate(inside) if kind == "bold" and _clean(v)), None)
    begins = [k for k, (kind, _) in enumerate(inside) if kind == "paragraph"] + [len(inside)]
    headings = (_clean(v).removesuffix(".") for kind, v in inside[: begins[0]] if kind == "italic")
    paragraphs = []
    for a, b in zip(begins, begins[1:]):
        runs = (v if kind == "text" else v.text() for k, (kind, v) in enumerate(inside[a + 1 : b], a + 1) if kind in ("text", "bold", "italic") and k != labelled)
        paragraphs.append((inside[a][1], normal("".join(runs))))
    if not anchor and paragraphs:
        anchor = PARAGRAPH_ID.fullmatch(paragraphs[0][0])[1]
    m = ANCHOR.fullmatch(anchor or "")
    kept = [{"anchor": i, "number": k, "text": t} for k, (i, t) in enumerate(((i, t) for i, t in paragraphs if t), 1)]
    full = "\n\n".join(p["text"] for p in kept)
    return {
        "anchor": anchor or "", "kind": "temporary" if re.match(r"B\d", anchor or "") else "article" if anchor else "annex", "article_number": int(m[1]) if m else None, "article_letter": (m and m[2].lower()) or None,
        "chapter": chapter, "label": _clean(inside[labelled][1]) if labelled is not None else "", "heading": next((h for h in headings if h), None), "footnotes": [v for kind, v in inside if kind == "footnote"],
        "paragraphs": kept, "full_text": full, "is_repealed": not re.sub(r"[\s….]", "", full),
    }


def _articles(segments: list):
    """The articles in order; those without an anchor get one, those without a label the number or the anchor for one."""
    chapters = annexes = 0
    for kind, name, inside in segments:
        if kind == "chapter":
            chapters += 1
            continue
        a = _article(name, inside, chapters - 1)
        if a["kind"] == "annex":
            a["anchor"], annexes = f"X{annexes}", annexes + 1
        letter = f" {a['article_letter']}." if a["article_letter"] else ""
        a["label"] = a["label"] or (a["anchor"] if a["article_number"] is None else f"{a['article_number']}. gr.{letter}")
        if a["label"] or a["full_text"]:
            yield a


def parse(html: str | None) -> dict | None:
    """Title, number, year, version, chapters and articles of a page; null for null, an act without articles for other pages."""
    if html is None:
        return None
    root = tree(html)
    box = _find(root, lambda n: n.tag == "div" and n.classes() >= BOX)
    body = (box and _find(box, lambda n: BODY in n.classes())) or _find(root, lambda n: n.tag == "body") or root
    heading = _find(body, lambda n: n.tag == "h2")
    numbers = (NUMBER.match(n.text()) for p in body.walk() if p.tag == "p" for n in p.walk() if n.tag in ("strong", "b"))
    number = next((m for m in numbers if m), None)
    version = VERSION.search(body.text())
    segments = _segments(events(body))
    return {
        "title": _clean(heading) if heading else "",
        "act_number": int(number[2]) if number else None,
        "year": int(number[1]) if number else None,
        "codex_version": version[1] if version else None,
        "chapters": [_chapter(name, inside) | {"ordering": k} for k, (name, inside) in enumerate((n, e) for kind, n, e in segments if kind == "chapter")],
        "provisions": list(_articles(segments)),
    }


_S, _I = T.StringType(), T.IntegerType()


def _struct(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


PARAGRAPH = _struct(anchor=_S, number=_I, text=_S)
ACT = _struct(
    title=_S, act_number=_I, year=_I, codex_version=_S,
    chapters=T.ArrayType(_struct(numeral=_S, letter=_S, label=_S, title=_S, ordering=_I)),
    provisions=T.ArrayType(_struct(anchor=_S, kind=_S, article_number=_I, article_letter=_S, chapter=_I, label=_S, heading=_S, footnotes=T.ArrayType(_S), paragraphs=T.ArrayType(PARAGRAPH), full_text=_S, is_repealed=T.BooleanType())),
)




def parsed_act(html: Column) -> Column:
    """The parsed statute of a page column as a struct."""

    def run(pages: pd.Series) -> pd.DataFrame:
        found = [parse(p) or dict.fromkeys(ACT.names) for p in pages]
        return pd.DataFrame(found, columns=ACT.names).astype({"act_number": "Int32", "year": "Int32"})

    return F.pandas_udf(run, ACT)(html)


# Elements around a page's text, and those that stand on lines of their own.
CHROME = frozenset(("nav", "header", "footer", "script", "style", "noscript", "form", "aside"))
LINES = frozenset(("p", "div", "br", "li", "h1", "h2", "h3", "h4", "article", "section", "tr"))


def main_text(html: str | None) -> str | None:
    """The text of a page's main part, without what is around it."""
    if html is None:
        return None
    root = tree(html)
    main = _find(root, lambda n: n.tag in ("main", "article")) or _find(root, lambda n: n.tag == "body") or root
    parts, stack = [], list(reversed(main.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag not in CHROME:
            edge = ["\n"] if x.tag in LINES else []
            stack += edge + list(reversed(x.children)) + edge
    return "".join(parts)


def page_text(html: Column) -> Column:
    """The reading text of a page: its main part without navigation, on reflowed lines."""

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    return reflowed(F.pandas_udf(run, T.StringType())(html))
