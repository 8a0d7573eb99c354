"""What users type: boolean queries, case numbers, citations of articles. Plain Python on the driver, for one string at a time."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# How case numbers are written, E-123/2020 or 123/2020; the letters that may stand before the number.
CASE_LETTERS = "A-Za-zÞÆÖÁÐÉÍÓÚÝþæöáðéíóúý"
CASE_NUMBER = rf"(?<![A-Za-z0-9_])(?:[{CASE_LETTERS}]{{1,3}}-?[0-9]{{1,5}}/[0-9]{{2,4}}|[0-9]{{1,6}}/[0-9]{{4}})(?![A-Za-z0-9_])"


@dataclass(frozen=True)
class Node:
    """A part of a query: term, phrase, and, or, not."""

    kind: str
    term: str = ""
    terms: tuple[str, ...] = ()
    nodes: tuple[Node, ...] = field(default=())

    def positive_terms(self) -> list[str]:
        """The terms outside negations, in order."""
        if self.kind == "not":
            return []
        own = [self.term] if self.term else list(self.terms)
        return own + [t for n in self.nodes for t in n.positive_terms()]


    def positive_items(self) -> list[str]:
        """The terms and phrases outside negations, in order; a phrase is its words between blanks."""
        if self.kind == "not":
            return []
        own = [self.term] if self.term else [" ".join(self.terms)] if self.terms else []
        return own + [t for n in self.nodes for t in n.positive_items()]


@dataclass(frozen=True)
class ParsedQuery:
    raw: str
    web: str
    case_numbers: tuple[str, ...]


def parse_query(text: str) -> ParsedQuery:
    """The query with AND, NOT and or between blanks rewritten, and the case numbers in it."""
    raw = text.strip()
    web = re.sub(r"\s+AND\s+", " ", raw)
    web = re.sub(r"\s+NOT\s+", " -", web)
    web = re.sub(r"\s+or\s+", " OR ", web, flags=re.IGNORECASE)
    return ParsedQuery(raw, web, tuple(re.findall(CASE_NUMBER, raw)))


def _words(text: str) -> tuple[str, ...]:
    return tuple(w for w in re.split(r"[\W_]+", text.lower()) if w)


def query_tree(web: str) -> Node | None:
    """Words side by side must all match, quotes make phrases, OR alternatives, - negations; None for a query without a word."""
    options: list[list[Node]] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"?|(\S+)', web):
        if m.group(3) == "OR":
            options.append([])
            continue
        quoted = m.group(3) is None
        barred = m.group(1) == "-" if quoted else m.group(3).startswith("-")
        words = _words(m.group(2) if quoted else m.group(3))
        if not words:
            continue
        node = Node("term", words[0]) if len(words) == 1 else Node("phrase", terms=words)
        options[-1].append(Node("not", nodes=(node,)) if barred else node)
    parts = [o[0] if len(o) == 1 else Node("and", nodes=tuple(o)) for o in options if o]
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else Node("or", nodes=tuple(parts))


def highlight_terms(text: str) -> list[str]:
    """Phrases, then words without a leading -, longer than one character, each once; no operators."""
    phrases = re.findall(r'"([^"]+)"', text)
    words = [w.lstrip("-") for w in re.sub(r'"[^"]*"', " ", text).split()]
    found = [p.strip() for p in phrases] + [w for w in words if w.upper() not in ("AND", "OR", "NOT")]
    return list(dict.fromkeys(t for t in found if len(t) > 1))


@dataclass(frozen=True)
class ProvisionQuery:
    act_query: str
    article: int | None = None
    letter: str | None = None
    paragraph: int | None = None

    @property
    def has_article(self) -> bool:
        return self.article is not None


# The abbreviations for point, sentence, paragraph and article, and what may stand between an article and its statute's name.
UNITS = {"tölul": "point", "málsl": "sentence", "mgr": "paragraph", "gr": "article"}
ORDER = ["point", "sentence", "paragraph", "article"]
LEAD_IN = ["sbr", "í", "lögunum", "laganna", "lögum", "laga", "lög", "l"]
TOKEN = re.compile(r"\d+|[^\W\d_]+|[^\w\s]")


def parse_provision_query(text: str) -> ProvisionQuery:
    """`2. mgr. 211. gr. b laga um ...` as paragraph 2 of article 211 b of "um ..."; without a leading article all is the statute.

    Read token by token: numbers with a unit behind each, in the order of UNITS, up to an article; then a single letter; then the words
    that lead to a statute's name, each at most once and in their order.
    """
    text = text.strip()
    tokens = [(m.group().lower(), m.end()) for m in TOKEN.finditer(text)]
    at, end, numbers = 0, 0, {}

    def word(k: int) -> str:
        return tokens[k][0] if k < len(tokens) else ""

    def skip(*marks: str) -> None:
        nonlocal at, end
        while word(at) in marks:
            end, at = tokens[at][1], at + 1

    while "article" not in numbers:
        unit = UNITS.get(word(at + 2)) if word(at).isdigit() and word(at + 1) == "." else None
        if unit is None or any(ORDER.index(u) >= ORDER.index(unit) for u in numbers) or unit != "article" and word(at + 3) != ".":
            return ProvisionQuery(text)
        numbers[unit], end, at = int(word(at)), tokens[at + 2][1], at + 3
        skip(".")
    letter = None
    if len(word(at)) == 1 and word(at).isalpha() and not (word(at) in ("í", "l") and word(at + 1) in (".", *LEAD_IN)):
        letter, end, at = word(at), tokens[at][1], at + 1
        skip(".")
    skip(",")
    if word(at) == "sbr":
        skip("sbr", ".")
    if word(at) == "í":
        skip("í")
    if word(at) in LEAD_IN[2:-1]:
        skip(word(at))
    elif word(at) == "l" and word(at + 1) == ".":
        skip("l", ".")
    return ProvisionQuery(text[end:].strip(), numbers["article"], letter, numbers.get("paragraph"))


def article_label(q: ProvisionQuery) -> str:
    """`2. mgr. 211. gr. b`, empty without an article."""
    if not q.has_article:
        return ""
    parts = [f"{q.paragraph}. mgr." if q.paragraph else "", f"{q.article}. gr.", q.letter or ""]
    return " ".join(p for p in parts if p)


def pages_shown(current: int, total: int, window: int = 5) -> list[int | None]:
    """The page numbers of a pager: the first, the last and a window around the current one, None for gaps."""
    half = window // 2
    low = max(1, min(current - half, total - window + 1))
    shown = sorted({1, total, *range(low, min(total, low + window - 1) + 1)})
    out: list[int | None] = []
    for a, b in zip([0, *shown], shown):
        if b - a > 1:
            out.append(None)
        out.append(b)
    return out
