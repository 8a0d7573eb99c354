"""Landing zone: what connectors fetched, as files, read into documents, statute indexes and case links.

Fetching itself needs a network and is left to the connector; everything behind it is a DataFrame operation here.
"""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jurispark.functions.judgment import reflowed
from jurispark.operators.merge import first_of

# The courts' names with and without accents and their keys; node types that end a line; the least length of a judgment.
COURTS = (("hæstirétt", "haestarett", "haestirettur"), ("landsrétt", "landsrett", "landsrettur"), ("héraðsdóm", "heradsdom", "heradsdomar"))
BLOCK_NODES = frozenset(
    "document paragraph heading-1 heading-2 heading-3 heading-4 heading-5 heading-6 ordered-list unordered-list list-item blockquote hr table table-row table-cell".split()
)
LEAST_CHARS = 800
SLICE = 64
CASE = r"E-\d{1,3}/\d{2,4}"


def source_key(court: Column) -> Column:
    """The source of a court's name, null for others."""
    name, key = F.lower(court), None
    for accented, plain, value in COURTS:
        hit = F.contains(name, F.lit(accented)) | F.contains(name, F.lit(plain))
        key = F.when(hit, value) if key is None else key.when(hit, value)
    return key


def feed_items(spark: SparkSession, path: str, schema: str = "id string, court string, caseNumber string, title string, verdictDate string, keywords array<string>") -> DataFrame:
    """Items of list pages stored as JSON lines."""
    return spark.read.schema(schema).json(path)


CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w-]+)|encoding\s*=\s*[\"']([\w-]+)", re.I)


def decode(raw: bytes | None, content_type: str | None = None, default: str = "utf-8") -> str | None:
    """A stored page by the charset of its response header, else by that which its first bytes declare, else by the default; a charset that
    is unknown, or no charset of texts, is passed over. Bytes that are none of it become U+FFFD; null stays null."""
    if raw is None:
        return None
    for head in ((content_type or "").encode(), raw[:4096]):
        m = CHARSET.search(head)
        if m:
            try:
                return raw.decode((m.group(1) or m.group(2)).decode(), "replace")
            except LookupError:
                break
    return raw.decode(default, "replace")


def decoded(raw: Column, content_type: Column, default: str = "utf-8") -> Column:
    """The text of stored pages' bytes, by their response headers first."""

    def run(raws: pd.Series, types: pd.Series) -> pd.Series:
        return pd.Series([decode(r, t, default) for r, t in zip(raws, types)], dtype="object")

    return F.pandas_udf(run, T.StringType())(raw, content_type)


def decoded_pages(spark: SparkSession, path: str, default: str = "utf-8", headers: DataFrame | None = None) -> DataFrame:
    """(path, text) of stored pages. `headers` has (path, content_type) of the responses they came in, where these were kept."""
    pages = spark.read.format("binaryFile").load(path).select("path", "content")
    pages = pages.withColumn("content_type", F.lit(None).cast("string")) if headers is None else pages.join(headers.select("path", "content_type").dropDuplicates(["path"]), "path", "left")
    return pages.select("path", decoded(F.col("content"), F.col("content_type"), default).alias("text"))


def _by_type(node, name: str):
    """The first object with a __typename, depth first."""
    stack = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if x.get("__typename") == name:
                return x
            stack += reversed(list(x.values()))
        elif isinstance(x, list):
            stack += reversed(x)
    return None


def _flat(node) -> str:
    """A rich-text tree's text, a line break behind each block."""
    parts, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif isinstance(x, list):
            stack += reversed(x)
        elif isinstance(x, dict):
            if x.get("nodeType") in BLOCK_NODES:
                stack.append("\n")
            stack.append(x.get("content") or x.get("value") or [])
    return re.sub(r"\n{2,}", "\n", "".join(parts)).strip()


def rich_text(payload: Column, typename: str) -> Column:
    """The text of the first object of a type in a JSON payload; null without one or for malformed JSON."""

    def one(s: str | None) -> str | None:
        try:
            found = _by_type(json.loads(s), typename) if s else None
        except ValueError:
            return None
        inner = found and (found.get("richText") or found)
        return None if found is None else _flat(inner.get("document") or inner.get("content") or [])

    def run(s: pa.Array) -> pa.Array:
        """Some texts at a time are Python strings, not a whole batch's."""
        parts = (s.slice(i, SLICE) for i in range(0, len(s), SLICE))
        return pa.concat_arrays([pa.array(map(one, part.to_pylist()), pa.string()) for part in parts] or [pa.array([], pa.string())])

    return F.arrow_udf(run, T.StringType())(payload)


# The element of a judgment's page that holds its data, and the type of the object with the text.
DATA, VERDICT = r'(?is)<script[^>]*\bid="__NEXT_DATA__"[^>]*>(.*?)</script>', "WebVerdictByIdItem"


def judgment_text(html: Column, pdf_text: Column | None = None) -> Column:
    """A judgment's text from its page: what was read from its PDF, reflowed, else the rich text in the page's data; null without either."""
    rich = rich_text(F.nullif(F.regexp_extract(html, DATA, 1), F.lit("")), VERDICT)
    rich = F.nullif(F.trim(rich), F.lit(""))
    return rich if pdf_text is None else F.coalesce(F.nullif(reflowed(pdf_text), F.lit("")), rich)


def statute_index(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(number, year, title, version, position) of linked statutes, the first mention of each, by year and number; number 0 exists."""
    pattern = r'<a[^>]*href="[^"]*?/?(\d{4})(\d{3})\.html"[^>]*>([^<]*)</a>'
    text = F.col(html)
    groups = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), k).alias(n) for k, n in ((2, "number"), (1, "year"), (3, "title"))))
    version = F.nullif(F.regexp_extract(text, r"Útgáfa\s+(\w+)\.", 1), F.lit(""))
    rows = pages.select(page, version.alias("version"), F.posexplode(groups).alias("position", "g"))
    rows = rows.select(page, "version", "position", F.col("g.number").cast("int").alias("number"), F.col("g.year").cast("int").alias("year"), F.trim("g.title").alias("title"))
    return first_of(rows, ["number", "year"], [F.asc(page), F.asc("position")]).orderBy("year", "number")


def links(html: Column) -> Column:
    """array<struct<href, text>> of a page's anchors with an address, in order; null for null. Anchors cannot nest, so a pattern reads them."""
    anchor = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))[^>]*>(.*?)(?=</a>|<a\s|\z)"""
    part = lambda k: F.regexp_extract_all(html, F.lit(anchor), F.lit(k))
    address = F.zip_with(F.zip_with(part(1), part(2), lambda a, b: F.concat(a, b)), part(3), lambda a, b: F.concat(a, b))
    bare = lambda t: F.trim(F.regexp_replace(entities(F.regexp_replace(t, "<[^>]*>", "")), r"\s+", " "))
    found = F.zip_with(address, part(4), lambda h, t: F.struct(entities(h).alias("href"), bare(t).alias("text")))
    return F.filter(found, lambda a: a["href"] != "")


def entities(text: Column) -> Column:
    """The common character references as characters."""
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def case_links(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(href, case_number, text) of links that name a case, the first of each address."""
    rows = pages.select(page, F.posexplode(links(F.col(html))).alias("position", "a"))
    number = F.regexp_extract(F.concat_ws(" ", "a.text", "a.href"), CASE, 0)
    rows = rows.select(page, "position", F.col("a.href").alias("href"), F.col("a.text").alias("text"), number.alias("case_number")).where("case_number <> ''")
    return first_of(rows, ["href"], [F.asc(page), F.asc("position")]).select("href", "case_number", "text")


def english_document(candidates: DataFrame, by: str) -> DataFrame:
    """The document to read for each case: labelled English before unlabelled, others never; the first of equals."""
    label = F.lower(F.concat_ws(" ", "text", "href"))
    score = F.when(F.contains(label, F.lit("english")), 2).when(label.rlike("icelandic|norwegian|german|french"), 0).otherwise(1)
    best = candidates.withColumn("score", score).where("score > 0")
    return best.groupBy(by).agg(F.max_by(F.struct("href", "text"), F.struct("score", -F.col("position"))).alias("d")).select(by, "d.href", "d.text")


def gate(documents: DataFrame, main: str, fallback: str) -> DataFrame:
    """documents with text and reason: main where long enough, else the fallback if that is longer and long enough, else a reason."""
    a, b = F.length(F.coalesce(main, F.lit(""))), F.length(F.coalesce(fallback, F.lit("")))
    text = F.when(a >= LEAST_CHARS, F.col(main)).when((b > a) & (b >= LEAST_CHARS), F.col(fallback))
    return documents.withColumn("text", text).withColumn("reason", F.when(text.isNull(), F.format_string("only %d characters", F.greatest(a, b))))
