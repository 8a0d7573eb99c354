"""The engine's public functions: one for each thing a search application asks.

A Library holds the tables as DataFrames. Every function checks its arguments (ValueError for bad ones, KeyError for unknown ids) and returns
DataFrames or small results of one page; nothing of corpus size is collected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jurispark.functions.judgment import SUMMARY_WINDOW, escaped, marked, snippet, summary_of
from jurispark.functions.query import article_label, highlight_terms, parse_provision_query, parse_query, query_tree
from jurispark.operators import citation_graph as G
from jurispark.operators import fulltext as X
from jurispark.operators import fuzzy as Z
from jurispark.operators import ingest as I
from jurispark.operators import retrieval as R
from jurispark.operators import tags as T
from jurispark.operators.runner import Store


@dataclass(frozen=True)
class SearchRequest:
    query: str = ""
    sources: tuple[str, ...] = ()
    date_from: str | None = None
    date_to: str | None = None
    year: int | None = None
    tags: tuple[str, ...] = ()
    provision_ids: tuple = ()
    act_ids: tuple = ()
    sort: str = "relevance"
    page: int = 1
    page_size: int = R.PAGE_SIZE
    count_cap: int | None = None  # without one all documents found are counted


@dataclass(frozen=True)
class Library:
    """documents: document_id, source, case_number, case_name, title, date, year, tags, text. acts: act_id, act_number, year, title, aliases.
    provisions: provision_id, act_id, kind, article_number, article_letter, label, heading, ordering. The links as the linking operator gives them.
    postings and provision_postings are the indexes of `fulltext.postings`."""

    documents: DataFrame
    acts: DataFrame
    provisions: DataFrame
    provision_links: DataFrame
    act_links: DataFrame
    postings: DataFrame
    provision_postings: DataFrame
    sources: dict = field(default_factory=dict)  # key: (name, group, status)
    vocabulary: DataFrame | None = None  # (tag, n) of the documents' tags, as `tags.vocabulary` counts them


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int
    capped: bool
    pages: int


def search_documents(lib: Library, req: SearchRequest) -> Page:
    """One page of documents that match the text or a case number in it and all filters; similar case numbers, titles and names are tried only
    if nothing matches. Snippets and summaries are made for the page's rows alone."""
    known = [s for s in req.sources if not lib.sources or s in lib.sources]
    if not known:
        raise ValueError("at least one known source is needed")
    if req.sort not in R.ORDERS:
        raise ValueError(f"sort must be one of {', '.join(R.ORDERS)}")
    allowed = lib.documents.where(R.in_sources(known) & R.in_dates(req.date_from, req.date_to) & R.in_year(req.year) & R.has_all(list(dict.fromkeys(req.tags))))
    allowed = G.with_citations(allowed, list(req.provision_ids), list(req.act_ids), lib.provision_links, lib.provisions, lib.act_links)
    parsed = parse_query(req.query)
    tree = query_tree(parsed.web)
    items = tree.positive_items() if tree else []
    found = allowed.withColumn("rank", F.lit(0.0)) if not req.query.strip() else _matching(lib, allowed, parsed, tree)
    if req.query.strip() and found.isEmpty():
        near = F.lit(False)
        for n in parsed.case_numbers:
            near = near | (Z.similarity(Z.trigrams(F.col("case_number")), Z.trigrams(F.lit(n))) >= Z.THRESHOLD)
        for c in ("title", "case_name"):
            near = near | (Z.similarity(Z.trigrams(F.col(c)), Z.trigrams(F.lit(parsed.raw))) >= Z.THRESHOLD)
        found = allowed.where(F.coalesce(near, F.lit(False))).withColumn("rank", F.lit(0.0))
    count = R.capped_count(found.select("document_id"), req.count_cap).first()
    page = R.page(found.drop("text"), req.sort, req.page, req.page_size)
    shown = page.join(lib.documents.select("document_id", "text"), "document_id")
    rows = shown.withColumns({"snippet": snippet(F.col("text"), items), "summary": summary_of(F.substring("text", 1, SUMMARY_WINDOW))}).drop("text").orderBy(*R.ORDERS[req.sort]())
    size = min(R.MOST_PER_PAGE, max(1, req.page_size))
    return Page(rows, count["total"], count["capped"], R.total_pages(count["total"], size))


def _matching(lib: Library, allowed: DataFrame, parsed, tree) -> DataFrame:
    ids = X.matching(lib.postings, tree, allowed) if tree else allowed.select("document_id").limit(0)
    for n in parsed.case_numbers:
        ids = ids.union(allowed.where(R.case_number_is(n)).select("document_id"))
    found = allowed.join(ids.distinct(), "document_id", "left_semi")
    words = tree.positive_terms() if tree else []
    if not words:
        return found.withColumn("rank", F.lit(0.0))
    return found.join(X.rank(lib.postings, words), "document_id", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))


def search_acts(lib: Library, q: str, most: int = 10) -> DataFrame:
    """Type-ahead over statutes with their articles; nothing for a blank query."""
    found = Z.type_ahead(lib.acts, q, most, "act_number") if q.strip() else lib.acts.withColumns({"bucket": F.lit(0), "similarity": F.lit(0.0)}).limit(0)
    counted = found.join(G.articles_per_act(lib.provisions), "act_id", "left").withColumn("articles", F.coalesce("articles", F.lit(0)))
    return with_addresses(counted)


# Where statutes are shown here and where the official text is.
ACT_PATH, OFFICIAL = "/log/%d-%d", "https://www.althingi.is/lagas/nuna/%d%03d.html"


def with_addresses(acts: DataFrame) -> DataFrame:
    """Statutes with citation, path and official_url; their articles' paths have the anchor behind `#`."""
    return acts.withColumns({
        "citation": F.format_string("lög nr. %d/%d", "act_number", "year"), "path": F.format_string(ACT_PATH, "act_number", "year"), "official_url": F.format_string(OFFICIAL, "year", "act_number"),
    })


def filter_acts(acts: DataFrame, q: str) -> DataFrame:
    """Statutes whose title holds the query, whatever its case, or whose citation, number or an alias does; all for a blank one."""
    lowered = F.lit(q.strip().lower())
    number = F.format_string("%d/%d", "act_number", "year")
    hit = F.contains(F.lower("title"), lowered) | F.contains(F.concat(F.lit("lög nr. "), number), lowered) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(a, lowered))
    return acts.where(hit) if q.strip() else acts


def filter_provisions(provisions: DataFrame, q: str) -> DataFrame:
    """Articles whose label, heading or any of whose paragraphs holds the query, whatever its case; all for a blank one."""
    lowered = F.lit(q.strip().lower())
    holds = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), lowered)
    hit = holds(F.col("label")) | holds(F.col("heading")) | F.coalesce(F.exists("paragraphs", holds), F.lit(False))
    return provisions.where(hit) if q.strip() else provisions


def hit_count(text: Column, query: str) -> Column:
    """How often any word of the query occurs in a text, as a pattern and whatever its case; 0 for a blank query or one that is no pattern."""
    words = query.replace('"', "").split()
    if not words:
        return F.lit(0)
    pattern = "(?iu)" + "|".join(words)
    java = SparkSession.active().sparkContext._jvm.java.util.regex
    try:
        java.Pattern.compile(pattern)  # the engine that will run it has to say whether it is a pattern
    except IllegalArgumentException:
        return F.lit(0)
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def highlighted(text: Column, query: str) -> Column:
    """HTML of a whole text with the query's phrases and words marked, whatever their case; nothing else of it is read as HTML. Null stays null."""
    terms = highlight_terms(query)
    return marked(text, f"(?iu)({'|'.join(map(re.escape, terms))})") if terms else escaped(text)


def list_acts(lib: Library, sort: str = "title", cited_only: bool = False, page: int = 1, page_size: int = 100) -> DataFrame:
    size = min(1000, max(1, page_size))
    return G.catalogue(lib.acts, lib.provision_links, lib.provisions, lib.act_links, sort, cited_only).offset((max(1, page) - 1) * size).limit(size)


def parse_slug(slug: str) -> tuple[int, int]:
    m = re.fullmatch(r"(\d{1,3})-(\d{4})", slug)
    if not m:
        raise ValueError("a slug looks like 91-1991")
    return int(m[1]), int(m[2])


def act_detail(lib: Library, slug: str) -> tuple[dict, DataFrame]:
    """A statute and its articles in order with their badges and chapters' runs."""
    number, year = parse_slug(slug)
    act = lib.acts.where((F.col("act_number") == number) & (F.col("year") == year)).first()
    if act is None:
        raise KeyError(slug)
    own = lib.provisions.where(F.col("act_id") == act["act_id"])
    links = lib.provision_links.join(own.select("provision_id"), "provision_id", "left_semi")
    badges = G.provision_badges(links, own).select("provision_id", "judgments", "passages")
    total = G.citing_act(act["act_id"], lib.provision_links, lib.provisions, lib.act_links).count()
    cited = badges.agg(F.count_if(F.col("judgments") > 0)).first()[0]
    return act.asDict() | {"judgments": total, "cited_provisions": cited}, own.join(badges, "provision_id").orderBy("ordering")


def search_provisions(lib: Library, q: str, act_id=None, page: int = 1, page_size: int = 20) -> DataFrame:
    """Articles by number, or by text; within a statute a number replaces the text search. Nothing without a query and a statute."""
    size = min(R.MOST_PER_PAGE, max(1, page_size))
    own = lib.provisions if act_id is None else lib.provisions.where(F.col("act_id") == act_id)
    m = re.fullmatch(r"(\d+)\.?\s*(?:gr\.?)?\s*([a-záðéíóúýþæö])?\.?", q.strip(), re.I)
    exact = F.lit(False)
    if m:
        letter = F.lit(m[2].lower() if m[2] else None).cast("string")
        exact = (F.col("kind") == "article") & (F.col("article_number") == int(m[1])) & F.col("article_letter").eqNullSafe(letter)
    tree = query_tree(parse_query(q).web)
    if not q.strip() and act_id is None:
        found = own.limit(0).withColumn("rank", F.lit(0.0))
    elif m and act_id is not None or not tree:
        found = own.where(exact if m else F.lit(True)).withColumn("rank", F.lit(0.0))
    else:
        keyed = own.withColumnRenamed("provision_id", "document_id")
        ids = X.matching(lib.provision_postings, tree, keyed).union(keyed.where(exact).select("document_id")).distinct()
        found = keyed.join(ids, "document_id", "left_semi").join(X.rank(lib.provision_postings, tree.positive_terms()), "document_id", "left")
        found = found.withColumnRenamed("document_id", "provision_id").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    counts = G.judgments_per_provision(lib.provision_links)
    found = found.join(lib.acts.select("act_id", F.col("title").alias("act_title"), F.col("year").alias("act_year")), "act_id").join(counts, "provision_id", "left")
    number = F.when(F.col("article_number") == int(m[1]), 0).otherwise(1) if m else F.lit(0)
    found = found.withColumns({"judgments": F.coalesce("judgments", F.lit(0)), "by_number": number})
    return found.orderBy("by_number", F.desc("rank"), F.desc("act_year"), "ordering", "provision_id").offset((max(1, page) - 1) * size).limit(size)


def provision_cases(lib: Library, provision_id, page: int = 1) -> tuple[dict, DataFrame]:
    """How many judgments and passages cite an article, and a page of the judgments with collapsed passages."""
    if lib.provisions.where(F.col("provision_id") == provision_id).isEmpty():
        raise KeyError(provision_id)
    own = lib.provision_links.where(F.col("provision_id") == provision_id)
    counts = own.agg(F.count_distinct("document_id").alias("total"), F.count("*").alias("citations")).first().asDict()
    shown = G.provision_cases(provision_id, lib.provision_links, lib.documents.drop("text")).offset((max(1, page) - 1) * R.PAGE_SIZE).limit(R.PAGE_SIZE)
    passages = G.collapse_passages(own.join(shown.select("document_id"), "document_id", "left_semi"), ["document_id"])
    listed = passages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("char_offset", "excerpt", "occurrences"))).alias("collapsed"))
    return counts, shown.join(listed, "document_id").orderBy(F.desc_nulls_first("date"), F.asc_nulls_last("case_number"), "document_id")


def lookup(lib: Library, q: str, most: int = 3) -> dict:
    """What a citation-like query may mean: articles of the likeliest statutes, or the statutes; needs_act if only an article was given."""
    parsed = parse_provision_query(q)
    if len(q.strip()) < 2:
        return {"needs_act": False, "label": "", "acts": [], "provisions": []}
    if parsed.has_article and not parsed.act_query:
        return {"needs_act": True, "label": article_label(parsed), "acts": [], "provisions": []}
    acts = [r.asDict() for r in search_acts(lib, parsed.act_query, 10).orderBy("bucket", F.desc("similarity"), F.desc("year")).collect()]
    place = {a["act_id"]: k for k, a in enumerate(acts)}
    found = []
    if parsed.has_article and acts:
        letter = F.lit(parsed.letter).cast("string")
        wanted = (F.col("kind") == "article") & F.col("act_id").isin(list(place)) & (F.col("article_number") == parsed.article) & F.col("article_letter").eqNullSafe(letter)
        found = sorted((r.asDict() for r in lib.provisions.where(wanted).collect()), key=lambda r: place[r["act_id"]])
    return {"needs_act": False, "label": article_label(parsed), "acts": acts if not parsed.has_article else [] if found else acts[:most], "provisions": found}


def search_tags(lib: Library, q: str, most: int = 12) -> DataFrame:
    """Tags for what has been typed, from the library's stored vocabulary; without one it is counted anew."""
    return T.lookup(lib.vocabulary if lib.vocabulary is not None else T.vocabulary(lib.documents), q, most)


def document_with_related(lib: Library, document_id, cited) -> tuple[dict, DataFrame]:
    """A document and the documents whose case numbers it cites; `cited` makes the array of case numbers from text and own number."""
    doc = lib.documents.where(F.col("document_id") == document_id)
    first = doc.first()
    if first is None:
        raise KeyError(document_id)
    numbers = doc.select("document_id", cited(F.col("text"), F.col("case_number")).alias("case_numbers"))
    return first.asDict(), G.related_cases(numbers, lib.documents).orderBy("place")


def home_cases(lib: Library, seed: int) -> tuple[dict | None, DataFrame]:
    """A featured document by the seed, and the newest others."""
    featured = R.random_row(lib.documents.drop("text"), seed).first()
    return featured and featured.asDict(), R.newest_without(lib.documents.drop("text"), featured["document_id"] if featured else None)


def progress(lib: Library) -> DataFrame:
    """Documents of every source that is live."""
    spark = lib.documents.sparkSession
    live = [(k, name, group) for k, (name, group, status) in lib.sources.items() if status == "live"]
    return I.progress(spark.createDataFrame(live, "source string, name string, group string"), lib.documents.select("source"))


def sources(lib: Library) -> DataFrame:
    """Every source that is known: source, name, group, status."""
    return lib.documents.sparkSession.createDataFrame([(k, *v) for k, v in sorted(lib.sources.items())], "source string, name string, group string, status string")


def ingestion_status(lib: Library, store: Store) -> DataFrame:
    """Every source with its documents, the time of its last successful run, and its last five runs."""
    return store.ingestion_status(sources(lib), lib.documents.select("source"))


def run_pipeline(store: Store, name: str, dry_run: bool = False) -> dict[str, DataFrame]:
    """Runs one of a store's pipelines; a dry run gives what it would store and writes nothing."""
    return store.run(name, dry_run)
