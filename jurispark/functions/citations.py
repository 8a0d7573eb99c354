"""Citations of statutes, articles and cases as built-in column expressions with exact offsets.

Every citation of legislation ends in a number and a year, so a text is cut at these: what stands between them, and of that the last
MOST_WORDS words before a number, however long, is all that is searched, once, by a pattern bound to the number; no citation has more words.
Lengths of the pieces before it add up to a citation's offset. All offsets count code points. Word runs are possessive: text that begins
like a citation and is none costs no backtracking.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from jurispark.functions.judgment import let
from jurispark.functions.query import CASE_NUMBER

MOST_WORDS = 32  # three qualifiers and an article of two words each, its letter, sbr., a statute of four words, um, eight words, nr.: 25
MARK = "\u0001"

# The declined forms of the words for a statute, for a case and for a judgment, the names of regulations, the order of an article's qualifiers.
FORMS = ["lög", "lögum", "laga", "laganna", "lögunum", "lögin"]
CASES = ["máli", "málinu", "málum", "málsins", "mali", "malinu", "malum", "malsins"]
JUDGMENTS = ["dómi", "dómnum", "dómur", "dóms", "domi", "domnum", "domur", "doms"]
REGULATIONS = [r"reglugerð\p{L}*", "reglur", "reglum", "reglna", r"tilskipun\p{L}*", r"auglýsing\p{L}*", r"samþykkt\p{L}*", r"ákvörðun\p{L}*", r"rg\."]
QUALIFIERS = ["tölul", "málsl", "mgr"]
LETTERS = "a-záðéíóúýþæö"


def _one_of(words: list[str]) -> str:
    """Any of the words, the longest that fits first: `laganna` is not read as `laga`."""
    return f"(?:{'|'.join(sorted(words, key=len, reverse=True))})"


def _words(low: int, high: int, before: str = "", behind: str = "") -> str:
    """So many words, as few as will do, none of which is a case's or a judgment's."""
    guard = rf"(?!{_one_of(CASES + JUDGMENTS)}(?![A-Za-z0-9_]))"
    return rf"(?:{before}{guard}\p{{L}}++{behind}){{{low},{high}}}?"


def _maybe(pattern: str) -> str:
    return f"(?:{pattern})?"


# A statute is named by up to three words and a form of "lög", which may end a compound; what it is about may follow.
NUMBERED = r"(?<!\d)\d{1,4}\s*/\s*\d{4}"
STATUTE = rf"(?:\p{{L}}++\s++){{0,3}}\p{{L}}*{_one_of(FORMS)}"
ABBREVIATED = r"(?<![A-Za-z0-9_])l\."
SUBJECT = _maybe(r"\s+um\s+" + _words(1, 8, behind=r"[\s,.-]*+"))
CONSTITUTION = r"stjórnarskr\p{L}*+" + _words(0, 3, before=r"\s+")
REGULATION = _one_of(REGULATIONS) + _words(0, 2, before=r"\s+") + _maybe(r"\s*\([\p{L}\d ]{1,14}\)") + SUBJECT
BEFORE_NUMBER = r"\s*,?\s*(?:nr\.\s*)?"
ARTICLE = "".join(_maybe(rf"(\d+)\.\s*{q}\.\s*") for q in QUALIFIERS) + rf"(\d+)\.\s*gr\.(?:\s*([{LETTERS}])(?!\p{{L}}))?"

LEGISLATION = rf"(?:(?<!\p{{L}}){STATUTE}{SUBJECT}|{CONSTITUTION}|{REGULATION}|{ABBREVIATED}){BEFORE_NUMBER}"
ACT = rf"(?<!\p{{L}})({STATUTE}|l\.){SUBJECT}{BEFORE_NUMBER}"
PROVISION = rf"{ARTICLE}\s*,?\s*(?:sbr\.\s*)?(?:{STATUTE}|l\.){SUBJECT}{BEFORE_NUMBER}"


# In a text read backwards: the last words and what stands around them.
LAST_WORDS = rf"^(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}]++){{0,{MOST_WORDS}}}[^\p{{L}}\p{{N}}]*+"


def plain_spaces(text: Column) -> Column:
    """Non-breaking blanks as blanks, one for one."""
    wide = "\u00a0\u2007\u202f" + MARK
    met = reduce(lambda a, b: a | b, (F.contains(text, F.lit(c)) for c in wide))
    return F.when(met, F.translate(text, wide, "    ")).otherwise(text)  # looking for them costs less than going through a text that has none


def _numbered(text: Column, pattern: str, groups: int) -> Column:
    """array<struct<gap, number, found>> of the numbers with years: the text since the last one, and how the pattern ends there, in pieces
    between marks: the whole match, then its groups; one piece where it does not match."""
    replaced = "".join(f"{MARK}${k}" for k in range(1, groups + 2))
    bound = rf"(?siuU)^.*?({pattern})$"

    def cut(gaps: Column) -> Column:
        def one(number: Column, k: Column) -> Column:
            gap = F.get(gaps, k)
            behind = F.length(F.regexp_extract(F.reverse(gap), LAST_WORDS, 0))
            window = F.substring(gap, F.length(gap) - behind + 1, behind)
            return F.struct(gap.alias("gap"), number.alias("number"), F.split(F.regexp_replace(window, bound, replaced), MARK).alias("found"))

        return F.transform(F.regexp_extract_all(text, F.lit(NUMBERED), 0), one)

    return let(F.split(text, NUMBERED, -1), cut)


def running_sum(values: Column, run: int = 128) -> Column:
    """array<int> of the sums of an array of ints up to each place: sums of runs first, so that no place adds up all before it."""

    def sums(values: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / run).cast("int")), lambda k: _sum(F.slice(values, k * run + 1, F.lit(run))))

    def before(sums: Column) -> Column:
        step = lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x))
        return F.aggregate(sums, F.array(F.lit(0)), step)

    def all_of(values: Column) -> Column:
        def at(before: Column) -> Column:
            return F.transform(values, lambda _, k: F.get(before, F.floor(k / run).cast("int")) + _sum(F.slice(values, F.floor(k / run).cast("int") * run + 1, k % run + 1)))

        return let(let(sums(values), before), at)

    return F.when(F.size(values) > 0, let(values, all_of)).otherwise(F.array().cast("array<int>"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def matches(text: Column, pattern: str, groups: int) -> Column:
    """array<struct<offset, length, text, g1, ..., number, year>> of all matches; a group that took no part is null."""

    def ends(rows: Column) -> Column:
        return running_sum(F.transform(rows, lambda r: F.length(r["gap"]) + F.length(r["number"])))

    def one(r: Column, end: Column) -> Column:
        piece = lambda k: F.get(r["found"], F.lit(k))
        length = F.length(piece(1)) + F.length(r["number"])
        named = [F.nullif(piece(k + 1), F.lit("")).alias(f"g{k}") for k in range(1, groups + 1)]
        part = lambda k: F.trim(F.element_at(F.split(r["number"], r"\s*/\s*"), k)).cast("int")
        return F.struct((end - length).alias("offset"), length.alias("length"), F.concat(piece(1), r["number"]).alias("text"), *named, part(1).alias("number"), part(2).alias("year"))

    def hits(rows: Column) -> Column:
        return F.filter(F.zip_with(rows, ends(rows), lambda r, end: F.when(F.size(r["found"]) > 1, one(r, end))), lambda m: m.isNotNull())

    return let(_numbered(text, pattern, groups), hits)


def mask_legislation(text: Column) -> Column:
    """Citations of legislation as blanks of their length."""

    def blanks(r: Column) -> Column:
        n = F.length(F.coalesce(F.get(r["found"], F.lit(1)), F.lit("")))
        masked = F.concat(F.substring(r["gap"], F.lit(1), F.length(r["gap"]) - n), F.repeat(F.lit(" "), n + F.length(r["number"])))
        return F.when(F.size(r["found"]) > 1, masked).otherwise(F.concat(r["gap"], r["number"]))

    def whole(plain: Column) -> Column:
        return F.concat(F.array_join(F.transform(_numbered(plain, LEGISLATION, 0), blanks), ""), F.element_at(F.split(plain, NUMBERED, -1), -1))

    return let(plain_spaces(text), whole)


def cited_cases(text: Column, own: Column | None = None) -> Column:
    """Case numbers in order of first appearance, without those inside citations of legislation and without the text's own."""
    found = F.array_distinct(F.regexp_extract_all(mask_legislation(text), F.lit(CASE_NUMBER), 0))
    return found if own is None else F.filter(found, lambda x: ~x.eqNullSafe(own))


def alias(stem: Column) -> Column:
    """The compound name of a statute in a citation, null for a bare form."""
    word = F.lower(F.element_at(F.split(F.trim(stem), r"\s+"), -1))
    return F.when(word.rlike(f"\\p{{L}}{_one_of(FORMS)}$"), word)


def act_citations(text: Column) -> Column:
    """array<struct<act_number, year, offset, length, alias>> in text order; the offset is that of the citation's first letter."""
    found = F.filter(matches(plain_spaces(text), ACT, 1), lambda m: m["number"] < 1000)
    return F.transform(found, lambda m: F.struct(m["number"].alias("act_number"), m["year"].alias("year"), m["offset"].alias("offset"), m["length"].alias("length"), alias(m["g1"]).alias("alias")))


def provision_citations(text: Column) -> Column:
    """array<struct<point, paragraph, article, letter, act_number, year, offset, length, text>> in text order; text on one line."""
    found = F.filter(matches(plain_spaces(text), PROVISION, 5), lambda m: m["number"] < 1000)
    return F.transform(found, lambda m: F.struct(
        m["g1"].cast("int").alias("point"), m["g3"].cast("int").alias("paragraph"), m["g4"].cast("int").alias("article"), F.lower(m["g5"]).alias("letter"),
        m["number"].alias("act_number"), m["year"].alias("year"), m["offset"].alias("offset"), m["length"].alias("length"),
        F.trim(F.regexp_replace(m["text"], r"\s+", " ")).alias("text")))


def official_citation(court: Column, date: Column, number: Column, name: Column, url: Column) -> Column:
    """`court, 3. maí 2020, mál nr. E-1/2020 (name) — url`; what is missing is left out."""
    # The months' names.
    months = F.array(*(F.lit(m) for m in ("janúar", "febrúar", "mars", "apríl", "maí", "júní", "júlí", "ágúst", "september", "október", "nóvember", "desember")))
    day = F.concat(F.dayofmonth(date).cast("string"), F.lit(". "), F.element_at(months, F.month(date)), F.lit(" "), F.year(date).cast("string"))
    blank = lambda c: F.when(F.trim(c) != "", c)
    head = F.concat_ws(", ", F.concat_ws(" ", blank(court), day), F.concat(F.lit("mál nr. "), blank(number)), blank(name))
    return F.concat_ws(" — ", blank(head), blank(url))
