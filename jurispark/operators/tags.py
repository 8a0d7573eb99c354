"""Subject tags: vocabulary and look-up without regard to accents."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters with marks and what is left without them, by canonical decomposition of all code points up to the Greek and Cyrillic blocks and of the extended Latin and Greek ones.
_BARE = {chr(c): "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x)) for c in (*range(0xC0, 0x530), *range(0x1E00, 0x2000))}
_BARE = {c: bare for c, bare in _BARE.items() if bare != c and len(bare) == 1}
ACCENTED, PLAIN = "".join(_BARE), "".join(_BARE.values())
MARKS = "".join(chr(c) for c in range(0x300, 0x370))
# Letters that become two, that is, how they are written in plain ones.
DOUBLED = {"þ": "th", "æ": "ae", "ð": "d"}


def fold(column: Column) -> Column:
    """Lower case without accents, written as one character or as marks, with þ, æ and ð in Latin letters."""
    out = F.translate(F.lower(column), ACCENTED + MARKS, PLAIN)
    for a, b in DOUBLED.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fold_text(text: str) -> str:
    text = text.lower().translate(str.maketrans(ACCENTED, PLAIN, MARKS))
    for a, b in DOUBLED.items():
        text = text.replace(a, b)
    return text


def vocabulary(docs: DataFrame, tags: str = "tags") -> DataFrame:
    """(tag, n) of every tag that is not empty, by the number of documents."""
    found = docs.select(F.explode(tags).alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "tag")


def lookup(words: DataFrame, query: str, most: int = 12) -> DataFrame:
    """Tags that begin with the query before those that hold it, the frequent first; all by frequency for a blank query."""
    q, most = fold_text(query.strip()), min(30, max(1, most))
    folded = fold(F.col("tag"))
    bucket = F.when(F.startswith(folded, F.lit(q)), 0).when(F.contains(folded, F.lit(q)), 1)
    return words.withColumn("bucket", bucket).where("bucket IS NOT NULL").orderBy("bucket", F.desc("n"), "tag").limit(most).select("tag", "n", "bucket")
