"""Filters, paging, and search by substring, terms and phrases."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import search_text

STATUSES = ("archive_only", "review_candidate", "quarantined")
REVIEWS = ("unreviewed", "reviewed", "keep", "reject")


@dataclass
class Query:
    """What a search asks for; empty filters filter nothing."""

    q: str = ""
    collection: str = ""
    language: str = ""
    pair_type: str = ""
    quality_status: str = ""
    view: str = "raw"
    review_filter: str = ""
    offset: int = 0
    limit: int = 40
    extra: list[Column] = field(default_factory=list)


def _variants() -> dict[str, str]:
    """Letters that are another letter with marks (Latin, Greek, Cyrillic, in either case) and that letter: by rule, from the Unicode database."""
    out = {}
    for c in map(chr, (*range(0xC0, 0x530), *range(0x1E00, 0x2000))):
        low = c.lower()
        d = "".join(x for x in unicodedata.normalize("NFD", low) if not "\u0300" <= x <= "\u036f")
        if len(d) == 1 and d != low and d.isalpha():
            out[c] = d
    return out


VARIANTS = _variants()
ACCENTED, PLAIN = ("".join(x) for x in zip(*((k, v) for k, v in VARIANTS.items() if k == k.lower())))


def fold(text: Column) -> Column:
    """Lower case without accents and loose marks."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"[\x{300}-\x{36f}]", "")


def folded(text: str) -> str:
    """The same for a query."""
    return "".join(VARIANTS.get(c, c) for c in unicodedata.normalize("NFC", text).lower() if not "\u0300" <= c <= "\u036f")


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def terms_of(q: str) -> list[list[str]]:
    """The query's folded terms; one that the index would split is a phrase of several tokens."""
    return [t for t in ([x for x in re.split(r"[\W_]+", w) if x] for w in re.findall(r"\w+", folded(q.strip()[:300]))) if t]


MARKS = r"[\x{300}-\x{36f}]*"


def _letter(c: str) -> str:
    """All that folds to a letter, with the marks that may follow it."""
    kin = {c, c.upper(), *(k for k, v in VARIANTS.items() if v == c)}
    return "[" + "".join(f"\\x{{{ord(x):x}}}" for x in sorted(kin) if len(x) == 1) + "]" + MARKS


def term_pattern(term: list[str]) -> str:
    """A pattern of a term, or of the tokens of a phrase, over text that is not folded: one pass and no tokens made."""
    return r"(?<![\p{L}\p{N}])(?<![\p{L}\p{N}][\x{300}-\x{36f}]{1,4})" + r"[^\p{L}\p{N}]+".join("".join(map(_letter, t)) for t in term) + r"(?![\p{L}\p{N}])"


def has_terms(text: Column, q: str) -> Column:
    """Whether all terms occur; a query without terms filters nothing."""
    out = F.lit(True)
    for t in terms_of(q):
        out = out & text.rlike(term_pattern(t))
    return out


def matches(text: Column, q: str) -> Column:
    """Substring search where the query has Han letters or kana, else search by terms."""
    q = q.strip()[:300]
    if not q:
        return F.lit(True)
    if re.search(r"[぀-ヿ㐀-鿿]", q):
        return F.instr(text, q.lower()) > 0
    return has_terms(text, q)


def filtered(records: DataFrame, query: Query, reviews: DataFrame | None = None) -> DataFrame:
    """Rows that pass all filters; reviews are (id, content_hash, decision)."""
    if query.quality_status and (query.view != "clean" or query.quality_status not in STATUSES):
        raise ValueError("quality_status is a filter of the clean view, with one of " + ", ".join(STATUSES))
    out = records
    for name in ("collection", "language", "pair_type", "quality_status"):
        if getattr(query, name):
            out = out.where(F.col(name) == getattr(query, name))
    if query.q.strip():
        out = out.where(matches(search_text(), query.q))
    if query.review_filter in REVIEWS and reviews is not None:
        r = reviews.select(F.col("id").alias("_id"), F.col("content_hash").alias("_hash"), F.col("decision").alias("_decision"))
        if query.review_filter in ("keep", "reject"):
            r = r.where(F.col("_decision") == query.review_filter)
        on = (F.col("record_id") == F.col("_id")) & (F.col("content_hash") == F.col("_hash"))
        out = out.join(r, on, "left_anti" if query.review_filter == "unreviewed" else "left_semi")
    return out


def page(records: DataFrame, query: Query, reviews: DataFrame | None = None) -> tuple[int, DataFrame]:
    """The number of hits and one page of them, by rid; limit is kept within 1 and 100."""
    hits = filtered(records, query, reviews)
    rows = hits.select("rid", "record_id", "collection", "language", "pair_type", "title", "content_hash")
    return hits.count(), rows.orderBy("rid").offset(max(0, query.offset)).limit(min(100, max(1, query.limit)))


def inverted(records: DataFrame) -> DataFrame:
    """(token, rid): the distinct tokens of every row."""
    return records.select("rid", F.explode(F.array_distinct(tokens(search_text()))).alias("token"))


def lookup(index: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows that hold all wanted tokens, by counting them in the index."""
    wanted = sorted(set(wanted))
    return index.where(F.col("token").isin(wanted)).groupBy("rid").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == len(wanted)).select("rid")


PARTS = 256  # folders of a stored index


def _part(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(PARTS)).cast("int")


def write_index(records: DataFrame, path: str) -> None:
    """The inverted index as a table in folders by the token's hash, sorted by token; written at ingest, appended to for new rows.

    Rows of one token spread over several files where it is frequent: the hash of the row salts the shuffle.
    """
    x = inverted(records).withColumn("part", _part(F.col("token")))
    salt = F.pmod(F.xxhash64("rid"), F.lit(8))
    x.repartition("part", salt).sortWithinPartitions("part", "token", "rid").write.mode("append").partitionBy("part").parquet(path)


def read_index(spark, path: str, q: str) -> DataFrame:
    """Rows that hold all terms of a query (phrases by all their tokens), reading only the folders of those tokens."""
    wanted = sorted({x for t in terms_of(q) for x in t})
    parts = [r.p for r in spark.createDataFrame([(w,) for w in wanted] or [("",)], "token string").select(_part(F.col("token")).alias("p")).distinct().collect()]
    return lookup(spark.read.parquet(path).where(F.col("part").isin(parts)), wanted)
