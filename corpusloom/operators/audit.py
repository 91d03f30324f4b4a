"""Audits and checks: what cleaning changed, whether two views agree, which flags fit which outputs."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cleaning
from ..functions import text as X

# Warnings of texts that need repair before they can be sources.
BLOCKED = ("structured_json_preserved_not_prose", "source_latex_diff_markup_preserved_not_prose", "ascii_art_or_corrupted_markup_preserved_not_prose", "source_wiki_editing_markup_preserved_review_required", "source_formula_placeholders_preserved_review_required", "nonempty_source_became_empty")


def rules_fingerprint(*parts) -> str:
    """Digest of the cleaning version and further rule tables, for every audit row."""
    return hashlib.sha256(json.dumps([cleaning.VERSION, *parts], sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def audit_rows(records: DataFrame, fingerprint: str) -> DataFrame:
    """(rid, side, raw_sha, clean_sha, raw_chars, clean_chars, result, rules): sides with something to record."""
    c = cleaning.cleaned(records)
    part = lambda name, text: F.struct(F.lit(name).alias("side"), F.col(text).alias("raw"), F.col(f"{name}_result").alias("r"))
    x = c.select("rid", F.explode(F.array(part("left", "text"), part("right", "right_text"))).alias("s")).select("rid", "s.*").where("r.text is not null")
    said = (F.col("raw") != F.col("r.text")) | (F.size("r.warnings") > 0) | (F.size(F.map_keys("r.protected")) > 0)
    return x.where(said).select("rid", "side", X.sha(F.col("raw")).alias("raw_sha"), X.sha(F.col("r.text")).alias("clean_sha"), F.length("raw").alias("raw_chars"), F.length("r.text").alias("clean_chars"), F.col("r").alias("result"), F.lit(fingerprint).alias("rules"))


def not_idempotent(records: DataFrame) -> DataFrame:
    """(rid, side) whose cleaned text a second pass would change; must be empty."""
    c = cleaning.cleaned(records)
    part = lambda name, text: F.struct(F.lit(name).alias("side"), F.col(text).alias("raw"), F.col(f"{name}_result.text").alias("once"))
    x = c.select("rid", "title", "source_url", "collection", F.explode(F.array(part("left", "text"), part("right", "right_text"))).alias("s")).select("rid", "title", "source_url", "collection", "s.*")
    x = x.where(F.col("once") != F.col("raw"))  # what the first pass left alone, the second does too
    again = cleaning.clean_column(F.col("once"), F.col("title"), F.col("source_url"), F.col("collection"), F.lit(""))
    return x.select("rid", "side", "once", again.alias("r")).where(F.col("once") != F.col("r.text")).select("rid", "side")


def scoped_removals(sides: DataFrame, rules: DataFrame) -> DataFrame:
    """Spans removed from the one side they are bound to by record, side and hash.

    sides (record_id, side, text), rules (record_id, side, text_sha, span).  A span must occur exactly once and
    every rule must find its side; anything else is an error column, never a silent pass.
    """
    s = sides.withColumn("text_sha", X.sha(F.col("text")))
    x = rules.join(s, ["record_id", "side", "text_sha"], "left")
    times = (F.length("text") - F.length(F.replace("text", F.col("span"), F.lit("")))) / F.length("span")
    error = F.when(F.col("text").isNull(), "stale_rule").when(times != 1, "span_not_unique")
    return x.select("record_id", "side", "span", error.alias("error"), F.when(error.isNull(), F.replace("text", F.col("span"), F.lit(""))).alias("text"))


def key_parity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two views has: (key, only_in)."""
    x = a.select(key).distinct().withColumn("_a", F.lit(True)).join(b.select(key).distinct().withColumn("_b", F.lit(True)), key, "full_outer")
    return x.where("_a is null or _b is null").select(key, F.when(F.col("_b").isNull(), "first").otherwise("second").alias("only_in"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two tables has more often than the other; empty when they are the same multiset."""
    return a.exceptAll(b).withColumn("more_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("more_in", F.lit("second")))


def attach_flags(outputs: DataFrame, flags: DataFrame, on: list[str]) -> DataFrame:
    """Outputs with the status of the flag bound to exactly them, null where there is none."""
    return outputs.join(flags.select(*on, "status"), on, "left")


def unused_flags(outputs: DataFrame, flags: DataFrame, on: list[str]) -> DataFrame:
    """Flags bound to no output; must be empty."""
    return flags.join(outputs.select(*on).distinct(), on, "left_anti")


def zipped(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """Two tables side by side by place within a key; error marks places that one of them lacks."""
    place = lambda df: df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    x = place(a).select(key, "place", F.col(order).alias("first")).join(place(b).select(key, "place", F.col(order).alias("second")), [key, "place"], "full_outer")
    return x.withColumn("error", F.when(F.col("first").isNull() | F.col("second").isNull(), "unequal_length"))


def eligible(records: DataFrame, warnings: Column, domains: tuple[str, ...], least: int, most: int) -> DataFrame:
    """Candidates for a queue: of the domains (in any case), within a band of lengths, changed by their revision, of no blocked warning."""
    changed = F.col("right_text").isNull() | (X.collapse(F.col("text")) != X.collapse(F.col("right_text")))
    ok = F.lower(F.trim("domain")).isin(*domains) & F.length("text").between(least, most) & changed
    return records.where(ok & ~F.arrays_overlap(F.coalesce(warnings, F.array().cast("array<string>")), F.array(*map(F.lit, BLOCKED))))


def point(records: DataFrame, ids: DataFrame, key: str = "record_id") -> DataFrame:
    """The rows of the wanted ids beside found; an id that no row has comes out once with found = false."""
    x = ids.select(key).distinct().join(records.withColumn("found", F.lit(True)), key, "left")
    return x.withColumn("found", F.coalesce("found", F.lit(False)))


def without_ids(rows: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose id is on no exclusion list; a null id is on none."""
    return rows.join(excluded.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def any_startswith(items: Column, prefix: str) -> Column:
    """Whether some item of an array begins with the prefix; null arrays have none."""
    return F.coalesce(F.exists(items, lambda x: F.coalesce(x.startswith(prefix), F.lit(False))), F.lit(False))


def without_known_failures(rows: DataFrame, failures: DataFrame, key: str, text: str) -> DataFrame:
    """Rows that have failed before with this very text (key, text_sha) left out; a changed text is tried anew."""
    x = rows.withColumn("text_sha", X.sha(F.col(text)))
    return x.join(failures.select(key, "text_sha").distinct(), [key, "text_sha"], "left_anti").drop("text_sha")


SENTENCES = r"(?<=[.!?。！？])\s*|\n+"


def unaligned(records: DataFrame, key: str = "rid", left: str = "text", right: str = "right_text") -> DataFrame:
    """(key, side, sentences, unaligned): sentences of each side of a pair, and how many of them the other side lacks."""
    cut = lambda c: F.array_distinct(F.filter(F.transform(F.split(F.col(c), r"\n"), X.collapse), lambda x: x != ""))
    x = records.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(key, cut(left).alias("a"), cut(right).alias("b"))
    one = lambda name, p, q: F.struct(F.lit(name).alias("side"), F.size(p).cast("long").alias("sentences"), F.size(F.array_except(p, q)).cast("long").alias("unaligned"))
    return x.select(key, F.explode(F.array(one("left", F.col("a"), F.col("b")), one("right", F.col("b"), F.col("a")))).alias("s")).select(key, "s.*")


def same_query(answers: DataFrame, query: str, key: str, order: list[str]) -> DataFrame:
    """(key, query, first): each further answer to a query beside the first one; nothing is paired with all."""
    first = answers.groupBy(query).agg(F.min_by(key, F.struct(*order)).alias("first"))
    return answers.join(first, query).where(F.col(key) != F.col("first")).select(key, query, "first")


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest): a digest of a table as a multiset of rows, whatever their order; repeated rows count."""
    line = F.concat_ws(chr(31), *[F.coalesce(F.col(c).cast("string"), F.lit(chr(0))) for c in columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.conv(F.substring(X.sha(line), 1, 12), 16, 10).cast("decimal(28,0)")).alias("digest"))  # 48 bits each: as long, the sum overflows at some 65,000 rows


def metadata_manifest(records: DataFrame) -> DataFrame:
    """(rid, record_id, roles, hashes, languages): what is known of a record beside its texts."""
    sides = [("left", "text", "text_role"), ("right", "right_text", "right_role")]
    entries = lambda value: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("k"), value(t, r).alias("v")) for n, t, r in sides]), lambda e: e.v.isNotNull()))
    roles = entries(lambda t, r: F.when(F.col(t).isNotNull(), F.col(r)))
    hashes = entries(lambda t, r: X.sha(F.col(t)))
    return records.select("rid", "record_id", roles.alias("roles"), hashes.alias("hashes"), (F.col("right_text") == "").alias("deletion"))


def message_text(raw: Column) -> Column:
    """Text of a message in JSON: a string, the text parts of a list, or the JSON itself."""
    parts = F.from_json(raw, "array<struct<type: string, text: string>>")
    return F.when(raw.startswith("["), F.array_join(F.transform(F.filter(parts, lambda p: p.text.isNotNull()), lambda p: p.text), "\n")).when(raw.startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), raw, F.lit("}")), "$.x")).otherwise(raw)


def relative(raw: Column, root: str) -> Column:
    """A path, or JSON full of paths, without the root before them."""
    return F.replace(raw, F.lit(root.rstrip("/") + "/"), F.lit(""))


def markdown(summary: DataFrame, title: str, rows: int = 500) -> str:
    """A report of a small aggregate; larger results are refused."""
    got: pd.DataFrame = summary.limit(rows + 1).toPandas()
    if len(got) > rows:
        raise ValueError("a report is for aggregates")
    line = lambda v: "| " + " | ".join(map(str, v)) + " |"
    return "\n".join([f"# {title}", "", line(got.columns), line("-" * len(got.columns)), *map(line, got.itertuples(index=False))]) + "\n"
