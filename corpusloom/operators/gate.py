"""The quality gate over cleaned records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# The warning that holds nothing back; the names of reasons and states below are fixed too.
EXEMPT = ("image_removed_review_surrounding_references",)


def reasons(left: Column, right: Column, warnings: Column, flags: Column | None = None) -> Column:
    """Sorted distinct reasons to hold a generated pair back."""
    empty = lambda t: X.strip(t) == ""
    rules = F.array_compact(F.array(
        F.when(empty(left) | empty(right), F.lit("empty_rewrite_side")),
        F.when(left == right, F.lit("identical_text_no_style_contrast")),
        F.when((F.length(left) > 1000) & (F.length(right) / F.greatest(F.length(left), F.lit(1)) < 0.2), F.lit("extreme_compression_review_required")),
    ))
    none = F.array().cast("array<string>")
    kept = F.filter(F.coalesce(warnings, none), lambda w: ~w.isin(*EXEMPT))
    return F.array_sort(F.array_distinct(F.concat(rules, kept, F.coalesce(flags, none) if flags is not None else none)))


def status(generated: Column, why: Column) -> Column:
    return F.when(generated & (F.size(why) > 0), "quarantined").when(generated, "review_candidate").otherwise("archive_only")


def gate(rows: DataFrame, generated: Column, left: Column, right: Column, warnings: Column, flags: Column | None = None) -> DataFrame:
    """rows with reasons and quality_status; only generated pairs can be held back."""
    why = F.when(generated & right.isNotNull(), reasons(left, right, warnings, flags)).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("reasons", why).withColumn("quality_status", status(generated & right.isNotNull(), F.col("reasons")))


def status_counts(gated: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("quality_status") == s).alias(s)
    return gated.groupBy("collection").agg(n("quarantined"), n("review_candidate"), n("archive_only"))


def reason_counts(gated: DataFrame) -> DataFrame:
    return gated.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def flag_totals(gated: DataFrame) -> DataFrame:
    """How many rows were scanned, flagged, and left empty."""
    return gated.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.size("reasons") > 0).alias("flagged"), F.count_if(F.array_contains("reasons", "empty_rewrite_side")).alias("became_empty"))


def flag_export(gated: DataFrame, key: str, warnings: str) -> DataFrame:
    """(kind, value, quality_status, n, first_key): flagged rows by status, by warning and by reason in one pass."""
    none = F.array().cast("array<string>")
    tag = lambda kind, c: F.transform(F.array_distinct(F.coalesce(c, none)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    all_tags = F.concat(F.array(F.struct(F.lit("status").alias("kind"), F.col("quality_status").alias("value"))), tag("warning", F.col(warnings)), tag("reason", F.col("reasons")))
    x = gated.where((F.size("reasons") > 0) | (F.coalesce(F.size(warnings), F.lit(0)) > 0)).select(key, "quality_status", F.explode(all_tags).alias("t"))
    return x.groupBy("t.kind", "t.value", "quality_status").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key")).select("kind", "value", "quality_status", "n", "first_key")
