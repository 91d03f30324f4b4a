"""Length statistics of pairs, never pooling Han letters and words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def measured(pairs: DataFrame) -> DataFrame:
    """pairs (id, language, left, right, ...) in zh and en with their lengths and change; a source of length 0 is left out."""
    x = pairs.where(F.col("language").isin("zh", "en"))
    x = x.withColumn("original", X.length_in(F.col("language"), F.col("left"))).withColumn("rewritten", X.length_in(F.col("language"), F.col("right")))
    x = x.where(F.col("original") > 0).withColumn("delta", F.col("rewritten") - F.col("original"))
    return x.withColumn("change_pct", X.change_pct(F.col("original"), F.col("rewritten"))).drop("left", "right")


def summary(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each group and language."""
    pct = F.col("change_pct")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("delta") > 0).alias("longer"), F.count_if(F.col("delta") == 0).alias("equal"), F.count_if(F.col("delta") < 0).alias("shorter"),
        F.round(F.avg("original"), 6).alias("original_mean"), F.round(F.avg("rewritten"), 6).alias("rewritten_mean"), F.round(F.median(pct), 6).alias("median_change_pct"), F.round(F.avg(pct), 6).alias("mean_change_pct"),
        F.round((F.sum("rewritten") / F.sum("original") - 1) * 100, 6).alias("total_change_pct"), F.count_if(pct > 10 + 1e-8).alias("longer_by_10"), F.count_if(pct < -10 - 1e-8).alias("shorter_by_10"),
    )


def in_groups(rows: DataFrame) -> DataFrame:
    """Each row once for every group it belongs to: all of a language, its collection, its model."""
    names = F.array(F.concat(F.lit("all/"), F.col("language")), F.concat(F.lit("collection/"), F.col("collection"), F.lit("/"), F.col("language")), F.concat(F.lit("model/"), F.col("model"), F.lit("/"), F.col("language")))
    return rows.withColumn("group_name", F.explode(names))


def effect(rows: DataFrame, *keys: str) -> DataFrame:
    """What cleaning does to the lengths: totals of both views, delta, percentage (null on 0) and rows changed."""
    def part(name: str) -> list:
        raw, clean = F.sum(f"raw_{name}"), F.sum(f"clean_{name}")
        return [raw.alias(f"raw_{name}_total"), clean.alias(f"clean_{name}_total"), (clean - raw).alias(f"{name}_delta"), F.round(X.change_pct(raw, clean), 6).alias(f"{name}_change_pct"), F.count_if(F.col(f"raw_{name}") != F.col(f"clean_{name}")).alias(f"{name}_rows_changed")]

    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *part("original"), *part("rewritten"))
