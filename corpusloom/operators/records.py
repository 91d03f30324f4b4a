"""The record: sides, search text, hashes, catalog counts, deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def sides(records: DataFrame) -> DataFrame:
    """One row for each side: left, right unless it is null, and the alternatives in order.

    A null right side is unpaired and yields no row; an empty one is a deletion and does.
    """
    one = lambda name, t, role: F.struct(F.lit(name).alias("side"), t.alias("text"), role.alias("role"))
    more = F.transform(F.coalesce("alternatives", F.array().cast("array<string>")), lambda t, i: F.struct(F.concat(F.lit("alternatives["), i.cast("string"), F.lit("]")).alias("side"), t.alias("text"), F.lit("alternative").alias("role")))
    right = F.when(F.col("right_text").isNotNull(), F.array(one("right", F.col("right_text"), F.col("right_role")))).otherwise(F.array().cast("array<struct<side:string,text:string,role:string>>"))
    return records.select("rid", "record_id", F.explode(F.concat(F.array(one("left", F.col("text"), F.col("text_role"))), right, more)).alias("s")).select("rid", "record_id", "s.*")


def search_text(absent_right: str | None = "") -> Column:
    """Title, sides and alternatives by lines, in lower case; a null right side counts as absent_right, or not at all."""
    right = F.col("right_text") if absent_right is None else F.coalesce("right_text", F.lit(absent_right))
    return F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")), right, F.coalesce("alternatives", F.array().cast("array<string>"))))


def content_hash() -> Column:
    """Digest of the record's content, nulls and empty strings told apart."""
    cols = [F.col(c) for c in ("record_id", "collection", "title", "text", "right_text", "alternatives")]
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).cast("binary"), 256)


def catalog_counts(records: DataFrame) -> DataFrame:
    """Counts by collection, by language, by pair type and in all, in one pass."""
    g = records.groupingSets([["collection"], ["language"], ["pair_type"], []], "collection", "language", "pair_type")
    return g.agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"))


def collection_catalog(records: DataFrame, collections: DataFrame) -> DataFrame:
    """Counts beside the metadata of each collection; a collection without metadata, or without records, stays."""
    n = records.groupBy("collection").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("right_text").isNull()).alias("unpaired"), F.count_if(F.col("right_text") == "").alias("deletions"),
        F.array_sort(F.collect_set(F.when(F.coalesce("split", F.lit("")) != "", F.col("split")))).alias("splits"),
    )
    return collections.select("collection", "collection_title", F.size("expected_languages").alias("languages_expected")).join(n, "collection", "full_outer").withColumn("has_metadata", F.col("collection_title").isNotNull())


def latest_delivery(records: DataFrame) -> DataFrame:
    """The last delivered row of each record; ties go to the greater rid."""
    best = records.groupBy("record_id").agg(F.max(F.struct("ingested_at", "rid")).alias("m"), F.count(F.lit(1)).alias("deliveries"), F.countDistinct("license").alias("licenses"))
    return best.select("record_id", F.col("m.rid").alias("rid"), "deliveries", "licenses")


def conflicting_ids(records: DataFrame) -> DataFrame:
    """Ids delivered with more than one content."""
    h = records.select("record_id", F.sha2(F.concat_ws("\x1f", F.coalesce("text", F.lit("\x00")), F.coalesce("right_text", F.lit("\x00")), F.coalesce("license", F.lit("\x00"))).cast("binary"), 256).alias("h"))
    return h.groupBy("record_id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("h").alias("versions")).where(F.col("versions") > 1)


def duplicate_groups(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Groups of rows whose texts differ in white space at most: hash, size, first key."""
    h = texts.where(F.col(text).isNotNull()).select(key, X.sha(X.collapse(F.col(text))).alias("text_hash"))
    return h.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key")).where(F.col("n") > 1)


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def text_export(records: DataFrame) -> DataFrame:
    """(id, a, b, references): texts alone, a null target kept null."""
    return records.select(F.col("record_id").alias("id"), F.col("text").alias("a"), F.col("right_text").alias("b"), F.col("alternatives").alias("references"), "collection")


def coverage(records: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows found against rows expected (collection, expected), and whether they agree."""
    n = records.groupBy("collection").agg(F.count(F.lit(1)).alias("found"))
    x = n.join(expected, "collection", "full_outer").select("collection", F.coalesce("found", F.lit(0)).cast("long").alias("found"), F.coalesce("expected", F.lit(0)).cast("long").alias("expected"))
    return x.withColumn("agrees", F.col("found") == F.col("expected"))


def violations(records: DataFrame) -> DataFrame:
    """(rid, rule) of every rule of the record model a row breaks."""
    rules = {
        "empty_id": F.coalesce("record_id", F.lit("")) == "", "empty_collection": F.coalesce("collection", F.lit("")) == "",
        "no_left_text": F.col("text").isNull(), "no_pair_type": F.coalesce("pair_type", F.lit("")) == "",
        "unpaired_with_right": (F.col("pair_type") == "unpaired") & F.col("right_text").isNotNull(),
        "no_language": X.strip(F.coalesce("language", F.lit(""))) == "", "no_license": X.strip(F.coalesce("license", F.lit(""))) == "",
        "null_alternative": F.exists(F.coalesce("alternatives", F.array().cast("array<string>")), lambda t: t.isNull()),
    }
    return records.select("rid", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias("rule"))
