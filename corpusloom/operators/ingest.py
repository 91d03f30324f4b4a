"""Incremental ingest with immutable ids: all of a batch or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Conflict(ValueError):
    """A batch that would change an id already there, or that contradicts itself."""


def classify(base: DataFrame, batch: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action): insert, skip (same content is there) or conflict (other content, there or in the batch)."""
    inside = batch.groupBy(key).agg(F.countDistinct(digest).alias("versions"), F.min(digest).alias("d"))
    there = base.groupBy(key).agg(F.collect_set(digest).alias("had"))
    x = inside.join(there, key, "left")
    act = F.when((F.col("versions") > 1) | F.col("had").isNotNull() & ~F.array_contains("had", F.col("d")), "conflict").when(F.col("had").isNotNull(), "skip").otherwise("insert")
    return x.select(key, act.alias("action"))


BUCKETS = 256  # folders of a table that is ingested into, by the hash of the key


def bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def ingest(base_path: str, batch: DataFrame, key: str = "record_id", digest: str = "content_hash") -> dict[str, int]:
    """Append the new rows of a batch to the table at base_path; a conflict appends nothing and raises.

    The table lies in folders by the key's hash (column _bucket), so a batch reads the key and digest columns of its own
    folders only.  A second run of the same batch appends nothing.  The rows are written in one job, whose commit is the
    only change, so a lost executor or a failed run leaves the table as it was.  Of equal rows of a key in the batch the
    one of least hash is written.
    """
    spark = batch.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base_path)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    batch = batch.drop("_bucket").withColumn("_bucket", bucket(key)).persist()
    touched = [r._bucket for r in batch.select("_bucket").distinct().collect()]  # at most BUCKETS numbers
    base = spark.read.parquet(base_path).where(F.col("_bucket").isin(touched)) if exists else batch.limit(0)
    actions = classify(base.select(key, digest), batch, key, digest).persist()
    try:
        n = {r.action: r["count"] for r in actions.groupBy("action").count().collect()}
        if n.get("conflict"):
            raise Conflict(f"{n['conflict']} ids have other content")
        if n.get("insert"):
            one = batch.withColumn("_order", F.xxhash64(*batch.columns)).groupBy(key).agg(F.min_by(F.struct(*batch.columns), "_order").alias("r")).select("r.*")
            one.join(actions.where("action = 'insert'").select(key), key, "left_semi").write.mode("append").partitionBy("_bucket").parquet(base_path)
        return {"inserted": n.get("insert", 0), "skipped": n.get("skip", 0)}
    finally:
        actions.unpersist()
        batch.unpersist()


def merge_catalog(old: DataFrame, counts: DataFrame) -> DataFrame:
    """Old metadata kept, counts refreshed; a collection without metadata is marked, not dropped."""
    return counts.join(old.drop("n"), "collection", "left").withColumn("missing_metadata", F.col("collection_title").isNull())
