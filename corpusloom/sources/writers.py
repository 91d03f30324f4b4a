"""Writing archives and exports; nothing is ever overwritten."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def publish(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), fmt: str = "parquet", **options) -> None:
    """Write to a staging folder beside the target and rename it; fail if the target is there."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        raise FileExistsError(path)
    staging = jvm.org.apache.hadoop.fs.Path(f"{path}.staging-{uuid.uuid4().hex[:8]}")
    try:
        w = df.write.format(fmt).mode("errorifexists").options(**options)
        (w.partitionBy(*partition_by) if partition_by else w).save(staging.toString())
        if not fs.rename(staging, target):
            raise OSError(f"cannot rename to {path}")
    finally:
        if fs.exists(staging):
            fs.delete(staging, True)


def archive(records: DataFrame, path: str) -> None:
    publish(records, path, ("collection",))


def text_only(export: DataFrame, path: str) -> None:
    """One folder of compressed JSON lines for each collection; null targets are written as null."""
    publish(export, path, ("collection",), "json", compression="gzip", ignoreNullFields="false")


def by_status(gated: DataFrame, path: str) -> None:
    """Candidates and quarantined rows apart, as folders of one publication: both are there or none is."""
    publish(gated.where(F.col("quality_status").isin("review_candidate", "quarantined")), path, ("quality_status",))


def csv(df: DataFrame, path: str) -> None:
    publish(df, path, fmt="csv", header="true")


PART_ROWS = 100_000  # lines of a part file, so that each can be digested whole


def queue(rows: DataFrame, path: str) -> dict:
    """Queue rows as JSON lines with their columns in order of name, and a manifest: rows, the sha256 of each part in order
    of name, and the sha256 of those digests."""
    lines = rows.select(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}).alias("value"))
    publish(lines, path, fmt="text", maxRecordsPerFile=str(PART_ROWS))
    spark = rows.sparkSession
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    digests = [r.d for r in parts.select("path", F.sha2("content", 256).alias("d")).orderBy("path").collect()]  # one for each part file
    return {"rows": spark.read.text(path).count(), "parts": digests, "digest": hashlib.sha256("".join(digests).encode()).hexdigest()}
