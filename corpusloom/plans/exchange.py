"""Queries that read and write files: each writes whole tables with a sink and reads them back with a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ingest, records, search
from ..session import scratch, table
from ..sources import readers, writers
from .catalog import DIGEST, GATED, LINE, SEARCH, _digest, _gated, query


@query("select collection, count(*) as n, count(right_text) as pairs, sum(length(text))::bigint as chars from records group by 1")
def archive_roundtrip(spark, d):
    path = scratch(spark, "archive")
    writers.archive(table(spark, d, "records"), path)
    return spark.read.parquet(path).groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.count("right_text").alias("pairs"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("select record_id as id, count(*) as n, count(right_text) as targets, sum(len(coalesce(alternatives, [])))::bigint as refs from records group by 1")
def text_only_files(spark, d):
    path = scratch(spark, "text")
    writers.text_only(records.text_export(table(spark, d, "records")), path)
    x = readers.jsonl(spark, path, "id string, a string, b string, references array<string>")
    return x.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count("b").alias("targets"), F.sum(F.coalesce(F.size("references"), F.lit(0))).cast("long").alias("refs"))


@query(f"select quality_status, pair_id, len(reasons) as reasons from {GATED} where quality_status in ('review_candidate', 'quarantined')")
def status_split_files(spark, d):
    path = scratch(spark, "status")
    writers.by_status(_gated(spark, d).select("pair_id", "reasons", "quality_status"), path)
    return spark.read.parquet(path).select("quality_status", "pair_id", F.size("reasons").cast("long").alias("reasons"))


@query("select collection, collection_title, family, license, home_url from collections")
def csv_roundtrip(spark, d):
    path = scratch(spark, "csv")
    writers.csv(table(spark, d, "collections").select("collection", "collection_title", "family", "license", "home_url"), path)
    return readers.csv(spark, path).drop("row_no")


@query("select queue_id, collection, selected_source_chars from enrichment_queue")
def jsonl_strict_roundtrip(spark, d):
    path = scratch(spark, "queue")
    writers.queue(table(spark, d, "enrichment_queue"), path)
    x = readers.jsonl_strict(spark, path, "queue_id string, collection string, selected_source_chars int")
    return x.select("queue_id", "collection", "selected_source_chars")


@query("select count(*) as rows, true as whole from enrichment_queue")
def queue_manifest(spark, d):
    """Rows of the written queue as the manifest has them, and whether its digest comes out again from the files."""
    import hashlib

    path = scratch(spark, "manifest")
    said = writers.queue(table(spark, d, "enrichment_queue"), path)
    now = [r.sha256 for r in readers.checksums(spark, f"{path}/part-*").orderBy("file").collect()]  # one for each part file
    same = hashlib.sha256("".join(now).encode()).hexdigest() == said["digest"]
    return spark.createDataFrame([(said["rows"], same)], "rows long, whole boolean")


@query("select doc_id, len(string_split(regexp_replace(text, '\\n+$', ''), chr(10)))::bigint as lines, len(string_split(regexp_replace(text, '\\n+$', ''), chr(10)))::bigint as span from documents where text is not null and text <> '' and not contains(text, chr(13))")
def numbered_lines_roundtrip(spark, d):
    """Documents written as lines of text files and read back: the lines of each and the span of their numbers."""
    path = scratch(spark, "lines")
    x = table(spark, d, "documents").where("text is not null and text <> '' and not contains(text, chr(13))").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\n+\z", ""), "\n")).alias("i", "line"))
    x = x.repartition("doc_id").sortWithinPartitions("doc_id", "i")
    x.select(F.concat(F.col("doc_id").cast("string"), F.lit("\t"), "line").alias("value")).write.text(path)
    got = readers.numbered_lines(spark, path).select("line_no", F.split("text", "\t")[0].cast("long").alias("doc_id"))
    return got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), (F.max("line_no") - F.min("line_no") + 1).alias("span"))


@query("select rid, title as a, language as b from records where title is not null and language is not null and not regexp_matches(title, '[\\n\\r]')")
def parallel_lines_roundtrip(spark, d):
    """Two files of one order, zipped by line."""
    x = table(spark, d, "records").where(r"title is not null and language is not null and not title rlike '[\\n\\r]'").coalesce(1).sortWithinPartitions("rid")
    paths = {c: scratch(spark, c) for c in ("rid", "title", "language")}
    for c, path in paths.items():
        x.select(F.col(c).cast("string").alias("value")).write.text(path)
    z = readers.parallel_lines(spark, paths)
    return z.select(F.col("rid").cast("long").alias("rid"), F.col("title").alias("a"), F.col("language").alias("b"))


@query("select * from (values ('changed', 1), ('missing', 1)) as t(error, n)")
def manifest_of_files(spark, d):
    """Files against their manifest, of which one entry has another digest and one names a file that is not there."""
    path = scratch(spark, "files")
    table(spark, d, "records").select("rid", "record_id").write.json(path)
    now = readers.checksums(spark, f"{path}/part-*").select("file", "sha256")
    name = now.agg(F.min("file")).first()[0]  # one value
    taken = now.select("file", F.when(F.col("file") == name, F.lit("other")).otherwise(F.col("sha256")).alias("sha256"))
    gone = spark.createDataFrame([(name + ".gone", "x")], "file string, sha256 string")
    return readers.changed_files(now, taken.unionByName(gone)).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("select 'data' as kind, true as some")
def file_inventory(spark, d):
    path = scratch(spark, "inventory")
    table(spark, d, "collections").write.json(path)
    x = readers.inventory(spark, path).where("file like '%.json'")
    return x.groupBy("kind").agg((F.sum("bytes") > 0).alias("some"))


@query(f"select rid from records where instr({LINE.of(SEARCH)}, ' annual ') > 0 and instr({LINE.of(SEARCH)}, ' budget ') > 0")
def stored_index_search(spark, d):
    """The index written as at ingest, then read for two terms."""
    path = scratch(spark, "index")
    search.write_index(table(spark, d, "records"), path)
    return search.read_index(spark, path, "Budget annual")


@query(f"select record_id, min(h) as digest from (select record_id, {DIGEST} as h from records) where record_id is not null group by 1 having count(distinct h) = 1")
def ingest_appends(spark, d):
    """Two batches of records that contradict nothing, and the second once more: each id is there once."""
    path = scratch(spark, "ingest")
    r = table(spark, d, "records").where("record_id is not null").select("record_id", _digest().alias("content_hash"))
    fine = r.groupBy("record_id").agg(F.countDistinct("content_hash").alias("k")).where("k = 1").select("record_id")
    rows = r.join(fine, "record_id", "left_semi")
    half = F.pmod(F.xxhash64("record_id"), F.lit(2)) == 0
    for part in (rows.where(half), rows, rows):
        ingest.ingest(path, part)
    return spark.read.parquet(path).select("record_id", F.col("content_hash").alias("digest"))


@query("select doc_id as k, 1 as depth, 'top' as heading, title as sentence from documents where title is not null union all select doc_id, 2, 'inner', lang from documents where lang is not null")
def nested_sections(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("k"), F.to_json(F.struct(
        F.lit("top").alias("heading"), F.array_compact(F.array("title")).alias("sentences"),
        F.array(F.struct(F.lit("inner").alias("heading"), F.array_compact(F.array("lang")).alias("sentences"))).alias("sections"),
    )).alias("raw"))
    return readers.flat_sections(x, "k", "raw").select("k", "depth", "heading", "sentence")


@query("select rid, sha256(text) as text_sha from records where text is not null")
def glob_roundtrip(spark, d):
    """Records as JSON lines, read by a pattern of files."""
    path = scratch(spark, "documents")
    rows = table(spark, d, "records").where("text is not null").select(F.to_json(F.struct("rid", "text")).alias("value"))
    rows.write.text(path)
    return readers.glob(spark, f"{path}/part-*", "rid long, text string").select("rid", X.sha(F.col("text")).alias("text_sha"))
