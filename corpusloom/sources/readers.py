"""Reading the formats that records come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

FILE = "_metadata.file_path"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no from 1, text) of text files; only the line feed and one carriage return before it go.

    Files are split as any text is.  The place of a line within its split comes from its row number, and the lines of
    the splits before it from a count per split, a table of one row for each split; the text is not shuffled.
    """
    at = F.monotonically_increasing_id()
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col(FILE).alias("file"), F.col("_metadata.file_block_start").alias("block"), at.alias("at"), "value")
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(Window.partitionBy("file").orderBy("block")) - F.col("k")
    splits = splits.select("file", "block", (F.col("first") - before).alias("base"))
    x = lines.join(splits, ["file", "block"])
    return x.select("file", (F.col("at") - F.col("base") + 1).alias("line_no"), F.regexp_replace("value", r"\r\z", "").alias("text"))


def jsonl_strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows with their line number; a blank line, broken JSON, repeated keys or a number that is not finite fail the job."""
    lines = numbered_lines(spark, path)
    bad = (F.trim("text") == "") | F.try_parse_json("text").isNull()
    told = F.when(bad, F.raise_error(F.concat(F.lit("bad line "), F.col("line_no").cast("string"), F.lit(" of "), F.col("file")))).otherwise(F.from_json("text", schema, {"mode": "FAILFAST"}))
    return lines.select("file", "line_no", told.alias("row")).select("file", "line_no", "row.*")


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Lenient: blank lines are skipped, and a broken line gives nulls with its text in the column broken."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*kind.fields, T.StructField("broken", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)


def json_document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema is not None else r).json(path)


def csv(spark: SparkSession, path: str, count_prefix: str = "count.") -> DataFrame:
    """With header and quoted line ends; columns that begin with the prefix are whole numbers; row_no counts from 2, after the header."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    out = df.select(F.col(FILE).alias("file"), F.monotonically_increasing_id().alias("at"), *[F.col(f"`{c}`").cast("int").alias(c) if c.startswith(count_prefix) else F.col(f"`{c}`") for c in df.columns])
    first = out.groupBy("file").agg(F.min("at").alias("first"))  # a file with quoted line ends is one split
    return out.join(first, "file").select((F.col("at") - F.col("first") + 2).alias("row_no"), *[F.col(f"`{c}`") for c in df.columns])


def parallel_lines(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Files zipped by line, one column each; files of unequal length fail the job."""
    out = None
    for name, path in paths.items():
        one = numbered_lines(spark, path).select("line_no", F.col("text").alias(name))
        out = one if out is None else out.join(one, "line_no", "full_outer")
    short = F.greatest(*[F.col(c).isNull().cast("int") for c in paths]) if len(paths) > 1 else F.lit(0)
    return out.select("line_no", *[F.when(short == 1, F.raise_error(F.lit("files of unequal length"))).otherwise(F.col(c)).alias(c) for c in paths])


def glob(spark: SparkSession, pattern: str, schema: T.StructType | str) -> DataFrame:
    """All JSON line files of a pattern, with the file each row came from."""
    return spark.read.schema(schema).json(pattern).select("*", F.col(FILE).alias("file"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files of a folder; for files of bounded size, such as the parts that writers make."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed_files(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, error) of files missing, new or of other content than in the manifest (file, sha256)."""
    x = now.select("file", F.col("sha256").alias("is")).join(manifest.select("file", F.col("sha256").alias("was")), "file", "full_outer")
    return x.where(~F.col("is").eqNullSafe(F.col("was"))).select("file", F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "new").otherwise("changed").alias("error"))


def manifest_check(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, found, expected) where they differ; empty when all files are whole."""
    n = rows.groupBy("file").agg(F.count(F.lit(1)).alias("found"))
    x = n.join(manifest.select("file", F.col("record_count").alias("expected")), "file", "full_outer")
    return x.where(~F.col("found").eqNullSafe(F.col("expected")))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, kind) of all files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    end = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(end.isin("json", "jsonl", "csv", "tsv", "parquet"), "data").when(end.isin("md", "txt", "pdf", "html"), "document").when(end.isin("py", "sh", "js"), "code").otherwise("other")
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), kind.alias("kind"))


def flat_sections(docs: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, depth, heading, sentence) of nested section JSON: up to six levels of {heading, sentences, sections}."""
    node = "heading string, sentences array<string>"
    for _ in range(5):
        node = f"heading string, sentences array<string>, sections array<struct<{node}>>"
    x = docs.select(key, F.from_json(raw, node).alias("n"))
    out = None
    for depth in range(1, 7):
        here = x.select(key, F.lit(depth).alias("depth"), F.col("n.heading").alias("heading"), F.posexplode("n.sentences").alias("place", "sentence"))
        out = here if out is None else out.unionByName(here)
        if depth < 6:
            x = x.select(key, F.explode("n.sections").alias("n"))
    return out
