"""Search folding, stored index, split files, manifests, ledger prefixes, digests and lifecycle steps."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import audit, enrichment, ingest, ledger, search
from corpusloom.sources import readers, writers


@pytest.mark.parametrize(
    "text,query,hit",
    [
        ("Московский край", "московский КРАЙ", True), ("Московский край", "московскии краи", True), ("Άνθρωπος και πόλη", "ανθρωπος", True), ("ανθρωπος", "Άνθρωπος", True),
        ("café noir", "CAFÉ", True), ("café noir", "cafe", True), ("cafés", "cafe", False), ("decafe", "cafe", False), ("décafe", "cafe", False),
        ("a field, diary b", "field_diary", True), ("diary field", "field_diary", False), ("x2 y", "x2", True), ("x21", "x2", False), ("a.b", "a.b", True), ("", "a", False),
    ],
)
def test_query_and_text_fold_alike(spark, text, query, hit):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(search.has_terms(F.col("text"), query)).first()[0] is hit
    # the same answer by tokens
    line = F.concat(F.lit(" "), F.array_join(search.tokens(F.col("text")), " "), F.lit(" "))
    want = all(df.select(F.instr(line, " " + " ".join(t) + " ") > 0).first()[0] for t in search.terms_of(query))
    assert want is hit


def test_stored_index(spark, tmp_path):
    rows = [(1, "Annual budget", None), (2, "annual report", "of the BUDGÉT"), (3, None, None), (4, "", "budget")]
    df = spark.createDataFrame([(a, None, b, c, None) for a, b, c in rows], "rid long, title string, text string, right_text string, alternatives array<string>")
    path = str(tmp_path / "index")
    search.write_index(df, path)
    assert sorted(r.rid for r in search.read_index(spark, path, "budget ANNUAL").collect()) == [1, 2]
    search.write_index(df.where("rid = 1").withColumn("rid", F.lit(9).cast("long")), path)
    assert sorted(r.rid for r in search.read_index(spark, path, "annual").collect()) == [1, 2, 9]
    assert search.read_index(spark, path, "nothing").count() == 0


def test_lines_of_split_files(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_bytes(b"".join(b"line %d\r\n" % i for i in range(1, 3001)) + b"last")
    (tmp_path / "other.txt").write_bytes(b"a\n\nb\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.numbered_lines(spark, str(tmp_path / "*.txt"))
        assert got.rdd.getNumPartitions() > 3
        rows = {(r.file.rsplit("/", 1)[1], r.line_no): r.text for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == {**{("long.txt", i): f"line {i}" for i in range(1, 3001)}, ("long.txt", 3001): "last", ("other.txt", 1): "a", ("other.txt", 2): "", ("other.txt", 3): "b"}


def test_lenient_lines_tell_what_is_broken(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"x": 1}\n{"x": \n\n{"x": 3}\n')
    rows = readers.jsonl(spark, str(tmp_path / "x.jsonl"), "x int").collect()
    assert sorted((r.x or 0, r.broken) for r in rows if r.broken is None) == [(1, None), (3, None)] and [r.broken for r in rows if r.broken] == ['{"x": ']
    (tmp_path / "t.csv").write_text('a,b\n"x\ny",3\nz,4\n')
    assert [(r.row_no, r.a) for r in readers.csv(spark, str(tmp_path / "t.csv")).orderBy("row_no").collect()] == [(2, "x\ny"), (3, "z")]


def test_manifest_counts_repeats(spark, tmp_path):
    one = writers.queue(spark.createDataFrame([("a",), ("b",)], "q string").coalesce(1), str(tmp_path / "one"))
    three = writers.queue(spark.createDataFrame([("a",), ("b",), ("b",), ("b",)], "q string").coalesce(1), str(tmp_path / "three"))
    assert one["rows"] == 2 and three["rows"] == 4 and one["digest"] != three["digest"] and len(one["digest"]) == 64
    files = readers.checksums(spark, str(tmp_path / "one" / "part-*"))
    assert readers.changed_files(files, files).count() == 0
    assert [r.error for r in readers.changed_files(files, files.withColumn("sha256", F.lit("x"))).collect()] == ["changed"]


def test_status_folders_are_one_publication(spark, tmp_path):
    df = spark.createDataFrame([(1, "quarantined"), (2, "archive_only")], "k int, quality_status string")
    writers.by_status(df, str(tmp_path / "s"))
    assert [(r.k, r.quality_status) for r in spark.read.parquet(str(tmp_path / "s")).collect()] == [(1, "quarantined")]
    with pytest.raises(FileExistsError):
        writers.by_status(df, str(tmp_path / "s"))


def test_ingest_takes_one_row_of_equal_digests(spark, tmp_path):
    path = str(tmp_path / "base")
    rows = [("a", "1", "x"), ("a", "1", "y"), ("b", "2", None)]
    for order in (rows, rows[::-1]):
        p = f"{path}{len(order[0][0])}{order[0][2]}"
        assert ingest.ingest(p, spark.createDataFrame(order, "record_id string, content_hash string, note string")) == {"inserted": 2, "skipped": 0}
    got = [sorted((r.record_id, r.note or "") for r in spark.read.parquet(f"{path}1{n}").collect()) for n in ("x", "None")]
    assert got[0] == got[1]


def test_ledger_prefixes_by_hours_equal_one_window(spark):
    rows = [(f"e{i:03d}", "m", ("settled", "pending", "unknown")[i % 3 if i > 40 else i % 2], i * 700 - i % 7 * 300, "0.01", "0.004" if i % 3 == 0 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "entry_id string, model string, entry_state string, created_at_unix long, r string, a string")
    df = df.select("entry_id", "model", "entry_state", "created_at_unix", F.col("r").cast("decimal(18,8)").alias("reserved_usd"), F.col("a").cast("decimal(18,8)").alias("actual_usd"), F.lit(None).cast("decimal(18,8)").alias("held_usd"))
    order = sorted(rows, key=lambda r: (r[3], r[0]))
    total, want, halted, calls = 0.0, {}, False, 0
    for e, _, s, _, r, a in order:
        want[e] = "halted" if halted else "call_cap" if calls >= 50 else "over_budget" if total + float(r) > 0.3 + 1e-12 else "granted"
        total += (float(a) if a else 0.0) if s == "settled" else float(r)
        calls, halted = calls + 1, halted or s == "unknown"
    assert {r.entry_id: r.decision for r in ledger.replay(df, "0.3", 50).collect()} == want


def test_lifecycle_steps(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "queue_id string")
    done = spark.createDataFrame([("a", "v1"), ("a", "v0"), ("b", "v0")], "queue_id string, config string")
    assert {r.queue_id: r.action for r in enrichment.resume(q, done, "v1").collect()} == {"a": "skip", "b": "configuration_conflict", "c": "run"}
    p = spark.createDataFrame([("x", "fine", ["c1"], ["c1"], ["w"]), ("y", "c2 is here", ["c2", "c3"], None, None)], "pair_id string, text string, claim_ids array<string>, unresolved_claim_ids array<string>, normalization_warnings array<string>")
    got = {r.pair_id: (r.status, r.unresolved, r.warnings) for r in enrichment.downgraded(p).collect()}
    assert got == {"x": ("resolved", ["c1"], ["w"]), "y": ("unresolved", ["c2", "c3"], ["claim_id_in_text"])}
    r = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "record_id string, rid int")
    assert sorted((x.record_id, x.rid, x.found) for x in audit.point(r, spark.createDataFrame([("a",)], "record_id string")).collect()) == [("a", 1, True), ("a", 2, True)]
    assert [x.found for x in audit.point(r, spark.createDataFrame([("zz",)], "record_id string")).collect()] == [False]
    assert [x.rid for x in audit.without_ids(r, spark.createDataFrame([("a",), (None,)], "record_id string"), "record_id").collect()] == [3]


def test_table_digest_sums_beyond_a_long(spark):
    n = 140_000
    df = spark.range(0, n, 1, 2).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id") % 7)).alias("text"))
    line = lambda i: f"{i}\x1f" + (f"t{i % 7}" if i % 3 else "\0")
    want = sum(int(hashlib.sha256(line(i).encode()).hexdigest()[:12], 16) for i in range(n))
    got = audit.table_digest(df, ["id", "text"])
    assert want > 2**63 and got.schema["digest"].dataType.simpleString() == "decimal(38,0)"
    assert tuple(got.first()) == (n, want)
    twice = audit.table_digest(df.union(df), ["id", "text"]).first()
    assert tuple(twice) == (2 * n, 2 * want)
