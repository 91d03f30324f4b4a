import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import enrichment, gate, ingest, ledger, packets, records, sampling, search
from corpusloom.sources import readers, writers


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r[1] for r in df.select("i", expr(F.col("t"))).orderBy("i").collect()]


def test_blanks_are_those_of_python(spark):
    import re

    values = ["a   　b\x1c", " \t x \n", "", "no", None]
    assert col(spark, values, X.collapse) == [None if v is None else re.sub(r"\s+", " ", v).strip() for v in values]


def test_line_end(spark):
    assert col(spark, ["a\r\n", "a\n\n", "a\r", "a", "\r\r\n"], X.strip_line_end) == ["a", "a\n", "a", "a", "\r"]


def test_script_language(spark):
    assert col(spark, ["", "123", "word", "汉" * 30, "汉" * 25 + "a" * 200], X.script_language) == ["unknown", "unknown", "en", "zh", "mixed"]


def test_error_labels_redact(spark):
    got = col(spark, ["Rate limit for sk-abc", "odd", "invalid argument: schema is too complex"], X.error_labels)
    assert got[0] == ["rate_limit"] and got[1] == ["unclassified_provider_error"] and got[2] == ["schema_complexity", "invalid_argument"]


@pytest.fixture(scope="module")
def three(spark):
    rows = [(1, "a", "c1", "en", "rewrite", "T", "left words", "right words", ["alt"]), (2, "b", "c1", "en", "rewrite", None, "gone", "", None), (3, "c", "c2", "zh", "unpaired", "题", "左边", None, [])]
    return spark.createDataFrame(rows, "rid long, record_id string, collection string, language string, pair_type string, title string, text string, right_text string, alternatives array<string>").withColumn("text_role", F.lit("input")).withColumn("right_role", F.lit("target"))


def test_null_and_empty_right_differ(three):
    got = {(r.rid, r.side): r.text for r in records.sides(three).collect()}
    assert got[2, "right"] == "" and (3, "right") not in got and got[1, "alternatives[0]"] == "alt"
    assert {r.rid: r.s for r in three.select("rid", records.search_text("").alias("s")).collect()}[3] == "题\n左边\n"
    assert three.select(records.content_hash().alias("h")).distinct().count() == 3


def test_search(three):
    hits = lambda q: sorted(r.rid for r in search.filtered(three, search.Query(q=q)).collect())
    assert hits("words RIGHT") == [1] and hits("left_words") == [1] and hits("words_left") == [] and hits("边") == [3] and hits("!!") == [1, 2, 3]
    with pytest.raises(ValueError):
        search.filtered(three, search.Query(quality_status="quarantined"))
    x = three.withColumn("content_hash", F.lit("h"))
    rev = x.sparkSession.createDataFrame([("a", "h", "keep"), ("b", "old", "keep")], "id string, content_hash string, decision string")
    f = lambda w: sorted(r.rid for r in search.filtered(x, search.Query(review_filter=w), rev).collect())
    assert f("reviewed") == [1] and f("unreviewed") == [2, 3] and f("keep") == [1] and f("reject") == [] and f("odd") == [1, 2, 3]
    total, rows = search.page(x, search.Query(limit=0, offset=1))
    assert total == 3 and [r.rid for r in rows.collect()] == [2]


def test_gate(spark):
    x = spark.createDataFrame([("p", "a", "a", None), ("q", "a", " ", ["w"]), ("r", "a", "b", ["image_removed_review_surrounding_references"]), ("s", "a", None, ["w"]), ("t", "x" * 1200, "y", None)], "id string, l string, r string, w array<string>")
    got = {r.id: (r.quality_status, r.reasons) for r in gate.gate(x, F.lit(True), F.col("l"), F.col("r"), F.col("w")).collect()}
    assert got["p"] == ("quarantined", ["identical_text_no_style_contrast"]) and got["q"] == ("quarantined", ["empty_rewrite_side", "w"])
    assert got["r"] == ("review_candidate", []) and got["s"] == ("archive_only", []) and got["t"][1] == ["extreme_compression_review_required"]


def test_round_robin_against_loop(spark):
    import hashlib

    rows = [(i, "abc"[i % 3] if i < 12 else "a") for i in range(30)]
    got = [r.rid for r in sampling.round_robin(spark.createDataFrame(rows, "rid long, s string"), "rid", "s", 11, "seed").collect()]
    by = {k: sorted((hashlib.sha256(f"seed\0{i}".encode()).hexdigest(), i) for i, s in rows if s == k) for k in "abc"}
    want = []
    while len(want) < 11:
        for k in "abc":
            if by[k] and len(want) < 11:
                want.append(by[k].pop(0)[1])
    assert got == want


def test_greedy_queue_against_loop(spark):
    import random

    rng = random.Random(4)
    rows = [(i, f"r{rng.randrange(40)}", f"t{rng.randrange(30)}", f"t{rng.randrange(30)}", rng.choice([None, f"d{rng.randrange(20)}"])) for i in range(80)]
    got = {r.place: r.outcome for r in sampling.greedy_queue(spark.createDataFrame(rows, "place long, record_id string, selected_hash string, original_hash string, doc_id string")).collect()}
    ids, sel, orig, docs = set(), set(), set(), set()
    for p, r, s, o, d in rows:
        why = "record_id_already_selected" if r in ids else "selected_text_duplicate_across_queue" if s in sel | orig else "original_input_duplicate_across_queue" if o in sel | orig else "document_already_selected" if d and d in docs else "taken"
        assert got[p] == why
        if why == "taken":
            ids.add(r), sel.add(s), orig.add(o), docs.add(d)


def test_units_keep_fences():
    assert enrichment.split_units("a\n\nb\n```\nx\n\ny\n```\n\n\nc") == ["a", "b\n```\nx\n\ny\n```", "c"]
    assert enrichment.split_units("") == [] and enrichment.split_units("````\n```\n\nz") == ["````\n```\n\nz"]


def test_ledger_is_exact(spark):
    x = spark.createDataFrame([("a", "m", "settled", "0.10000001", "0.2", None, 1), ("b", "m", "unknown", None, "0.3", None, 2), ("c", "m", "pending", None, "0.3", "0.4", 3)], "entry_id string, model string, entry_state string, actual string, reserved string, held string, created_at_unix long")
    x = x.select("entry_id", "model", "entry_state", "created_at_unix", *[F.col(c).cast(ledger.MONEY).alias(f"{c}_usd") for c in ("actual", "reserved", "held")])
    r = ledger.spend(x, "model").first()
    assert str(r.spent_usd) == "0.10000001" and str(r.held_usd) == "0.70000000" and r.unknown == 1
    assert [v.decision for v in ledger.replay(x, "1", 9).orderBy("entry_id").collect()] == ["granted", "granted", "halted"]


def document(**over):
    claim = lambda i, d: {"id": i, "subject": "s", "predicate": "p", "object": "o", "qualifiers": {}, "attribution": None, "modality": "m", "polarity": "positive", "depends_on": d, "source_locator": i}
    doc = {"article_id": "x", "language": "en", "claims": [claim("a", []), claim("b", ["a"]), claim("c", ["a", "b"])], "excluded": [], "coverage": {"scope": "full_article", "uncovered_units": [], "units": [{"source_locator": str(i), "claim_ids": [i], "excluded_ids": []} for i in "abc"]}}
    return doc | over


def test_claim_documents():
    doc = document()
    assert packets.problems(doc) == []
    loop = json.loads(json.dumps(doc))
    loop["claims"][0]["depends_on"] = ["c"]
    assert packets.problems(loop) == ["dependency_cycle"]
    loop["claims"][0]["depends_on"] = ["a"]
    assert "self_dependency" in packets.problems(loop)
    loop["claims"][0]["depends_on"] = ["z"]
    assert "unknown_dependency" in packets.problems(loop)
    short = json.loads(json.dumps(doc))
    short["coverage"]["units"].pop()
    assert "claims_not_covered" in packets.problems(short)
    twice = json.loads(json.dumps(doc))
    twice["coverage"]["units"][1]["source_locator"] = "a"
    assert "duplicate_locator" in packets.problems(twice)
    with pytest.raises(ValueError):
        packets.parse('{"a": 1, "a": 2}')
    with pytest.raises(ValueError):
        packets.parse('{"a": NaN}')
    p = packets.packet(doc, "s")
    assert len(p["claims"]) == 3 and all("source_locator" not in c for c in p["claims"]) and p == packets.packet(doc, "s")
    two = document(claims=doc["claims"][:2])
    assert [c["subject"] for c in packets.packet(two, "s")["claims"]] == ["s", "s"]


def test_ingest_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "base")
    df = lambda rows: spark.createDataFrame(rows, "record_id string, content_hash string")
    assert ingest.ingest(path, df([("a", "1"), ("b", "2"), ("a", "1")])) == {"inserted": 2, "skipped": 0}
    assert ingest.ingest(path, df([("a", "1"), ("c", "3")])) == {"inserted": 1, "skipped": 1}
    assert ingest.ingest(path, df([("a", "1"), ("c", "3")])) == {"inserted": 0, "skipped": 2}
    for bad in ([("d", "4"), ("a", "9")], [("e", "1"), ("e", "2")]):
        with pytest.raises(ingest.Conflict):
            ingest.ingest(path, df(bad))
    assert spark.read.parquet(path).count() == 3


def test_stream_ingest(spark, tmp_path):
    from corpusloom.streaming.appends import ingest_stream

    src, base = str(tmp_path / "in"), str(tmp_path / "base")
    schema = "record_id string, content_hash string"
    spark.createDataFrame([("a", "1"), ("b", "2")], schema).write.parquet(src)
    ingest_stream(spark, src, spark.read.parquet(src).schema, base, str(tmp_path / "ck")).awaitTermination()
    spark.createDataFrame([("b", "2"), ("c", "3")], schema).write.mode("append").parquet(src)
    ingest_stream(spark, src, spark.read.parquet(src).schema, base, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.record_id for r in spark.read.parquet(base).collect()) == ["a", "b", "c"]


def test_late_rows_are_left_out(spark, tmp_path):
    from corpusloom.streaming.appends import late_counts

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda rows: spark.createDataFrame(rows, "t string, k string").select(F.to_timestamp("t").alias("at"), "k").coalesce(1).write.mode("append").parquet(src)
    put([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 09:00:00", "b")])

    def run():
        stream = late_counts(spark.readStream.schema("at timestamp, k string").parquet(src), "at", "k")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()

    run()
    put([("2024-01-01 00:20:00", "a"), ("2024-01-01 12:00:00", "c")])  # the first is later than two hours
    run()
    assert {(r.k, r.n) for r in spark.read.parquet(out).collect()} >= {("a", 2)} and ("a", 1) not in {(r.k, r.n) for r in spark.read.parquet(out).collect()}


def test_audit_checks(spark):
    from corpusloom.operators import audit

    sides = spark.createDataFrame([("r", "left", "a x b x"), ("r", "right", "a y b")], "record_id string, side string, text string")
    rules = sides.select("record_id", "side", X.sha(F.col("text")).alias("text_sha"), F.when(F.col("side") == "left", "x").otherwise(" y").alias("span"))
    rules = rules.unionByName(spark.createDataFrame([("r", "left", "stale", "x")], rules.schema))
    got = {(r.side, r.error): r.text for r in audit.scoped_removals(sides, rules).collect()}
    assert got == {("left", "span_not_unique"): None, ("right", None): "a b", ("left", "stale_rule"): None}
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert {(r.k, r.more_in) for r in audit.differences(a, b).collect()} == {(1, "first"), (3, "second")}
    assert [(r.k, r.only_in) for r in audit.key_parity(a, b, "k").collect()] == [(3, "second")]
    m = spark.createDataFrame([('"hi"',), ('[{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]',), ("plain",)], "raw string")
    assert [r[0] for r in m.select(audit.message_text(F.col("raw"))).collect()] == ["hi", "a\nb", "plain"]
    assert audit.markdown(a.groupBy("k").count().orderBy("k"), "Counts").splitlines()[4:] == ["| 1 | 2 |", "| 2 | 1 |"]
    assert len(audit.rules_fingerprint("x")) == 64


def test_writing_rules(spark):
    p = spark.createDataFrame([("a", "text c1", ["c1"], ["c9"]), ("b", " ", ["c1", "c1"], None), ("c", "fine", None, [])], "pair_id string, text string, claim_ids array<string>, unresolved_claim_ids array<string>")
    got = {r.pair_id: r.problems for r in enrichment.writing_problems(p).collect()}
    assert got == {"a": ["unknown_unresolved", "claim_id_in_text"], "b": ["empty_writing", "repeated_claim_id"], "c": []}


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    (tmp_path / "c.jsonl").write_text('{"x": 1, "x": 3}\n')
    strict = lambda n: readers.jsonl_strict(spark, str(tmp_path / n), "x int")
    assert sorted((r.line_no, r.x) for r in strict("a.jsonl").collect()) == [(1, 1), (2, 2)]
    for n in ("b.jsonl", "c.jsonl"):
        with pytest.raises(Exception):
            strict(n).collect()
    assert readers.jsonl(spark, str(tmp_path / "b.jsonl"), "x int").count() == 2
    (tmp_path / "l.txt").write_bytes(b"one\r\ntwo\n")
    (tmp_path / "r.txt").write_bytes(b"eins\nzwei\n")
    got = readers.parallel_lines(spark, {"l": str(tmp_path / "l.txt"), "r": str(tmp_path / "r.txt")}).orderBy("line_no").collect()
    assert [(r.l, r.r) for r in got] == [("one", "eins"), ("two", "zwei")]
    (tmp_path / "s.txt").write_bytes(b"eins\n")
    with pytest.raises(Exception):
        readers.parallel_lines(spark, {"l": str(tmp_path / "l.txt"), "r": str(tmp_path / "s.txt")}).collect()
    (tmp_path / "t.csv").write_text('a,count.b\n"x\ny",3\n')
    r = readers.csv(spark, str(tmp_path / "t.csv")).first()
    assert r.a == "x\ny" and r["count.b"] == 3
    nested = {"heading": "A", "sentences": ["one"], "sections": [{"heading": "B", "sentences": ["two", "three"], "sections": [{"heading": "C", "sentences": ["four"]}]}]}
    flat = readers.flat_sections(spark.createDataFrame([(1, json.dumps(nested))], "k int, raw string"), "k", "raw")
    assert sorted((r.depth, r.heading, r.sentence) for r in flat.collect()) == [(1, "A", "one"), (2, "B", "three"), (2, "B", "two"), (3, "C", "four")]
    rows = readers.glob(spark, str(tmp_path / "[ab].jsonl"), "x int").where("x is not null")
    files = rows.select("file").distinct().withColumn("record_count", F.lit(2))
    assert rows.count() == 4 and readers.manifest_check(rows, files).count() == 0 and readers.manifest_check(rows, files.withColumn("record_count", F.lit(3))).count() == 2
    kinds = {r.file.rsplit("/", 1)[1]: r.kind for r in readers.inventory(spark, str(tmp_path)).collect()}
    assert kinds["a.jsonl"] == "data" and kinds["l.txt"] == "document"


def test_writers(spark, tmp_path, three):
    path = str(tmp_path / "archive")
    writers.archive(three, path)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(FileExistsError):
        writers.archive(three, path)
    writers.text_only(records.text_export(three), str(tmp_path / "text"))
    assert spark.read.json(str(tmp_path / "text")).where("b is null").count() == 1
    assert writers.queue(three.select("rid", "record_id"), str(tmp_path / "queue"))["rows"] == 3


def test_every_query_runs(spark, sf):
    import __spark_entry__ as e

    names = [n for n in e.queries() if not (n[0] == "p" and n[1].isdigit())]
    assert set(e.oracle_sql()) <= set(e.queries()) and len(names) > 50
    for n in names:
        assert e.queries()[n](spark, sf).columns


def test_a_few_queries_against_duckdb(spark, sf):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for t in ("records", "documents", "enrichment_pairs", "enrichment_queue", "ledger_entries"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for n in ("length_groups", "quality_gate", "ledger_spend", "number_set_diff", "stratified_round_robin", "search_phrase"):
        df = e.queries()[n](spark, sf)
        got = sorted(map(str, (tuple(r) for r in df.collect())))
        rel = con.sql(f"select {', '.join(df.columns)} from ({e.oracle_sql()[n]})")
        assert got == sorted(map(str, rel.fetchall())), n
