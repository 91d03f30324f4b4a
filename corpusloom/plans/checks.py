"""Queries of further checks, exports of metadata, and lifecycle steps, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit, enrichment, gate, ingest, ledger, sampling
from ..session import table
from .catalog import AMOUNT, COLLAPSE, DIGEST, GATED, PAIRS, QUEUE, SEED, STRIP, _digest, _gated, query


@query("select i.record_id, r.rid, r.rid is not null as found from (select distinct source_id as record_id from enrichment_queue union select 'no-such-record') i left join records r using (record_id)")
def point_lookup(spark, d):
    ids = table(spark, d, "enrichment_queue").select(F.col("source_id").alias("record_id"))
    ids = ids.union(spark.createDataFrame([("no-such-record",)], "record_id string"))
    return audit.point(table(spark, d, "records").select("record_id", "rid"), ids).select("record_id", "rid", "found")


@query("select rid from records where record_id is null or record_id not in (select source_id from enrichment_queue where source_id is not null and is_optional)")
def excluded_ids(spark, d):
    out = table(spark, d, "enrichment_queue").where("is_optional").select(F.col("source_id").alias("record_id"))
    return audit.without_ids(table(spark, d, "records"), out, "record_id").select("rid")


@query("select queue_id, len(list_filter(coalesce(quality_notes, []), lambda x: starts_with(x, 's'))) > 0 as noted from (select distinct queue_id, quality_notes from enrichment_queue)")
def notes_any_startswith(spark, d):
    q = table(spark, d, "enrichment_queue").select("queue_id", "quality_notes").dropDuplicates()
    return q.select("queue_id", audit.any_startswith(F.col("quality_notes"), "s").alias("noted"))


FAILED = "(select distinct p.queue_id from ledger_entries l join enrichment_pairs p using (pair_id) where l.entry_state = 'unknown')"


@query(f"select distinct q.queue_id from enrichment_queue q where q.selected_source_text is null or (q.queue_id, sha256(q.selected_source_text)) not in (select distinct f.queue_id, sha256(x.selected_source_text) from {FAILED} f join enrichment_queue x using (queue_id) where x.selected_source_text is not null and not x.is_optional)")
def known_failures_excluded(spark, d):
    q = table(spark, d, "enrichment_queue")
    failed = table(spark, d, "ledger_entries").where("entry_state = 'unknown'").join(table(spark, d, "enrichment_pairs").select("pair_id", "queue_id").distinct(), "pair_id").select("queue_id").distinct()
    bound = q.where("not is_optional").join(failed, "queue_id", "left_semi").select("queue_id", X.sha(F.col("selected_source_text")).alias("text_sha"))
    return audit.without_known_failures(q, bound, "queue_id", "selected_source_text").select("queue_id").distinct()


_CUT = "list_distinct(list_filter(list_transform(string_split(@@, chr(10)), lambda x: " + COLLAPSE.of("x") + "), lambda x: x <> ''))"


@query(f"""select rid, s.side as side, s.n as sentences, s.u as unaligned from (select rid, unnest([{{'side': 'left', 'n': len(a), 'u': len(list_filter(a, lambda x: not list_contains(b, x)))}}, {{'side': 'right', 'n': len(b), 'u': len(list_filter(b, lambda x: not list_contains(a, x)))}}]) as s from
 (select rid, {_CUT.replace('@@', 'text')} a, {_CUT.replace('@@', 'right_text')} b from records where text is not null and right_text is not null))""")
def unaligned_lines(spark, d):
    return audit.unaligned(table(spark, d, "records"))


@query("select distinct p.pair_id, p.queue_id, f.first from enrichment_pairs p join (select queue_id, arg_min(pair_id, (created_at, pair_id)) as first from enrichment_pairs group by 1) f using (queue_id) where p.pair_id <> f.first")
def same_query_match(spark, d):
    p = table(spark, d, "enrichment_pairs").select("pair_id", "queue_id", "created_at").dropDuplicates()
    return audit.same_query(p, "queue_id", "pair_id", ["created_at", "pair_id"])


@query("""select exporter, collection, count(*) as n, count(text) as texts, sum(length(text))::bigint as chars from (select 'records' as exporter, collection, text from records union all select 'queue', collection, selected_source_text from enrichment_queue
 union all select 'documents', source, text from documents) group by 1, 2""")
def union_exports(spark, d):
    """One table of what several exporters give, whatever columns each has."""
    parts = [("records", "records", "collection", "text"), ("queue", "enrichment_queue", "collection", "selected_source_text"), ("documents", "documents", "source", "text")]
    out = None
    for name, t, group, text in parts:
        x = table(spark, d, t).select(F.lit(name).alias("exporter"), F.col(group).alias("collection"), F.col(text).alias("text"))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out.groupBy("exporter", "collection").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("texts"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(f"""select 'records' as source, count(*) as rows, sum(('0x' || substr(sha256(coalesce(rid::varchar, chr(0)) || chr(31) || coalesce(record_id, chr(0)) || chr(31) || coalesce(text, chr(0)) || chr(31) || coalesce(right_text, chr(0))), 1, 12))::bigint)::varchar as digest from records
 union all select 'documents', count(*), sum(('0x' || substr(sha256(coalesce(doc_id::varchar, chr(0)) || chr(31) || coalesce(text, chr(0))), 1, 12))::bigint)::varchar from documents""")
def input_digests(spark, d):
    """Digests of the inputs, taken before and after a run to show that it changed none."""
    one = lambda name, cols: audit.table_digest(table(spark, d, name), cols).select(F.lit(name).alias("source"), "rows", F.col("digest").cast("string").alias("digest"))
    return one("records", ["rid", "record_id", "text", "right_text"]).unionByName(one("documents", ["doc_id", "text"]))


@query("""select rid, record_id, text_role as left_role, case when right_text is not null then right_role end as right_role, sha256(text) as left_hash, sha256(right_text) as right_hash, right_text = '' as deletion from records""")
def metadata_manifest(spark, d):
    m = audit.metadata_manifest(table(spark, d, "records"))
    get = lambda c, k: F.try_element_at(F.col(c), F.lit(k)).alias(f"{k}_{'role' if c == 'roles' else 'hash'}")
    return m.select("rid", "record_id", get("roles", "left"), get("roles", "right"), get("hashes", "left"), get("hashes", "right"), "deletion")


@query(f"""select t.kind as kind, t.value as value, quality_status, count(*) as n, min(pair_id) as first_key from (select g.pair_id, g.quality_status, unnest(list_concat([{{'kind': 'status', 'value': g.quality_status}}], list_transform(list_distinct(coalesce(p.normalization_warnings, [])), lambda v: {{'kind': 'warning', 'value': v}}),
 list_transform(g.reasons, lambda v: {{'kind': 'reason', 'value': v}}))) as t from {GATED} g join (select distinct pair_id, normalization_warnings from enrichment_pairs) p using (pair_id) where len(g.reasons) > 0 or len(coalesce(p.normalization_warnings, [])) > 0) group by 1, 2, 3""")
def flags_export(spark, d):
    return gate.flag_export(_gated(spark, d), "pair_id", "normalization_warnings")


@query(f"select entry_id, case when entry_state='settled' and actual_usd is null then 'violation_no_amount' when entry_state='settled' and actual_usd > reserved_usd then 'violation_over_reservation' when entry_state='settled' then 'settled' when entry_state='unknown' then 'held' else 'open' end as outcome_state, ({AMOUNT})::decimal(18,8) as charged_usd from ledger_entries")
def ledger_settlement(spark, d):
    return ledger.settlement(table(spark, d, "ledger_entries"))


@query(f"""with p as (select distinct pair_id, text, claim_ids, unresolved_claim_ids, normalization_warnings, coalesce(claim_ids, []) ids, coalesce(unresolved_claim_ids, []) un from enrichment_pairs), x as (select *, list_filter([case when coalesce({STRIP.of('text')}, '') = '' then 'empty_writing' end,
 case when len(list_distinct(ids)) < len(ids) then 'repeated_claim_id' end, case when len(list_filter(un, lambda x: not list_contains(ids, x))) > 0 then 'unknown_unresolved' end, case when len(list_filter(ids, lambda x: instr(coalesce(text, ''), x) > 0)) > 0 then 'claim_id_in_text' end], lambda x: x is not null) as problems from p)
 select distinct pair_id, case when len(problems) > 0 then 'unresolved' else 'resolved' end as status, case when len(problems) > 0 then list_sort(list_distinct(list_concat(ids, un))) else list_sort(list_distinct(un)) end as unresolved, list_sort(list_distinct(list_concat(coalesce(normalization_warnings, []), problems))) as warnings from x""")
def writing_downgrade(spark, d):
    return enrichment.downgraded(table(spark, d, "enrichment_pairs")).distinct()


@query("""select q.queue_id, case when c.same is null then 'run' when c.same then 'skip' else 'configuration_conflict' end as action from (select distinct queue_id from enrichment_queue) q left join
 (select queue_id, bool_or(model like '%plume%') as same from enrichment_pairs where text is not null group by 1) c using (queue_id)""")
def resume_run(spark, d):
    done = table(spark, d, "enrichment_pairs").where("text is not null").select("queue_id", F.when(F.col("model").like("%plume%"), "plume").otherwise("other").alias("config"))
    return enrichment.resume(table(spark, d, "enrichment_queue"), done, "plume")


@query(f"""select rid, stratum, round from (select rid, stratum, row_number() over (partition by stratum order by score, rid) as round from (select rid, lower(trim(coalesce(domain,''))) as stratum, sha256('{SEED}' || chr(0) || rid::varchar) as score,
 row_number() over (partition by sha256({COLLAPSE.of("coalesce(text,'')")}) order by sha256('{SEED}' || chr(0) || rid::varchar), rid) as copy, {COLLAPSE.of("coalesce(text,'')")} <> '' as solid from records) where solid and copy = 1) where round <= 200 order by round, stratum limit 200""")
def round_robin_without_rejects(spark, d):
    """Blank texts and further copies of a text are rejected; their turn goes to the next of the stratum."""
    text = X.collapse(F.coalesce("text", F.lit("")))
    r = table(spark, d, "records").select("rid", F.lower(F.trim(F.coalesce("domain", F.lit("")))).alias("stratum"), X.sha(text).alias("h"), (text != "").alias("solid"), X.seeded_score(SEED, F.col("rid").cast("string")).alias("s"))
    first = r.where("solid").groupBy("h").agg(F.min_by(F.struct("rid", "stratum"), F.struct("s", "rid")).alias("m")).select("m.*")
    return sampling.round_robin(first, "rid", "stratum", 200, SEED).select("rid", "stratum", "round")


@query(f"select record_id, count(distinct {DIGEST}) as contents, count(distinct coalesce(license, '')) as licenses, min(rid) as first_rid, max(rid) as last_rid from records group by 1 having count(*) > 1")
def repeated_deliveries(spark, d):
    r = table(spark, d, "records").select("record_id", "rid", "license", _digest().alias("d"))
    x = r.groupBy("record_id").agg(F.countDistinct("d").alias("contents"), F.countDistinct(F.coalesce("license", F.lit(""))).alias("licenses"), F.min("rid").alias("first_rid"), F.max("rid").alias("last_rid"), F.count(F.lit(1)).alias("n"))
    return x.where("n > 1").drop("n")


@query(f"select q.queue_id, list_sort(list(distinct p.model)) as models from {QUEUE} q join {PAIRS} p using (queue_id) where p.text is not null group by 1 having count(distinct p.text) > 1")
def differing_answers(spark, d):
    p = table(spark, d, "enrichment_pairs").where("text is not null").join(table(spark, d, "enrichment_queue").select("queue_id").distinct(), "queue_id", "left_semi")
    x = p.groupBy("queue_id").agg(F.array_sort(F.collect_set("model")).alias("models"), F.countDistinct("text").alias("k"))
    return x.where("k > 1").drop("k")


@query("select coalesce(c.collection, n.collection) as collection, coalesce(n.n, 0) as n, c.collection is null as missing_metadata from collections c full join (select collection, count(*) n from records group by 1) n on c.collection = n.collection where n.n is not null")
def catalog_merge(spark, d):
    counts = table(spark, d, "records").groupBy("collection").agg(F.count(F.lit(1)).alias("n"))
    old = table(spark, d, "collections").select("collection", "collection_title", F.lit(0).alias("n"))
    return ingest.merge_catalog(old, counts).select("collection", "n", "missing_metadata")


@query("""select rid, side, case when n = 0 then 'span_not_unique' when n > 1 then 'span_not_unique' end as error, case when n = 1 then sha256(replace(text, 'ferry', '')) end as text_sha from
 (select rid, 'left' as side, text, (length(text) - length(replace(text, 'ferry', ''))) // 5 as n from records where text is not null and language = 'en')""")
def scoped_span_removal(spark, d):
    """A rule for each English left side: the one span must occur once in just that text."""
    r = table(spark, d, "records").where("text is not null and language = 'en'").select("rid", F.col("rid").cast("string").alias("record_id"), F.lit("left").alias("side"), "text")
    rules = r.select("record_id", "side", X.sha(F.col("text")).alias("text_sha"), F.lit("ferry").alias("span"))
    x = audit.scoped_removals(r.drop("rid"), rules)
    return x.select(F.col("record_id").cast("long").alias("rid"), "side", "error", X.sha(F.col("text")).alias("text_sha"))
