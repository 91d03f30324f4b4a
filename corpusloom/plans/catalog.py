"""All queries of the core and their SQL; every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning
from ..functions import text as X
from ..operators import audit, enrichment, gate, ingest, ledger, lengths, packets, records, sampling, search
from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

B, HAN, WORD = X.BLANK, X.HAN, X.WORD
PAIRS = "(select distinct pair_id, queue_id, source_id, model, text, unresolved_claim_ids, normalization_warnings from enrichment_pairs)"
QUEUE = "(select distinct queue_id, collection, source_unit_type, split_part(lower(replace(target_language,'_','-')),'-',1) lang0, selected_source_text, selected_source_chars, is_optional, source_id from enrichment_queue)"
LANG = "case lang0 when 'eng' then 'en' when 'zho' then 'zh' when 'jpn' then 'ja' when 'deu' then 'de' when 'fra' then 'fr' when 'spa' then 'es' else lang0 end"


class Part(str):
    """A piece of SQL with a gap."""

    def of(self, value: str) -> str:
        return self.replace("@@", value)


STRIP = Part(f"regexp_replace(@@, '^{B}+|{B}+$', '', 'g')")
COLLAPSE = Part(f"regexp_replace(regexp_replace(@@, '{B}+', ' ', 'g'), '^ | $', '', 'g')")
SEARCH = "lower(array_to_string(list_concat([coalesce(title,''), coalesce(text,''), coalesce(right_text,'')], coalesce(alternatives, [])), chr(10)))"
FOLD = Part(f"regexp_replace(translate(@@, '{search.ACCENTED}', '{search.PLAIN}'), '[\\x{{300}}-\\x{{36f}}]', '', 'g')")
LINE = Part("' ' || array_to_string(list_filter(string_split_regex(" + FOLD + ", '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' '")
DIGEST = "sha256(coalesce(text, chr(1)) || chr(31) || coalesce(right_text, chr(1)))"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _queue(spark: SparkSession, d: str) -> DataFrame:
    known = F.create_map(*[F.lit(v) for p in {"eng": "en", "zho": "zh", "jpn": "ja", "deu": "de", "fra": "fr", "spa": "es"}.items() for v in p])
    lang = F.split(F.lower(F.regexp_replace("target_language", "_", "-")), "-")[0]
    q = table(spark, d, "enrichment_queue").select("queue_id", "collection", "source_unit_type", lang.alias("lang0"), "selected_source_text", "selected_source_chars", "is_optional", "source_id").dropDuplicates()
    return q.withColumn("language", F.coalesce(F.try_element_at(known, F.col("lang0")), F.col("lang0")))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "enrichment_pairs").select("pair_id", "queue_id", "source_id", "model", "text", "unresolved_claim_ids", "normalization_warnings").dropDuplicates()


def _joined(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).join(_queue(spark, d).drop("source_id"), "queue_id")


def _measured(spark: SparkSession, d: str) -> DataFrame:
    j = _joined(spark, d).where(F.col("text").isNotNull())
    return lengths.measured(j.select(F.col("pair_id").alias("id"), "collection", "language", "model", F.col("selected_source_text").alias("left"), F.col("text").alias("right")))


def _digest():
    return X.sha(F.concat(F.coalesce("text", F.lit("\x01")), F.lit("\x1f"), F.coalesce("right_text", F.lit("\x01"))))


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on the records that were queued, bound to the content of their first delivery."""
    q = table(spark, d, "enrichment_queue").groupBy(F.col("source_id").alias("id")).agg(F.min(F.when(F.col("is_optional"), "reject").otherwise("keep")).alias("decision"))
    first = table(spark, d, "records").groupBy(F.col("record_id").alias("id")).agg(F.min(F.struct("rid", _digest().alias("h"))).alias("m"))
    return q.join(first.select("id", F.col("m.h").alias("content_hash")), "id")


REVIEWS = f"(select q.id, q.decision, f.h as content_hash from (select source_id id, min(case when is_optional then 'reject' else 'keep' end) decision from enrichment_queue group by 1) q join (select record_id id, arg_min({DIGEST}, rid) h from records group by 1) f using (id))"
MEASURED = f"""select p.pair_id as id, q.collection, {LANG} as language, p.model,
 case {LANG} when 'zh' then len(regexp_extract_all(selected_source_text, '{HAN}')) else len(regexp_extract_all(selected_source_text, '[A-Za-z]+(?:[''’][A-Za-z]+)*')) end as original,
 case {LANG} when 'zh' then len(regexp_extract_all(p.text, '{HAN}')) else len(regexp_extract_all(p.text, '[A-Za-z]+(?:[''’][A-Za-z]+)*')) end as rewritten
 from {PAIRS} p join {QUEUE} q using (queue_id) where p.text is not null and {LANG} in ('zh','en')"""
CHANGED = f"(select *, rewritten - original as delta, (rewritten::double / original - 1) * 100 as change_pct from ({MEASURED}) where original > 0)"
SUMMARY = """count(*) as n, count(*) filter (delta > 0) as longer, count(*) filter (delta = 0) as equal, count(*) filter (delta < 0) as shorter,
 round(avg(original), 6) as original_mean, round(avg(rewritten), 6) as rewritten_mean, round(median(change_pct), 6) as median_change_pct, round(avg(change_pct), 6) as mean_change_pct,
 round((sum(rewritten)::double / sum(original)::double - 1) * 100, 6) as total_change_pct, count(*) filter (change_pct > 10 + 1e-8) as longer_by_10, count(*) filter (change_pct < -10 - 1e-8) as shorter_by_10"""


# --- lengths ---------------------------------------------------------------------------------------------


@query(f"""select coalesce(lang, 'none') as lang, count(*) as n, round(avg(w), 6) as mean_words, median(w)::double as median_words, round(avg(h), 6) as mean_han from
 (select lang, len(regexp_extract_all(text, '[A-Za-z]+(?:[''’][A-Za-z]+)*')) w, len(regexp_extract_all(text, '{HAN}')) h from documents) group by 1""")
def length_summary_by_lang(spark, d):
    x = table(spark, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), X.word_count(F.col("text")).alias("w"), X.han_count(F.col("text")).alias("h"))
    return x.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("w"), 6).alias("mean_words"), F.median("w").cast("double").alias("median_words"), F.round(F.avg("h"), 6).alias("mean_han"))


@query(f"select id, language, model, original::bigint as original, rewritten::bigint as rewritten, delta::bigint as delta, round(change_pct, 6) as change_pct from {CHANGED}")
def pair_length_change(spark, d):
    return _measured(spark, d).select("id", "language", "model", F.col("original").cast("long"), F.col("rewritten").cast("long"), F.col("delta").cast("long"), F.round("change_pct", 6).alias("change_pct"))


@query(f"select language, {SUMMARY} from {CHANGED} group by 1")
def length_summary_pairs(spark, d):
    return lengths.summary(_measured(spark, d), "language")


@query(f"select group_name, {SUMMARY} from (select *, unnest(['all/' || language, 'collection/' || collection || '/' || language, 'model/' || model || '/' || language]) as group_name from {CHANGED}) group by 1")
def length_groups(spark, d):
    return lengths.summary(lengths.in_groups(_measured(spark, d)), "group_name")


@query(f"""select language, count(*) as n, sum(ro)::bigint as raw_original_total, sum(co)::bigint as clean_original_total, (sum(co)-sum(ro))::bigint as original_delta, round((sum(co)::double/nullif(sum(ro),0)::double-1)*100,6) as original_change_pct, count(*) filter (ro<>co) as original_rows_changed,
 sum(rr)::bigint as raw_rewritten_total, sum(cr)::bigint as clean_rewritten_total, (sum(cr)-sum(rr))::bigint as rewritten_delta, round((sum(cr)::double/nullif(sum(rr),0)::double-1)*100,6) as rewritten_change_pct, count(*) filter (rr<>cr) as rewritten_rows_changed from
 (select {LANG} as language, length(selected_source_text) ro, length({COLLAPSE.of("selected_source_text")}) co, length(text) rr, length({COLLAPSE.of("text")}) cr from {PAIRS} p join {QUEUE} q using (queue_id) where text is not null) group by 1""")
def raw_clean_lengths(spark, d):
    j = _joined(spark, d).where(F.col("text").isNotNull())
    a, b = F.col("selected_source_text"), F.col("text")
    x = j.select("language", F.length(a).cast("long").alias("raw_original"), F.length(X.collapse(a)).cast("long").alias("clean_original"), F.length(b).cast("long").alias("raw_rewritten"), F.length(X.collapse(b)).cast("long").alias("clean_rewritten"))
    return lengths.effect(x, "language")


@query(f"""select doc_id, length(text) as chars, length(regexp_replace(text, '{B}+', '', 'g')) as solid_chars, len(regexp_extract_all(text, '{HAN}')) as han, len(regexp_extract_all(text, '[A-Za-z]+(?:[''’-][A-Za-z]+)*')) as latin_words from documents where text is not null""")
def review_lengths(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where(t.isNotNull()).select("doc_id", F.length(t).cast("long").alias("chars"), F.length(X.without_blanks(t)).cast("long").alias("solid_chars"), X.han_count(t).cast("long").alias("han"), X.count(t, r"[A-Za-z]+(?:['’-][A-Za-z]+)*").cast("long").alias("latin_words"))


# --- records ----------------------------------------------------------------------------------------------


@query("""select rid, record_id, s.side as side, s.role as role, length(s.text)::bigint as chars from (select rid, record_id, unnest(list_concat(
 [{'side': 'left', 'text': text, 'role': text_role}], case when right_text is not null then [{'side': 'right', 'text': right_text, 'role': right_role}] else [] end,
 list_transform(coalesce(alternatives, []), lambda t, i: {'side': 'alternatives[' || (i - 1)::varchar || ']', 'text': t, 'role': 'alternative'}))) as s from records)""")
def fields_unpivot(spark, d):
    return records.sides(table(spark, d, "records")).select("rid", "record_id", "side", "role", F.length("text").cast("long").alias("chars"))


@query(f"select rid, sha256({SEARCH}) as search_sha, sha256(text) as text_sha, coalesce(record_id,'') || ':' || substr(sha256(text), 1, 24) as short_id from records where text is not null")
def content_digests(spark, d):
    r = table(spark, d, "records").where(F.col("text").isNotNull())
    return r.select("rid", X.sha(records.search_text()).alias("search_sha"), X.sha(F.col("text")).alias("text_sha"), X.short_id(F.coalesce("record_id", F.lit("")), F.col("text")).alias("short_id"))


@query("select collection, language, pair_type, grouping_id(collection, language, pair_type)::bigint as level, count(*) as n from records group by grouping sets ((collection), (language), (pair_type), ())")
def catalog_counts(spark, d):
    return records.catalog_counts(table(spark, d, "records"))


@query("""select collection, collection_title, len(expected_languages)::int as languages_expected, n, unpaired, deletions, splits, collection_title is not null as has_metadata from collections full join
 (select collection, count(*) n, count(*) filter (right_text is null) unpaired, count(*) filter (right_text = '') deletions, list_sort(list(distinct split) filter (coalesce(split,'') <> '')) splits from records group by 1) using (collection)""")
def collection_catalog(spark, d):
    return records.collection_catalog(table(spark, d, "records"), table(spark, d, "collections"))


@query("select record_id, arg_max(rid, (ingested_at, rid)) as rid, count(*) as deliveries, count(distinct license) as licenses from records group by 1")
def latest_delivery(spark, d):
    return records.latest_delivery(table(spark, d, "records"))


@query("select record_id, count(*) as rows, count(distinct (coalesce(text, chr(0)) || chr(31) || coalesce(right_text, chr(0)) || chr(31) || coalesce(license, chr(0)))) as versions from records group by 1 having versions > 1")
def conflicting_ids(spark, d):
    return records.conflicting_ids(table(spark, d, "records"))


@query(f"select sha256({COLLAPSE.of('text')}) as text_hash, count(*) as n, min(rid) as first_key from records where text is not null group by 1 having count(*) > 1")
def dup_groups_normalized_text(spark, d):
    return records.duplicate_groups(table(spark, d, "records"), "rid")


@query("select queue_id, collection, count(*) as copies from enrichment_queue group by 1, 2 having count(*) > 1")
def duplicate_id_check(spark, d):
    return table(spark, d, "enrichment_queue").groupBy("queue_id", "collection").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query("select source_id, arg_min(pair_id, (created_at, pair_id)) as pair_id, min(created_at) as created_at from enrichment_pairs group by 1")
def first_wins_dedup(spark, d):
    p = table(spark, d, "enrichment_pairs")
    return p.groupBy("source_id").agg(F.min(F.struct("created_at", "pair_id")).alias("m")).select("source_id", F.col("m.pair_id").alias("pair_id"), F.col("m.created_at").alias("created_at"))


@query("select record_id as id, text as a, right_text as b, alternatives as \"references\", collection from records")
def text_only_export(spark, d):
    return records.text_export(table(spark, d, "records"))


@query("""select coalesce(r.collection, c.collection) as collection, coalesce(found, 0)::bigint as found, coalesce(expected, 0)::bigint as expected, coalesce(found, 0) = coalesce(expected, 0) as agrees from
 (select collection, count(*) found from records group by 1) r full join (select collection, count(distinct record_id) expected from records group by 1) c on r.collection = c.collection""")
def coverage_vs_expected(spark, d):
    r = table(spark, d, "records")
    return records.coverage(r, r.groupBy("collection").agg(F.countDistinct("record_id").alias("expected")))


@query(f"""select rid, rule from (select rid, unnest(list_filter([case when coalesce(record_id,'')='' then 'empty_id' end, case when coalesce(collection,'')='' then 'empty_collection' end, case when text is null then 'no_left_text' end,
 case when coalesce(pair_type,'')='' then 'no_pair_type' end, case when pair_type='unpaired' and right_text is not null then 'unpaired_with_right' end, case when {STRIP.of("coalesce(language,'')")}='' then 'no_language' end, case when {STRIP.of("coalesce(license,'')")}='' then 'no_license' end, case when len(list_filter(coalesce(alternatives,[]), lambda x: x is null))>0 then 'null_alternative' end], lambda x: x is not null)) as rule from records)""")
def record_violations(spark, d):
    return records.violations(table(spark, d, "records"))


@query("select collection, list_sort(list(distinct coalesce(split, 'none'))) as splits, list_sort(list(distinct pair_type)) as pair_types from records group by 1")
def splits_per_collection(spark, d):
    return table(spark, d, "records").groupBy("collection").agg(F.array_sort(F.collect_set(F.coalesce("split", F.lit("none")))).alias("splits"), F.array_sort(F.collect_set("pair_type")).alias("pair_types"))


# --- scalar functions -------------------------------------------------------------------------------------


@query("""select rid, case when h=0 and l=0 then 'unknown' when h > greatest(20.0, l*0.2) then 'zh' when h > greatest(20.0, l*0.03) then 'mixed' else 'en' end as guessed from
 (select rid, len(regexp_extract_all(text, '[\\x{3400}-\\x{9fff}]')) h, len(regexp_extract_all(text, '[A-Za-z]')) l from records where text is not null)""")
def language_heuristic(spark, d):
    return table(spark, d, "records").where(F.col("text").isNotNull()).select("rid", X.script_language(F.col("text")).alias("guessed"))


@query(f"select rid, length({COLLAPSE.of('text')}) as collapsed, length(regexp_replace(text, '{B}+', '', 'g')) as solid, strlen(text) + 4096 as token_bound, least(60000, greatest(4096, strlen(text) * 2)) as output_cap from records where text is not null")
def text_bounds(spark, d):
    t = F.col("text")
    return table(spark, d, "records").where(t.isNotNull()).select("rid", F.length(X.collapse(t)).cast("long").alias("collapsed"), F.length(X.without_blanks(t)).cast("long").alias("solid"), X.token_bound(t).cast("long").alias("token_bound"), X.output_cap(t).cast("long").alias("output_cap"))


@query("select rid, case when instr(title, ':')>0 then substr(title, 1, instr(title, ':')-1) else '' end as head, case when instr(title, ':')>0 then regexp_replace(substr(title, instr(title, ':')+1), '^ ', '') else title end as tail from records where title is not null")
def title_partition(spark, d):
    head, tail = X.partition_at(F.col("title"))
    return table(spark, d, "records").where(F.col("title").isNotNull()).select("rid", head.alias("head"), tail.alias("tail"))


@query("select distinct pair_id, 'v3:' || replace(regexp_extract(model, '^(?:[^/]*/)?(.*)$', 1), '.', '') || ':' || substr(sha256(queue_id), 1, 24) as made_id from enrichment_pairs where queue_id is not null and model is not null")
def pair_ids(spark, d):
    p = table(spark, d, "enrichment_pairs").where("queue_id is not null and model is not null")
    return p.select("pair_id", enrichment.pair_id("v3", F.col("model"), F.col("queue_id")).alias("made_id")).distinct()


@query("select rid, len(regexp_extract_all(text, '</?[A-Za-z][A-Za-z0-9]*')) as tags, len(regexp_extract_all(text, '&[A-Za-z#0-9]+;')) as entities from records where regexp_matches(text, '</?[A-Za-z][A-Za-z0-9]*') or regexp_matches(text, '&[A-Za-z#0-9]+;')")
def detect_html_tags(spark, d):
    t = F.col("text")
    x = table(spark, d, "records").select("rid", X.count(t, "</?[A-Za-z][A-Za-z0-9]*").cast("long").alias("tags"), X.count(t, "&[A-Za-z#0-9]+;").cast("long").alias("entities"))
    return x.where((F.col("tags") > 0) | (F.col("entities") > 0))


@query("select rid, sha256(regexp_replace(text, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<!--.*?-->', '', 'g')) as h from records where text is not null")
def strip_script_style(spark, d):
    t = F.regexp_replace("text", r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", "")
    return table(spark, d, "records").where(F.col("text").isNotNull()).select("rid", X.sha(t).alias("h"))


_SAFE = "lower(regexp_replace(outcome, '(?i)sk-[a-z0-9_-]+', '[REDACTED]', 'g'))"
_LABELS = "list_filter([" + ", ".join(f"case when regexp_matches({_SAFE}, '{p}') then '{k}' end" for k, p in X.ERROR_LABELS) + "], lambda x: x is not null)"


@query(f"select entry_id, case when len(found) > 0 then found else ['unclassified_provider_error'] end as found from (select entry_id, {_LABELS} as found from ledger_entries where outcome is not null)")
def ledger_outcome_labels(spark, d):
    return table(spark, d, "ledger_entries").where(F.col("outcome").isNotNull()).select("entry_id", X.error_labels(F.col("outcome")).alias("found"))


# --- search -----------------------------------------------------------------------------------------------


def _contains(word: str) -> str:
    return f"instr({LINE.of(SEARCH)}, ' {word} ') > 0"


@query(f"select rid from records where {_contains('annual')} and {_contains('budget')}")
def search_all_terms(spark, d):
    return search.filtered(table(spark, d, "records"), search.Query(q="budget annual")).select("rid")


@query(f"select rid from records where {_contains('field diary')}")
def search_phrase(spark, d):
    return search.filtered(table(spark, d, "records"), search.Query(q="field_diary")).select("rid")


@query(f"select rid from records where instr({SEARCH}, '博物馆') > 0")
def search_substring(spark, d):
    return search.filtered(table(spark, d, "records"), search.Query(q=" 博物馆 ")).select("rid")


@query(f"select rid, count(*) over () as total from records where language='en' and pair_type='rewrite' and instr({SEARCH}, 'ferry') > 0 and {_contains('ferry')} order by rid limit 20 offset 40")
def page_with_total(spark, d):
    q = search.Query(q="ferry", language="en", pair_type="rewrite", offset=40, limit=20)
    total, rows = search.page(table(spark, d, "records").withColumn("content_hash", _digest()), q)
    return rows.select("rid", F.lit(total).cast("long").alias("total"))


@query(f"select token, count(*) as rows from (select distinct rid, unnest(list_filter(string_split_regex({FOLD.of(SEARCH)}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) as token from records) group by 1")
def inverted_index(spark, d):
    return search.inverted(table(spark, d, "records")).groupBy("token").agg(F.count(F.lit(1)).alias("rows"))


@query(f"select rid from records where {_contains('rail')} and {_contains('depot')}")
def index_lookup(spark, d):
    return search.lookup(search.inverted(table(spark, d, "records")), ["rail", "depot"])


@query(f"select rid from records where {_contains('telegrafo')} or {_contains('bibliotheque')}")
def search_folded(spark, d):
    t = records.search_text()
    return table(spark, d, "records").where(search.has_terms(t, "Telégrafo") | search.has_terms(t, "BIBLIOTHÈQUE")).select("rid")


def _reviewed(spark, d, which: str) -> DataFrame:
    r = table(spark, d, "records").withColumn("content_hash", _digest())
    return search.filtered(r, search.Query(review_filter=which), _reviews(spark, d)).select("rid")


@query(f"select rid from records r where exists (select 1 from {REVIEWS} v where v.id=r.record_id and v.content_hash={DIGEST})")
def reviewed_semi(spark, d):
    return _reviewed(spark, d, "reviewed")


@query(f"select rid from records r where not exists (select 1 from {REVIEWS} v where v.id=r.record_id and v.content_hash={DIGEST})")
def unreviewed_anti(spark, d):
    return _reviewed(spark, d, "unreviewed")


@query(f"select rid from records r where exists (select 1 from {REVIEWS} v where v.id=r.record_id and v.content_hash={DIGEST} and v.decision='keep')")
def review_keep(spark, d):
    return _reviewed(spark, d, "keep")


# --- gate and audit -----------------------------------------------------------------------------------------


def _gated(spark, d) -> DataFrame:
    return gate.gate(_joined(spark, d), F.lit(True), F.col("selected_source_text"), F.col("text"), F.col("normalization_warnings"))


WHY = f"""case when text is null then []::varchar[] else list_sort(list_distinct(list_concat(list_filter([case when {STRIP.of('selected_source_text')}='' or {STRIP.of('text')}='' then 'empty_rewrite_side' end,
 case when selected_source_text=text then 'identical_text_no_style_contrast' end, case when length(selected_source_text)>1000 and length(text)::double/greatest(length(selected_source_text),1)<0.2 then 'extreme_compression_review_required' end], lambda x: x is not null),
 list_filter(coalesce(normalization_warnings, []), lambda x: x <> 'image_removed_review_surrounding_references')))) end"""
GATED = f"(select pair_id, collection, reasons, case when text is null then 'archive_only' when len(reasons)>0 then 'quarantined' else 'review_candidate' end as quality_status from (select p.*, q.collection, {WHY} as reasons from {PAIRS} p join {QUEUE} q using (queue_id)))"


@query(f"select pair_id, reasons, quality_status from {GATED}")
def quality_gate(spark, d):
    return _gated(spark, d).select("pair_id", "reasons", "quality_status")


@query(f"select collection, count(*) filter (quality_status='quarantined') as quarantined, count(*) filter (quality_status='review_candidate') as review_candidate, count(*) filter (quality_status='archive_only') as archive_only from {GATED} group by 1")
def status_counts(spark, d):
    return gate.status_counts(_gated(spark, d))


@query(f"select reason, count(*) as n from (select unnest(reasons) as reason from {GATED}) group by 1")
def gate_reason_counts(spark, d):
    return gate.reason_counts(_gated(spark, d))


@query(f"select count(*) as scanned, count(*) filter (len(reasons)>0) as flagged, count(*) filter (list_contains(reasons, 'empty_rewrite_side')) as became_empty from {GATED}")
def flag_totals(spark, d):
    return gate.flag_totals(_gated(spark, d))


@query("select w as warning, count(*) as n from (select unnest(normalization_warnings) as w from (select distinct pair_id, normalization_warnings from enrichment_pairs)) group by 1")
def warning_explode_counts(spark, d):
    p = table(spark, d, "enrichment_pairs").select("pair_id", "normalization_warnings").dropDuplicates()
    return p.select(F.explode("normalization_warnings").alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


# --- sampling -----------------------------------------------------------------------------------------------

SEED = "loom-1"


@query(f"""select rid, stratum, round from (select rid, stratum, row_number() over (partition by stratum order by score, rid) as round from (select rid, lower(trim(coalesce(domain,''))) as stratum, sha256('{SEED}' || chr(0) || rid::varchar) as score from records))
 where round <= 200 order by round, stratum limit 200""")
def stratified_round_robin(spark, d):
    r = table(spark, d, "records").select("rid", F.lower(F.trim(F.coalesce("domain", F.lit("")))).alias("stratum"))
    return sampling.round_robin(r, "rid", "stratum", 200, SEED).select("rid", "stratum", "round")


@query(f"select rid, sha256('{SEED}' || chr(0) || record_id) as score from records order by score, rid limit 100")
def seeded_score_topk(spark, d):
    return table(spark, d, "records").select("rid", X.seeded_score(SEED, F.col("record_id")).alias("score")).orderBy("score", "rid").limit(100)


@query(f"""select rid, place::int as place, refs[place + 1] as reference from (select rid, refs, ('0x' || substr(sha256('{SEED}' || chr(0) || record_id), 1, 8))::bigint % len(refs) as place from
 (select rid, record_id, list_filter(coalesce(alternatives, []), lambda t: length({STRIP.of('t')}) >= 1) as refs from records) where len(refs) > 0)""")
def pick_reference(spark, d):
    return sampling.pick_reference(table(spark, d, "records"), SEED)


@query("select collection, min(selected_source_chars) as selected_source_chars, arg_min(queue_id, (selected_source_chars, queue_id)) as queue_id from enrichment_queue where selected_source_chars is not null group by 1")
def shortest_per_collection(spark, d):
    return sampling.shortest_by(table(spark, d, "enrichment_queue").where("selected_source_chars is not null"), "collection", "selected_source_chars", "queue_id")


@query()
def greedy_dedup_queue(spark, d):
    r = table(spark, d, "records").where(F.col("text").isNotNull())
    # one record per document where the records are revisions of whole documents; a missing document counts as one
    document = F.when(F.col("collection") == "news-revision", F.coalesce("source_doc_id", F.lit("")))
    c = r.select(F.col("rid").alias("place"), "record_id", X.sha(X.collapse(F.coalesce("right_text", "text"))).alias("selected_hash"), X.sha(X.collapse(F.col("text"))).alias("original_hash"), document.alias("doc_id"))
    return sampling.greedy_queue(c)


DIMENSIONS = ("sampling_group", "split", "collection", "source_language", "target_language", "authorship_status", "existing_pair_type")


@query(f"""select d.k as dimension, d.v as value, count(*) as n, sum(selected_source_chars)::bigint as chars, count(distinct source_id) as sources, count(distinct selected_source_text) as texts from
 (select *, unnest([{", ".join(f"{{'k': '{x}', 'v': coalesce({x}, 'none')}}" for x in DIMENSIONS)}]) as d from enrichment_queue) group by 1, 2""")
def queue_counts(spark, d):
    q = table(spark, d, "enrichment_queue")
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("dimension"), F.coalesce(x, F.lit("none")).alias("value")) for x in DIMENSIONS]))
    x = q.select("selected_source_chars", "source_id", "selected_source_text", each.alias("d")).select("*", "d.*")
    return x.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("selected_source_chars").cast("long").alias("chars"), F.countDistinct("source_id").alias("sources"), F.countDistinct("selected_source_text").alias("texts"))


# --- enrichment -----------------------------------------------------------------------------------------------

NUMS = Part("list_sort(list_distinct(regexp_extract_all(@@, '(?:^|[^\\p{L}\\p{N}_])(\\d+(?:[.,]\\d+)*(?:%)?)', 1)))")


@query(f"""select pair_id, list_filter(na, lambda x: not list_contains(nb, x)) as numbers_missing, list_filter(nb, lambda x: not list_contains(na, x)) as numbers_added, list_filter([case when len(list_filter(na, lambda x: not list_contains(nb, x)))>0 then 'literal_numbers_missing_or_reformatted' end,
 case when len(list_filter(nb, lambda x: not list_contains(na, x)))>0 then 'literal_numbers_added_or_reformatted' end, case when ratio<0.4 then 'substantial_compression_check_omissions' end, case when ratio>2 then 'substantial_expansion_check_additions' end,
 case when unresolved>0 then 'writer_reported_unresolved_or_issues' end], lambda x: x is not null) as flags from (select pair_id, {NUMS.of('selected_source_text')} na, {NUMS.of('text')} nb, length(text)::double/greatest(length(selected_source_text),1) ratio, coalesce(len(unresolved_claim_ids),0) unresolved
 from {PAIRS} p join {QUEUE} q using (queue_id) where text is not null)""")
def number_set_diff(spark, d):
    j = _joined(spark, d).where(F.col("text").isNotNull())
    x = enrichment.diagnostics(j.select("pair_id", F.col("selected_source_text").alias("source"), "text", F.col("unresolved_claim_ids").alias("unresolved")))
    return x.select("pair_id", "numbers_missing", "numbers_added", "flags")


@query()
def unit_segmentation(spark, d):
    return enrichment.units(table(spark, d, "documents"), "doc_id", "text")


@query("""select q.queue_id, q.collection, coalesce(f.failures, []) as failures from (select distinct queue_id, collection from enrichment_queue) q left join
 (select p.queue_id, list_sort(list(distinct outcome) filter (outcome is not null)) failures from (select * from ledger_entries where entry_state <> 'settled') l join (select distinct pair_id, queue_id from enrichment_pairs) p using (pair_id) group by 1) f using (queue_id)
 where not exists (select 1 from enrichment_pairs p where p.queue_id = q.queue_id and p.text is not null)""")
def uncovered_targets(spark, d):
    return enrichment.uncovered(table(spark, d, "enrichment_queue"), table(spark, d, "enrichment_pairs"), table(spark, d, "ledger_entries"))


@query("""select pair_id, model, case when rn = 1 then marks end as marks from (select *, row_number() over (partition by queue_id order by created_at, pair_id) rn from (select distinct pair_id, queue_id, model, created_at from enrichment_pairs)) p
 left join (select queue_id, list_sort(list(collection)) marks from (select distinct queue_id, collection from enrichment_queue) group by 1) using (queue_id)""")
def attach_first_match(spark, d):
    p = table(spark, d, "enrichment_pairs").select("pair_id", "queue_id", "model", "created_at").dropDuplicates()
    q = table(spark, d, "enrichment_queue").select("queue_id", "collection").dropDuplicates()
    return enrichment.attach_first(p, q, ["queue_id"], ["created_at", "pair_id"], "collection").select("pair_id", "model", "marks")


@query("select queue_id, list_sort(list(model)) as models, count(*) as answers from (select distinct pair_id, queue_id, model from enrichment_pairs) group by 1")
def collect_annotations(spark, d):
    p = table(spark, d, "enrichment_pairs").select("pair_id", "queue_id", "model").dropDuplicates()
    return p.groupBy("queue_id").agg(F.array_sort(F.collect_list("model")).alias("models"), F.count(F.lit(1)).alias("answers"))


@query("select p.pair_id, r.n as deliveries from (select distinct pair_id, source_id from enrichment_pairs) p left join (select record_id, count(*) n from records group by 1) r on p.source_id = r.record_id where r.n is null or r.n > 1")
def referential_check(spark, d):
    p = table(spark, d, "enrichment_pairs").select("pair_id", "source_id").dropDuplicates()
    r = table(spark, d, "records").groupBy("record_id").agg(F.count(F.lit(1)).alias("deliveries"))
    return p.join(r, p.source_id == r.record_id, "left").where("deliveries is null or deliveries > 1").select("pair_id", "deliveries")


@query("select distinct pair_id, len(list_distinct(claim_ids)) as claims, len(claim_ids) - len(list_distinct(claim_ids)) as repeats, list_sort(list_filter(list_distinct(coalesce(unresolved_claim_ids, [])), lambda x: not list_contains(claim_ids, x))) as unknown from enrichment_pairs where claim_ids is not null")
def claim_set_checks(spark, d):
    p = table(spark, d, "enrichment_pairs").where("claim_ids is not null")
    none = F.array().cast("array<string>")
    return p.select("pair_id", F.size(F.array_distinct("claim_ids")).cast("long").alias("claims"), (F.size("claim_ids") - F.size(F.array_distinct("claim_ids"))).cast("long").alias("repeats"), F.array_sort(F.array_except(F.coalesce("unresolved_claim_ids", none), F.col("claim_ids"))).alias("unknown")).distinct()


@query(f"""select distinct pair_id, list_filter([case when coalesce({STRIP.of('text')}, '') = '' then 'empty_writing' end, case when len(list_distinct(coalesce(claim_ids, []))) < len(coalesce(claim_ids, [])) then 'repeated_claim_id' end,
 case when len(list_filter(coalesce(unresolved_claim_ids, []), lambda x: not list_contains(coalesce(claim_ids, []), x))) > 0 then 'unknown_unresolved' end,
 case when len(list_filter(coalesce(claim_ids, []), lambda x: instr(coalesce(text, ''), x) > 0)) > 0 then 'claim_id_in_text' end], lambda x: x is not null) as problems from enrichment_pairs""")
def writing_validation(spark, d):
    return enrichment.writing_problems(table(spark, d, "enrichment_pairs")).distinct()


@query()
def seeded_shuffle(spark, d):
    p = table(spark, d, "enrichment_pairs").select("pair_id", "claim_ids").dropDuplicates()
    return enrichment.shuffled(p, "pair_id", "claim_ids", SEED)


@query()
def claim_packets(spark, d):
    docs = packets.claim_documents(table(spark, d, "enrichment_pairs"))
    return packets.checked(docs, "pair_id", "raw", SEED).select("pair_id", "problems", F.length("packet").alias("packet_chars"))


def _flags(spark, d) -> DataFrame:
    """Review flags bound to an output by pair, model and the digest of its text."""
    p = table(spark, d, "enrichment_pairs").where("text is not null and unresolved_claim_ids is not null").select("pair_id", "model", X.sha(F.col("text")).alias("text_sha"), F.when(F.size("unresolved_claim_ids") > 0, "unresolved").otherwise("resolved").alias("status"))
    return p.groupBy("pair_id", "model", "text_sha").agg(F.min("status").alias("status"))


FLAGS = "(select pair_id, model, sha256(text) text_sha, min(case when len(unresolved_claim_ids)>0 then 'unresolved' else 'resolved' end) status from enrichment_pairs where text is not null and unresolved_claim_ids is not null group by all)"


@query(f"select o.pair_id, o.model, o.text_sha, f.status from (select distinct pair_id, model, sha256(text) text_sha from enrichment_pairs where text is not null) o left join {FLAGS} f using (pair_id, model, text_sha)")
def qa_flag_attach(spark, d):
    o = table(spark, d, "enrichment_pairs").where("text is not null").select("pair_id", "model", X.sha(F.col("text")).alias("text_sha")).distinct()
    return audit.attach_flags(o, _flags(spark, d), ["pair_id", "model", "text_sha"])


FIRST = "(select queue_id, arg_min(pair_id, (created_at, pair_id)) pair_id from enrichment_pairs where text is not null group by 1)"


@query(f"select pair_id, model, text_sha, status from {FLAGS} f where pair_id not in (select pair_id from {FIRST})")
def unused_flags(spark, d):
    """Flags whose output is not the first answer to its queue row, the one that is put out."""
    p = table(spark, d, "enrichment_pairs").where("text is not null")
    first = p.groupBy("queue_id").agg(F.min_by("pair_id", F.struct("created_at", "pair_id")).alias("pair_id")).select("pair_id")
    o = p.join(first, "pair_id", "left_semi").select("pair_id", "model", X.sha(F.col("text")).alias("text_sha"))
    return audit.unused_flags(o, _flags(spark, d), ["pair_id", "model", "text_sha"])


@query("select coalesce(a.id, b.id) as id, case when b.id is null then 'first' else 'second' end as only_in from (select distinct source_id id from enrichment_queue) a full join (select distinct source_id id from enrichment_pairs) b on a.id = b.id where a.id is null or b.id is null")
def view_key_parity(spark, d):
    q, p = table(spark, d, "enrichment_queue"), table(spark, d, "enrichment_pairs")
    return audit.key_parity(q.select(F.col("source_id").alias("id")), p.select(F.col("source_id").alias("id")), "id")


@query("""(select queue_id, target_language, 'first' as more_in from (select queue_id, target_language from enrichment_queue except all select distinct queue_id, target_language from enrichment_queue))""")
def repeat_differences(spark, d):
    q = table(spark, d, "enrichment_queue").select("queue_id", "target_language")
    return audit.differences(q, q.distinct())


@query("""select coalesce(a.queue_id, b.queue_id) as queue_id, coalesce(a.place, b.place) as place, a.x as first, b.x as second, case when a.x is null or b.x is null then 'unequal_length' end as error from
 (select queue_id, row_number() over (partition by queue_id order by pair_id) place, pair_id x from (select distinct queue_id, pair_id from enrichment_pairs where model like 'plume%' or model like '%/plume%')) a full join
 (select queue_id, row_number() over (partition by queue_id order by pair_id) place, pair_id x from (select distinct queue_id, pair_id from enrichment_pairs where not (model like 'plume%' or model like '%/plume%'))) b on a.queue_id=b.queue_id and a.place=b.place""")
def positional_zip(spark, d):
    p = table(spark, d, "enrichment_pairs").select("queue_id", "pair_id", "model").dropDuplicates()
    plume = F.col("model").like("plume%") | F.col("model").like("%/plume%")
    return audit.zipped(p.where(plume).drop("model"), p.where(~plume).drop("model"), "queue_id", "pair_id")


@query(f"""select rid from records where lower(trim(domain)) in ('news', 'wiki') and length(text) between 200 and 1200 and (right_text is null or {COLLAPSE.of('text')} <> {COLLAPSE.of('right_text')})""")
def eligible_candidates(spark, d):
    return audit.eligible(table(spark, d, "records"), F.array().cast("array<string>"), ("news", "wiki"), 200, 1200).select("rid")


@query("select l.entry_id, p.pair_id, l.model = p.model as same_model, l.entry_state = 'settled' and l.actual_usd <= l.reserved_usd as within_bound from ledger_entries l join (select distinct pair_id, model from enrichment_pairs) p using (pair_id)")
def ledger_call_match(spark, d):
    p = table(spark, d, "enrichment_pairs").select("pair_id", F.col("model").alias("pair_model")).dropDuplicates()
    x = table(spark, d, "ledger_entries").join(p, "pair_id")
    return x.select("entry_id", "pair_id", (F.col("model") == F.col("pair_model")).alias("same_model"), ((F.col("entry_state") == "settled") & (F.col("actual_usd") <= F.col("reserved_usd"))).alias("within_bound"))


# --- ledger -----------------------------------------------------------------------------------------------


AMOUNT = "case when entry_state='settled' then actual_usd else coalesce(held_usd, reserved_usd) end"


@query(f"""select model, count(*) as calls, coalesce(sum(actual_usd) filter (entry_state='settled'),0)::decimal(28,8) as spent_usd, coalesce(sum({AMOUNT}) filter (entry_state<>'settled'),0)::decimal(28,8) as held_usd,
 count(*) filter (entry_state='pending') as pending, count(*) filter (entry_state='settled') as settled, count(*) filter (entry_state='unknown') as unknown from ledger_entries group by 1""")
def ledger_spend(spark, d):
    return ledger.spend(table(spark, d, "ledger_entries"), "model")


@query(f"select entry_id, model, ({AMOUNT})::decimal(18,8) as amount, (sum({AMOUNT}) over (partition by model order by created_at_unix, entry_id rows unbounded preceding))::decimal(28,8) as exposure_usd from ledger_entries")
def ledger_running_exposure(spark, d):
    return ledger.running(table(spark, d, "ledger_entries"))


@query(f"""select entry_id, model, case when halted=1 then 'halted' when calls >= 500 then 'call_cap' when before + reserved_usd > 0.5 then 'over_budget' else 'granted' end as decision from (select entry_id, model, reserved_usd,
 coalesce(sum({AMOUNT}) over w, 0) before, count(*) over w calls, coalesce(max(case when entry_state='unknown' then 1 else 0 end) over w, 0) halted from ledger_entries window w as (partition by model order by created_at_unix, entry_id rows between unbounded preceding and 1 preceding))""")
def budget_replay(spark, d):
    return ledger.replay(table(spark, d, "ledger_entries"), "0.5", 500)


# --- ingest and streams -------------------------------------------------------------------------------------


@query(f"""with h as (select record_id, {DIGEST} as d, ingested_at < timestamp '2024-07-01' as early from records), base as (select distinct record_id, d from h where early), batch as (select record_id, count(distinct d) v, min(d) d from h where not early or early is null group by 1)
 select record_id, case when v > 1 or (record_id in (select record_id from base) and (record_id, d) not in (select record_id, d from base)) then 'conflict' when record_id in (select record_id from base) then 'skip' else 'insert' end as action from batch""")
def incremental_ingest(spark, d):
    r = table(spark, d, "records").select("record_id", "ingested_at", _digest().alias("d"))
    early = F.coalesce(F.col("ingested_at") < F.lit("2024-07-01").cast("timestamp_ntz"), F.lit(False))
    return ingest.classify(r.where(early).select("record_id", "d"), r.where(~early).select("record_id", "d"), "record_id", "d")


@query("select event_type, date_trunc('hour', ts) as hour, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


# --- cleaning -------------------------------------------------------------------------------------------------


@query()
def clean_documents_full(spark, d):
    r = cleaning.cleaned(table(spark, d, "records", spread=True))
    return r.select("rid", F.col("left_result.text").alias("clean_text"), F.map_keys("left_result.actions").alias("left_actions"), F.col("left_result.warnings").alias("left_warnings"), F.length("right_result.text").alias("right_chars"))


@query()
def clean_action_totals(spark, d):
    r = cleaning.cleaned(table(spark, d, "records", spread=True))
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(f"{name}_result.actions").alias("actions"))
    x = r.select(F.explode(F.array(side("left"), side("right"))).alias("s")).select("s.side", F.explode("s.actions").alias("action", "k"))
    return x.groupBy("side", "action").agg(F.sum("k").alias("n"))


@query()
def cleaning_length_effect(spark, d):
    """Lengths before and after the cleaning operator, by collection and side."""
    r = cleaning.cleaned(table(spark, d, "records", spread=True))
    side = lambda name, raw: F.struct(F.lit(name).alias("side"), F.length(raw).cast("long").alias("raw"), F.length(f"{name}_result.text").cast("long").alias("clean"))
    x = r.select("collection", F.explode(F.array(side("left", "text"), side("right", "right_text"))).alias("s")).select("collection", "s.*").where("raw is not null")
    return x.groupBy("collection", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("raw_total"), F.sum("clean").alias("clean_total"), F.count_if(F.col("raw") != F.col("clean")).alias("rows_changed"))


@query("""select rid, sha256(regexp_replace(trim(regexp_replace(text, '[\\t \\f\\v\\x{a0}\\x{202f}]+', ' ', 'g')), '([A-Za-z\\x{3400}-\\x{9fff}\\])"''”’]) +([,;:!?，。；：！？、])', '\\1\\2', 'g')) as h from records
 where text is not null and not regexp_matches(text, '[\\r\\n<>&*_~`\\[\\]$\\\\]') and not contains(text, ' .')""")
def clean_prose_fast(spark, d):
    t = F.col("text")
    r = table(spark, d, "records").where(t.isNotNull() & ~t.rlike(r"[\r\n<>&*_~`\[\]$\\]") & ~t.contains(" ."))
    return r.select("rid", X.sha(cleaning.prose_expression(t)).alias("h"))


@query()
def clean_idempotence(spark, d):
    return audit.not_idempotent(table(spark, d, "records", spread=True))


@query()
def clean_audit(spark, d):
    a = audit.audit_rows(table(spark, d, "records", spread=True), audit.rules_fingerprint())
    return a.select("rid", "side", "raw_sha", "clean_sha", "raw_chars", "clean_chars", F.size("result.removed").alias("removed"), F.size("result.warnings").alias("warnings"), "rules")


from . import checks, exchange  # noqa: E402, F401  they add their queries
