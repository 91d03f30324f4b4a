"""Enrichment data: units of a source, diagnostics of an answer, pairing and coverage."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def split_units(text: str) -> list[str]:
    """Blocks between blank lines; blank lines inside a code fence part nothing."""
    out: list[str] = []
    block: list[str] = []
    closing: re.Pattern | None = None
    for line in text.splitlines():
        if closing is None:
            m = re.match(r"\s{0,3}(`{3,}|~{3,})", line)
            if m:
                closing = re.compile(rf"\s{{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*\Z")
        elif closing.match(line):
            closing = None
        if line.strip() or block and closing is not None:
            block.append(line)
        elif block:
            out.append("\n".join(block))
            block = []
    if block:
        out.append("\n".join(block))
    return out


def units(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, unit, text): the numbered units of each text; null and blank texts have none."""

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split_units(t) if isinstance(t, str) else [])

    x = rows.select(key, F.posexplode(cut(F.col(text))).alias("i", "unit_text"))
    return x.select(key, F.format_string("u%04d", F.col("i") + 1).alias("unit"), "unit_text")


def diagnostics(pairs: DataFrame) -> DataFrame:
    """pairs (pair_id, source, text, unresolved) with numbers lost and gained, the length ratio and review flags."""
    a, b = X.numbers(F.col("source")), X.numbers(F.col("text"))
    ratio = F.length("text") / F.greatest(F.length("source"), F.lit(1))
    x = pairs.select("pair_id", F.array_except(a, b).alias("numbers_missing"), F.array_except(b, a).alias("numbers_added"), ratio.alias("length_ratio"), F.coalesce(F.size("unresolved"), F.lit(0)).alias("unresolved_n"))
    flags = F.array_compact(F.array(
        F.when(F.size("numbers_missing") > 0, F.lit("literal_numbers_missing_or_reformatted")),
        F.when(F.size("numbers_added") > 0, F.lit("literal_numbers_added_or_reformatted")),
        F.when(F.col("length_ratio") < 0.4, F.lit("substantial_compression_check_omissions")),
        F.when(F.col("length_ratio") > 2, F.lit("substantial_expansion_check_additions")),
        F.when(F.col("unresolved_n") > 0, F.lit("writer_reported_unresolved_or_issues")),
    ))
    return x.withColumn("flags", flags)


def pair_id(version: str, model, queue_id):
    return F.concat(F.lit(version + ":"), X.profile_of(model), F.lit(":"), F.substring(X.sha(queue_id), 1, 24))


def uncovered(queue: DataFrame, pairs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Queue rows without an answer text, with the outcomes of the calls that failed for them."""
    q = queue.select("queue_id", "collection").dropDuplicates()
    p = pairs.select("queue_id", "pair_id", F.col("text").isNotNull().alias("has")).dropDuplicates()
    open_rows = q.join(p.where("has"), "queue_id", "left_anti")
    failed = ledger.where("entry_state <> 'settled'").join(p.select("pair_id", "queue_id").dropDuplicates(), "pair_id").groupBy("queue_id").agg(F.array_sort(F.collect_set("outcome")).alias("failures"))
    return open_rows.join(failed, "queue_id", "left").select("queue_id", "collection", F.coalesce("failures", F.array().cast("array<string>")).alias("failures"))


def attach_first(rows: DataFrame, marks: DataFrame, on: list[str], order: list[str], collected: str) -> DataFrame:
    """All marks of a key collected, in order, onto the first row of that key; other rows keep none."""
    from pyspark.sql.window import Window

    all_marks = marks.groupBy(*on).agg(F.array_sort(F.collect_list(collected)).alias("marks"))
    first = F.row_number().over(Window.partitionBy(*on).orderBy(*order)) == 1
    return rows.withColumn("is_first", first).join(all_marks, on, "left").withColumn("marks", F.when(F.col("is_first"), F.col("marks"))).drop("is_first")


def shuffled(rows: DataFrame, key: str, items: str, seed: str) -> DataFrame:
    """(key, items): repeats of an item dropped (first place kept), then in an order seeded by the key."""
    import hashlib
    import random

    @F.pandas_udf("array<string>")
    def order(k: pd.Series, v: pd.Series) -> pd.Series:
        out = []
        for name, values in zip(k, v):
            x = list(dict.fromkeys(values)) if values is not None else None
            if x:
                random.Random(hashlib.sha256(f"{seed}|{name}".encode()).hexdigest()).shuffle(x)
            out.append(x)
        return pd.Series(out)

    return rows.select(key, order(F.col(key), F.col(items)).alias(items))


def writing_problems(pairs: DataFrame) -> DataFrame:
    """(pair_id, problems): rules of an answer's coverage that it breaks; an unresolved claim must be one of its claims,
    none may be listed twice, and no claim id may stand in the text."""
    none = F.array().cast("array<string>")
    ids, left = F.coalesce("claim_ids", none), F.coalesce("unresolved_claim_ids", none)
    rules = {
        "empty_writing": F.coalesce(X.strip(F.col("text")), F.lit("")) == "",
        "repeated_claim_id": F.size(F.array_distinct(ids)) < F.size(ids),
        "unknown_unresolved": F.size(F.array_except(left, ids)) > 0,
        "claim_id_in_text": F.exists(ids, lambda c: F.coalesce(F.instr(F.col("text"), c) > 0, F.lit(False))),
    }
    return pairs.select("pair_id", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])).alias("problems"))


def downgraded(pairs: DataFrame) -> DataFrame:
    """(pair_id, status, unresolved, warnings): an answer that breaks a rule of its coverage keeps its text, but all its claims
    count as unresolved and the rule is added to its warnings."""
    none = F.array().cast("array<string>")
    x = writing_problems(pairs.withColumn("pair_id", F.struct("pair_id", "claim_ids", "unresolved_claim_ids", "normalization_warnings"))).select("pair_id.*", "problems")
    bad = F.size("problems") > 0
    known = F.array_sort(F.array_distinct(F.coalesce("unresolved_claim_ids", none)))
    every = F.array_sort(F.array_union(F.coalesce("claim_ids", none), F.coalesce("unresolved_claim_ids", none)))
    warnings = F.array_sort(F.array_union(F.coalesce("normalization_warnings", none), F.col("problems")))
    return x.select("pair_id", F.when(bad, "unresolved").otherwise("resolved").alias("status"), F.when(bad, every).otherwise(known).alias("unresolved"), warnings.alias("warnings"))


def resume(queue: DataFrame, committed: DataFrame, config: str) -> DataFrame:
    """(queue_id, action) of a run that goes on: skip what is committed under the same configuration, run what is not, and
    name a conflict where a committed row was made under another one.  committed is (queue_id, config)."""
    done = committed.groupBy("queue_id").agg(F.max(F.col("config") == config).alias("same"))
    x = queue.select("queue_id").distinct().join(done, "queue_id", "left")
    return x.select("queue_id", F.when(F.col("same").isNull(), "run").when(F.col("same"), "skip").otherwise("configuration_conflict").alias("action"))
