"""Reproducible sampling: round robin over strata, rotation, and greedy deduplication across a queue."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..session import checkpointed, held


def round_robin(rows: DataFrame, key: str, stratum: str, quota: int, seed: str) -> DataFrame:
    """quota rows, one from each stratum in turn, within a stratum by seeded score.

    Only the first quota rows of a stratum can be drawn, so each stratum is cut to those before the sort.
    """
    s = rows.withColumn("score", X.seeded_score(seed, F.col(key).cast("string"))).withColumn("round", F.row_number().over(Window.partitionBy(stratum).orderBy("score", key)))
    return s.where(F.col("round") <= quota).orderBy("round", stratum).limit(quota)


def pick_reference(records: DataFrame, seed: str, least: int = 1) -> DataFrame:
    """One reference of each record with alternatives, rotated by its seeded score: (rid, side, reference)."""
    refs = F.filter(F.coalesce("alternatives", F.array().cast("array<string>")), lambda t: F.length(X.strip(t)) >= least)
    x = records.select("rid", refs.alias("refs"), X.seeded_score(seed, F.col("record_id")).alias("score")).where(F.size("refs") > 0)
    at = (F.conv(F.substring("score", 1, 8), 16, 10).cast("long") % F.size("refs")).cast("int")
    return x.select("rid", at.alias("place"), F.get("refs", at).alias("reference"))


def shortest_by(rows: DataFrame, group: str, size: str, key: str) -> DataFrame:
    return rows.groupBy(group).agg(F.min(F.struct(size, key)).alias("m")).select(group, F.col(f"m.{size}").alias(size), F.col(f"m.{key}").alias(key))


ROUNDS = 6
REJECTIONS = ("record_id_already_selected", "selected_text_duplicate_across_queue", "original_input_duplicate_across_queue", "document_already_selected", "taken")


def greedy_queue(candidates: DataFrame) -> DataFrame:
    """Accept candidates (place, record_id, selected_hash, original_hash, doc_id) in order of place unless an
    accepted one has the same record, text or document; selected and original texts are compared with both.

    Only candidates that share a key can affect one another, and of those that share one at most one is accepted.
    So in rounds the first of all its keys is accepted and who shares a key with it is settled, however many they
    are; what long chains leave after ROUNDS goes by connected keys, with the loop in each group, over hashes only.
    """
    keys = F.array(F.concat(F.lit("r"), F.col("record_id")), F.concat(F.lit("t"), F.col("selected_hash")), F.concat(F.lit("t"), F.col("original_hash")), F.concat(F.lit("d"), F.col("doc_id")))
    candidates = held(candidates)
    edges = candidates.select("place", F.explode(F.array_distinct(F.array_compact(keys))).alias("k"))
    # a key that occurs once decides nothing
    edges = checkpointed(edges.join(edges.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k"), "k"))
    rest, won = edges, candidates.limit(0).select("place")
    for _ in range(ROUNDS):
        least = rest.groupBy("k").agg(F.min("place").alias("least"))
        first = rest.join(least, "k").groupBy("place").agg(F.min(F.col("place") == F.col("least")).alias("first")).where("first").select("place")
        first = checkpointed(first)
        won = won.union(first)
        taken = rest.join(first, "place").select("k")
        rest = checkpointed(rest.join(rest.join(taken, "k", "left_semi").select("place").distinct(), "place", "left_anti"))
        if rest.isEmpty():
            break
    else:
        left = candidates.join(rest.select("place").distinct(), "place", "left_semi")
        won = won.union(_by_groups(left, rest).where(F.col("outcome") == REJECTIONS[4]).select("place"))
    # each key has one accepted row at most; the first reason that names an earlier one stands
    owner = checkpointed(edges.join(won, "place").select("k", F.col("place").alias("owner")))
    why = F.when(F.col("k") == F.concat(F.lit("r"), F.col("record_id")), 0).when(F.col("k") == F.concat(F.lit("t"), F.col("selected_hash")), 1).when(F.substring("k", 1, 1) == "t", 2).otherwise(3)
    reason = edges.join(owner, "k").where("owner < place").join(candidates.select("place", "record_id", "selected_hash"), "place").groupBy("place").agg(F.min(why).alias("why"))
    outcome = F.get(F.array(*map(F.lit, REJECTIONS)), F.coalesce("why", F.lit(4)))
    return candidates.join(reason, "place", "left").select(F.col("place").cast("long").alias("place"), "record_id", outcome.alias("outcome"))


def _by_groups(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """The same by connected keys (every key occurring once drops out by a count), one Python loop for each group."""
    label = edges.groupBy("k").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    comp = edges.join(label.select("k", "least"), "k").groupBy("place").agg(F.min("least").alias("comp"))
    # min-label rounds over shared keys, as many as the longest chain of shared keys is long; the count of changes ends them
    while True:
        by_key = edges.join(comp, "place").groupBy("k").agg(F.min("comp").alias("c"))
        nxt = edges.join(by_key, "k").groupBy("place").agg(F.min("c").alias("new"))
        step = comp.join(nxt, "place").select("place", F.least("comp", "new").alias("new"), "comp")
        step = checkpointed(step)
        changed = step.where("new < comp").limit(1).count()
        comp = step.select("place", F.col("new").alias("comp"))
        if not changed:
            break
    x = candidates.join(comp, "place", "left").withColumn("comp", F.coalesce("comp", "place"))

    def loop(g: pd.DataFrame) -> pd.DataFrame:
        ids, chosen, originals, docs, out = set(), set(), set(), set(), []
        for r in g.sort_values("place").itertuples():
            if r.record_id in ids:
                why = REJECTIONS[0]
            elif r.selected_hash in chosen or r.selected_hash in originals:
                why = REJECTIONS[1]
            elif r.original_hash in originals or r.original_hash in chosen:
                why = REJECTIONS[2]
            elif r.doc_id is not None and r.doc_id == r.doc_id and r.doc_id in docs:
                why = REJECTIONS[3]
            else:
                why = REJECTIONS[4]
                ids.add(r.record_id)
                chosen.add(r.selected_hash)
                originals.add(r.original_hash)
                docs.add(r.doc_id)
            out.append(why)
        g = g.sort_values("place")
        return pd.DataFrame({"place": g.place, "record_id": g.record_id, "outcome": out})

    return x.groupBy("comp").applyInPandas(loop, "place long, record_id string, outcome string")
