"""Problem 9: a mix of sources by weight of tokens, as a curriculum over training positions.

A source's weight may change over the training; its schedule is integrated to a cumulative token demand,
whose inverse gives every document the position at which its tokens are due.  Documents are then
range-sorted by position.  Cumulative tokens within a source come from a histogram of fixed size over random
keys, so that no source is ever summed or sorted in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import held
from . import tokens as T

BINS, LEAN = 1 << 12, 0.5


def fill(weights: list[float], capacity: list[float], total: float) -> list[float]:
    """Demands by weight, none over capacity; what a short source leaves goes to the others by weight."""
    got = [0.0] * len(weights)
    free = [i for i, (w, c) in enumerate(zip(weights, capacity)) if w > 0 and c > 0]
    rest = total
    while free and rest > 1e-9:
        w = sum(weights[i] for i in free)
        short = [i for i in free if rest * weights[i] / w >= capacity[i]]
        if not short:
            for i in free:
                got[i] = rest * weights[i] / w
            return got
        for i in short:
            got[i] = capacity[i]
            rest -= capacity[i]
        free = [i for i in free if i not in short]
    return got


def stretches(knots: list[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """The schedule through the knots (time, weight) as stretches (t0, t1, w0, w1, c0) of straight lines over [0, 1], with its
    integral c0 up to each; weights are scaled so that the whole integral is 1."""
    k = sorted((min(max(t, 0.0), 1.0), max(w, 0.0)) for t, w in knots) or [(0.0, 1.0)]
    k = [(0.0, k[0][1])] * (k[0][0] > 0) + k + [(1.0, k[-1][1])] * (k[-1][0] < 1)
    lines = [(t0, t1, w0, w1) for (t0, w0), (t1, w1) in zip(k, k[1:]) if t1 > t0]
    whole = sum((t1 - t0) * (w0 + w1) / 2 for t0, t1, w0, w1 in lines)
    if whole <= 0:
        return [(0.0, 1.0, 1.0, 1.0, 0.0)]
    out, c = [], 0.0
    for t0, t1, w0, w1 in lines:
        out.append((t0, t1, w0 / whole, w1 / whole, c))
        c += (t1 - t0) * (w0 + w1) / 2 / whole
    return out


STRETCH = "array<struct<t0: double, t1: double, w0: double, w1: double, c0: double>>"


def demands(targets: DataFrame, sources: DataFrame, schedule: DataFrame | None = None) -> DataFrame:
    """(mix_id, source, target_weight, max_repeats, source_tokens, wanted_tokens, demand_tokens, schedule).

    A source's weight over the training follows the knots of schedule (mix_id, source, at in [0, 1], weight), straight
    between them.  A source without knots is tilted from weight * (1 - lean) to weight * (1 + lean): sources that repeat
    come later, the others sooner, so that the leans of a mix cancel out at every moment.
    """
    s = sources.select("source", F.col("source_tokens").cast("double").alias("source_tokens"))
    all_tokens = float(sources.agg(F.sum("source_tokens")).first()[0] or 0)
    t = targets.select("mix_id", "source", F.col("target_weight").cast("double").alias("target_weight"), F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(0)).cast("int").alias("max_repeats"), F.col("total_share").cast("double").alias("total_share"))
    t = t.dropDuplicates(["mix_id", "source"]).join(s, "source", "left")
    if schedule is None:
        t = t.withColumn("knots", F.array().cast("array<struct<at: double, weight: double>>"))
    else:
        k = schedule.groupBy("mix_id", "source").agg(F.array_sort(F.collect_list(F.struct(F.col("at").cast("double").alias("at"), F.col("weight").cast("double").alias("weight")))).alias("knots"))
        t = t.join(k, ["mix_id", "source"], "left")

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("source").reset_index(drop=True)
        size = g.source_tokens.fillna(0.0).tolist()
        total = float(g.total_share[0] * all_tokens)
        w = g.target_weight.fillna(0.0).tolist()
        w = [x / max(sum(w), 1e-12) for x in w]
        d = fill(w, [a * b for a, b in zip(size, g.max_repeats)], total)
        knots = [[(k["at"], k["weight"]) for k in x if k["at"] is not None and k["weight"] is not None] if x is not None else [] for x in g.knots]
        late = [x > y > 0 for x, y in zip(d, size)]
        a, b = sum(x for x, l in zip(d, late) if l), sum(x for x, l in zip(d, late) if not l)
        lean = [(LEAN * min(1, b / a) if l else -LEAN * min(1, a / b)) if a and b else 0.0 for l in late]
        plan = [[dict(zip(("t0", "t1", "w0", "w1", "c0"), x)) for x in stretches(k or [(0.0, 1 - e), (1.0, 1 + e)])] for k, e in zip(knots, lean)]
        return pd.DataFrame({"mix_id": g.mix_id, "source": g.source, "target_weight": w, "max_repeats": g.max_repeats, "source_tokens": [int(x) for x in size], "wanted_tokens": [x * total for x in w], "demand_tokens": d, "schedule": plan})

    return t.groupBy("mix_id").applyInPandas(one, f"mix_id string, source string, target_weight double, max_repeats int, source_tokens long, wanted_tokens double, demand_tokens double, schedule {STRETCH}")


def position(done: Column, demand: Column, schedule: Column) -> Column:
    """The time in [0, 1] at which the integral of the schedule reaches the share done of the demand."""
    x = F.least(F.try_divide(done, demand), F.lit(1.0))
    s = F.element_at(F.filter(schedule, lambda s: s.c0 <= x + 1e-12), -1)
    rest = F.greatest(x - s.c0, F.lit(0.0))
    slope = (s.w1 - s.w0) / (s.t1 - s.t0)
    root = F.sqrt(F.greatest(s.w0 * s.w0 + 2 * slope * rest, F.lit(0.0)))
    return F.least(s.t0 + F.coalesce(F.try_divide(2 * rest, s.w0 + root), F.lit(0.0)), s.t1)


def with_prefix(docs: DataFrame, key: str, seed: int) -> DataFrame:
    """docs (key, source, tokens) with the tokens of their source that come before them in random order."""
    d = docs.withColumn("draw", F.xxhash64(F.lit(seed), F.col(key))).withColumn("bin", F.shiftrightunsigned(F.col("draw"), 52))
    bins = d.groupBy("source", "bin").agg(F.sum("tokens").alias("k"))
    bins = bins.select("source", "bin", (F.sum("k").over(Window.partitionBy("source").orderBy("bin")) - F.col("k")).alias("base"))
    inner = F.sum("tokens").over(Window.partitionBy("source", "bin").orderBy("draw", key).rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    return d.withColumn("inner", inner).join(bins, ["source", "bin"]).select(key, "source", "tokens", (F.col("base") + F.col("inner")).alias("before"))


def _sized(docs: DataFrame, key: str, path: str) -> DataFrame:
    return held(T.sized(docs, key, ("source",), path).where("tokens > 0 and source is not null"))


def _sources(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))


def _placed(docs: DataFrame, targets: DataFrame, key: str, seed: int, schedule: DataFrame | None = None) -> DataFrame:
    need = demands(targets, _sources(docs), schedule).where("demand_tokens > 0 and source_tokens > 0")
    x = with_prefix(docs, key, seed).join(need, "source")
    passes = F.sequence(F.lit(0), F.least(F.col("max_repeats") - 1, F.floor(F.try_divide(F.col("demand_tokens") - F.col("before") - 1e-6, F.col("source_tokens"))).cast("int")))
    x = x.where(F.col("before") < F.col("demand_tokens")).withColumn("repeat", F.explode(passes))
    done = F.col("repeat") * F.col("source_tokens") + F.col("before")
    return x.select("mix_id", key, "source", (F.col("repeat") + 1).cast("int").alias("repeat_no"), "tokens", position(done.cast("double"), F.col("demand_tokens"), F.col("schedule")).alias("position"))


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 9, path: str = T.TOKENIZER, schedule: DataFrame | None = None) -> DataFrame:
    """(mix_id, key, source, repeat_no, tokens, position), range-sorted by mix and position.

    A document is used at most max_repeats times; the last one of a source may overshoot its demand by less
    than itself.  Texts without tokens and of no target source are not used.
    """
    return _placed(_sized(docs, key, path), targets, key, seed, schedule).repartitionByRange("mix_id", "position").sortWithinPartitions("mix_id", "position", key, "repeat_no")


def report(docs: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 9, path: str = T.TOKENIZER) -> DataFrame:
    """(mix_id, source, target_weight, max_repeats, source_tokens, wanted_tokens, reached_tokens, reached_share, shortfall_tokens)."""
    sized = _sized(docs, key, path)
    got = _placed(sized, targets, key, seed).groupBy("mix_id", "source").agg(F.sum("tokens").alias("reached_tokens"))
    x = demands(targets, _sources(sized)).join(got, ["mix_id", "source"], "left").withColumn("reached_tokens", F.coalesce("reached_tokens", F.lit(0)))
    share = F.coalesce(F.try_divide(F.col("reached_tokens"), F.sum("reached_tokens").over(Window.partitionBy("mix_id"))), F.lit(0.0))
    return x.select("mix_id", "source", "target_weight", "max_repeats", "source_tokens", "wanted_tokens", "reached_tokens", share.alias("reached_share"), F.greatest(F.col("wanted_tokens") - F.col("reached_tokens"), F.lit(0.0)).alias("shortfall_tokens"))
