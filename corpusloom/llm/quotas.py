"""Problem 2: a sample of rows whose categories have target proportions.

Counts per category are aggregated first; integer quotas follow by largest remainder with floors and caps;
of each category the rows with the smallest random keys are taken.  The key's leading bits form a histogram
of fixed size, so that only one narrow bin of a category is ever ranked, however large the category is.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 1 << 14
FIELDS = ("collection", "split", "domain")


def largest_remainder(wants: list[float], total: int) -> list[int]:
    """Integers near the wants that sum to total; ties go to the earlier place."""
    base = [int(w) for w in wants]
    order = sorted(range(len(wants)), key=lambda i: (base[i] - wants[i], i))
    for i in order[: max(0, total - sum(base))]:
        base[i] += 1
    return base


def allocate(shares: list[float], available: list[int], total: int, least: int) -> list[int]:
    """Quotas by share, none under min(least, available) nor over what is available.

    A category held at its floor or cap leaves the rest to the others in proportion to their shares; the
    whole falls short of total only where everything available is taken.
    """
    n = len(shares)
    floor = [min(least, a) if s > 0 else 0 for s, a in zip(shares, available)]
    total = min(total, sum(a for s, a in zip(shares, available) if s > 0))
    total = max(total, sum(floor))
    held: dict[int, int] = {}
    while True:
        free = [i for i in range(n) if i not in held and shares[i] > 0]
        rest, weight = total - sum(held.values()), sum(shares[i] for i in free)
        if not free or weight <= 0:
            break
        want = {i: rest * shares[i] / weight for i in free}
        over = {i: available[i] for i in free if want[i] > available[i]}
        under = {i: floor[i] for i in free if want[i] < floor[i]}
        # settle the side that moves more first; the other is judged anew with what is left
        gain, need = sum(want[i] - available[i] for i in over), sum(floor[i] - want[i] for i in under)
        if not over and not under:
            got = largest_remainder([want[i] for i in free], rest)
            held |= dict(zip(free, got))
            break
        held |= over if gain >= need and over else under
    return [min(held.get(i, 0), available[i]) for i in range(n)]


def category_of(value: Column) -> Column:
    """Categories are compared without case and outer blanks; null and empty are no category."""
    x = F.lower(F.trim(value))
    return F.when(x != "", x)


def long_form(records: DataFrame, plans: DataFrame, key: str = "rid", seed: int = 17) -> DataFrame:
    """(plan_id, category, key, draw) of every row under every plan; the few plans are a literal."""
    rows = plans.select("plan_id", "field_name").distinct().collect()
    rows = [r for r in rows if r.field_name in records.columns]
    cells = [F.struct(F.lit(r.plan_id).alias("plan_id"), category_of(F.col(r.field_name)).alias("category"), F.xxhash64(F.lit(seed), F.lit(r.plan_id), F.col(key)).alias("draw")) for r in rows]
    empty = "array<struct<plan_id: string, category: string, draw: bigint>>"
    fields = sorted({r.field_name for r in rows})
    base = records.select(F.col(key).cast("long").alias(key), *fields)
    return base.select(key, F.explode(F.array(*cells) if cells else F.array().cast(empty)).alias("c")).select(key, "c.*").where(F.col("category").isNotNull())


def quotas(counts: DataFrame, total_rows: int, plans: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan_id, category, target_share, target_rows, available, quota, sample_rows) from the counts per category."""
    t = targets.select("plan_id", category_of(F.col("category")).alias("category"), F.col("target_share").cast("double").alias("target_share")).where("category is not null")
    t = t.groupBy("plan_id", "category").agg(F.sum("target_share").alias("target_share"))
    p = plans.dropDuplicates(["plan_id"]).select("plan_id", F.col("sample_share").cast("double").alias("sample_share"), F.coalesce(F.col("min_per_category"), F.lit(0)).cast("int").alias("least"))
    x = t.join(p, "plan_id").join(counts, ["plan_id", "category"], "left")

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("category").reset_index(drop=True)
        total = int(round(g.sample_share[0] * total_rows))
        share, available = g.target_share.fillna(0.0).tolist(), g.available.fillna(0).astype(int).tolist()
        want = largest_remainder([total * s / max(sum(share), 1e-12) for s in share], total)
        got = allocate(share, available, total, int(g.least[0]))
        return pd.DataFrame({"plan_id": g.plan_id, "category": g.category, "target_share": share, "target_rows": want, "available": available, "quota": got, "sample_rows": sum(got)})

    return x.groupBy("plan_id").applyInPandas(one, "plan_id string, category string, target_share double, target_rows long, available long, quota long, sample_rows long")


def _plan(records: DataFrame, plans: DataFrame, targets: DataFrame, key: str, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = long_form(records, plans, key, seed).withColumn("bin", F.shiftrightunsigned(F.col("draw"), 50))
    bins = rows.groupBy("plan_id", "category", "bin").agg(F.count(F.lit(1)).alias("k"))
    counts = bins.groupBy("plan_id", "category").agg(F.sum("k").alias("available"))
    q = quotas(counts, records.count(), plans, targets)
    return rows, bins, q


def sample(records: DataFrame, plans: DataFrame, targets: DataFrame, key: str = "rid", seed: int = 17) -> DataFrame:
    """(plan_id, category, key): the rows drawn for each plan.

    Rows of no target category are never drawn; repeated rows are rows; equal draws are told apart by key.
    """
    rows, bins, q = _plan(records, plans, targets, key, seed)
    before = F.sum("k").over(Window.partitionBy("plan_id", "category").orderBy("bin")) - F.col("k")
    cut = bins.withColumn("before", before).join(F.broadcast(q.select("plan_id", "category", "quota")), ["plan_id", "category"])
    cut = cut.where((F.col("before") < F.col("quota")) & (F.col("before") + F.col("k") >= F.col("quota"))).select("plan_id", "category", F.col("bin").alias("cut_bin"), "before", "quota")
    # one row for each category of a plan
    near = rows.join(F.broadcast(cut), ["plan_id", "category"]).where(F.col("bin") <= F.col("cut_bin"))
    whole = near.where(F.col("bin") < F.col("cut_bin")).select("plan_id", "category", key)
    rank = F.row_number().over(Window.partitionBy("plan_id", "category").orderBy("draw", key))
    part = near.where(F.col("bin") == F.col("cut_bin")).withColumn("rank", rank).where(F.col("rank") <= F.col("quota") - F.col("before")).select("plan_id", "category", key)
    return whole.unionByName(part)


def report(records: DataFrame, plans: DataFrame, targets: DataFrame, key: str = "rid", seed: int = 17) -> DataFrame:
    """(plan_id, category, target_share, target_rows, available, sampled_rows, sampled_share, shortfall_rows, share_gap)."""
    _, _, q = _plan(records, plans, targets, key, seed)
    got = F.col("quota") / F.when(F.col("sample_rows") > 0, F.col("sample_rows"))
    return q.select(
        "plan_id", "category", "target_share", "target_rows", "available", F.col("quota").alias("sampled_rows"), got.alias("sampled_share"),
        F.greatest(F.col("target_rows") - F.col("quota"), F.lit(0)).alias("shortfall_rows"), (got - F.col("target_share")).alias("share_gap"),
    )
