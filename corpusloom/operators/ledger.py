"""Exact accounting of metered calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MONEY = "decimal(18,8)"


def exposure(state: str = "entry_state") -> Column:
    """What an entry costs or may still cost: the actual amount once settled, else what is held or reserved."""
    return F.when(F.col(state) == "settled", F.col("actual_usd")).otherwise(F.coalesce("held_usd", "reserved_usd")).cast(MONEY)


def spend(entries: DataFrame, *keys: str) -> DataFrame:
    settled = F.col("entry_state") == "settled"
    zero = F.lit(0).cast(MONEY)
    total = lambda c: F.coalesce(F.sum(c), zero).cast("decimal(28,8)")
    return entries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), total(F.when(settled, F.col("actual_usd").cast(MONEY))).alias("spent_usd"), total(F.when(~settled, exposure())).alias("held_usd"),
        *[F.count_if(F.col("entry_state") == s).alias(s) for s in ("pending", "settled", "unknown")],
    )


BIN = 3600  # seconds of a model's ledger that one window task holds


def _before(entries: DataFrame, per: str) -> DataFrame:
    """entries with amount, and the amount, calls and unknown calls of the same key before each, in order of time.

    Entries are summed by key and hour first; only an hour of a key is ever sorted in one task, and of the hours of a
    key only their sums.
    """
    zero = F.lit(0).cast(MONEY)
    x = entries.withColumns({"amount": exposure(), "_unknown": (F.col("entry_state") == "unknown").cast("int"), "_bin": F.floor(F.col("created_at_unix") / BIN)})
    hours = x.groupBy(per, "_bin").agg(F.sum("amount").alias("a"), F.count(F.lit(1)).alias("c"), F.sum("_unknown").alias("u"))
    earlier = Window.partitionBy(per).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select(F.col(per).alias("_per"), F.col("_bin").alias("_hour"), F.coalesce(F.sum("a").over(earlier).cast("decimal(28,8)"), zero).alias("_a"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in "cu"])
    inner = Window.partitionBy(per, "_bin").orderBy("created_at_unix", "entry_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"_a1": F.coalesce(F.sum("amount").over(inner).cast("decimal(28,8)"), zero), "_c1": F.count(F.lit(1)).over(inner), "_u1": F.coalesce(F.sum("_unknown").over(inner), F.lit(0))}
    both = x.withColumns(sums).join(hours, F.col(per).eqNullSafe(F.col("_per")) & F.col("_bin").eqNullSafe(F.col("_hour")))
    return both.withColumns({"before": F.col("_a") + F.col("_a1"), "calls": F.col("_c") + F.col("_c1"), "unknown_calls": F.col("_u") + F.col("_u1")})


def running(entries: DataFrame, per: str = "model") -> DataFrame:
    """Exposure after each entry in order of time."""
    return _before(entries, per).select("entry_id", per, "amount", (F.col("before") + F.coalesce("amount", F.lit(0))).cast("decimal(28,8)").alias("exposure_usd"))


def replay(entries: DataFrame, budget: str, max_calls: int, per: str = "model") -> DataFrame:
    """Whether each call could be reserved: budget and calls left, and no unknown call before it."""
    over = F.col("before") + F.col("reserved_usd").cast(MONEY) > F.lit(budget).cast(MONEY)
    what = F.when(F.col("unknown_calls") > 0, "halted").when(F.col("calls") >= max_calls, "call_cap").when(over, "over_budget").otherwise("granted")
    return _before(entries, per).select("entry_id", per, what.alias("decision"))


def settlement(entries: DataFrame) -> DataFrame:
    """(entry_id, outcome_state, charged_usd): settled within its reservation, violated (charged more, or nothing known), held, or open."""
    actual, reserved = F.col("actual_usd").cast(MONEY), F.col("reserved_usd").cast(MONEY)
    settled = F.col("entry_state") == "settled"
    state = F.when(settled & actual.isNull(), "violation_no_amount").when(settled & (actual > reserved), "violation_over_reservation").when(settled, "settled").when(F.col("entry_state") == "unknown", "held").otherwise("open")
    return entries.select("entry_id", state.alias("outcome_state"), exposure().alias("charged_usd"))
