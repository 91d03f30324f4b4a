"""Queries of the ten problems over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import language, mixture, overlap, packing, pairs, pii, quotas, residue, stock, unify


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return unify.found(table(spark, d, "records", spread=True))


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "records", spread=True).select("rid", "text", "title")
    return unify.unify_text(r, ("text", "title")).select("rid", "text", "title")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return quotas.sample(table(spark, d, "records"), table(spark, d, "sampling_plans"), table(spark, d, "sampling_targets"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return quotas.report(table(spark, d, "records"), table(spark, d, "sampling_plans"), table(spark, d, "sampling_targets"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found(table(spark, d, "records", spread=True))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(table(spark, d, "records", spread=True))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return overlap.classes(table(spark, d, "records", spread=True))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return stock.found(table(spark, d, "records", spread=True))


def p4_blocks(spark: SparkSession, d: str) -> DataFrame:
    return stock.blocks(table(spark, d, "records", spread=True))


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return stock.without_stock(table(spark, d, "records", spread=True))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.found(table(spark, d, "enrichment_pairs", spread=True), table(spark, d, "enrichment_queue"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.found(table(spark, d, "records", spread=True))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.cleaned(table(spark, d, "records", spread=True))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return language.found(table(spark, d, "records", spread=True))


def p7_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(table(spark, d, "records", spread=True))


def p7_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(table(spark, d, "records", spread=True))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents", spread=True), table(spark, d, "packing_specs"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(table(spark, d, "documents", spread=True), table(spark, d, "packing_specs"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents", spread=True), table(spark, d, "mix_targets"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture.report(table(spark, d, "documents", spread=True), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "documents", spread=True))


def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.masked(table(spark, d, "documents", spread=True))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("p") and k[1].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {}
