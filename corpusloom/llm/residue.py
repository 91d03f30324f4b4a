"""Problem 6: documents with markup residue, and their clean text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import markup
from .textio import map_text


def _input(records: DataFrame, key: str) -> DataFrame:
    return records.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))


def found(records: DataFrame, key: str = "rid") -> DataFrame:
    """(key, markup_kind) of every markup a text holds at least one construct of; null and empty texts hold none."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        row, kind = [], []
        for i, (held, _, _) in enumerate(markup.judge(b.column("text").to_pylist())):
            row += [i] * len(held)
            kind += sorted(held)
        return pa.RecordBatch.from_arrays([b.column(key).take(pa.array(row)), pa.array(kind)], names=[key, "markup_kind"]) if row else None

    return map_text(_input(records, key), run, f"{key} long, markup_kind string")


def cleaned(records: DataFrame, key: str = "rid") -> DataFrame:
    """(key, text, blocks): the text without markup, and the flat blocks with their roles; null stays null."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column("text").to_pylist()
        blocks = [[{"role": r, "text": s} for r, (s, _) in zip(roles, parts)] for _, roles, parts in markup.judge(texts)]
        return pa.RecordBatch.from_arrays(
            [b.column(key), pa.array([t if t is None else markup.clean(t) for t in texts], pa.string()), pa.array(blocks, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))],
            names=[key, "text", "blocks"],
        )

    return map_text(_input(records, key), run, f"{key} long, text string, blocks array<struct<role: string, text: string>>")
