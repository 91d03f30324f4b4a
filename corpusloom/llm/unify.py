"""Problem 1: text that looks the same in one form of characters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import codepoints as C
from .textio import map_text, slices


def unify_text(df: DataFrame, column: str | tuple[str, ...], out: str | None = None, flag: str | None = None) -> DataFrame:
    """df with the column (or several, in one pass) in one form, in place or as column out, and if asked whether it held a stand-in.

    Nulls stay null and empty strings empty; other columns, whatever their names and types, pass unchanged.
    """
    from pyspark.sql import types as T

    columns = (column,) if isinstance(column, str) else column
    outs = (out,) if out else columns
    fields = [f for f in df.schema.fields if f.name not in (*outs, flag)]
    schema = T.StructType([*fields, *[T.StructField(x, T.StringType()) for x in outs]] + ([T.StructField(flag, T.BooleanType())] if flag else []))
    names = [f.name for f in fields]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        new, held = [], np.zeros(b.num_rows, bool)
        for c in columns:
            arr = b.column(c)
            cp, off = C.explode(arr)
            cp, off, bad = C.unify(cp, off)
            new.append(C.implode(cp, off, C.valid_of(arr)))
            held |= bad
        return pa.RecordBatch.from_arrays([b.column(n) for n in names] + new + ([pa.array(held)] if flag else []), names=[*names, *outs] + ([flag] if flag else []))

    return map_text(df, run, schema, columns[0])


def found(records: DataFrame, key: str = "rid", columns: tuple[str, ...] = ("text", "title")) -> DataFrame:
    """(key, field_name) of each field that holds a stand-in or hidden character; null and empty fields hold none."""
    ship(records.sparkSession)

    def run(batches):
        for b in batches:
            keys = b.column(key)
            for name in columns:
                for part in slices(b.select([key, name]), name):
                    cp, off = C.explode(part.column(name))
                    _, _, bad = C.unify(cp, off)
                    if bad.any():
                        at = np.flatnonzero(bad)
                        yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(at)), pa.array([name] * len(at))], names=[key, "field_name"])

    return records.select(F.col(key).cast("long").alias(key), *[F.col(c).cast("string").alias(c) for c in columns]).mapInArrow(run, f"{key} long, field_name string")
