"""Running numpy code over Arrow batches of text, in slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

SLICE = 1 << 20  # bytes of text handled at once; a longer text is a slice of its own


def text_bytes(arr: pa.Array) -> np.ndarray:
    """Bytes up to each row: n + 1 rising numbers."""
    n = len(arr)
    kind = np.int64 if arr.type == pa.large_string() else np.int32
    if not n:
        return np.zeros(1, np.int64)
    return np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + n + 1].astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    at = text_bytes(batch.column(column))
    a, n = 0, batch.num_rows
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


@lru_cache(1)
def single_thread() -> None:
    """Matrix products of this process on one thread: tasks fill the cores already, and small products on several threads
    spend more time waiting for one another than they save."""
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        try:
            lib = ctypes.CDLL(str(path))
        except OSError:
            continue
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", limit: int = SLICE) -> DataFrame:
    """df through fn, slice by slice of its text column."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_thread()
        for batch in batches:
            for part in slices(batch, column, limit):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def lists(values: np.ndarray, row: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Values (ordered by row) as one list for each of n rows."""
    off = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(row, minlength=n), out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


def site_of(url: Column, collection: Column) -> Column:
    """The host of a URL in lower case without leading www., port and closing dot; the collection where there is no URL."""
    host = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@\s]*@)?([^/?#:\s]+)", 1)
    bare = F.regexp_extract(F.lower(url), r"^\s*([^/?#:\s]+)(?::\d+)?(?:[/?#]|\s*$)", 1)
    host = F.when(F.instr(url, "//") > 0, host).otherwise(bare)
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"\.$", "")
    return F.when(host != "", F.concat(F.lit("host:"), host)).otherwise(F.concat(F.lit("collection:"), F.coalesce(collection, F.lit(""))))
