"""Problem 4: lines that recur across the documents of one site.

Lines are compared by their letters alone.  The lines of a site are the nodes of a graph, consecutive
lines its edges, both weighted by the rows they occur in.  Nodes and edges of high support stay; the
connected components are the site's stock blocks, whose lines are deleted from every document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import held
from . import codepoints as C
from .textio import lists, map_text, site_of

LEAST_ROWS, LEAST_SHARE, LEAST_LETTERS, LEAST_CJK = 10, 20, 15, 6
LISTS_MOST = 64 << 20  # bytes of all sites' lists up to which they are broadcast
SALTS = 16


def split_lines(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and number (from 1) of each line; a row without text has one empty line."""
    n = len(off) - 1
    cut = np.flatnonzero(cp == 10)
    starts = np.sort(np.concatenate([off[:-1], cut + 1]), kind="stable")
    row_of_cut = np.searchsorted(off, cut, "right") - 1
    per_row = np.bincount(row_of_cut, minlength=n) + 1
    row = np.repeat(np.arange(n), per_row)
    first = np.concatenate([[0], np.cumsum(per_row)])[:-1]
    number = np.arange(len(row)) - first[row] + 1
    ends = np.empty(len(row), np.int64)
    ends[:-1] = starts[1:] - 1
    last = first + per_row - 1
    ends[last] = off[1:]
    return starts, ends, row, number


def line_keys(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number, key, start and end of each line long enough to count; the text must be unified already."""
    t = C.tables()
    starts, ends, row, number = split_lines(cp, off)
    bounds = np.append(starts, len(cp)).astype(np.int64)
    low, at = C.fold(cp, bounds)
    p = t.props[C.clip(low)]
    letters, at = C.keep(low, at, (p & C.LETTER) != 0)
    han = np.concatenate([[0], np.cumsum((t.props[C.clip(letters)] & C.HAN) != 0)])
    size = np.diff(at)
    ok = np.flatnonzero((size >= LEAST_LETTERS) | (size >= LEAST_CJK) & (han[at[1:]] > han[at[:-1]]))
    key = C.hash_runs(letters, at[ok], at[ok + 1]).view(np.int64)
    return row[ok], number[ok], key, starts[ok], ends[ok]


def site_lines(records: DataFrame, key: str = "rid") -> DataFrame:
    """(key, site, line_no array, line_key array) of every row, of the lines long enough to count."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cp, off = C.explode(b.column("text"))
        cp, off, _ = C.unify(cp, off)
        row, number, keys, _, _ = line_keys(cp, off)
        n = b.num_rows
        return pa.RecordBatch.from_arrays([b.column(key), b.column("site"), lists(number.astype(np.int32), row, n, pa.int32()), lists(keys, row, n, pa.int64())], names=[key, "site", "line_no", "line_key"])

    return map_text(with_site(records, key), run, f"{key} long, site long, line_no array<int>, line_key array<long>")


def with_site(records: DataFrame, key: str = "rid") -> DataFrame:
    return records.select(F.col(key).cast("long").alias(key), F.xxhash64(site_of(F.col("source_url"), F.col("collection"))).alias("site"), F.col("text").cast("string").alias("text"))


def stock_nodes(lines: DataFrame, sites: DataFrame) -> DataFrame:
    """(site, key, support, site_rows) of the lines found in enough rows of their site; counted over all rows."""
    totals = sites.groupBy("site").agg(F.count(F.lit(1)).alias("site_rows")).where(F.col("site_rows") >= LEAST_ROWS)
    nodes = lines.select("site", F.explode(F.array_distinct("line_key")).alias("line_key")).groupBy("site", "line_key").agg(F.count(F.lit(1)).alias("support"))
    return nodes.where(F.col("support") >= LEAST_ROWS).join(totals, "site").where(F.col("support") * LEAST_SHARE >= F.col("site_rows"))


def stock_by_site(nodes: DataFrame) -> DataFrame:
    """(site, stock_keys): at most LEAST_SHARE times the mean number of lines of the site's rows."""
    return nodes.groupBy("site").agg(F.sort_array(F.collect_list("line_key")).alias("stock_keys"), F.first("site_rows").alias("site_rows"))


def stock_edges(lines: DataFrame, by_site: DataFrame) -> DataFrame:
    """(site, key_a, key_b, support) of stock lines that follow one another in enough rows."""
    kept = lines.join(by_site, "site").withColumn("own", F.array_intersect("line_key", "stock_keys"))  # hashed; then only the row's own are looked through
    kept = kept.select("site", "site_rows", F.expr("filter(line_key, x -> array_contains(own, x))").alias("k")).where(F.size("k") > 1)
    pairs = kept.select("site", "site_rows", F.explode(F.array_distinct(F.expr("transform(sequence(1, size(k) - 1), i -> struct(k[i - 1] as a, k[i] as b))"))).alias("e"))
    edges = pairs.groupBy("site", F.col("e.a").alias("key_a"), F.col("e.b").alias("key_b")).agg(F.count(F.lit(1)).alias("support"), F.first("site_rows").alias("n"))
    return edges.where((F.col("support") >= LEAST_ROWS) & (F.col("support") * LEAST_SHARE >= F.col("n")) & (F.col("key_a") != F.col("key_b"))).drop("n")


def stock_blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(site, block, line_key, support): connected components of each site's graph, named by their least key."""

    def components(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g.key_b.isna()], g[g.key_b.notna()]
        top = {k: k for k in a.key_a}

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for x, y in zip(b.key_a, b.key_b.astype("int64")):
            if x in top and y in top:
                x, y = find(x), find(y)
                top[max(x, y)] = min(x, y)
        return pd.DataFrame({"site": a.site, "block": [find(k) for k in a.key_a], "line_key": a.key_a, "support": a.support})

    alone = nodes.select("site", F.col("line_key").alias("key_a"), F.lit(None).cast("long").alias("key_b"), "support")
    return alone.unionByName(edges.select("site", "key_a", "key_b", "support")).withColumn("key_b", F.col("key_b").cast("string")).groupBy("site").applyInPandas(components, "site long, block long, line_key long, support long")


def graph(lines: DataFrame) -> DataFrame:
    """Stock blocks of every site, from the lines of all its rows."""
    nodes = stock_nodes(lines, lines)
    return stock_blocks(nodes, stock_edges(lines, stock_by_site(nodes)))


def found(records: DataFrame, key: str = "rid") -> DataFrame:
    """(key, line_no) of every occurrence of a stock line.

    Rows whose text is null or has no line long enough have none; equal rows count each; a line that
    recurs within a row counts once for its support and is listed at every place.
    """
    lines = held(site_lines(records, key))
    blocks = graph(lines).groupBy("site").agg(F.collect_list("line_key").alias("stock_keys"))
    own = lines.join(blocks, "site").select(key, "line_no", "line_key", F.array_intersect("line_key", "stock_keys").alias("own")).where(F.size("own") > 0)
    hits = own.select(key, F.explode(F.expr("filter(arrays_zip(line_no, line_key), x -> array_contains(own, x.line_key))")).alias("x"))
    return hits.select(key, F.col("x.line_no").alias("line_no"))


def drop_lines(cp: np.ndarray, off: np.ndarray, stock: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unified text without the lines whose key is in the row's list; null lists drop nothing."""
    size = np.asarray(stock.value_lengths().fill_null(0))
    if not size.any():
        return cp, off
    row, _, keys, starts, ends = line_keys(cp, off)
    # one sorted table of (row, key) pairs, as the lists of a site repeat in its rows
    flat = np.asarray(stock.flatten())
    table = np.stack([np.repeat(np.arange(len(size)), size), flat], 1)
    mix = lambda r, k: C.scramble(k.view(np.uint64) ^ C.scramble(r.astype(np.uint64) + np.uint64(1)))
    have = np.sort(mix(table[:, 0], np.ascontiguousarray(table[:, 1])))
    want = mix(row, keys)
    at = np.minimum(np.searchsorted(have, want), len(have) - 1)
    hit = np.flatnonzero(have[at] == want)
    flag = np.zeros(len(cp) + 1, np.int32)
    np.add.at(flag, starts[hit], 1)
    stop = np.minimum(ends[hit] + 1, off[row[hit] + 1])
    np.add.at(flag, stop, -1)
    return C.keep(cp, off, np.cumsum(flag[:-1]) == 0)


def stock_of(records: DataFrame, key: str = "rid") -> DataFrame:
    """(site, stock_keys) of all sites; the rows of a site are counted without reading the text."""
    sites = records.select(F.xxhash64(site_of(F.col("source_url"), F.col("collection"))).alias("site"))
    return stock_by_site(stock_nodes(site_lines(records, key), sites)).select("site", "stock_keys")


def with_stock(records: DataFrame, rows: DataFrame, key: str = "rid", most: int = LISTS_MOST) -> DataFrame:
    """rows (key, site, text, ...) beside stock_keys, the stock lines of the site or of the row itself; null where it has none.

    Texts are never shuffled by site, as one site may hold a third of them: the lists of all sites are broadcast if
    their measured size is at most `most` bytes.  Beyond it the lines of each row, hashes only, meet the stock lines in
    a salted join, and what a row has of them comes to it by its key.
    """
    by_site = held(stock_of(records, key))
    size = by_site.agg(F.sum(F.size("stock_keys") * 8 + 32).alias("n")).first().n or 0
    if size <= most:
        return rows.join(F.broadcast(by_site), "site", "left").drop("site")
    keys = by_site.select("site", F.explode("stock_keys").alias("line_key")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lines = site_lines(records, key).select(key, "site", F.explode(F.array_distinct("line_key")).alias("line_key")).withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    own = lines.join(keys, ["site", "line_key", "salt"]).groupBy(key).agg(F.collect_list("line_key").alias("stock_keys"))
    return rows.drop("site").join(own, key, "left")


def without_stock(records: DataFrame, key: str = "rid") -> DataFrame:
    """(key, text): each record's text in one form, without its site's stock lines; null text stays null."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        arr = b.column("text")
        cp, off = C.explode(arr)
        cp, off, _ = C.unify(cp, off)
        cp, off = drop_lines(cp, off, b.column("stock_keys"))
        return pa.RecordBatch.from_arrays([b.column(key), C.implode(cp, off, C.valid_of(arr))], names=[key, "text"])

    return map_text(with_stock(records, with_site(records, key), key).select(key, "text", "stock_keys"), run, f"{key} long, text string")


def blocks(records: DataFrame, key: str = "rid") -> DataFrame:
    """(site, block, line_key, support) of all stock lines; site is the hash of the site's name."""
    return graph(held(site_lines(records, key)))
