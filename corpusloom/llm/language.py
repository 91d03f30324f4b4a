"""Problem 7: the language of each document and of each segment of a mixed one.

A bidirectional recurrent network over the bytes of the text labels every position; the positions of a
segment (a sentence or line) are pooled to its language, the segments to the document's.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import codepoints as C
from . import gru, markup, overlap, stock
from .textio import map_text

CODES = ["en", "zh", "ja", "de", "fr", "es"]
# Other ways to write the codes.
SYNONYMS = {
    "eng": "en", "english": "en", "zho": "zh", "chi": "zh", "cmn": "zh", "chinese": "zh", "jpn": "ja", "japanese": "ja", "jp": "ja",
    "deu": "de", "ger": "de", "german": "de", "fra": "fr", "fre": "fr", "french": "fr", "spa": "es", "spanish": "es", "cn": "zh",
}
LEAST_LETTERS, LEAST_HAN, WINDOW, MARGIN = 12, 5, 448, 32
READ = 1 << 18  # bytes read at once: the states of a step then stay in a core's cache


def code_of(label: str | None) -> str:
    x = (label or "").strip().lower().replace("_", "-").split("-")[0]
    return SYNONYMS.get(x, x)


def code_column(label: Column) -> Column:
    x = F.split(F.regexp_replace(F.lower(F.trim(label)), "_", "-"), "-")[0]
    known = F.create_map(*[F.lit(v) for pair in SYNONYMS.items() for v in pair])
    return F.coalesce(F.try_element_at(known, x), x, F.lit(""))


@lru_cache(1)
def net() -> dict[str, np.ndarray]:
    return gru.load("lang_gru.npz")


def cut_segments(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the segments and the row of each: they end after a line and after a closing mark of a sentence."""
    n = len(cp)
    t = C.tables()
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    wide = np.isin(cp, [0x3002, 0xFF01, 0xFF1F])
    after = np.append(cp[1:], 32)
    narrow = np.isin(cp, [33, 46, 63, 0x2026]) & ((t.props[C.clip(after)] & C.SPACE) != 0)
    # a full stop after one letter or a short number is an abbreviation or an ordinal
    end = np.flatnonzero(wide | narrow | (cp == 10)) + 1
    starts = np.union1d(off[:-1][np.diff(off) > 0], end[end < n])
    return starts, np.searchsorted(off, starts, "right") - 1


def label_positions(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(languages, bytes): probabilities at every byte; long texts are cut into overlapping windows."""
    p = net()
    pieces = np.maximum(1, -(-(size - 2 * MARGIN) // (WINDOW - 2 * MARGIN)))
    row = np.repeat(np.arange(len(size)), pieces)
    i = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    a = i * (WINDOW - 2 * MARGIN)
    last = i == pieces[row] - 1
    b = np.where(last, size[row], a + WINDOW)
    if (pieces == 1).all():
        return gru.probabilities(p, data, start, size)
    n = b - a
    at = np.concatenate([[0], np.cumsum(n)])
    src = np.arange(at[-1]) - np.repeat(at[:-1], n) + np.repeat(start[row] + a, n)
    inner = np.arange(at[-1]) - np.repeat(at[:-1], n)
    lead, tail = np.repeat(np.where(a > 0, MARGIN, 0), n), np.repeat(np.where(last, n, n - MARGIN), n)
    take = np.flatnonzero((inner >= lead) & (inner < tail))
    core = np.zeros(len(data), np.intp)
    core[src[take]] = take
    return gru.probabilities(p, data[src], at[:-1], n, core)


def read(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of unified running text: start, row, language, confidence, letters (weighted)."""
    t = C.tables()
    starts, row = cut_segments(cp, off)
    m = len(starts)
    if not m:
        return starts, row, np.empty(0, int), np.empty(0), np.empty(0, int)
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    byte = np.concatenate([[0], np.cumsum(width)])
    data = np.frombuffer(cp.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
    live = np.flatnonzero(np.diff(off) > 0)
    q = label_positions(data, byte[off[live]], byte[off[live + 1]] - byte[off[live]])
    p = t.props[C.clip(cp)]
    letter = np.repeat((p & C.LETTER) != 0, width).astype(np.float32)
    cut = byte[starts]
    q *= letter
    pooled = np.add.reduceat(q, cut, 1)
    count = np.add.reduceat(letter, cut)
    pooled = (pooled / np.maximum(count, 1)).T
    letters = np.add.reduceat(((p & C.LETTER) != 0).astype(np.int64), starts)
    han = np.add.reduceat(((p & C.HAN) != 0).astype(np.int64), starts)
    weight = np.where((letters >= LEAST_LETTERS) | (han >= LEAST_HAN), letters, 0)
    return starts, row, pooled.argmax(1), pooled.max(1), np.where(letters > 0, np.maximum(weight, 0), -1)


def label_rows(cp: np.ndarray, off: np.ndarray) -> tuple[list[list[int]], np.ndarray]:
    """For each row the languages that hold at least a quarter of the sentences each (one or two), and the mean confidence."""
    n = len(off) - 1
    _, row, lang, sure, weight = read(cp, off)
    out: list[list[int]] = [[] for _ in range(n)]
    conf = np.zeros(n)
    if not len(row):
        return out, conf
    full = weight > 0
    rows_full = np.bincount(row, full, n)
    use = np.where(rows_full[row] > 0, full, weight >= 0)  # a row of short lines only is judged by them
    k = len(CODES)
    votes = np.bincount(row * k + lang, use, n * k).reshape(n, k)
    total = votes.sum(1)
    conf = np.bincount(row, use * sure, n) / np.maximum(total, 1)
    best = votes.argmax(1)
    second = votes.copy()
    second[np.arange(n), best] = 0
    other = second.argmax(1)
    for i in np.flatnonzero(total > 0):
        out[i] = [int(best[i])]
        if second[i, other[i]] * 4 >= total[i]:
            out[i].append(int(other[i]))
    return out, conf


SENTENCES = re.compile(r"(?<=[.!?…])(?=\s)|(?<=[。！？\n])")


def without_code(text: str) -> str:
    return markup.bare(text, drop_code=True)


def sentences(text: str) -> str:
    """The words of the text in sentences; names in links, titles and lists have no vote where the text has sentences."""
    whole = without_code(text)
    kept = "\n".join(x.strip() for x in SENTENCES.split(whole) if _sentence(x))
    return kept if any(c.isalpha() for c in kept) else whole


def _sentence(x: str) -> bool:
    ends = x.rstrip()[-1:] in (*".!?…。！？",)
    return markup._size(x) >= (4 if ends else 6)


def prepared(b: pa.RecordBatch, rewrite=sentences) -> tuple[np.ndarray, np.ndarray]:
    cp, off = C.explode(b.column("text"))
    cp, off, _ = C.unify(cp, off)
    cp, off = stock.drop_lines(cp, off, b.column("stock_keys"))
    return overlap.running_text(cp, off, rewrite)


def languages(records: DataFrame, key: str = "rid") -> DataFrame:
    """(key, languages array, confidence); text without letters has an empty array."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        labels, conf = label_rows(*prepared(b))
        return pa.RecordBatch.from_arrays([b.column(key), pa.array([[CODES[x] for x in v] for v in labels], pa.list_(pa.string())), pa.array(conf)], names=[key, "languages", "confidence"])

    return map_text(stock.with_stock(records, stock.with_site(records, key), key).select(key, "text", "stock_keys"), run, f"{key} long, languages array<string>, confidence double", limit=READ)


def segments(records: DataFrame, key: str = "rid") -> DataFrame:
    """(key, segment_no, segment, lang_code, confidence) of all segments with letters."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        cp, off = prepared(b, without_code)
        starts, row, lang, sure, weight = read(cp, off)
        ok = np.flatnonzero(weight >= 0)
        if not len(ok):
            return None
        bounds = np.append(starts, len(cp)).astype(np.int64)
        text = C.implode(cp, bounds).take(pa.array(ok))
        first = np.searchsorted(row, row[ok], "left")
        return pa.RecordBatch.from_arrays([b.column(key).take(pa.array(row[ok])), pa.array((ok - first + 1).astype(np.int32)), text, pa.array([CODES[x] for x in lang[ok]]), pa.array(sure[ok].astype(float))], names=[key, "segment_no", "segment", "lang_code", "confidence"])

    return map_text(stock.with_stock(records, stock.with_site(records, key), key).select(key, "text", "stock_keys"), run, f"{key} long, segment_no int, segment string, lang_code string, confidence double", limit=READ)


def found(records: DataFrame, key: str = "rid") -> DataFrame:
    """(key, lang_code) of the rows whose label is missing or wrong; both languages of a mixed text.

    Null, empty and letterless texts are no case; another code for the same language is right; any code
    but 'mixed' is wrong for a text of two languages.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        labels, _ = label_rows(*prepared(b))
        row, code = [], []
        for i, (v, said) in enumerate(zip(labels, b.column("said").to_pylist())):
            if v and not (len(v) == 2 and said == "mixed" or len(v) == 1 and said == CODES[v[0]]):
                row += [i] * len(v)
                code += [CODES[x] for x in v]
        if not row:
            return None
        return pa.RecordBatch.from_arrays([b.column(key).take(pa.array(row)), pa.array(code)], names=[key, "lang_code"])

    said = records.select(F.col(key).cast("long").alias(key), code_column(F.col("language")).alias("said"), F.xxhash64(stock.site_of(F.col("source_url"), F.col("collection"))).alias("site"), F.col("text").cast("string").alias("text"))
    return map_text(stock.with_stock(records, said, key).select(key, "said", "text", "stock_keys"), run, f"{key} long, lang_code string", limit=READ)
