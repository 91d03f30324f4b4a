"""Problem 10: personal data in free text, found by a bidirectional LSTM with CRF over characters.

Texts are cut into overlapping windows; each is tagged, and the cores of the windows are put together to
one tagging of the text, repaired where a span crosses a seam.  An exact check then settles the edges of
each span (what belongs to an e-mail address or a number, which titles and marks do not) and drops spans
that cannot be what they were tagged as.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codepoints as C
from . import gru, lstm
from .pii_carriers import JA_FAMILY, JA_GIVEN, ZH_FAMILY, ZH_GIVEN
from .pii_labels import KINDS
from .textio import map_text

WINDOW, MARGIN = 1024, 32
HAN_BUCKETS = 512
READ = 1 << 21  # bytes read at once: fewer would make the calls of a step dearer than its numbers
OWN = "".join(sorted({*ZH_FAMILY, *ZH_GIVEN, *"".join(JA_FAMILY + JA_GIVEN), *"号路街巷市区县省镇村室栋楼町丁目番都道府県州"} - {*map(chr, range(0x3400))}))  # Han letters that have a symbol of their own
SYMBOLS = 128 + 192 + 64 + 192 + HAN_BUCKETS + len(OWN) + 4
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind


@lru_cache(1)
def symbol_table() -> np.ndarray:
    n = C.TOP + 1
    t = np.full(n, SYMBOLS - 1, np.int16)
    t[:128] = np.arange(128)
    t[0xC0:0x180] = 128 + np.arange(0xC0)
    t[0xFF01:0xFF5F] = np.arange(0x21, 0x7F)
    t[0x3000:0x3040] = 320 + np.arange(64)
    t[0x3000] = 32
    t[0x3040:0x3100] = 384 + np.arange(192)
    t[0x3400:0xA000] = 576 + (np.arange(0x3400, 0xA000) * 40503 >> 4) % HAN_BUCKETS
    t[[ord(c) for c in OWN]] = 576 + HAN_BUCKETS + np.arange(len(OWN))
    t[0xA0] = 32
    t[0x2010:0x2016] = 45
    t[[0x2018, 0x2019]] = 39
    t[[0x201C, 0x201D]] = 34
    return t


@lru_cache(1)
def net() -> dict[str, np.ndarray]:
    p = gru.load("pii_lstm.npz")
    p["tr"] = allowed_steps(p["tr"])
    return p


def allowed_steps(tr: np.ndarray) -> np.ndarray:
    """A continuation follows only its own beginning or continuation."""
    tr = tr.copy()
    for k in range(len(KINDS)):
        for j in range(TAGS):
            if j not in (1 + 2 * k, 2 + 2 * k):
                tr[j, 2 + 2 * k] = -1e4
    return tr


def tag(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A tag for every character, from overlapping windows."""
    size = np.diff(off)
    pieces = np.maximum(1, -(-(size - 2 * MARGIN) // (WINDOW - 2 * MARGIN)))
    row = np.repeat(np.arange(len(size)), pieces)
    i = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    a = i * (WINDOW - 2 * MARGIN)
    last = i == pieces[row] - 1
    n = np.where(last, size[row], a + WINDOW) - a
    at = np.cumsum(n) - n
    src = np.arange(n.sum()) + np.repeat(off[row] + a - at, n)
    tags = lstm.decode(net(), symbol_table()[C.clip(cp)][src], at, n)
    hit = np.flatnonzero(tags)
    w = np.searchsorted(at, hit, "right") - 1
    inner = hit - at[w]
    take = (inner >= np.where(a > 0, MARGIN, 0)[w]) & (inner < np.where(last, n, n - MARGIN)[w])
    out = np.zeros(len(cp), np.int8)
    out[src[hit[take]]] = tags[hit[take]]
    return out


def tagged_spans(tags: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and kind of runs of one kind; a continuation without beginning (at a seam) begins one."""
    hit = np.flatnonzero(tags)
    t = tags[hit].astype(np.int64)
    kind = (t + 1) // 2
    first = (t % 2 == 1) | (off[np.searchsorted(off, hit, "right") - 1] == hit)
    first[1:] |= (np.diff(hit) > 1) | (np.diff(kind) != 0)
    first[:1] = True
    return hit[first], hit[np.append(first[1:], True)[: len(hit)]] + 1, kind[first] - 1


_LEFT = r"[A-Za-z0-9][A-Za-z0-9._%+-]*(?:\s(?:dot|DOT)\s[A-Za-z0-9._%+-]+)?"
_AT = r"(?:@|\s?@\s?|\s?[\[(]\s?(?:at|AT)\s?[\])]\s?|\sAT\s|\s(?:arobase|arroba)\s)"
_SAID = r"(?:\s?[\[(]\s?(?:dot|DOT)\s?[\])]\s?|\sDOT\s|\sdot\s|\s(?:point|punto|punkt)\s)"
_DOT = rf"(?:\.|{_SAID})"
# a bare "at" makes an address only with its dots said too
EMAIL = re.compile(rf"{_LEFT}(?:{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}|\sat\s[A-Za-z0-9-]+(?:{_SAID}[A-Za-z0-9-]+)*{_SAID})[A-Za-z]{{2,}}(?![A-Za-z0-9])")
NUMBER = re.compile(r"[+(（]?\d(?:[\d ().（）/+\-‐-–ー−]*\d)?")
CODE = re.compile(r"(?:[A-Z]{1,3}[ -]?)?\d(?:[ .-]?[\dA-Z](?![a-z]))*")
TITLE = re.compile(r"^(?:(?:Dr|Mr|Mrs|Ms|Prof|Sr|Sra|Mme|Mlle|M|Hr|Fr)\.?|Frau|Herrn?|Madame|Monsieur|Señora?|Doña|Don)\s+(?=\S)")
GIVEN = re.compile(r"(?:^|(?<=[\s(]))((?:[A-ZÀ-Þ]\. ?){1,2} ?|[A-ZÀ-Þ'’-]{2,} )$")
TAIL = re.compile(r"(?:['’]s|さん|氏|様|女士|先生|くん)$")
NAME_CHARS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ一-鿿ぁ-ヿ々ヶ]")


def settle(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The exact edges of a tagged span, or None where it cannot be of its kind."""
    lo, hi = max(0, a - 40), min(len(text), b + 40)
    if kind == "email":
        for m in EMAIL.finditer(text, lo, hi):
            if m.start() < b and m.end() > a:
                return m.span()
        return None
    if kind in ("phone", "id_number"):
        while kind == "id_number" and a > lo and text[a - 1].isascii() and text[a - 1].isalnum():
            a -= 1
        for m in (NUMBER if kind == "phone" else CODE).finditer(text, a if kind == "id_number" else max(0, a - 12), hi):
            if m.start() < b and m.end() > a and sum(c.isdigit() for c in m[0]) >= 5:
                x, y = m.span()
                if kind == "phone":
                    while text[x] in "(（" and not re.search("[)）]", text[x + 1 : y]):
                        x += 1
                return x, y
        return None
    while a < b and (text[a].isspace() or text[a] in ",.;:：，。、—–-|"):
        a += 1
    while b > a and (text[b - 1].isspace() or text[b - 1] in ",;:：，。、|" or text[b - 1] == "." and not re.search(r"(?:^|[\s.])[A-Z]\.$", text[max(0, b - 3) : b])):
        b -= 1
    if kind == "person_name":
        while a > 0 and (text[a - 1].isalpha() and text[a - 1].isascii() or "À" <= text[a - 1] <= "ɏ") and (text[a].isascii() or "À" <= text[a] <= "ɏ"):
            a -= 1
        while b < len(text) and text[b - 1].isalpha() and text[b].isalpha() and (text[b].isascii() or "À" <= text[b] <= "ɏ") and (text[b - 1].isascii() or "À" <= text[b - 1] <= "ɏ"):
            b += 1
        m = GIVEN.search(text[max(0, a - 24) : a])
        if m and not re.search(r"\d ?$", text[max(0, a - 30) : a - len(m[1])]) and (m[1][1] == "." or text[a:b].isupper()):  # initials, or a name in capitals, cut at its family name
            a -= len(m[1])
        m = TITLE.match(text[a:b])
        while m and not (m[0][:2] == "M." and not re.search(r"[\s,]", text[a + m.end() : b])):  # an initial, not Monsieur
            a += m.end()
            m = TITLE.match(text[a:b])
        m = TAIL.search(text[a:b])
        if m and b - a > len(m[0]) + 1:
            b -= len(m[0])
        s = text[a:b]
        if b - a < 2 or any(c.isdigit() for c in s) or not NAME_CHARS.search(s):
            return None
        if s.isascii() and " " not in s or re.fullmatch(r"[^\W\d_]+", s) and not re.search("[一-鿿ぁ-ヿ]", s):
            return None  # a family name needs a given name or initials
        return a, b
    while a > 0 and text[a - 1].isalnum() and text[a].isalnum() and text[a].isascii() and text[a - 1].isascii():
        a -= 1
    while b < len(text) and text[b - 1].isalnum() and text[b].isalnum() and text[b].isascii() and text[b - 1].isascii():
        b += 1
    return (a, b) if b - a > 4 and any(c.isdigit() for c in text[a:b]) else None


def pieces(arr: pa.Array) -> list[list[tuple[int, int, int]]]:
    """For each text its settled (start, end, kind) spans, in order and without overlap."""
    cp, off = C.explode(arr)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(off) - 1)]
    if not len(cp):
        return out
    start, stop, kind = tagged_spans(tag(cp, off), off)
    row = np.searchsorted(off, start, "right") - 1
    text, last = "", -1
    for a, b, k, r in zip(start.tolist(), stop.tolist(), kind.tolist(), row.tolist()):
        if r != last:
            text, last = arr[r].as_py(), r
        at = settle(text, a - int(off[r]), b - int(off[r]), KINDS[k])
        if at and (not out[r] or out[r][-1][1] <= at[0]):
            out[r].append((*at, k))
    return out


def masked(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text) with each piece of personal data as [EMAIL], [PHONE], ...; null stays null, empty stays empty."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        arr = b.column("text")
        new = arr.to_pylist()
        for r, spans in enumerate(pieces(arr)):
            for a, z, k in reversed(spans):
                new[r] = new[r][:a] + f"[{KINDS[k].upper()}]" + new[r][z:]
        return pa.RecordBatch.from_arrays([b.column(key), pa.array(new, pa.string())], names=[key, "text"])

    return map_text(_input(docs, key), run, f"{key} long, text string", limit=READ)


def found(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pii_kind, found_text): each distinct piece of each document."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        arr = b.column("text")
        rows, kinds, texts = [], [], []
        for r, spans in enumerate(pieces(arr)):
            text = arr[r].as_py() if spans else ""
            for k, s in sorted({(k, text[a:z]) for a, z, k in spans}):
                rows.append(r)
                kinds.append(KINDS[k])
                texts.append(s)
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows)), pa.array(kinds), pa.array(texts)], names=[key, "pii_kind", "found_text"])

    return map_text(_input(docs, key), run, f"{key} long, pii_kind string, found_text string", limit=READ)


def _input(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))
