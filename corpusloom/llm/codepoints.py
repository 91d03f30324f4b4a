"""Arrow text as numpy code-point arrays: decoding, folding and bringing look-alike text to one form.

A batch of strings is one flat ``uint32`` array plus row offsets.  Every step below is a table gather,
a prefix sum or a sorted lookup over the whole batch; no step calls a string method per row.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

TOP = 0x30000  # code points above are folded into the last cell, which has no property

# Letters of other scripts that read as a Latin letter.
CYRILLIC = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C",
    "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T",
    "У": "Y", "Х": "X", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Һ": "H",
}
GREEK = {
    "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
}
LATIN_VARIANTS = {"ɡ": "g", "ɑ": "a", "ɩ": "i", "ʏ": "Y", "ı": "i"}

# Property bits of a code point.
MAPS, DROPS, MARK, LETTER, LATIN, FOREIGN, HAN, DIGIT, SPACE, JOINER, PICTURE, ODD = (1 << i for i in range(12))


def _picture(c: int) -> bool:
    return 0x1F000 <= c <= 0x1FAFF or 0x2190 <= c <= 0x2BFF or c == 0xFE0F


class Tables:
    """Everything derived from the Unicode database by rule, built once per process."""

    def __init__(self) -> None:
        n = TOP + 1
        self.props = np.zeros(n, np.uint16)
        self.lower = np.arange(n, dtype=np.uint32)
        self.latin = np.zeros(n, np.uint32)  # look-alike in Latin, or 0
        self.ccc = np.zeros(n, np.uint8)
        self.script = np.zeros(n, np.uint8)  # 1 Cyrillic, 2 Greek
        grown: dict[int, str] = {}
        folds: dict[int, str] = {}
        canon: dict[int, str] = {}
        pairs: dict[tuple[int, int], int] = {}
        p = self.props
        for c in range(TOP):
            if 0x3400 <= c <= 0x4DBF or 0x4E00 <= c <= 0x9FFF or 0x20000 <= c:
                p[c] = LETTER | HAN
                d = unicodedata.decomposition(chr(c)) if c >= 0x2F800 else ""
                if d:
                    grown[c] = unicodedata.normalize("NFC", chr(c))
                    p[c] |= MAPS
                continue
            if 0xAC00 <= c <= 0xD7A3:
                p[c] = LETTER
                continue
            if 0xD800 <= c <= 0xF8FF:
                continue
            ch = chr(c)
            cat = unicodedata.category(ch)
            if cat == "Cn":
                continue
            k = unicodedata.combining(ch)
            self.ccc[c] = k
            if cat[0] == "M":
                p[c] |= MARK
            if cat[0] == "L":
                p[c] |= LETTER
                low = ch.casefold()
                if len(low) == 1:
                    self.lower[c] = ord(low)
                elif c < 0x1E9F and len(low) == 2 and low.isalpha():
                    folds[c] = low
            if cat == "Nd":
                p[c] |= DIGIT
            if ch.isspace():
                p[c] |= SPACE
            if 0x3041 <= c <= 0x30FF or 0x31F0 <= c <= 0x31FF or c in (0x3005, 0x3006, 0x3007) or 0xF900 <= c <= 0xFAFF:
                p[c] |= HAN | LETTER
            if 0x41 <= c <= 0x7A or 0xC0 <= c <= 0x24F or 0x250 <= c <= 0x2AF or 0x1E00 <= c <= 0x1EFF:
                p[c] |= LATIN if cat[0] == "L" else 0
            if 0x400 <= c <= 0x52F and cat[0] == "L":
                p[c] |= FOREIGN
                self.script[c] = 1
            if (0x370 <= c <= 0x3FF or 0x1F00 <= c <= 0x1FFF) and cat[0] == "L":
                p[c] |= FOREIGN
                self.script[c] = 2
            if _picture(c):
                p[c] |= PICTURE
            d = unicodedata.decomposition(ch)
            if d and d[0] != "<":
                full = unicodedata.normalize("NFD", ch)
                canon[c] = full
                first = [int(x, 16) for x in d.split()]
                if len(first) == 2 and unicodedata.normalize("NFC", ch) == ch:
                    pairs[first[0], first[1]] = c
                if unicodedata.normalize("NFC", ch) != ch:
                    grown[c] = unicodedata.normalize("NFC", ch)
                    p[c] |= MAPS
            elif d:
                tag, plain = d[1:].split("> ")
                to = unicodedata.normalize("NFKC", ch)
                take = False
                if tag in ("wide", "narrow"):
                    take = cat[0] in "LNM"
                elif tag == "compat":
                    take = cat[0] == "L" and cat != "Lm" and not 0x2100 <= c <= 0x218F or 0x2E80 <= c <= 0x2FDF
                elif tag in ("isolated", "initial", "medial", "final"):
                    take = cat[0] == "L"
                elif tag == "font":
                    take = c >= 0x1D400 or 0xFB00 <= c <= 0xFB4F
                if take and to != ch:
                    if c in (0xFF9E, 0xFF9F):
                        to = chr(0x3099 + c - 0xFF9E)
                    grown[c] = to
                    p[c] |= MAPS
            if cat == "Zs" and c != 0x20:
                grown[c] = " "
                p[c] |= MAPS
            if c == 0x200D or c == 0x200C:
                p[c] |= JOINER
            elif cat == "Cf" and not (0x600 <= c <= 0x605 or c in (0x6DD, 0x70F)) or cat == "Cc" and c not in (9, 10, 11, 12, 13, 0x85) or 0xFE00 <= c < 0xFE0F or c in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x180B, 0x180C, 0x180D):
                p[c] |= DROPS
                p[c] &= 0xFFFF ^ (MAPS | LETTER)
                grown.pop(c, None)
        for a, b in {**CYRILLIC, **GREEK}.items():
            self.latin[ord(a)] = ord(b)
        self.variant = {ord(a): ord(b) for a, b in LATIN_VARIANTS.items() if a != "ı"}
        for c in self.variant:
            p[c] |= ODD
        back: tuple[dict, dict] = ({}, {})
        for i, table in enumerate((CYRILLIC, GREEK)):
            for a, b in table.items():
                back[i].setdefault(ord(b), ord(a))
        self.other = [np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)]
        for i in (0, 1):
            for a, b in back[i].items():
                self.other[i + 1][a] = b
        self.grow = _ragged(grown, n)
        self.canon = _ragged(canon, n)
        self.folds = _ragged(folds, n)
        keys = np.array([a << 21 | b for a, b in pairs], np.uint64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_to = keys[order], np.array(list(pairs.values()), np.uint32)[order]
        # a row needs more than a glance if one of its characters has one of these
        self.glance = ((p & (MAPS | DROPS | MARK | FOREIGN | JOINER | ODD)) != 0)
        self.glance[0x1100:0x1200] = True
        self.glance[TOP] = True


def _ragged(m: dict[int, str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each code point's expansion in one flat array; length 0 stands for itself."""
    start, size, flat = np.zeros(n, np.int32), np.zeros(n, np.uint8), []
    for c, s in m.items():
        start[c], size[c] = len(flat), len(s)
        flat += map(ord, s)
    return start, size, np.array(flat or [0], np.uint32)


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def clip(cp: np.ndarray) -> np.ndarray:
    return np.minimum(cp, TOP)


def explode(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows and the offsets of the rows; a null counts as an empty row."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.type not in (pa.string(), pa.large_string()):
        arr = arr.cast(pa.string())
    n = len(arr)
    if arr.null_count:
        import pyarrow.compute as pc

        arr = pc.fill_null(arr, "")
    if not n:
        return np.empty(0, np.uint32), np.zeros(1, np.int64)
    kind = np.int64 if arr.type == pa.large_string() else np.int32
    off = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    if not len(data) or data.max() < 0x80:
        return data.astype(np.uint32), off
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=seen[1:])
    return cp, seen[off]


def implode(cp: np.ndarray, off: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The inverse of explode; rows where valid is false become null."""
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    ends = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(width, out=ends[1:])
    at = ends[off]
    data = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    kind, t = (np.int32, pa.string()) if at[-1] < 2**31 else (np.int64, pa.large_string())
    out = pa.Array.from_buffers(t, len(off) - 1, [None, pa.py_buffer(at.astype(kind)), pa.py_buffer(data)])
    if valid is not None and not valid.all():
        import pyarrow.compute as pc

        out = pc.if_else(pa.array(valid), out, pa.nulls(len(out), t))
    return out


def valid_of(arr: pa.Array) -> np.ndarray:
    return np.asarray(arr.is_valid())


def rows_of(off: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def any_by_row(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    seen = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=seen[1:])
    return seen[off[1:]] > seen[off[:-1]]


def pick(cp: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given rows alone."""
    size = off[rows + 1] - off[rows]
    new = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(off[rows] - new[:-1], size) + np.arange(new[-1])
    return cp[at], new


def keep(cp: np.ndarray, off: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the flagged characters."""
    seen = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(flag, out=seen[1:])
    return cp[flag], seen[off]


def grow(cp: np.ndarray, off: np.ndarray, ragged: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replace characters by their expansions; also returns for each new character the old position."""
    start, size, flat = ragged
    c = clip(cp)
    k = np.maximum(size[c], 1).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(k)])
    src = np.repeat(np.arange(len(cp)), k)
    inner = np.arange(ends[-1]) - ends[src]
    new = np.where(size[c][src] > 0, flat[start[c][src] + inner], cp[src])
    return new.astype(np.uint32), ends[off], src


def fold(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Case folded."""
    t = tables()
    c = clip(cp)
    if len(cp) and (t.folds[1][c] > 0).any():
        cp, off, _ = grow(cp, off, t.folds)
        c = clip(cp)
    return np.where(c < TOP, t.lower[c], cp).astype(np.uint32), off


def compose(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical composition of decomposed text; the flag tells which characters took in a mark."""
    t = tables()
    n = len(cp)
    took = np.zeros(n, bool)
    if not n:
        return cp, off, took
    row_start = np.zeros(n + 1, bool)
    row_start[off] = True
    ccc = t.ccc[clip(cp)].astype(np.int64)
    # order runs of marks by class, stably
    marks = np.flatnonzero(ccc)
    if len(marks):
        lone = np.ones(len(marks), bool)
        lone[1:] = (np.diff(marks) != 1) | row_start[marks[1:]]
        run = np.cumsum(lone)
        order = np.lexsort((np.arange(len(marks)), ccc[marks], run))
        cp = cp.copy()
        cp[marks] = cp[marks[order]]
        ccc[marks] = ccc[marks[order]]
        gone = np.zeros(n, bool)
        head = np.flatnonzero(lone)
        size = np.diff(np.append(head, len(marks)))
        base = marks[head] - 1
        ok = (base >= 0) & ~row_start[marks[head]]
        head, size, base = head[ok], size[ok], base[ok]
        blocked = np.zeros(len(head), np.int64)
        for i in range(int(size.max()) if len(size) else 0):
            live = np.flatnonzero(size > i)
            at = marks[head[live] + i]
            key = cp[base[live]].astype(np.uint64) << np.uint64(21) | cp[at].astype(np.uint64)
            j = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
            hit = (t.pair_keys[j] == key) & (blocked[live] < ccc[at])
            cp[base[live[hit]]] = t.pair_to[j[hit]]
            gone[at[hit]] = True
            took[base[live[hit]]] = True
            blocked[live[~hit]] = ccc[at[~hit]]
        cp, took, off2 = cp[~gone], took[~gone], np.concatenate([[0], np.cumsum(~gone)])[off]
        off = off2
        n = len(cp)
    # letters that join with a following letter: Hangul by arithmetic, the few others by table
    while True:
        if n < 2:
            break
        a, b = cp[:-1].astype(np.int64), cp[1:].astype(np.int64)
        inside = np.ones(n - 1, bool)
        cut = off[(off > 0) & (off < n)]
        inside[cut - 1] = False
        lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
        lvt = (a >= 0xAC00) & (a <= 0xD7A3) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
        maybe = np.flatnonzero(inside & (lv | lvt | (t.ccc[clip(cp[1:])] == 0) & (b >= 0x300) & ((t.props[clip(cp[1:])] & MARK) != 0)))
        if not len(maybe):
            break
        to = np.where(lv, 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28, np.where(lvt, a + b - 0x11A7, 0))[maybe]
        key = cp[maybe].astype(np.uint64) << np.uint64(21) | cp[maybe + 1].astype(np.uint64)
        j = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        to = np.where(to > 0, to, np.where(t.pair_keys[j] == key, t.pair_to[j], 0))
        maybe, to = maybe[to > 0], to[to > 0]
        if not len(maybe):
            break
        apart = np.ones(len(maybe), bool)
        apart[1:] = np.diff(maybe) > 1
        maybe, to = maybe[apart], to[apart]
        cp = cp.copy()
        cp[maybe] = to
        took[maybe] = True
        stay = np.ones(n, bool)
        stay[maybe + 1] = False
        off = np.concatenate([[0], np.cumsum(stay)])[off]
        cp, took = cp[stay], took[stay]
        n = len(cp)
    return cp, off, took


def one_script(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of another script inside a word become the letters they look like; the flag marks them."""
    t = tables()
    n = len(cp)
    changed = np.zeros(n, bool)
    c = clip(cp)
    p = t.props[c]
    word = (p & (LETTER | MARK)) != 0
    word &= (p & HAN) == 0
    if not n or not (p & (FOREIGN | ODD)).any():
        return cp, changed
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = off[:-1][off[:-1] < n]
    first[starts] = word[starts]
    at = np.flatnonzero(word)
    run = np.cumsum(first[at]) - 1
    m = int(run[-1]) + 1 if len(at) else 0
    if not m:
        return cp, changed
    foreign, latin, like = (p[at] & FOREIGN) != 0, (p[at] & LATIN) != 0, t.latin[c[at]] > 0
    count = lambda x: np.bincount(run, x, m)
    nf, nl, nk = count(foreign), count(latin), count(foreign & like)
    size = np.bincount(run, minlength=m)
    mixed = (nf > 0) & (nl > 0)
    to_latin = mixed & (nk == nf)
    out = cp.copy()
    hit = at[(to_latin[run]) & foreign]
    out[hit] = t.latin[c[hit]]
    changed[hit] = True
    # a mostly foreign word with letters that no Latin letter looks like takes in the Latin ones
    for s in (1, 2):
        inside = np.bincount(run, t.script[c[at]] == s, m)
        back = t.other[s][c[at]] > 0
        turned = mixed & ~to_latin & (inside == nf) & (count(latin & back) == nl) & (nf > nl)
        hit = at[turned[run] & latin]
        out[hit] = t.other[s][c[hit]]
        changed[hit] = True
    # in a row with such words, a word wholly of look-alikes is one of them (single Greek letters are symbols)
    rows = np.searchsorted(off, at, "right") - 1
    row_of_run = np.zeros(m, np.int64)
    row_of_run[run] = rows
    dirty = np.bincount(row_of_run, to_latin, len(off) - 1)[row_of_run] > 0
    greek = np.bincount(run, t.script[c[at]] == 2, m) > 0
    pure = (nl == 0) & (nf == size) & (nk == nf) & dirty & ~(greek & (size < 2))
    hit = at[pure[run]]
    out[hit] = t.latin[c[hit]]
    for a, b in t.variant.items():
        hit = at[(cp[at] == a) & (size[run] > 1)]
        out[hit] = b
        changed[hit] = True
    return out, changed


def unify(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One form for text that looks alike: (code points, offsets, whether a row held a stand-in character).

    Width, ligature, radical and presentation forms take their usual letters, unusual spaces become a
    space, unseen characters go (joiners inside pictures and in scripts that need them stay), marks join
    their letters and look-alike letters take the script of their word.  Full-width punctuation,
    superscripts, fractions, circled figures and whole words of another script stay as they are.
    """
    t = tables()
    n = len(off) - 1
    found = np.zeros(n, bool)
    look = t.glance[clip(cp)] if len(cp) else np.zeros(0, bool)
    todo = np.flatnonzero(any_by_row(look, off))
    if not len(todo):
        return cp, off, found
    a, o = pick(cp, off, todo)
    p = t.props[clip(a)]
    row = rows_of(o)
    hit = (p & MAPS) != 0
    drop = (p & DROPS) != 0
    join = np.flatnonzero(p & JOINER)
    if len(join):
        before, after = np.maximum(join - 1, 0), np.minimum(join + 1, len(a) - 1)
        picture = ((p[before] & PICTURE) != 0) & ((p[after] & PICTURE) != 0)
        needed = (a[before] >= 0x600) & (a[before] < 0x10A0)
        drop[join[~picture & ~needed]] = True
    tagged = np.flatnonzero((a >= 0xE0000) & (a < 0xE1000))
    if len(tagged):
        before = np.maximum(tagged - 1, 0)
        drop[tagged[(a[before] < 0x1F000)]] = True
    bad = np.bincount(row[hit | drop], minlength=len(todo)) > 0
    a, o = keep(a, o, ~drop)
    a, o, _ = grow(a, o, t.grow)
    marked = np.flatnonzero(any_by_row(((t.props[clip(a)] & MARK) != 0) | (a >= 0x1100) & (a < 0x1200), o))
    if len(marked):
        b, bo = pick(a, o, marked)
        before = b, bo
        b, bo, _ = grow(b, bo, t.canon)
        b, bo, took = compose(b, bo)
        same = np.diff(bo) == np.diff(before[1])
        other = np.zeros(len(marked), bool)
        if same.any():
            x, xo = pick(*before, np.flatnonzero(same))
            y, _ = pick(b, bo, np.flatnonzero(same))
            other[np.flatnonzero(same)] = any_by_row(x != y, xo)
        bad[marked] |= ~same | other
        a, o = _put(a, o, marked, b, bo)
    a, changed = one_script(a, o)
    bad |= any_by_row(changed, o)
    found[todo] = bad
    out, new = _put(cp, off, todo, a, o)
    return out, new, found


def _put(cp: np.ndarray, off: np.ndarray, rows: np.ndarray, a: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one batch replaced by those of another."""
    if len(rows) == len(off) - 1:
        return a, o
    size = np.diff(off)
    src = off[:-1].copy()
    size[rows] = np.diff(o)
    src[rows] = o[:-1] + len(cp)
    both = np.concatenate([cp, a])
    new = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(src - new[:-1], size) + np.arange(new[-1])
    return both[at], new


MULT, SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """SEED to the powers 0..n-1, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        m = max(n, 4096)
        x = np.full(m, SEED, np.uint64)
        x[0] = 1
        _powers = np.multiply.accumulate(x)
    return _powers[:n]


def scramble(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * MULT
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def hash_runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run values[starts:ends]; runs are disjoint and ascending."""
    if not len(starts):
        return np.empty(0, np.uint64)
    size = ends - starts
    total = int(size.sum())
    new = np.concatenate([[0], np.cumsum(size)])
    inner = np.arange(total) - np.repeat(new[:-1], size)
    at = inner + np.repeat(starts, size)
    terms = scramble(values[at]) * powers(int(size.max()) if total else 1)[inner]
    seen = np.zeros(total + 1, np.uint64)
    np.cumsum(terms, out=seen[1:])
    return scramble((seen[new[1:]] - seen[new[:-1]]) + size.astype(np.uint64))
