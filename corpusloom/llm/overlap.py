"""Problem 3: records of the evaluation splits that recur, exactly or nearly, in the training split.

Texts are compared as sequences of words (single characters for Han and kana) without stock lines, the signs of
markup, case, spacing and punctuation; words that markup holds (code, tables, lists, links) are compared like all
others.  Equal sequences form a class; classes are joined by edit distance: of k edits at most one falls into each of
k + 1 disjoint windows of an evaluation sequence, so a training sequence within k edits holds one of them at an allowed
position.  Candidates that pass the length, position and signature tests are verified with a banded dynamic programme
over whole batches.  All pairs within the bound are found, whichever windows are chosen; how common windows are decides
only the work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import held
from . import codepoints as C
from . import markup, stock
from .textio import map_text

SHARE = 8  # of the shorter text's tokens one in so many may differ
EVALUATION = ("dev", "test", "validation")
BITS_MOST, BITS_PER_KEY = 1 << 27, 40
GRAM, COUNTERS, COUNTERS_MOST = 3, 1 << 19, 1 << 22  # how common a stretch of text is, is read off a sketch of so many counters
LENGTHS, RARE = (3, 5, 7, 9, 12, 16), 48  # lengths that a window may have; how often a rare stretch may occur beyond the sketch's noise
NOISE_MOST = 64  # a sketch whose usual counter is beyond this tells nothing: windows are then as long as they can be
HOT, HOT_LIST = 1 << 12, 1 << 20  # a window in more training texts is split; so many of such windows are broadcast
SIGNATURE = [f"sig_{i}" for i in range(2)]
SIGNATURE_TYPES = ", ".join(f"{x} long" for x in SIGNATURE)


def whole(text: str) -> str:
    """Without the signs of markup, but with all its words; a text of nothing else stays as it is."""
    t = markup.bare(text)
    return t if any(c.isalnum() for c in t) else text


def running_text(cp: np.ndarray, off: np.ndarray, rewrite=whole) -> tuple[np.ndarray, np.ndarray]:
    """The texts rewritten where they hold a sign of markup."""
    rows = marked(cp, off)
    if not len(rows):
        return cp, off
    texts = C.implode(*C.pick(cp, off, rows)).to_pylist()
    a, o = C.explode(pa.array([rewrite(t) for t in texts], pa.string()))
    return C._put(cp, off, rows, a, o)


def marked(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows that hold a sign of markup."""
    look = markup.trigger_table(C.TOP + 1)[C.clip(cp)] if len(cp) else np.zeros(0, bool)
    rows = np.flatnonzero(C.any_by_row(look, off))
    quotes = np.flatnonzero((cp[:-1] == 39) & (cp[1:] == 39)) if len(cp) else np.empty(0, int)
    dashes = np.flatnonzero((cp[:-2] == 45) & (cp[1:-1] == 45) & (cp[2:] == 45)) if len(cp) > 2 else np.empty(0, int)
    return np.union1d(rows, np.searchsorted(off, np.concatenate([quotes, dashes]), "right") - 1).astype(np.int64)


def tokens(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows and the offsets of the rows in them."""
    t = C.tables()
    cp, off = C.fold(cp, off)
    p = t.props[C.clip(cp)]
    han = (p & C.HAN) != 0
    word = ((p & (C.LETTER | C.DIGIT | C.MARK)) != 0) & ~han
    n = len(cp)
    if not n:
        return np.empty(0, np.int32), np.zeros(len(off), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    start = np.flatnonzero(first | han)
    # a word ends before the next character that is no part of it
    stop = np.flatnonzero(~word | edge[:-1])
    at = np.searchsorted(stop, start, "right")
    end = np.where(han[start], start + 1, np.append(stop, n)[at])
    h = (C.hash_runs(cp, start, end) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return h, np.searchsorted(start, off)


def allowed(n: Column | np.ndarray):
    """Edits between a text of n tokens and one that is no shorter."""
    return n // SHARE


def comparable(records: DataFrame, key: str = "rid") -> DataFrame:
    """(key, train, cls, n, signature, tokens) of the records of the training and evaluation splits that have words.

    A record whose text names its own host in a short line comes twice: with and without such lines.
    """
    split = F.lower(F.trim(F.col("split")))
    # a short line that names the record's own host is a line of the site, however few rows the site has
    host = F.regexp_extract(stock.site_of(F.col("source_url"), F.lit(None).cast("string")), r"^host:(.+)$", 1)
    text = F.col("text").cast("string")
    own = F.concat(F.lit(r"(?im)^.{0,120}\Q"), host, F.lit(r"\E.{0,120}$"))
    # ... or a line of its own words: such a text is compared without the line and with it
    text = F.explode(F.array_distinct(F.array(F.when((host != "") & (F.instr(F.lower(text), host) > 0), F.regexp_replace(text, own, F.lit(""))).otherwise(text), text)))
    rows = records.where(split.isin("train", *EVALUATION)).select(
        F.col(key).cast("long").alias(key), F.xxhash64(stock.site_of(F.col("source_url"), F.col("collection"))).alias("site"), (split == "train").alias("train"), text.alias("text")
    )
    rows = stock.with_stock(records, rows, key).select(key, "train", "text", "stock_keys")

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        cp, off = C.explode(b.column("text"))
        cp, off, _ = C.unify(cp, off)
        cp, off = stock.drop_lines(cp, off, b.column("stock_keys"))
        tok, at = tokens(*running_text(cp, off))
        n = np.diff(at)
        keep = np.flatnonzero(n > 0)
        if not len(keep):
            return None
        cls = C.hash_runs(tok.view(np.uint32), at[keep], at[keep + 1]).view(np.int64)
        sig = []
        spot = C.scramble(tok.view(np.uint32).astype(np.uint64))
        for part in range(2):
            bit = np.where(spot & np.uint64(1) == np.uint64(part), np.uint64(1) << (spot >> np.uint64(58)), np.uint64(0))
            seen = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(bit)])
            sig.append((seen[at[keep + 1]] ^ seen[at[keep]]).view(np.int64))
        data = np.ascontiguousarray(tok).tobytes()
        packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(data)]).take(pa.array(keep))
        take = pa.array(keep)
        return pa.RecordBatch.from_arrays(
            [b.column(key).take(take), b.column("train").take(take), pa.array(cls), pa.array(n[keep].astype(np.int32)), *map(pa.array, sig), packed],
            names=[key, "train", "cls", "n", *SIGNATURE, "tokens"],
        )

    return map_text(rows, run, f"{key} long, train boolean, cls long, n int, {SIGNATURE_TYPES}, tokens binary")


def _unpack(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.int32) if len(col) and off[-1] > off[0] else np.empty(0, np.int32)
    return data, (off - off[0]) // 4


def _window_hash(tok: np.ndarray, at: np.ndarray, w: int) -> np.ndarray:
    """Hash of the w tokens from each position (positions must leave room)."""
    h = np.zeros(len(at), np.uint64)
    for j in range(w):
        h = C.scramble(h + tok[at + j].view(np.uint32).astype(np.uint64) + np.uint64(j + 1))
    return h


def _ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges one after the other, and the range of each."""
    row = np.repeat(np.arange(len(size)), size)
    return np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + start[row], row


def gram_counts(classes: DataFrame, counters: int = COUNTERS) -> np.ndarray:
    """Counters of the three-token stretches of all given classes; stretches share a counter, so counts are never too low."""

    def run(batches):
        field = np.zeros(counters, np.int64)
        for b in batches:
            tok, off = _unpack(b.column("tokens"))
            at, _ = _ranges(off[:-1], np.maximum(np.diff(off) - GRAM + 1, 0))
            field += np.bincount(_window_hash(tok, at, GRAM).astype(np.int64) & (counters - 1), minlength=counters)
        at = np.flatnonzero(field)
        for a in range(0, len(at), 1 << 16):
            part = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(field[part])], names=["at", "k"])

    t = classes.select("tokens").mapInArrow(run, "at int, k long").groupBy("at").agg(F.sum("k").alias("k")).toArrow()
    field = np.zeros(counters, np.int64)
    if t.num_rows:
        field[np.asarray(t["at"])] = np.asarray(t["k"])
    return np.minimum(field, 1 << 30).astype(np.int32)


def rare_count(common: np.ndarray) -> int:
    """A count that still is rare: stretches that share a counter add the noise that most counters show; -1 where noise is all there is."""
    noise = int(np.median(common)) if len(common) else 0
    return RARE + 3 * noise if noise <= NOISE_MOST else -1


def cut(tok: np.ndarray, off: np.ndarray, common: np.ndarray, rare_most: int = RARE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, ordinal, position and length of k + 1 disjoint windows of each text.

    Any k + 1 disjoint windows find all partners, so they are chosen to be rare: first the three-token
    stretches that the counters call rare, then, between those, the rarest of the longest windows of which
    there are enough.
    """
    n = np.diff(off)
    rows = len(n)
    g = allowed(n) + 1
    at, row = _ranges(off[:-1], np.maximum(n - GRAM + 1, 0))
    counts = np.full(len(tok) + 1, 1 << 30, np.int64)
    counts[at] = common[_window_hash(tok, at, GRAM).astype(np.int64) & (len(common) - 1)]
    rare = at[counts[at] <= rare_most]
    rare_row = np.searchsorted(off, rare, "right") - 1
    head = np.ones(len(rare), bool)
    head[1:] = (np.diff(rare) != 1) | (np.diff(rare_row) != 0)
    first = rare[np.flatnonzero(head)][np.cumsum(head) - 1] if len(rare) else rare
    take = (rare - first) % GRAM == 0
    rare, rare_row = rare[take], rare_row[take]
    apart = np.ones(len(rare), bool)
    apart[1:] = (np.diff(rare) >= GRAM) | (np.diff(rare_row) != 0)
    rare, rare_row = rare[apart], rare_row[apart]
    # the rarest g of them, where there are more
    order = np.lexsort((counts[rare], rare_row))
    rank = np.arange(len(order)) - np.searchsorted(rare_row, rare_row[order])
    kept = np.sort(order[rank < g[rare_row[order]]])
    rare, rare_row = rare[kept], rare_row[kept]
    missing = g - np.bincount(rare_row, minlength=rows)
    # the gaps that they leave
    gap_start = np.concatenate([off[:-1], rare + GRAM])
    gap_stop = np.concatenate([off[1:], rare])
    gap_row = np.concatenate([np.arange(rows), rare_row])
    order, stop_order = np.lexsort((gap_start, gap_row)), np.lexsort((gap_stop, gap_row))
    gap_start, gap_stop, gap_row = gap_start[order], gap_stop[stop_order], gap_row[order]
    size = np.maximum(gap_stop - gap_start, 0)
    width = np.zeros(rows, np.int64)
    for w in LENGTHS:
        width[np.bincount(gap_row, size // w, rows) >= missing] = w
    short = np.flatnonzero((width == 0) & (missing > 0))
    width[missing <= 0] = 0
    out = [(rare, np.full(len(rare), GRAM), rare_row)]
    if len(short):  # too crowded: windows of equal length all over
        dropped = np.isin(rare_row, short)
        out = [(rare[~dropped], np.full((~dropped).sum(), GRAM), rare_row[~dropped])]
        each, of = _ranges(np.zeros(len(short), np.int64), g[short])
        r = short[of]
        w = np.array(LENGTHS)[np.searchsorted(LENGTHS, n[short] // g[short], "right") - 1]
        out.append((off[r] + each * n[r] // g[r], w[of], r))
        width[short] = 0
    for w in LENGTHS:
        x = np.flatnonzero((width[gap_row] == w) & (size >= w))
        if not len(x):
            continue
        each, of = _ranges(np.zeros(len(x), np.int64), size[x] // w)
        pos, r = gap_start[x][of] + each * w, gap_row[x][of]
        cost = counts[pos].copy()
        for j in range(1, w - GRAM + 1):
            cost = np.minimum(cost, counts[pos + j])
        order = np.lexsort((cost, r))
        rank = np.arange(len(order)) - np.searchsorted(r, r[order])
        keep = order[rank < missing[r[order]]]
        out.append((pos[keep], np.full(len(keep), w), r[keep]))
    pos, length, row = (np.concatenate(c) for c in zip(*out))
    order = np.lexsort((pos, row))
    pos, length, row = pos[order], length[order], row[order]
    return row, np.arange(len(row)) - np.searchsorted(row, row), pos, length


def segments(classes: DataFrame, common) -> DataFrame:
    """(seg, cls, i, at, n, signature): the k + 1 windows of each evaluation class."""

    def run(batches):
        for big in batches:
            for a in range(0, big.num_rows, 2000):
                b = big.slice(a, 2000)
                tok, off = _unpack(b.column("tokens"))
                row, i, at, size = cut(tok, off, *common.value)
                seg = np.zeros(len(row), np.uint64)
                for w in LENGTHS:
                    x = np.flatnonzero(size == w)
                    seg[x] = C.scramble(_window_hash(tok, at[x], w) + np.uint64(w))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(seg.view(np.int64)), *[b.column(c).take(take) for c in ("cls", "n", *SIGNATURE)], pa.array(i.astype(np.int32)), pa.array((at - off[row]).astype(np.int32))], names=["seg", "cls", "n", *SIGNATURE, "i", "at"])

    return classes.select("cls", "n", *SIGNATURE, "tokens").mapInArrow(run, f"seg long, cls long, n int, {SIGNATURE_TYPES}, i int, at int")


def _bit(seg: np.ndarray, bits: int) -> np.ndarray:
    return (C.scramble(seg.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def seen_bits(segs: DataFrame, bits: int) -> np.ndarray:
    """A filter of fixed size over the windows: it only spares training windows that no evaluation text has."""

    def run(batches):
        field = np.zeros(bits // 64, np.uint64)
        for b in batches:
            x = _bit(np.asarray(b.column("seg")), bits)
            np.bitwise_or.at(field, x >> 6, np.uint64(1) << (x & 63).astype(np.uint64))
        at = np.flatnonzero(field)
        for a in range(0, len(at), 1 << 16):
            part = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(field[part].view(np.int64))], names=["at", "word"])

    words = segs.select("seg").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    field = np.zeros(bits // 64, np.uint64)
    field[np.asarray(words["at"])] = np.asarray(words["word"].combine_chunks() if words.num_rows else pa.array([], pa.int64())).view(np.uint64)
    return field


def windows(classes: DataFrame, field, bits: int) -> DataFrame:
    """(seg, cls, at, n, signature): the windows of the training classes that some evaluation text may have."""

    def run(batches):
        bitmap = field.value
        for big in batches:
            for a in range(0, big.num_rows, 2000):
                b = big.slice(a, 2000)
                tok, off = _unpack(b.column("tokens"))
                for w in LENGTHS:
                    pos, row = _ranges(off[:-1], np.maximum(np.diff(off) - w + 1, 0))
                    seg = C.scramble(_window_hash(tok, pos, w) + np.uint64(w)).view(np.int64)
                    bit = _bit(seg, bits)
                    hit = np.flatnonzero((bitmap[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1))
                    if len(hit):
                        take = pa.array(row[hit])
                        yield pa.RecordBatch.from_arrays([pa.array(seg[hit]), *[b.column(c).take(take) for c in ("cls", "n", *SIGNATURE)], pa.array((pos - off[row])[hit].astype(np.int32))], names=["seg", "cls", "n", *SIGNATURE, "at"])

    return classes.select("cls", "n", *SIGNATURE, "tokens").mapInArrow(run, f"seg long, cls long, n int, {SIGNATURE_TYPES}, at int")


def banded(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, k: int) -> np.ndarray:
    """Edit distances of rows of two padded token tables, right up to k and k + 1 beyond."""
    m, width = len(la), 2 * k + 1
    j = np.arange(width, dtype=np.int32)
    wide = np.full((m, b.shape[1] + width + k + 2), -1, b.dtype)
    wide[:, k : k + b.shape[1]] = b  # column k + x holds b[x]
    big = np.int32(1 << 20)
    d = np.where(j - k < 0, big, j - k)[None, :].repeat(m, 0).astype(np.int32)
    d[(j - k)[None, :] > lb[:, None]] = big
    out = np.where(la == 0, lb, big).astype(np.int32)
    for i in range(1, a.shape[1] + 1):
        at = j + i - k  # positions in b (1-based) of this row's cells
        same = a[:, i - 1 : i] != wide[:, i - 1 : i - 1 + width]
        t = d + same
        t[:, :-1] = np.minimum(t[:, :-1], d[:, 1:] + 1)
        t[:, at < 0] = big
        if i <= k:
            t[:, k - i] = i
        t[at[None, :] > lb[:, None]] = big
        d = np.minimum.accumulate(t - j, axis=1) + j
        done = np.flatnonzero(la == i)
        if len(done):
            cell = lb[done] - i + k
            ok = (cell >= 0) & (cell < width)
            out[done[ok]] = d[done[ok], cell[ok]]
    return np.minimum(out, k + 1)


def verified(candidates: DataFrame) -> DataFrame:
    """(cls_a, cls_b, edits) of candidate pairs (cls_a, cls_b, tokens_a, tokens_b) that are close enough."""

    def run(batches):
        for b in batches:
            ta, oa = _unpack(b.column("tokens_a"))
            tb, ob = _unpack(b.column("tokens_b"))
            na, nb = np.diff(oa), np.diff(ob)
            k = allowed(np.minimum(na, nb))
            order = np.argsort(np.maximum(na, nb), kind="stable")
            edits = np.full(b.num_rows, -1, np.int64)
            at = 0
            while at < len(order):
                longest = int(max(na[order[at]], nb[order[at]])) + 32
                room = max(1, (1 << 21) // (longest + 2 * (longest // SHARE) + 1))
                rows = order[at : at + room]
                rows = rows[np.maximum(na, nb)[rows] <= longest] if len(rows) > 1 else rows
                at += len(rows)
                top = max(int(na[rows].max()), 1), max(int(nb[rows].max()), 1)
                pad = []
                for tok, off, n, w, fill in ((ta, oa, na, top[0], -2), (tb, ob, nb, top[1], -1)):
                    x = np.full((len(rows), w), fill, np.int64)
                    inner = np.arange(w)[None, :] < n[rows][:, None]
                    x[inner] = tok[np.repeat(off[rows] - np.concatenate([[0], np.cumsum(n[rows])])[:-1], n[rows]) + np.arange(n[rows].sum())].view(np.uint32)
                    pad.append(x)
                edits[rows] = banded(pad[0], na[rows], pad[1], nb[rows], int(k[rows].max()))
            ok = np.flatnonzero(edits <= k)
            take = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column("cls_a").take(take), b.column("cls_b").take(take), pa.array(edits[ok].astype(np.int32))], names=["cls_a", "cls_b", "edits"])

    return candidates.mapInArrow(run, "cls_a long, cls_b long, edits int")


def split_hot(e: DataFrame, t: DataFrame, hot: int = HOT, listed: int = HOT_LIST) -> tuple[DataFrame, DataFrame]:
    """Both sides of the window join with a salt: windows in more than hot training texts are split into parts of that size.

    The evaluation side of such a window is repeated for each part, so no task gets a hot window whole.
    """
    counts = held(t.groupBy("seg").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > hot).select("seg", F.ceil(F.col("k") / hot).cast("int").alias("parts")))
    if counts.limit(listed + 1).count() <= listed:
        counts = F.broadcast(counts)
    parts = F.coalesce(F.col("parts"), F.lit(1))
    e = e.join(counts, "seg", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    t = t.join(counts, "seg", "left").withColumn("salt", F.pmod(F.xxhash64("cls"), parts).cast("int")).drop("parts")
    return e, t


def close_classes(rows: DataFrame) -> DataFrame:
    """(cls_a of evaluation, cls_b of training, edits) of different texts within the allowed edits."""
    classes = rows.groupBy("cls").agg(F.first("n").alias("n"), *[F.first(x).alias(x) for x in SIGNATURE], F.first("tokens").alias("tokens"), F.max("train").alias("in_train"), F.min("train").alias("all_train"))
    classes = held(classes)
    ev = classes.where(~F.col("all_train") & (F.col("n") >= SHARE))  # of fewer tokens none may differ
    tr = classes.where(F.col("in_train") & (F.col("n") >= SHARE))
    share = rows.sparkSession.sparkContext.broadcast
    sums = classes.agg(F.sum(F.when(~F.col("all_train"), F.floor(F.col("n") / SHARE) + 1)).alias("k"), F.sum(F.when(F.col("in_train"), F.col("n"))).alias("t")).first()
    keys, counters = sums.k or 0, COUNTERS
    while counters < min(COUNTERS_MOST, (sums.t or 0) // 64):
        counters *= 2
    common = gram_counts(tr, counters)
    segs = segments(ev, share((common, rare_count(common))))
    bits = 1 << 16
    while bits < min(BITS_MOST, BITS_PER_KEY * keys):
        bits *= 2
    field = share(seen_bits(segs, bits))
    e, t = split_hot(segs, held(windows(tr, field, bits)))
    e, t = e.alias("e"), t.alias("t")
    # with k of at most tau edits, some window i is whole, has at most i + k - tau edits before it and tau - i behind it
    tau = F.floor(F.col("e.n") / SHARE)
    shift, more = F.col("t.at") - F.col("e.at"), F.col("t.n") - F.col("e.n")
    k = F.floor(F.least("e.n", "t.n") / SHARE)
    near = (
        (F.col("e.seg") == F.col("t.seg"))
        & (F.col("e.salt") == F.col("t.salt"))
        & (F.col("e.cls") != F.col("t.cls"))
        & (F.abs(more) <= k)
        & (F.abs(shift) <= F.col("e.i") + k - tau)
        & (F.abs(shift - more) <= tau - F.col("e.i"))
        & (sum(F.bit_count(F.col(f"e.{x}").bitwiseXOR(F.col(f"t.{x}"))) for x in SIGNATURE) <= 2 * k)
    )
    pairs = e.join(t, near).select(F.col("e.cls").alias("cls_a"), F.col("t.cls").alias("cls_b")).distinct()
    one = lambda x: classes.select(F.col("cls").alias(f"cls_{x}"), F.col("tokens").alias(f"tokens_{x}"))
    return verified(pairs.join(one("a"), "cls_a").join(one("b"), "cls_b").select("cls_a", "cls_b", "tokens_a", "tokens_b"))


def overlaps(records: DataFrame, key: str = "rid") -> DataFrame:
    """(eval_id, train_id, edits, tokens) of all pairs; rows without words, and of no or another split, pair with none."""
    rows = held(comparable(records, key))
    close = close_classes(rows)
    member = rows.select(F.col(key), "cls", "train", "n")
    ev = member.where(~F.col("train")).select(F.col(key).alias("eval_id"), F.col("cls").alias("cls_a"), F.col("n").alias("tokens"))
    tr = member.where("train").select(F.col(key).alias("train_id"), F.col("cls").alias("cls_b"))
    same = ev.join(tr, F.col("cls_a") == F.col("cls_b")).select("eval_id", "train_id", F.lit(0).alias("edits"), "tokens")
    both = same.unionByName(close.join(ev, "cls_a").join(tr, "cls_b").select("eval_id", "train_id", "edits", "tokens"))
    return both.groupBy("eval_id", "train_id").agg(F.min(F.struct("edits", "tokens")).alias("m")).select("eval_id", "train_id", "m.edits", "m.tokens")


def found(records: DataFrame, key: str = "rid") -> DataFrame:
    p = overlaps(records, key)
    return p.select(F.least("eval_id", "train_id").alias(f"{key}_a"), F.greatest("eval_id", "train_id").alias(f"{key}_b"))


def classes(records: DataFrame, key: str = "rid") -> DataFrame:
    """(key, class_id, copies, near_classes): each record of a text that both splits hold, exactly or nearly, once.

    Records of one class have equal texts (class_id is the hash of the tokens, copies their number); near_classes counts
    the other classes within the bound.  Nothing is expanded to pairs of records, however often a text recurs.
    """
    rows = held(comparable(records, key))
    close = held(close_classes(rows))
    links = close.select(F.col("cls_a").alias("cls"), F.col("cls_b").alias("other")).union(close.select("cls_b", "cls_a")).groupBy("cls").agg(F.count_distinct("other").alias("near_classes"))
    sizes = rows.groupBy("cls").agg(F.count_distinct(key).alias("copies"), F.max("train").alias("in_train"), F.min("train").alias("all_train"))
    both = sizes.join(links, "cls", "left").where((F.col("in_train") & ~F.col("all_train")) | F.col("near_classes").isNotNull())
    return rows.select(key, "cls").distinct().join(both, "cls").select(key, F.col("cls").alias("class_id"), "copies", F.coalesce("near_classes", F.lit(0)).alias("near_classes"))


def report(records: DataFrame, key: str = "rid") -> DataFrame:
    """(split, collection, eval_rows, exact_rows, near_rows, pairs): evaluation rows with an overlap, by split and collection."""
    split = F.lower(F.trim(F.col("split")))
    ev = records.where(split.isin(*EVALUATION)).select(F.col(key).cast("long").alias("eval_id"), split.alias("split"), "collection")
    hit = overlaps(records, key).groupBy("eval_id").agg(F.count(F.lit(1)).alias("pairs"), (F.min("edits") == 0).alias("exact"))
    x = ev.join(hit, "eval_id", "left")
    return x.groupBy("split", "collection").agg(
        F.count(F.lit(1)).alias("eval_rows"), F.count_if("exact").alias("exact_rows"), F.count_if(~F.col("exact")).alias("near_rows"), F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("pairs"),
    )
