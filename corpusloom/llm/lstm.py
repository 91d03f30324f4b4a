"""A bidirectional LSTM over characters with a linear-chain CRF on top, trained and run in numpy.

The input gate is coupled to the forget gate (1 - forget), and the gates are piecewise linear (a quarter of the
argument plus a half, kept within 0 and 1).  Sequences are sorted by falling length and their symbols laid out step by
step, so that the ones alive at any step lie side by side and no step gathers or scatters states.  The CRF is trained by
forward-backward and decoded by Viterbi, over whole batches.
"""

from __future__ import annotations

import numpy as np

from .gru import _alive, packed

#: tanh(2 q) = factor q (b + y / (y y - a)) with y = q q + k, for q within -1/2 and 1/2, fitted for the least largest error: factor, k, a, b
TANH = 2.02967168, -3.04382987, 13.42027484, 0.51325534 / 2.02967168


def init(symbols: int, hidden: int, tags: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Columns of the step weights: forget gate, output gate, candidate."""
    p = {}
    for d in "fb":
        p[d + "x"] = (rng.standard_normal((symbols, 3 * hidden)) * 0.3).astype(np.float32)
        p[d + "u"] = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        p[d + "b"] = np.concatenate([np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        p[d + "o"] = (rng.standard_normal((hidden, tags)) / np.sqrt(hidden)).astype(np.float32)
    p["ob"] = np.zeros(tags, np.float32)
    p["tr"] = np.zeros((tags, tags), np.float32)
    return p


def states(p: dict, d: str, symbol: np.ndarray, alive: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden state at every place of the layout, and what training needs of each step."""
    h = p[d + "u"].shape[0]
    x, u = p[d + "x"] + p[d + "b"], p[d + "u"]
    n = int(alive[0]) if len(alive) else 0
    out, hid, cell = np.empty((len(symbol), h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
    saved = []
    for t in range(len(alive)) if d == "f" else range(len(alive) - 1, -1, -1):
        m, at = alive[t], head[t]
        before = hid[:m].copy(), cell[:m].copy()
        a = x[symbol[at : at + m]] + before[0] @ u
        s = np.clip(a[:, : 2 * h] * np.float32(0.25) + np.float32(0.5), 0, 1)
        g = np.tanh(a[:, 2 * h :])
        cell[:m] = g + s[:, :h] * (before[1] - g)
        tc = np.tanh(cell[:m])
        hid[:m] = out[at : at + m] = tc * s[:, h:]
        saved.append((t, s, g, tc, *before))
    return out, saved


def put_scores(p: dict, d: str, symbol: np.ndarray, alive: np.ndarray, head: np.ndarray, scores: np.ndarray) -> None:
    """Tag scores of one direction, without the bias, at every place of the layout, forward first; nothing is kept for training.

    Library calls of tanh would be the largest part of a step.  The candidate is kept as half its tanh, 1 / (1 + exp(-2 x)) - 1/2,
    so the cell is half the cell; it stays within -1/2 and 1/2, as the gates only mix, where TANH is right to 6e-7.  The
    factors -2, 1/4 and that of TANH are in the weights.  The gates lie one after another in one array, so one call serves all.
    """
    h = p[d + "u"].shape[0]
    slope = np.concatenate([np.full(2 * h, 0.25), np.full(h, -2.0)]).astype(np.float32)
    middle = np.concatenate([np.full(2 * h, 0.5), np.zeros(h)]).astype(np.float32)
    factor, *tanh = map(np.float32, TANH)
    x, u = (np.ascontiguousarray(m.reshape(-1, 3, h).swapaxes(0, 1)) for m in ((p[d + "x"] + p[d + "b"]) * slope + middle, p[d + "u"] * slope * factor))
    w = p[d + "o"] * factor
    one, half, k, a, b = map(np.array, (np.float32(1), np.float32(0.5), *tanh))  # as arrays: numbers are made arrays in each call
    n = int(alive[0]) if len(alive) else 0
    part = np.empty((n, scores.shape[1]), np.float32)
    hid, cell, gates, fed = (np.zeros((j * n, h), np.float32) for j in (1, 1, 3, 3))
    low, high = np.zeros((2 * n, h), np.float32), np.ones((2 * n, h), np.float32)  # bounds in arrays: faster than bounds that are numbers
    steps = list(zip(alive.tolist(), head.tolist()))
    with np.errstate(over="ignore"):  # the exponential of a large argument is infinite, its share 0
        for m, at in steps if d == "f" else reversed(steps):
            every, v3, both = gates[: 3 * m], fed[: 3 * m], gates[: 2 * m]
            f, o, g, v, q, state = every[:m], every[m : 2 * m], every[2 * m :], v3[:m], cell[:m], hid[:m]
            x.take(symbol[at : at + m], 1, every.reshape(3, m, h), "clip")
            np.matmul(state, u, v3.reshape(3, m, h))
            np.add(every, v3, every)
            np.maximum(both, low[: 2 * m], both)
            np.minimum(both, high[: 2 * m], both)
            np.exp(g, g)
            np.add(g, one, g)
            np.divide(one, g, g)
            np.subtract(g, half, g)
            np.subtract(q, g, q)
            np.multiply(q, f, q)
            np.add(q, g, q)
            # tanh(2 q) = factor q (b + y / (y y - a)), y = q q + k
            np.square(q, g)
            np.add(g, k, g)
            np.square(g, v)
            np.subtract(v, a, v)
            np.divide(g, v, v)
            np.add(v, b, v)
            np.multiply(v, q, v)
            np.multiply(v, o, state)
            if d == "f":  # while the states are at hand
                np.matmul(state, w, scores[at : at + m])
            else:
                s, e = part[:m], scores[at : at + m]
                np.matmul(state, w, s)
                np.add(e, s, e)


def laid_scores(p: dict, data: np.ndarray, place: np.ndarray, alive: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Tag scores, without the bias, at every place of the layout."""
    symbol = data[place].astype(np.intp)  # as take wants it
    e = np.empty((len(symbol), len(p["ob"])), np.float32)
    for d in "fb":
        put_scores(p, d, symbol, alive, head, e)
    return e


def emissions(p: dict, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Tag scores (positions, tags) of the symbols of all sequences; 0 at positions of none."""
    order = np.argsort(-size, kind="stable")
    alive, head, place = packed(start[order], size[order])
    e = np.zeros((len(data), len(p["ob"])), np.float32)
    e[place] = laid_scores(p, data, place, alive, head) + p["ob"]
    return e


def decode(p: dict, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Best tag of the symbols of all sequences: viterbi of what lively leaves of emissions; 0 at positions of none.

    The scores stay as they are laid out; only those of the stretches are taken.
    """
    tags = np.zeros(len(data), np.int8)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    if not len(order):
        return tags
    start, size = start[order], size[order]
    # as packed, step by step: index arrays of its length would cost more
    alive = _alive(size)
    head = np.concatenate([[0], np.cumsum(alive)])
    place = np.empty(head[-1], np.intp)
    for t, (m, at) in enumerate(zip(alive.tolist(), head.tolist())):
        np.add(start[:m], t, out=place[at : at + m])
    scores = laid_scores(p, data, place, alive, head)
    a, n, row, left, right = _stretches(scores, p["tr"], p["ob"], start, size, alive, head, place)
    at = np.cumsum(n) - n
    step = np.arange(n.sum()) + np.repeat(a - start[row] - at, n)
    e = scores.take(head[step] + np.repeat(row, n), 0)
    e += p["ob"]
    e[at[left], 1:] = -1e9
    e[(at + n)[right] - 1, 1:] = -1e9
    tags[step + np.repeat(start[row], n)] = viterbi(e, p["tr"], at, n)
    return tags


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


def crf_gradients(e: np.ndarray, tr: np.ndarray, tag: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss per sequence and gradients, for a batch (length, sequences, tags) of equal length."""
    length, n, k = e.shape
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = e[0]
    for t in range(1, length):
        a[t] = _lse(a[t - 1, :, :, None] + tr[None], 1) + e[t]
    for t in range(length - 2, -1, -1):
        b[t] = _lse(tr[None] + (e[t + 1] + b[t + 1])[:, None, :], 2)
    z = _lse(a[-1], 1)
    q = np.exp(a + b - z[None, :, None])
    left, right = a[:-1] - z[None, :, None] / 2, e[1:] + b[1:] - z[None, :, None] / 2
    top = left.max(2, keepdims=True), right.max(2, keepdims=True)
    w = np.exp(left - top[0]) * np.exp(np.minimum(top[0] + top[1], 80.0))
    gtr = np.einsum("tni,tnj->ij", w, np.exp(right - top[1])) * np.exp(tr)
    rows, cols = np.arange(length)[:, None], np.arange(n)[None]
    score = e[rows, cols, tag].sum(0) + tr[tag[:-1], tag[1:]].sum(0)
    q[rows, cols, tag] -= 1
    np.subtract.at(gtr, (tag[:-1], tag[1:]), 1)
    return float((z - score).mean()), q / n, gtr / n


def gradients(p: dict, data: np.ndarray, tag: np.ndarray) -> tuple[dict, float]:
    """data and tag: (length, sequences)."""
    length, n = data.shape
    flat = data.reshape(-1)
    alive, head = np.full(length, n), np.arange(length + 1) * n
    runs = {d: states(p, d, flat, alive, head) for d in "fb"}
    e = (runs["f"][0] @ p["fo"] + runs["b"][0] @ p["bo"] + p["ob"]).reshape(length, n, -1)
    loss, ge, gtr = crf_gradients(e.astype(np.float64), p["tr"].astype(np.float64), tag)
    ge = ge.reshape(length * n, -1).astype(np.float32)
    g = {"ob": ge.sum(0), "tr": gtr.astype(np.float32)}
    for d in "fb":
        out, saved = runs[d]
        h = out.shape[1]
        g[d + "o"] = out.T @ ge
        up = (ge @ p[d + "o"].T).reshape(length, n, h)
        u = p[d + "u"]
        gu = np.zeros_like(u)
        inner = np.empty((length, n, 3 * h), np.float32)
        dhid, dcell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for t, s, c, tc, hid, cell in reversed(saved):
            f, o = s[:, :h], s[:, h:]
            dh = dhid + up[t]
            dc = dcell + dh * o * (1 - tc * tc)
            on = ((s > 0) & (s < 1)) * np.float32(0.25)
            dg = inner[t]
            dg[:, : 2 * h] = np.concatenate([dc * (cell - c), dh * tc], 1) * on
            dg[:, 2 * h :] = dc * (1 - f) * (1 - c * c)
            gu += hid.T @ dg
            dhid = dg @ u.T
            dcell = dc * f
        inner = inner.reshape(length * n, 3 * h)
        gx = np.stack([np.bincount(flat, inner[:, j], len(p[d + "x"])) for j in range(3 * h)], 1).astype(np.float32)
        g[d + "x"], g[d + "u"], g[d + "b"] = gx, gu, inner.sum(0)
    return g, loss


def _merged(a: np.ndarray, b: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted ranges of rows, those put together that touch or leave fewer than three positions between them."""
    order = np.argsort(a, kind="stable")
    a, b, row = a[order], np.maximum.accumulate(b[order]), row[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] > b[:-1] + 2) | (row[1:] != row[:-1])
    return a[first], b[np.append(first[1:], True)] if len(a) else b, row[first]


def _best_runs(gain: np.ndarray, alive: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The largest sum of gains of a run through each place of the layout."""
    g = gain.astype(np.float64)
    most = g.copy()
    steps = list(zip(alive.tolist(), head.tolist()))
    for way in (steps, reversed(steps)):
        run = np.zeros(alive[0])
        low = np.zeros(alive[0])
        for m, at in way:  # what the run up to here brings, if it brings anything
            r, here = run[:m], most[at : at + m]
            np.add(here, r, here)
            np.add(r, g[at : at + m], r)
            np.maximum(r, low[:m], r)
    return most


def _stretches(e: np.ndarray, tr: np.ndarray, bias: np.ndarray, start: np.ndarray, size: np.ndarray, alive: np.ndarray, head: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, sizes and sequences of the stretches that lively describes, in order, and which of them begin and which end
    with a position whose other tags are ruled out.  e: scores without bias in the layout of the sequences."""
    s = (tr - tr[0, 0]).astype(np.float64)
    # a step from j to k counts as that much less by shift[j] - shift[k]: any shift is right, this one makes a beginning
    # pay what its step to a continuation has over the step between continuations
    inner = np.arange(2, len(s), 2)
    over = s[1:, inner] - s[inner, inner]
    over[inner - 1, np.arange(len(inner))] = 0
    shift = -np.maximum(over.max(1, initial=0), 0)
    into = np.maximum((s[1:, 1:] + shift[:, None]).max(0), s[0, 1:]) - shift
    leave = (s[1:, 0] + shift).max()
    lead = (bias[1:] - bias[0])[:, None]
    gain, more = np.empty(len(e), np.float32), (into[:, None] + lead).astype(np.float32)
    for i in range(0, len(e), 4096):  # turned in pieces that stay in the cache
        t = np.ascontiguousarray(e[i : i + 4096].T)
        t[1:] += more
        np.subtract(t[1:].max(0), t[0], out=gain[i : i + 4096])
    n = len(size)
    first = e[:n].T
    gain[:n] = np.maximum(gain[:n], (first[1:] + lead - shift[:, None]).max(0) - first[0])
    gain[head[size - 1] + np.arange(n)] += max(0.0, shift.max() - leave)
    open_at = np.sort(place[_best_runs(gain, alive, head) > -1e-2 - leave])
    by = np.argsort(start, kind="stable")
    lo, hi, row = _merged(open_at, open_at + 1, by[np.searchsorted(start[by], open_at, "right") - 1])
    a, b = np.maximum(lo - 1, start[row]), np.minimum(hi + 1, (start + size)[row])
    return a, b - a, row, a < lo, b > hi


def lively(e: np.ndarray, tr: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the stretches that must be decoded; elsewhere tag 0 is on a best path, whatever the rest is.

    A run of other tags is on the best path only if it gains on the same run of tag 0.  A bound of that gain is a sum
    over its positions: the lead of the best other tag, with the most that a step to that tag can bring, and the most
    that leaving the run can bring.  Positions in no run whose bound is positive stay tag 0.  Stretches keep one such
    position at each side where the text goes on, whose other tags are ruled out in e.
    """
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    start, size = start[order], size[order]
    if not len(size):
        return start, size
    alive, head, place = packed(start, size)
    a, n, _, left, right = _stretches(e.take(place, 0), tr, np.zeros(len(tr), np.float32), start, size, alive, head, place)
    e[a[left], 1:] = -1e9
    e[(a + n)[right] - 1, 1:] = -1e9
    return a, n


FEW = 512  # sequences decoded at once: what a step needs stays in the cache


def viterbi(e: np.ndarray, tr: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Best tag at every position of the flat emissions, sequences in any order."""
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    out = np.zeros(len(e), np.int8)
    for i in range(0, len(order), max(FEW, 1)):
        some = order[i : i + max(FEW, 1)]
        alive, head, place = packed(start[some], size[some])
        out[place] = _best_tags(np.ascontiguousarray(e.take(place, 0).T), tr, size[some], alive.tolist(), head.tolist())
    return out


def _best_tags(e: np.ndarray, tr: np.ndarray, size: np.ndarray, alive: list[int], head: list[int]) -> np.ndarray:
    """viterbi of scores (tags, places of the layout); e becomes the score of the best path up to each place and tag.

    Which tag comes before is looked up on the way back, for the best path alone, by the sums of the way there.
    """
    step = tr[:, :, None]
    for t in range(1, len(alive)):
        m, at = alive[t], head[t]
        e[:, at : at + m] += (e[:, None, head[t - 1] : head[t - 1] + m] + step).max(0)
    out = np.empty(e.shape[1], np.int8)
    tag = e[:, np.array(head)[size - 1] + np.arange(len(size))].argmax(0)
    for t in range(len(alive) - 1, -1, -1):
        m, at = alive[t], head[t]
        out[at : at + m] = tag[:m]
        if t:
            tag[:m] = (e[:, head[t - 1] : head[t - 1] + m] + tr[:, tag[:m]]).argmax(0)
    return out
