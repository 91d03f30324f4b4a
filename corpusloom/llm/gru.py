"""A bidirectional gated recurrent network over bytes, forward and by backpropagation through time, in numpy.

Sequences of a batch are sorted by falling length, so that the ones alive at any step are a prefix and no
step works on padding.  Gates are computed as tanh of half the argument, which is the logistic function.
"""

from __future__ import annotations

import numpy as np

SYMBOLS = 256


def init(hidden: int, classes: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p[d + "x"] = (rng.standard_normal((SYMBOLS, 3 * hidden)) * 0.3).astype(np.float32)
        p[d + "u"] = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        p[d + "b"] = np.zeros(3 * hidden, np.float32)
        p[d + "o"] = (rng.standard_normal((hidden, classes)) / np.sqrt(hidden)).astype(np.float32)
    p["ob"] = np.zeros(classes, np.float32)
    return p


def _alive(size: np.ndarray) -> np.ndarray:
    """How many of the sequences (sorted by falling length) are longer than t, for each t."""
    return np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")


def states(p: dict, d: str, data: np.ndarray, start: np.ndarray, size: np.ndarray, keep: bool = False):
    """Hidden state at every position of the flat data, for sequences sorted by falling length."""
    h = p[d + "u"].shape[0]
    data = data.astype(np.intp)  # as take wants it
    # halving the gate weights beforehand leaves one tanh for both gates
    half = np.concatenate([np.full(2 * h, 0.5), np.ones(h)]).astype(np.float32)
    x, u = (p[d + "x"] + p[d + "b"]) * half, p[d + "u"] * half
    ug, uc = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
    out = np.zeros((len(data), h), np.float32)
    n = len(size)
    state = np.zeros((n, h), np.float32)
    xg, xc = np.ascontiguousarray(x[:, : 2 * h]), np.ascontiguousarray(x[:, 2 * h :])
    gates, inner, fed, cand = (np.empty((n, k), np.float32) for k in (2 * h, h, 2 * h, h))
    place = start.copy() if d == "f" else start + size - 1
    step = 1 if d == "f" else -1
    saved = []
    for m in _alive(size) if n else ():
        at = place[:m]
        symbol = data[at]
        s, zr, r, c = state[:m], gates[:m], inner[:m], cand[:m]
        np.take(xg, symbol, 0, zr, "clip")
        np.take(xc, symbol, 0, c, "clip")
        zr += np.matmul(s, ug, out=fed[:m])
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        np.multiply(zr[:, h:], s, out=r)
        c += np.matmul(r, uc, out=fed.reshape(-1)[: m * h].reshape(m, h))
        np.tanh(c, out=c)
        if keep:
            saved.append((at.copy(), s.copy(), zr.copy(), r.copy(), c.copy()))
        # s + z (c - s)
        c -= s
        c *= zr[:, :h]
        s += c
        out[at] = s
        at += step
    return (out, saved) if keep else out


def logits(p: dict, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    return states(p, "f", data, start, size) @ p["fo"] + states(p, "b", data, start, size) @ p["bo"] + p["ob"]


def packed(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences alive at each step, where each step begins, and the flat position behind each place of the layout."""
    alive = _alive(size)
    head = np.concatenate([[0], np.cumsum(alive)])
    step = np.repeat(np.arange(len(alive)), alive)
    return alive, head, start[np.arange(head[-1]) - head[step]] + step


def half_states(p: dict, d: str, symbol: np.ndarray, alive: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Half the hidden state at every place of the layout; nothing is kept for training.

    Library calls of tanh would be the largest part of a step.  Gates come as 1 + exp(-x), by which is divided, and the
    candidate as half its tanh, 1 / (1 + exp(-2 x)) - 1/2.  The factors are in the weights.
    """
    h = p[d + "u"].shape[0]
    slope = np.concatenate([np.full(2 * h, -1.0), np.full(h, -2.0)]).astype(np.float32)
    x, u = (p[d + "x"] + p[d + "b"]) * slope, p[d + "u"] * slope * 2
    # each gate in an array of its own: no operation then strides over the others
    (xz, xr, xc), (uz, ur, uc) = ([np.ascontiguousarray(m[:, j * h : (j + 1) * h]) for j in range(3)] for m in (x, u))
    one, half = np.float32(1), np.float32(0.5)
    n = int(alive[0])
    out = np.empty((len(symbol), h), np.float32)
    state, stay, reset, cand, free = (np.zeros((n, h), np.float32) for _ in range(5))
    with np.errstate(over="ignore"):  # the exponential of a large argument is infinite, its share 0
        for t in range(len(alive)) if d == "f" else range(len(alive) - 1, -1, -1):
            m, at = int(alive[t]), int(head[t])
            now = symbol[at : at + m]
            s, z, r, c, v = state[:m], stay[:m], reset[:m], cand[:m], free[:m]
            for table, weight, gate in ((xz, uz, z), (xr, ur, r)):
                table.take(now, 0, gate, "clip")
                np.matmul(s, weight, out=v)
                gate += v
                np.exp(gate, out=gate)
                gate += one
            np.divide(s, r, out=r)
            xc.take(now, 0, c, "clip")
            np.matmul(r, uc, out=v)
            c += v
            np.exp(c, out=c)
            c += one
            np.divide(one, c, out=c)
            c -= half
            # s + z (c - s)
            c -= s
            c /= z
            s += c
            out[at : at + m] = s
    return out


def probabilities(p: dict, data: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """(classes, positions), of all positions or those of at: one row for each class, which keeps the passes over the classes contiguous."""
    order = np.argsort(-size, kind="stable")
    alive, head, place = packed(start[order], size[order])
    symbol = data[place].astype(np.intp)  # as take wants it
    x = (p["fo"].T * 2) @ half_states(p, "f", symbol, alive, head).T
    x += (p["bo"].T * 2) @ half_states(p, "b", symbol, alive, head).T
    back = np.zeros(len(data), np.intp)
    back[place] = np.arange(len(place))
    x = x.take(back if at is None else back[at], 1)
    x += p["ob"][:, None]
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    x /= x.sum(1, keepdims=True)
    return x


def gradients(p: dict, data: np.ndarray, start: np.ndarray, size: np.ndarray, label: np.ndarray) -> tuple[dict, float, float]:
    """Gradients, mean loss and accuracy; positions labelled -1 carry no loss."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    runs = {d: states(p, d, data, start, size, True) for d in "fb"}
    x = runs["f"][0] @ p["fo"] + runs["b"][0] @ p["bo"] + p["ob"]
    q = softmax(x)
    on = np.flatnonzero(label >= 0)
    n = max(len(on), 1)
    loss = -np.log(np.maximum(q[on, label[on]], 1e-9)).sum() / n
    right = (q[on].argmax(1) == label[on]).mean() if len(on) else 0.0
    e = np.zeros_like(q)
    e[on] = q[on]
    e[on, label[on]] -= 1
    e /= n
    g = {"ob": e.sum(0)}
    for d in "fb":
        out, saved = runs[d]
        h = out.shape[1]
        g[d + "o"] = out.T @ e
        up = e @ p[d + "o"].T
        u = p[d + "u"]
        gx, gu = np.zeros_like(p[d + "x"]), np.zeros_like(u)
        carry = np.zeros((len(size), h), np.float32)
        for at, s, zr, r, c in reversed(saved):
            m = len(at)
            dh = carry[:m] + up[at]
            z, rr = zr[:, :h], zr[:, h:]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - s) * z * (1 - z)
            dr_in = dc @ u[:, 2 * h :].T
            dr = dr_in * s * rr * (1 - rr)
            dg = np.concatenate([dz, dr, dc], 1)
            gu[:, : 2 * h] += s.T @ dg[:, : 2 * h]
            gu[:, 2 * h :] += r.T @ dc
            np.add.at(gx, data[at], dg)
            carry[:m] = dh * (1 - z) + dr_in * rr + dg[:, : 2 * h] @ u[:, : 2 * h].T
        g[d + "x"], g[d + "u"], g[d + "b"] = gx, gu, gx.sum(0)
    return g, float(loss), float(right)


class Adam:
    def __init__(self, p: dict, rate: float) -> None:
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict, rate: float | None = None) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for k, x in g.items():
            x = x * scale
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.002 * (x * x - self.v[k])
            self.p[k] -= (rate or self.rate) * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.998**self.t)) + 1e-8)


def save(path: str, p: dict) -> None:
    np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in p.items()})


def load(name: str) -> dict[str, np.ndarray]:
    import io
    import pkgutil

    with np.load(io.BytesIO(pkgutil.get_data(__package__, name))) as z:
        return {k: z[k].astype(np.float32) for k in z.files}
