"""Train the language network: python -m corpusloom.llm.train_language SF_DIR

Rows of records and documents with a plain language label, at most SAMPLE of them, are the labelled rows.
Their labels are partly wrong; after half of the steps, sentences that the network gives to another
language with confidence are left out.  Sentences of two languages are put together so that it learns to
label each position.  The weights go to lang_gru.npz beside this module.
"""

from __future__ import annotations

import re
import sys
import time
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

from . import gru, markup
from .language import CODES, code_of

SAMPLE, HIDDEN, STEPS, BATCH, WIDTH = 24_000, 16, 2000, 192, 192

ENDS = re.compile(r"(?<=[.!?。！？])\s*|\n+")


def sentences(sf_dir: str, rng: np.random.Generator) -> list[tuple[bytes, int]]:
    out = []
    for name, column in (("records", "language"), ("documents", "lang")):
        t = pq.read_table(f"{sf_dir}/{name}.parquet", columns=["text", column])
        rows = [(x, code_of(y)) for x, y in zip(t["text"].to_pylist(), t[column].to_pylist()) if x and code_of(y) in CODES]
        for i in rng.permutation(len(rows))[: SAMPLE // 2]:
            text, code = rows[i]
            parts = [s.strip() for s in ENDS.split(markup.bare(text, True)) if len(s.strip()) > 5 and re.search(r"[^\W\d]", s)]
            out += [(s.encode(), CODES.index(code)) for s in parts[:6]]
    return out


def batch(pool: list, by: list, rng: np.random.Generator) -> tuple:
    data, label, start, size = [], [], [], []
    at = 0
    for _ in range(BATCH):
        s, y = pool[rng.choice(by[rng.integers(len(by))])]
        parts = [(s, y)]
        while sum(len(x) for x, _ in parts) < WIDTH and rng.random() < 0.7:
            k = y if rng.random() < 0.5 else rng.integers(len(by))
            parts.append(pool[rng.choice(by[k])])
        text, lab = [], []
        for x, k in parts:
            if rng.random() < 0.06:
                x = x.decode().upper().encode()
            text.append(x + (b" " if rng.random() < 0.6 else b"\n"))
            lab.append(np.full(len(x) + 1, k))
        x = np.frombuffer(b"".join(text), np.uint8)
        k = np.concatenate(lab)
        cut = int(rng.integers(0, max(1, len(x) - WIDTH)))
        x, k = x[cut : cut + WIDTH], k[cut : cut + WIDTH]
        data.append(x)
        label.append(k)
        start.append(at)
        size.append(len(x))
        at += len(x)
    return np.concatenate(data), np.array(start), np.array(size), np.concatenate(label)


def main(sf_dir: str) -> None:
    rng = np.random.default_rng(20)
    pool = sentences(sf_dir, rng)
    split = len(pool) * 9 // 10
    order = rng.permutation(len(pool))
    held, pool = [pool[i] for i in order[split:]], [pool[i] for i in order[:split]]
    by = [np.array([i for i, (_, y) in enumerate(pool) if y == k]) for k in range(len(CODES))]
    print("sentences", len(pool), [len(b) for b in by], flush=True)
    p = gru.init(HIDDEN, len(CODES), rng)
    opt = gru.Adam(p, 0.004)
    t0 = time.time()
    for step in range(STEPS):
        g, loss, right = gru.gradients(p, *batch(pool, by, rng))
        opt.step(g, 0.004 * min(1, 1.3 * (1 - step / STEPS)))
        if step % 100 == 99:
            print(step + 1, round(loss, 4), round(right, 4), round(time.time() - t0), flush=True)
        if step in (STEPS // 3, STEPS * 2 // 3):
            wrong = judged(p, pool)
            by = [np.array([i for i in b if not wrong[i]]) for b in by]
            print("left out", int(wrong.sum()), flush=True)
    wrong = judged(p, held)
    print("held out: sentences whose label the network contradicts", wrong.mean())
    gru.save(str(Path(__file__).with_name("lang_gru.npz")), p)


def judged(p: dict, pool: list) -> np.ndarray:
    out = np.zeros(len(pool), bool)
    for a in range(0, len(pool), 4000):
        part = pool[a : a + 4000]
        size = np.array([len(s) for s, _ in part])
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        q = gru.softmax(gru.logits(p, np.frombuffer(b"".join(s for s, _ in part), np.uint8), start, size))
        mean = np.add.reduceat(q, start, 0) / size[:, None]
        out[a : a + 4000] = (mean.argmax(1) != np.array([y for _, y in part])) & (mean.max(1) > 0.6)
    return out


if __name__ == "__main__":
    main(sys.argv[1])
