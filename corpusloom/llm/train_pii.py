"""Train the personal-data tagger: python -m corpusloom.llm.train_pii SF_DIR [OUT.npz [HIDDEN [STEPS [START.npz]]]]; from START the
training goes on at half the rate

Three kinds of labelled text are mixed: at most SAMPLE documents with the spans of pii_labels, whose names and figures
are varied at random; carrier sentences of pii_carriers filled with invented data, among sentences of the documents;
and sentences of the documents into which names, numbers, addresses or bodies are put.  The weights go to pii_lstm.npz
beside this module.
"""

from __future__ import annotations

import re
import sys
import time
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

from . import codepoints as C
from . import gru, lstm
from . import pii_carriers as made
from .pii import SYMBOLS, TAGS, symbol_table
from .pii_labels import KINDS, spans

SAMPLE, HIDDEN, STEPS, BATCH, WIDTH = 3000, 20, 5500, 88, 144
SYLLABLES = "ba be bo da de dor el fa gar hal i jo ka kel la len lo ma mar mel na nor o pa pel quen ra rin ro sa sel so ta tor u va vel wen wick yn za".split()


def varied(text: str, sp: list, rng: np.random.Generator) -> tuple[str, list]:
    """The text with some spans altered: other figures, invented names."""
    out, new, pos = [], [], 0
    n = 0
    for a, b, k in sp:
        piece = text[a:b]
        if rng.random() < 0.6 and KINDS[k] != "person_name":
            piece = "".join(str(rng.integers(10)) if c.isdigit() and c.isascii() else c for c in piece)
        if rng.random() < 0.5 and KINDS[k] in ("person_name", "street_address", "email"):
            words = []
            for w in re.split(r"([^A-Za-zÀ-ÿ]+)", piece):
                if len(w) > 3 and w.isalpha() and w.lower() not in ("flat", "road", "street", "lane", "avenue", "close", "drive", "court", "rue", "calle", "chemin", "weg"):
                    s = "".join(rng.choice(SYLLABLES) for _ in range(rng.integers(2, 4)))
                    w = s.upper() if w.isupper() else s.capitalize() if w[0].isupper() else s
                words.append(w)
            piece = "".join(words)
            if rng.random() < 0.5:
                piece = "".join(chr(int(rng.integers(0x4E00, 0x9FA0))) if "一" <= c <= "鿿" and KINDS[k] == "person_name" and rng.random() < 0.6 else c for c in piece)
        out.append(text[pos:a])
        n += a - pos
        new.append((n, n + len(piece), k))
        out.append(piece)
        n += len(piece)
        pos = b
    out.append(text[pos:])
    return "".join(out), new


# Words that join a name to a sentence, by language.
JOINTS = {
    "en": (", {},| by {}| with {}| ({})| and {}| for {}| from {}", " to {}| at {}| ({})|: {}"),
    "de": (", {},| von {}| mit {}| ({})| und {}| für {}", " an {}| in der {}| ({})|: {}"),
    "fr": (", {},| par {}| avec {}| ({})| et {}| pour {}", " au {}| à {}| ({})| : {}"),
    "es": (", {},| por {}| con {}| ({})| y {}| para {}", " a {}| en {}| ({})|: {}"),
    "zh": ("由{}|与{}|、{}、|（{}）|和{}", "（{}）|：{}|在{}"),
    "ja": ("、{}、|（{}）|と{}|の{}", "（{}）|：{}|、{}で"),
}
SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]?")


def inserted(sentence: str, lang: str, rng: np.random.Generator) -> tuple[str, list]:
    """A sentence of a document with a slot put in at a random place, filled."""
    cuts = [m.start() for m in re.finditer(r"(?<=\w)(?= )", sentence)] if lang not in ("zh", "ja") else list(range(1, len(sentence)))
    if not cuts or re.search(r"[{}]", sentence):
        return sentence, []
    slot = "NNNNNNoooEPIAA"[rng.integers(14)]
    at = cuts[rng.integers(len(cuts))]
    if slot in "No" and rng.random() < 0.3:
        return made.filled("{%s}%s%s" % (slot, "" if lang in ("zh", "ja") else " ", sentence[:1].lower() + sentence[1:]), lang, rng)
    if lang in ("zh", "ja") and rng.random() < 0.6:
        return made.filled(sentence[:at] + "{%s}" % slot + sentence[at:], lang, rng)
    joint = made.pick(rng, [*JOINTS[lang][slot not in "No"].split("|")]).replace("{}", "{%s}" % slot)
    return made.filled(sentence[:at] + joint + sentence[at:], lang, rng)


def put_together(lang: str, sentences: list[str], rng: np.random.Generator) -> tuple[str, list]:
    """Carriers, sentences of documents and sentences with insertions of one language, one after the other."""
    text, spans = "", []
    for _ in range(rng.integers(1, 4)):
        x = rng.random()
        own = sentences[rng.integers(len(sentences))]
        if x < 0.85:
            carrier = made.aside(lang, rng) if x < 0.1 else made.composed(lang, rng) if x < 0.45 else made.pick(rng, made.lines(lang)) if x < 0.65 else ""
            part, sp = made.filled(carrier, lang, rng) if carrier else inserted(own, lang, rng)
        else:
            part, sp = own, []
        if text:
            text += "\n" if rng.random() < 0.3 else "" if lang in ("zh", "ja") else " "
        spans += [(a + len(text), b + len(text), k) for a, b, k in sp]
        text += part
    return text, spans


def main(sf_dir: str, out: str = str(Path(__file__).with_name("pii_lstm.npz")), hidden: str = str(HIDDEN), steps: str = str(STEPS), begin: str = "") -> None:
    rng = np.random.default_rng(10)
    n_steps = int(steps)
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text", "lang"])
    both = [(x, y) for x, y in zip(t["text"].to_pylist(), t["lang"].to_pylist()) if x]
    both = [both[i] for i in rng.permutation(len(both))[: SAMPLE + SAMPLE // 10]]
    rows = [(x, spans(x)) for x, _ in both]
    held, rows = rows[SAMPLE:], rows[:SAMPLE]
    pool: dict[str, list[str]] = {k: [] for k in made.CARRIERS}
    for (x, y), (_, sp) in zip(both[:SAMPLE], rows):
        if y in pool and not sp:
            pool[y] += [s.strip() for s in SENTENCE.findall(x) if 12 < len(s) < 200]
    places = [(i, j) for i, (_, sp) in enumerate(rows) for j in range(len(sp))]
    print("documents", len(rows), "spans", len(places), {k: len(v) for k, v in pool.items()}, flush=True)
    p = lstm.init(SYMBOLS, int(hidden), TAGS, rng)
    rate = 0.006
    if begin:
        with np.load(begin) as z:
            p, rate = {k: z[k].astype(np.float32) for k in z.files}, rate / 2
    opt = gru.Adam(p, rate)
    t0 = time.time()
    table = symbol_table()
    langs = list(pool)
    for step in range(n_steps):
        data, tags = np.full((BATCH, WIDTH), 10, np.int64), np.zeros((BATCH, WIDTH), np.int64)
        for r in range(BATCH):
            x = rng.random()
            if x < 0.28:
                i, j = places[rng.integers(len(places))]
                text, sp = varied(*rows[i], rng)
                at = max(0, sp[j][0] - int(rng.integers(10, WIDTH - 30)))
            elif x < 0.38:
                i = int(rng.integers(len(rows)))
                text, sp = varied(*rows[i], rng)
                at = int(rng.integers(0, max(1, len(text) - WIDTH)))
            else:
                lang = langs[rng.integers(len(langs))]
                text, sp = put_together(lang, pool[lang], rng)
                at = int(rng.integers(0, max(1, len(text) - WIDTH + 40)))
            cut = text[at : at + WIDTH]
            cp = np.frombuffer(cut.encode("utf-32-le"), "<u4")
            data[r, : len(cp)] = table[C.clip(cp)]
            for a, b, k in sp:
                a, b = a - at, b - at
                if b > 0 and a < WIDTH:
                    tags[r, max(a, 0) : b] = 2 + 2 * k
                    if a >= 0:
                        tags[r, a] = 1 + 2 * k
        g, loss = lstm.gradients(p, np.ascontiguousarray(data.T), np.ascontiguousarray(tags.T))
        opt.step(g, rate * min(1, 1.2 * (1 - step / n_steps)))
        if step % 200 == 199:
            print(step + 1, round(loss, 4), round(time.time() - t0), flush=True)
    gru.save(out, p)
    report(held, out)


def report(held: list, out: str) -> None:
    import pyarrow as pa

    from . import pii
    from .pii import pieces

    with np.load(out) as z:
        p = {k: z[k].astype(np.float32) for k in z.files}
    p["tr"] = pii.allowed_steps(p["tr"])
    pii.net = lambda: p

    got = pieces(pa.array([t for t, _ in held]))
    for k, kind in enumerate(KINDS):
        want = {(i, a, b) for i, (_, sp) in enumerate(held) for a, b, x in sp if x == k}
        have = {(i, a, b) for i, sp in enumerate(got) for a, b, x in sp if x == k}
        print(kind, "held out: wanted", len(want), "found", len(have), "both", len(want & have), flush=True)
        for i, a, b in [*(want - have)][:4]:
            print("   missed", repr(held[i][0][max(0, a - 25) : a]), repr(held[i][0][a:b]), repr(held[i][0][b : b + 12]))
        for i, a, b in [*(have - want)][:4]:
            print("   extra", repr(held[i][0][max(0, a - 25) : a]), repr(held[i][0][a:b]), repr(held[i][0][b : b + 12]))


if __name__ == "__main__":
    main(*sys.argv[1:])
