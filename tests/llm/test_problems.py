import random
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import codepoints as C
from corpusloom.llm import gru, language, lstm, markup, mixture, overlap, packing, pairs, pii, queries, quotas, residue, stock, unify

SCHEMA = "rid long, collection string, split string, language string, source_url string, title string, text string"


def unified(values):
    cp, off, bad = C.unify(*C.explode(pa.array(values, pa.string())))
    return C.implode(cp, off).to_pylist(), bad.tolist()


# --- problem 1


def test_stand_ins_take_one_form():
    given_, want = zip(
        ("Ｆｕｌｌ ｗｉｄｔｈ １２", "Full width 12"), ("ｶﾞｷﾞﾌﾟ", "ガギプ"), ("cafe\u0301", "caf\u00e9"), ("zero​width﻿ and soft\xad", "zerowidth and soft"), ("no\xa0break there　now", "no break there now"),
        ("Тhе раіnt", "The paint"), ("Τοwn αnd", "Town and"), ("ﬁne oﬃce", "fine office"), ("⼭と⽔", "山と水"), ("\uf901", "\u66f4"), ("葛\U000e0100城\ufe00", "葛城"), ("ſtill", "still"), ("ﺍﻟ", "ال"), ("ɡlass", "glass"), ("Cиma", "Cиma"), ("Mосква", "Mосква".replace("M", "М")),
    )
    got, bad = unified(given_)
    assert got == list(want)
    assert [b for g, b in zip(given_, bad) if g != "Cиma"] == [True] * (len(given_) - 1)


def test_harmless_text_stays():
    plain = ["（番号：387）！とある，。", "Новый порт открыт", "x² and ½ and ①", "👩‍💻", "α and β", "&nbsp; café", "γνῶθι", "", None]
    got, bad = unified(plain)
    assert got == [x or "" for x in plain] and not any(bad)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aeouAEOcñåéが́̀̂̈̃̊̇きぷ゙ᄀ가ᅡᆨৌাে"), max_size=8), max_size=6))
def test_composition_is_canonical(values):
    cp, off, _ = C.grow(*C.explode(pa.array(values, pa.string())), C.tables().canon)
    cp, off, _ = C.compose(cp, off)
    assert C.implode(cp, off).to_pylist() == [unicodedata.normalize("NFC", unicodedata.normalize("NFD", v)) for v in values]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=20)), max_size=8))
def test_round_trip_and_second_pass(values):
    arr = pa.array(values, pa.string())
    assert C.implode(*C.explode(arr), C.valid_of(arr)).to_pylist() == values
    once, _ = unified(values)
    twice, bad = unified(once)
    assert unified(twice)[0] == twice


def test_unify_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "ａ", None, 3), (2, None, "x", 4), (3, "", "y", 5)], "rid long, text string, flag string, n int")
    got = {r.rid: (r.text, r.flag, r.n, r.bad) for r in unify.unify_text(df, "text", flag="bad").collect()}
    assert got == {1: ("a", None, 3, True), 2: (None, "x", 4, False), 3: ("", "y", 5, False)}


# --- problem 2


def test_largest_remainder_sums_up():
    assert quotas.largest_remainder([1.5, 1.5, 2.0], 5) == [2, 1, 2] and quotas.largest_remainder([0.2, 0.3, 0.5], 1) == [0, 0, 1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 60)), min_size=1, max_size=7), st.integers(0, 120), st.integers(0, 6))
def test_quotas_keep_floors_and_caps(cats, total, least):
    weight = sum(s for s, _ in cats) or 1
    shares, available = [s / weight for s, _ in cats], [a for _, a in cats]
    got = quotas.allocate(shares, available, total, least)
    floor = [min(least, a) if s else 0 for s, a in zip(shares, available)]
    most = sum(a for s, a in zip(shares, available) if s)
    assert all(f <= g <= a for f, g, a in zip(floor, got, available))
    assert sum(got) == max(min(total, most), sum(floor))


def test_sample_is_the_smallest_keys(spark):
    rows = [(i, ["a", "b", "B ", None, ""][i % 5] if i % 7 else "a", "train") for i in range(400)]
    df = spark.createDataFrame(rows, "rid long, domain string, split string").withColumn("collection", F.lit("c"))
    plans = spark.createDataFrame([("p", "domain", 0.2, 5)], "plan_id string, field_name string, sample_share double, min_per_category int")
    targets = spark.createDataFrame([("p", "a", 0.5), ("p", "b", 0.4), ("p", "z", 0.1)], "plan_id string, category string, target_share double")
    got = quotas.sample(df, plans, targets).collect()
    rep = {r.category: r for r in quotas.report(df, plans, targets).collect()}
    draws = df.select("rid", quotas.category_of(F.col("domain")).alias("c"), F.xxhash64(F.lit(17), F.lit("p"), F.col("rid")).alias("d")).collect()
    for c in "ab":
        unsigned = sorted((r.d % 2**64, r.rid) for r in draws if r.c == c)
        assert {r.rid for r in got if r.category == c} == {i for _, i in unsigned[: rep[c].sampled_rows]}
    assert len(got) == 80 and rep["z"].shortfall_rows == 8 and rep["z"].available == 0


# --- problem 3


def brute(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


def test_banded_distances():
    rng = random.Random(2)
    for _ in range(60):
        a = [rng.randrange(5) for _ in range(rng.randrange(0, 14))]
        b = [rng.randrange(5) for _ in range(rng.randrange(0, 14))]
        k = rng.randrange(0, 5)
        pad = lambda x, f: np.array([x + [f] * (14 - len(x))], np.int64)
        got = overlap.banded(pad(a, -2), np.array([len(a)]), pad(b, -1), np.array([len(b)]), k)[0]
        assert got == min(brute(a, b), k + 1)


def test_windows_are_disjoint_and_enough():
    rng = np.random.default_rng(3)
    n = rng.integers(8, 120, 60)
    off = np.concatenate([[0], np.cumsum(n)])
    tok = rng.integers(0, 50, off[-1]).astype(np.int32)
    common = rng.integers(0, 200, overlap.COUNTERS).astype(np.int32)
    row, i, at, size = overlap.cut(tok, off, common)
    assert (np.bincount(row, minlength=60) == overlap.allowed(n) + 1).all()
    for r in range(60):
        x = row == r
        assert (at[x] >= off[r]).all() and (at[x] + size[x] <= off[r + 1]).all() and (np.diff(at[x]) >= size[x][:-1]).all() and (i[x] == np.arange(x.sum())).all()


def overlap_rows(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, rid = [], 0
    for g in range(150):
        base = [rng.choice(words) for _ in range(rng.randrange(1, 70))]
        for _ in range(rng.randrange(1, 4)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, max(1, len(t) // 10), len(t) // 3])):
                p = rng.randrange(len(t)) if t else 0
                op = rng.random()
                if op < 0.4 and t:
                    t[p] = rng.choice(words)
                elif op < 0.7 and t:
                    del t[p]
                else:
                    t.insert(p, rng.choice(words))
            rid += 1
            rows.append((rid, "c", rng.choice(["train", "train", "dev", "test", "validation", None, ""]), "en", None, None, rng.choice(["%s", "**%s**", "%s!"]) % " ".join(t)))
    rows += [(900, "c", "train", "en", None, None, None), (901, "c", "test", "en", None, None, ""), (902, "c", "train", "en", None, None, ""), (903, "c", "test", "en", None, None, "汉字" * 30), (904, "c", "train", "en", None, None, "汉字" * 29 + "文")]
    return rows


def test_overlaps_against_brute_force(spark):
    rows = overlap_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.eval_id, r.train_id): r.edits for r in overlap.overlaps(df).collect()}
    import re

    tok = {r[0]: re.findall(r"[一-鿿]|[^\W一-鿿]+", r[6] or "") for r in rows}
    want = {}
    for a in rows:
        for b in rows:
            if a[2] in overlap.EVALUATION and b[2] == "train" and tok[a[0]] and tok[b[0]] and len({*tok[a[0]]} & {*tok[b[0]]}) * 2 >= len({*tok[a[0]]}):
                d = brute(tok[a[0]], tok[b[0]])
                if d <= overlap.allowed(min(len(tok[a[0]]), len(tok[b[0]]))):
                    want[a[0], b[0]] = d
    assert got == want and len(want) > 15


def test_overlap_of_empty_tables(spark):
    assert overlap.found(spark.createDataFrame([], SCHEMA)).count() == 0


# --- problem 4


def site_rows():
    rows = []
    for i in range(60):
        body = f"Wholly own sentence number {chr(97 + i % 26) * (i + 3)} here."
        rows.append((i, "c", "train", "en", ["https://www.Site.example:80/a", "http://site.example/b?x"][i % 2], None, f"{body}\n\nShare THIS page, with {i} friends!\nＡｌｌ rights reserved here\nshort" if i % 3 else body))
    rows += [(100 + i, "k", "train", "en", None, None, "ここに版権があります" if i < 12 else "別の文章がここに置かれています") for i in range(13)]
    rows += [(200, "c", None, None, "", None, None), (201, "c", None, None, "x", None, "")]
    return rows


def test_stock_lines_and_blocks(spark):
    df = spark.createDataFrame(site_rows(), SCHEMA)
    got = {(r.rid, r.line_no) for r in stock.found(df).collect()}
    assert got == {(i, n) for i in range(60) if i % 3 for n in (3, 4)} | {(100 + i, 1) for i in range(12)}
    blocks = [r.asDict() for r in stock.blocks(df).collect()]
    assert len(blocks) == 3 and len({b["block"] for b in blocks}) == 2
    texts = {r.rid: r.text for r in stock.without_stock(df).collect()}
    assert texts[1].endswith("here.\n\nshort") and texts[200] is None and texts[201] == "" and texts[100] == ""


def test_stock_threshold_is_of_rows_and_share(spark):
    rows = [(i, "c", None, None, "http://a.example/", None, "the very same line of text" if i < 10 else f"{'x' * 20}{'abcdefghijklmnopqrstuvwxyz'[i % 26] * (i + 1)}") for i in range(201)]
    assert stock.found(spark.createDataFrame(rows, SCHEMA)).count() == 0  # ten rows are less than 1/20 of 201
    assert stock.found(spark.createDataFrame(rows[:200], SCHEMA)).count() == 10
    assert stock.found(spark.createDataFrame(rows[1:200], SCHEMA)).count() == 0


# --- problem 5

SOURCE = "The mill of Otterford stood by the river for two centuries. In 1911 the flood took the wheel, and nobody rebuilt it.\nShare this page"


@pytest.mark.parametrize(
    "text,target,want",
    [
        (None, "en", ["empty"]), ("", "en", ["empty"]), (" ​\n", "en", ["empty"]), ("N/A", "en", ["empty"]), ("```\n```", "en", ["empty"]), ("（无）", "zh", ["empty"]),
        ("For two hundred years a mill was at Otterford; then the water of 1911 broke its", "en", ["truncated"]),
        ("A mill was there.\n\n## History", "en", ["truncated"]), ("A mill was there.\n```\nrun(path, ", "en", ["truncated"]), ("1. The mill was old.\n2. The wheel was", "en", ["truncated"]),
        ("A mill was there.\n\n- wheel\n- race", "en", []), ("A mill was there.\n```\nrun()\n```", "en", []), ("A mill was there (https://m.example/a)", "en", []), ('The sign of the mill read: "水車"', "en", []),
        ("As a language model I am not able to produce this. You may ask an editor.", "en", ["refusal"]), ("抱歉，我无法改写这段文字。", "zh", ["refusal"]),
        ('A clerk at the mill said: "I am sorry, but I cannot help." The wheel was gone by then, in the year of the flood.', "en", []),
        ("Here is the rewrite:\n\n" + SOURCE.upper(), "en", ["copied_source"]), (SOURCE, "en", ["copied_source"]),
        ("Die Mühle stand zweihundert Jahre an dem Fluss, und nach der Flut hat sie niemand wieder gebaut.", "en", ["other_language"]), ("水車小屋は二百年のあいだ川のそばに立っていた。", "zh-CN", ["other_language"]),
        ("For two hundred years people of Otterford had a mill, until water broke it.", "eng", []),
    ],
)
def test_defects(text, target, want):
    assert pairs.defects(text, SOURCE, target) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=25), st.lists(st.sampled_from("abc"), max_size=25))
def test_suffix_automaton_matches_are_longest(source, answer):
    auto = pairs.SuffixAutomaton(source)
    text = "".join(source)
    for end, at, n in auto.blocks(answer):
        piece = "".join(answer[end - n : end])
        assert text[at - n : at] == piece
        assert end == len(answer) or piece + answer[end] not in text


def test_pairs_repeat_and_miss_rows(spark):
    p = spark.createDataFrame([("a", "q1", None), ("a", "q1", None), ("b", None, "cut off in the"), ("c", "q9", "All is well.")], "pair_id string, queue_id string, text string")
    q = spark.createDataFrame([("q1", "s", "en"), ("q1", "s", "en")], "queue_id string, selected_source_text string, target_language string")
    assert sorted(map(tuple, pairs.found(p, q).collect())) == [("a", "empty"), ("b", "truncated")]
    assert pairs.found(p.limit(0), q).count() == 0


# --- problem 6


def test_markup_kinds_and_clean_text(spark):
    rows = [
        (1, "<h1>Mill</h1>\n<p>Stood by &amp; by.</p>"), (2, "# Mill\n\nIt was **old**.\n\n- wheel\n\n```\nx = 1\n```"), (3, "'''Mill''' by [[Otter|the ford]]\n== Past ==\n{{stub|x}}"),
        (4, "\\section{Mill} with $x_i = 3$"), (5, "a < b and c > d for $5 or <API_KEY> {name} user_name C:\\work\\x 5 * 3 -> [sic] #12 A*"), (6, None), (7, ""), (8, "cut <br> and [x](y)"),
    ]
    df = spark.createDataFrame(rows, "rid long, text string")
    got = {}
    for r in residue.found(df).collect():
        got.setdefault(r.rid, set()).add(r.markup_kind)
    assert got == {1: {"html"}, 2: {"markdown"}, 3: {"wiki"}, 4: {"latex"}, 8: {"html", "markdown"}}
    clean = {r.rid: r.text for r in residue.cleaned(df).collect()}
    assert clean[1] == "# Mill\nStood by & by." and clean[2] == "# Mill\n\nIt was old.\n\n- wheel\n\n```\nx = 1\n```" and clean[3] == "Mill by the ford\n## Past" and clean[4] == "# Mill\nwith $x_i = 3$" and clean[6] is None
    assert {r.markup_kind for r in residue.found(spark.createDataFrame([(i, clean[i]) for i in (1, 2, 3)], "rid long, text string")).collect()} == {"markdown"}  # the notation of structure
    assert all(markup.clean(x) == x for x in clean.values() if x)


def test_tree_learns_its_table():
    x = np.array([[0.0, 1], [1, 0], [2, 5], [3, 1]])
    y = np.array([0, 1, 1, 0])
    from corpusloom.llm import tree

    assert (tree.predict(tree.fit(x, y, 2), x) == y).all()
    markup.trees()


# --- problem 7


def test_gru_gradients_by_differences():
    rng = np.random.default_rng(1)
    p = {k: (rng.standard_normal(v.shape) * 0.5).astype(np.float32) for k, v in gru.init(5, 4, rng).items()}
    data, start, size, label = rng.integers(0, 256, 40).astype(np.uint8), np.array([0, 15, 30]), np.array([15, 15, 10]), rng.integers(-1, 4, 40)
    g = gru.gradients(p, data, start, size, label)[0]
    for k in ("fu", "bu", "fb", "fo", "ob"):
        i = tuple(int(rng.integers(0, s)) for s in p[k].shape)
        step = []
        for e in (2e-3, -2e-3):
            q = {a: b.copy() for a, b in p.items()}
            q[k][i] += e
            step.append(gru.gradients(q, data, start, size, label)[1])
        assert abs((step[0] - step[1]) / 4e-3 - g[k][i]) < 2e-3


def test_languages(spark):
    en = "The river board reviewed the annual budget of the town after the second reading. Nobody had asked for it."
    de = "Der Förderkreis verschob die Sitzung, weil niemand danach gefragt hatte. Das Protokoll fehlte noch immer."
    zh = "因为旧副本已经遗失，图书馆在本地更正了公开信。大约六十天后，公司归档了清单。"
    rows = [(1, en, None), (2, en, "de"), (3, en, "EN-us"), (4, de + " " + en, "de"), (5, de + "\n" + en, "mixed"), (6, zh, "ja"), (7, "1922: 34.86", "unknown"), (8, None, None), (9, "", ""), (10, en + " The sign reads «" + "Новый порт" + "».", "eng")]
    df = spark.createDataFrame([(i, "c", None, lang, None, None, t) for i, t, lang in rows], SCHEMA)
    got = {}
    for r in language.found(df).collect():
        got.setdefault(r.rid, set()).add(r.lang_code)
    assert got == {1: {"en"}, 2: {"en"}, 4: {"de", "en"}, 6: {"zh"}}
    seg = [r.lang_code for r in language.segments(df.where("rid = 4")).orderBy("segment_no").collect()]
    assert seg == ["de", "de", "en", "en"]
    sure = {r.rid: r.confidence for r in language.languages(df).collect()}
    assert 0.8 < sure[1] <= 1 + 1e-6 and sure[8] == 0


def test_long_text_is_read_to_its_end():
    text = "The board read the annual report of the town. " * 200 + "Der Rat las den Bericht der Stadt noch einmal. " * 200
    cp, off, _ = C.unify(*C.explode(pa.array([text])))
    labels, conf = language.label_rows(cp, off)
    assert sorted(language.CODES[i] for i in labels[0]) == ["de", "en"] and conf[0] <= 1 + 1e-6


# --- problems 8 and 9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.sampled_from(["norm", "dot"]), st.integers(0, 2), st.integers(1, 9))
def test_packing_exceeds_nothing(sizes, rule, separator, most):
    size = np.array(sizes, np.int64)
    where, slot, first = packing.best_fit(size, 100, separator, most, 100.0 * 100, rule)
    for b in set(where.tolist()):
        x = np.flatnonzero(where == b)
        x = x[np.argsort(first[x])]
        assert len(x) <= most and size[x].sum() + separator * (len(x) - 1) <= 100 and (size[x] ** 2).sum() <= 100 * 100
        assert (first[x][1:] >= first[x][:-1] + size[x][:-1] + separator).all() and first[x][0] == 0 and sorted(slot[x]) == list(range(len(x)))


needs_tokens = pytest.mark.skipif(not Path("/opt/tokenizers").exists(), reason="no public tokenizers")


@needs_tokens
def test_pack_keeps_every_token(spark):
    docs = spark.createDataFrame([(i, "word " * (i * 7 % 90 + 1), ["en", "zh", None][i % 3]) for i in range(80)] + [(900, None, "en"), (901, "", "en"), (902, "long " * 1000, "en")], "doc_id long, text string, lang string")
    specs = spark.createDataFrame([("a", 64, 1, None), ("b", 128, 0, "zh")], "spec_id string, capacity_tokens int, separator_tokens int, lang_filter string")
    from corpusloom.llm import tokens

    want = {r.doc_id: r.tokens for r in tokens.sized(docs).collect() if r.tokens}
    got = packing.pack(docs, specs).collect()
    for spec, ids in (("a", set(want)), ("b", {i for i in want if i % 3 == 1 and i < 900})):
        by = {}
        for r in got:
            if r.spec_id == spec:
                by[r.doc_id] = by.get(r.doc_id, 0) + r.tokens
        assert by == {i: want[i] for i in ids}
    assert all(r.fill > 0.9 for r in packing.report(docs, specs).collect() if r.spec_id == "a" and r.docs_most > 1000)


def test_fill_shares_what_is_short():
    assert mixture.fill([0.5, 0.5], [10, 1000], 100) == [10, 90] and mixture.fill([0.5, 0.5], [10, 20], 100) == [10, 20] and mixture.fill([1.0, 0.0], [0, 5], 9) == [0, 0]


@needs_tokens
def test_mix_reaches_its_weights(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 13 + 1), "abc"[i % 3] if i % 10 else "d") for i in range(600)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "a", 0.6, 2, 0.5), ("m", "d", 0.3, 2, 0.5), ("m", "x", 0.1, 2, 0.5)], "mix_id string, source string, target_weight double, max_repeats int, total_share double")
    got = mixture.mix(docs, targets).collect()
    times = {}
    for r in got:
        times.setdefault((r.doc_id, r.source), []).append(r.repeat_no)
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 2 for v in times.values())
    at = [r.position for r in got]
    assert at == sorted(at) and 0 <= min(at) and max(at) <= 1
    rep = {r.source: r for r in mixture.report(docs, targets).collect()}
    assert rep["x"].reached_tokens == 0 and abs(rep["a"].reached_share - 2 / 3) < 0.02 or rep["d"].shortfall_tokens > 0
    assert abs(sum(r.reached_share for r in rep.values()) - 1) < 1e-9


# --- problem 10


def test_crf_gradients_by_differences():
    rng = np.random.default_rng(1)
    p = {k: (rng.standard_normal(v.shape) * 0.5).astype(np.float32) for k, v in lstm.init(9, 5, 4, rng).items()}
    data, tags = rng.integers(0, 9, (3, 8)), rng.integers(0, 4, (3, 8))
    g = lstm.gradients(p, data, tags)[0]
    for k in ("fu", "bu", "tr", "fo"):
        i = tuple(int(rng.integers(0, s)) for s in p[k].shape)
        step = []
        for e in (2e-3, -2e-3):
            q = {a: b.copy() for a, b in p.items()}
            q[k][i] += e
            step.append(lstm.gradients(q, data, tags)[1])
        assert abs((step[0] - step[1]) / 4e-3 - g[k][i]) < 3e-3


def test_viterbi_finds_the_best_path():
    from itertools import product

    rng = np.random.default_rng(4)
    e, tr = rng.standard_normal((9, 3)).astype(np.float32), rng.standard_normal((3, 3)).astype(np.float32)
    start, size = np.array([0, 4]), np.array([4, 5])
    got = lstm.viterbi(e, tr, start, size)
    for a, n in zip(start, size):
        best = max(product(range(3), repeat=int(n)), key=lambda y: sum(e[a + i, t] for i, t in enumerate(y)) + sum(tr[x, y2] for x, y2 in zip(y, y[1:])))
        assert got[a : a + n].tolist() == list(best)


TEXT = "The survey team opened the annual budget on a wet Tuesday. {} The field station copied a new timetable."


@pytest.mark.parametrize(
    "sentence,want",
    [
        ("Please ask Petra Wexbrook before you change this.", {("person_name", "Petra Wexbrook")}),
        ("Call (202) 555-0129 after nine.", {("phone", "(202) 555-0129")}),
        ("Contact: edmund.larkgrave@mail.example\n", {("email", "edmund.larkgrave@mail.example")}),
        ("They moved to 32 Larkmoor Lane, Fenstead 00541 last spring.", {("street_address", "32 Larkmoor Lane, Fenstead 00541")}),
        ("Passport ZZ0091533 was left at the desk.", {("id_number", "ZZ0091533")}),
        ("Totals were 555 071 and 555 171 units.", set()), ("The build core@2.1.62 passed.", set()), ("Kellgarth Museum lent the frame.", set()), ("Ping @style-desk when done.", set()),
    ],
)
def test_personal_data(sentence, want):
    text = TEXT.format(sentence)
    got = {(pii.KINDS[k], text[a:b]) for a, b, k in pii.pieces(pa.array([text]))[0]}
    assert got == want


def test_masking_keeps_the_rest(spark):
    rows = [(1, TEXT.format("Call 303-555-0151 after nine.")), (2, None), (3, ""), (4, TEXT.format("All was well.") * 60 + " Contact: nils.aldgarth@post.example")]
    got = {r.doc_id: r.text for r in pii.masked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == TEXT.format("Call [PHONE] after nine.") and got[2] is None and got[3] == "" and got[4].endswith("Contact: [EMAIL]")


def test_held_out_accuracy(sf):
    import pyarrow.parquet as pq

    from corpusloom.llm.pii_labels import spans

    texts = [t for t in pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    want = {(i, *x) for i, t in enumerate(texts) for x in spans(t)}
    have = {(i, *x) for i, s in enumerate(pii.pieces(pa.array(texts))) for x in s}
    assert len(want & have) >= 0.95 * max(len(want), len(have))


EXTRA = ["site", "stock_keys", "train", "is_train", "said", "tokens", "bin", "draw", "category", "plan_id", "quota", "cls", "n", "line_no", "key_a", "source_tokens", "shard", "piece", "spec_id", "position", "_n"]
DOCS = "doc_id long, text string, lang string, source string"
PLANS = "plan_id string, field_name string, sample_share double, min_per_category int"
TARGETS = "plan_id string, category string, target_share double"
MIX = "mix_id string, source string, target_weight double, max_repeats int, total_share double"
SPECS = "spec_id string, capacity_tokens int, separator_tokens int, lang_filter string"


def every_operator(spark, records, docs):
    plans = spark.createDataFrame([("p", "split", 0.5, 1), ("q", "nothing", 0.5, 1)], PLANS)
    targets = spark.createDataFrame([("p", "train", 0.5), ("p", "dev", 0.5), ("q", "a", 1.0)], TARGETS)
    out = {
        "p1": unify.found(records), "p2": quotas.sample(records, plans, targets), "p2r": quotas.report(records, plans, targets), "p3": overlap.found(records), "p3r": overlap.report(records), "p3c": overlap.classes(records), "p4": stock.found(records), "p4c": stock.without_stock(records),
        "p6": residue.found(records), "p6c": residue.cleaned(records), "p7": language.found(records), "p7s": language.segments(records), "p10": pii.found(docs), "p10m": pii.masked(docs),
    }
    if Path("/opt/tokenizers").exists():
        specs = spark.createDataFrame([("a", 32, 1, None), ("b", 0, None, "en")], SPECS)
        mix = spark.createDataFrame([("m", "s", 0.5, 2, 0.5), ("m", None, 0.5, None, 0.5)], MIX)
        out |= {"p8": packing.pack(docs, specs), "p8r": packing.report(docs, specs), "p9": mixture.mix(docs, mix), "p9r": mixture.report(docs, mix)}
    return {k: df.collect() for k, df in out.items()}


def test_empty_tables(spark):
    got = every_operator(spark, spark.createDataFrame([], SCHEMA), spark.createDataFrame([], DOCS))
    assert all(not v for k, v in got.items() if k not in ("p2r", "p9r", "p8r"))


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    long = "The river board read the annual report again. " * 3000
    rows = [(1, "c", "train", "en", "http://a.example/x", "T", long), (2, "c", "dev", None, None, None, long), (2, "c", "dev", None, None, None, long), (None, None, None, None, None, None, None), (4, "c", "train", "en", "", "", ""), (5, "c", " TRAIN ", "xx", "http://", None, "\x00\ud7ff👩\u200d💻 ")]
    records = spark.createDataFrame(rows, SCHEMA)
    docs = spark.createDataFrame([(1, long, "en", "s"), (1, long, "en", "s"), (2, None, None, None), (None, "short text", "en", "s"), (3, "", "en", "s")], DOCS)
    plain = every_operator(spark, records, docs)
    for name in EXTRA:
        records, docs = records.withColumn(name, F.lit("x")), docs.withColumn(name, F.lit("x"))
    clashing = every_operator(spark, records, docs)
    assert {k: sorted(map(str, v)) for k, v in plain.items()} == {k: sorted(map(str, v)) for k, v in clashing.items()}
    assert {tuple(r) for r in plain["p3"]} == {(1, 2)} and {r.rid for r in plain["p7"]} == {2}


def test_all_queries_run(spark, sf):
    for name, q in queries.queries().items():
        df = q(spark, sf)
        assert df.columns and df.count() >= 0, name
