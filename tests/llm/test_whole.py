"""Cases where the operators once did less than the whole job."""

import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import codepoints as C
from corpusloom.llm import gru, language, lstm, markup, mixture, overlap, packing, pairs, residue, stock

sys.path.insert(0, str(Path(__file__).parent))  # held_carriers

PROSE = "The river board read the annual report <br/> of the town & its [[Otter|ford]]."


# --- fences that are never closed


@pytest.mark.parametrize("code", ["", "let v1 = parse(x);\nreturn v1;\n", "def f(path):\n    return open(path).read()\n\n", "SELECT v1, count(*) FROM runs GROUP BY v1\n", "for row in v1_rows:\n    emit(row)\n"])
def test_text_after_an_open_fence_is_text(code):
    text = f"A mill.\n```\n{code}{PROSE}\n- The list (one)\n\\emph{{Old}} wheel"
    [(start, a, b, end)] = markup.fences(text)
    assert (text[a:b].rstrip("\n"), b) == (code.rstrip("\n"), end) and text[end:].lstrip("\n").startswith(PROSE)
    assert "annual report" in markup.bare(text, True) and "Old wheel" in markup.clean(text)
    assert "<br/>" not in markup.clean(text) and "[[" not in markup.clean(text)
    assert ("return v1" in markup.clean(text)) == ("return v1" in code)


def test_markup_after_an_open_fence_is_found(spark):
    df = spark.createDataFrame([(1, f"A mill.\n```\nlet v1 = parse(x);\n{PROSE}"), (2, "A mill.\n```\n<br/>\n```")], "rid long, text string")
    assert sorted(map(tuple, residue.found(df).collect())) == [(1, "html"), (1, "markdown"), (1, "wiki"), (2, "markdown")]


def test_closed_and_nested_fences():
    text = "```js\nThe code says so here.\n```\nA mill.\n~~~~\n```\n~~~~\n```\nThe board read the report.\n```py\nx = 1\n```"
    assert [text[a:b] for _, a, b, _ in markup.fences(text)] == ["The code says so here.\n", "```\n", "", "x = 1\n"]
    assert len(markup.fences("```js\n" * 30000)) == 30000  # and in little time


def test_words_after_an_open_fence_are_compared():
    cp, off = overlap.running_text(*C.explode(pa.array([f"A mill.\n```\nlet v1 = parse(x);\n{PROSE}"])))
    assert "annual report" in C.implode(cp, off).to_pylist()[0]


# --- stretches that the tagger need not decode


def score(e, tr, tags):
    return e[np.arange(len(tags)), tags].sum() + tr[tags[:-1], tags[1:]].sum()


def test_skipping_never_changes_the_best_path():
    rng = np.random.default_rng(7)
    decoded = 0
    for trial in range(300):
        k = 2 * int(rng.integers(1, 4)) + 1
        size = rng.integers(1, 70, 6)
        start = np.concatenate([[0], np.cumsum(size + size % 2)])[:-1]
        e = rng.standard_normal((int((size + size % 2).sum()), k)).astype(np.float32) * rng.choice([0.5, 2, 4])
        e[:, 0] += rng.choice([0, 3, 9, 30], len(e) // 2).repeat(2)
        tr = rng.standard_normal((k, k)).astype(np.float32) * 2
        tr[1:, 0] -= rng.choice([0, 4, 8])
        want, raw = lstm.viterbi(e, tr, start, size), e.copy()
        a, n = lstm.lively(e, tr, start, size)
        got = lstm.viterbi(e, tr, a, n)
        decoded += n.sum() / size.sum() / 300
        for x, m in zip(start, size):
            assert abs(score(raw[x : x + m], tr, got[x : x + m]) - score(raw[x : x + m], tr, want[x : x + m])) < 1e-3
    assert decoded < 0.95


def test_small_leads_win_together():
    e = np.zeros((60, 3), np.float32)
    e[:, 0] = 6
    e[20:40, 2], e[20, 1] = 6.9, 6.9  # each leads by less than one
    tr = np.array([[0, -0.5, -1e4], [-4, -5, 1], [-4, -5, 0.3]], np.float32)
    got = lstm.viterbi(e, tr, *lstm.lively(e, tr, np.array([0]), np.array([60])))
    assert (got > 0).tolist() == [20 <= i < 40 for i in range(60)]


def test_nothing_to_decode():
    e, none = np.zeros((8, 3), np.float32), np.empty(0, np.int64)
    e[:, 0] = 50
    assert len(lstm.lively(e, np.zeros((3, 3), np.float32), np.array([0, 4]), np.array([4, 4]))[0]) == 0
    assert len(lstm.lively(e[:0], np.zeros((3, 3), np.float32), none, none)[0]) == 0


def test_scores_take_no_library_tanh(monkeypatch):
    rng = np.random.default_rng(5)
    p = {k: v * 2 for k, v in lstm.init(9, 6, 5, rng).items()}
    p["fx"][0] *= 80  # arguments whose exponential is infinite
    size = np.array([7, 300, 1, 41])
    start = np.array([310, 4, 317, 318])
    data = rng.integers(0, 9, 360)
    want = np.zeros((360, 5), np.float32)
    order = np.argsort(-size)
    alive, head, place = lstm.packed(start[order], size[order])
    want[place] = sum(lstm.states(p, d, data[place], alive, head)[0] @ p[d + "o"] for d in "fb") + p["ob"]
    with monkeypatch.context() as m:
        m.setattr(lstm.np, "tanh", None)  # it was two fifths of a step
        got = lstm.emissions(p, data, start, size)
    assert np.isfinite(got).all()
    inside = np.zeros(360, bool)
    inside[place] = True
    assert np.abs(got - want)[inside].max() < 1e-4


def test_a_step_has_two_calls_of_products_and_only_stretches_are_decoded(monkeypatch):
    rng = np.random.default_rng(12)
    p = {k: v * 2 for k, v in lstm.init(9, 6, 5, rng).items()}
    p["fo"], p["bo"] = p["fo"] * 6, p["bo"] * 6
    p["tr"] = rng.standard_normal((5, 5)).astype(np.float32)
    size = np.array([7, 0, 300, 1, 41, 300])
    start = np.cumsum(size) - size
    data = rng.integers(0, 9, int(size.sum()))
    e = lstm.emissions(p, data, start, size)
    p["ob"][0] = np.quantile(e[:, 1:].max(1) - e[:, 0], 0.95)  # most positions are of no kind
    e[:, 0] += p["ob"][0]
    want = lstm.viterbi(e, p["tr"], start[size > 0], size[size > 0])
    products, decoded = [], []
    matmul, viterbi = np.matmul, lstm.viterbi
    monkeypatch.setattr(lstm.np, "matmul", lambda *a, **k: products.append(1) or matmul(*a, **k))
    monkeypatch.setattr(lstm, "viterbi", lambda e, *a: decoded.append(len(e)) or viterbi(e, *a))
    got = lstm.decode(p, data, start, size)
    assert (got == want).all() and (want > 0).any()
    assert len(products) == 2 * 2 * 300  # one for the three gates and one for the scores; it was four a step
    assert decoded[0] < len(data)  # it was handed the scores of all positions


def test_language_scores_take_no_library_tanh(monkeypatch):
    rng = np.random.default_rng(6)
    p = gru.init(6, 4, rng)
    p["fx"][0] *= 400  # arguments whose exponential is infinite
    size = np.array([7, 300, 1, 41])
    start = np.array([300, 0, 307, 308])
    data = rng.integers(0, 9, 349).astype(np.uint8)
    want = gru.softmax(gru.logits(p, data, start, size)).T
    with monkeypatch.context() as m:
        m.setattr(gru.np, "tanh", None)
        got = gru.probabilities(p, data, start, size)
    assert np.abs(got - want).max() < 1e-5


def test_windows_of_long_texts_are_put_together_in_place():
    rng = np.random.default_rng(9)
    size = np.array([900, 3, 448, 1500])
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    data = rng.integers(32, 127, int(size.sum())).astype(np.uint8)
    got, p = language.label_positions(data, start, size), language.net()
    assert got.shape == (len(language.CODES), len(data))
    step = language.WINDOW - 2 * language.MARGIN
    for a, m in zip(start, size):
        pieces = max(1, -(-(m - 2 * language.MARGIN) // step))
        for i in range(pieces):
            lo, hi = i * step, m if i == pieces - 1 else i * step + language.WINDOW
            alone = gru.probabilities(p, data[a + lo : a + hi], np.array([0]), np.array([hi - lo]))
            x, y = language.MARGIN if i else 0, hi - lo - (language.MARGIN if i < pieces - 1 else 0)
            assert np.abs(got[:, a + lo + x : a + lo + y] - alone[:, x:y]).max() < 1e-5


def test_one_weak_run_across_a_long_text():
    e = np.zeros((9000, 3), np.float32)
    e[:, 2], e[0, 1] = 0.02, 0.02  # only all positions together win
    tr = np.array([[0, -60, -1e4], [-40, -1e4, 0], [-40, -1e4, 0]], np.float32)
    got = lstm.viterbi(e.copy(), tr, *lstm.lively(e, tr, np.array([0, 4]), np.array([9000, 0])))
    assert (got > 0).all()


def test_steps_of_many_and_of_few_sequences_decode_alike(monkeypatch):
    rng = np.random.default_rng(8)
    size = rng.integers(1, 30, 200)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    e = rng.integers(-3, 4, (int(size.sum()), 5)).astype(np.float32)  # with ties
    tr = rng.integers(-2, 3, (5, 5)).astype(np.float32)
    got = []
    for few in (0, 1000):
        monkeypatch.setattr(lstm, "FEW", few)
        got.append(lstm.viterbi(e, tr, start, size))
    assert (got[0] == got[1]).all()


# --- words that stand in markup

SCHEMA = "rid long, collection string, split string, language string, source_url string, title string, text string"
LONG = "the river board read the annual report of the town again and {} was glad of it before the rain came"


def pairs_of(spark, *texts, urls=None):
    rows = [(i, f"c{i}", "test" if i % 2 else "train", "en", (urls or {}).get(i), None, t) for i, t in enumerate(texts)]
    return sorted(map(tuple, overlap.found(spark.createDataFrame(rows, SCHEMA)).collect()))


def test_texts_of_code_tables_lists_and_links_are_compared(spark):
    code, items, table, wiki = "```\nprint(mill.wheel)\n```", "* the old wheel\n* the new race", "| mill | wheel |\n| race | board |", "{{Infobox mill|wheel=old}}"
    assert pairs_of(spark, code, code, items, items, table, table, wiki, wiki) == [(0, 1), (2, 3), (4, 5), (6, 7)]
    link = LONG.format("[everyone who lived there by the mill](https://a.example/x)")
    assert pairs_of(spark, link, LONG.format("everyone who lived there by the mill")) == [(0, 1)]


def test_added_code_is_compared_like_all_words(spark):
    added = LONG.format("everyone") + "\n```\nrun(mill)\n```"
    long = LONG.format("everyone") + "\n```\n" + "run(mill, wheel)\n" * 9 + "```"
    assert pairs_of(spark, added, LONG.format("everyone"), long) == [(0, 1)]  # two words more, and a whole block more


def test_different_code_and_tables_differ(spark):
    code = lambda x: LONG.format("everyone") + f"\n```\n{x}\n```"
    assert pairs_of(spark, code("load the old wheel from the pond"), code("sell every new boat at some fair")) == []


def test_unrelated_rows_change_no_pair(spark):
    words = [f"w{i}" for i in range(16)]
    near = [*words[:3], "x", *words[4:11], "y", *words[12:]]
    far = [*words[:3], "x", *words[4:8], "z", *words[9:11], "y", *words[12:]]
    noise = [" ".join(words[i : i + 9]) + f" n{j}" for j in range(40) for i in range(4)]
    few = pairs_of(spark, " ".join(words), " ".join(near), "q", " ".join(far))
    assert few == [(0, 1)]
    assert [x for x in pairs_of(spark, " ".join(words), " ".join(near), "q", " ".join(far), *noise) if x[1] < 4] == few


def test_texts_of_eight_words_may_differ_in_one(spark):
    assert pairs_of(spark, "the old mill fell into the river today", "the old mill fell into the water today", "the old mill fell into the pond", "the old mill fell into the race") == [(0, 1)]


def test_hot_windows_are_split_without_loss(spark):
    e = spark.createDataFrame([(s, c) for s in (1, 2) for c in range(4)], "seg long, cls long")
    t = spark.createDataFrame([(1, c) for c in range(100, 150)] + [(2, 7), (3, 8)], "seg long, cls long")
    want = e.alias("e").join(t.alias("t"), "seg").count()
    for listed in (10, 0):
        a, b = overlap.split_hot(e, t, 8, listed)
        assert a.where("seg = 1").count() == 4 * 7 and a.where("seg = 2").count() == 4
        assert a.join(b, ["seg", "salt"]).count() == want == 204


def test_stock_lists_by_row_where_they_are_too_many_to_broadcast(spark):
    rows = [(i, "c", None, "en", "https://a.example/p", None, f"The very same line of the site\nown {i}") for i in range(30)] + [(90, "c", None, "en", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    lists = [sorted((r.rid, tuple(r.stock_keys or ())) for r in stock.with_stock(df, stock.with_site(df), most=most).collect()) for most in (stock.LISTS_MOST, -1)]
    assert lists[0] == lists[1] and sum(len(k) for _, k in lists[0]) == 30


# --- clean text


@pytest.mark.parametrize(
    "text,want",
    [
        ("See a[i][j] for the matrix.", "See a[i][j] for the matrix."),
        ("Use the tag &lt;b&gt;bold&lt;/b&gt; here.", "Use the tag <b>bold</b> here."),
        ("A mill.\n```\n&amp;amp; x **y**\n```\nIt **fell**.", "A mill.\n```\n&amp;amp; x **y**\n```\nIt fell."),
        ("\\section{Outlook}\\label{s8}\nSee \\cite{mill90}.", "# Outlook\n[s8]\nSee [mill90]."),
        ("<h2>Mill</h2><ol><li>one</li><li>two</li></ol><ul><li>x</li></ul>", "## Mill\n1. one\n2. two\n- x"),
        ("\\begin{enumerate}\n\\item a\n\\item b\n\\end{enumerate}\n$$ a + b $$", "1. a\n2. b\n$$ a + b $$"),
        ("{|\n! A !! B\n|-\n| 1 || '''2'''\n|}", "| A | B |\n| 1 | 2 |"),
        ("Mill\n====\nThe mill stood by the river for two centuries.", "# Mill\nThe mill stood by the river for two centuries."),
        ("See [the mill][m] and [x][y].\n\n[m]: https://m.example", "See the mill and [x][y]."),
        ("<pre><code>for x in rows:\n    emit(&lt;x&gt;)</code></pre>", "```\nfor x in rows:\n    emit(<x>)\n```"),
    ],
)
def test_structure_stays_in_the_clean_text(text, want):
    assert markup.clean(text) == want


def test_the_trees_decide(monkeypatch):
    texts = ["The power 2 ** 8 and a < b and 3 * 4, said the clerk.", "Rows a[i][j] at C:\\work\\x and $5.", "Set <API_KEY> and {name} now.", "AT&T and x_{3} stand there.", "Docs > Guides > Release 4"]
    marked = ["It was **never** rebuilt.", "<p>The mill.</p>", "A [[mill]] by the ford.", "It fell by \\alpha then."]
    assert [h for h, _, _ in markup.judge(texts)] == [set()] * 5 and all(h for h, _, _ in markup.judge(marked))
    assert all(markup.features([(t, "")])[:, len(markup.BASE) :].any() for t in texts)  # shapes alone would find markup in them
    monkeypatch.setattr(markup, "trees", lambda: ([[(-1, 0.0, 0, 0, 0)]] * 4, [(-1, 0.0, 0, 0, 0)]))
    assert not any(h for h, _, _ in markup.judge(marked))
    assert markup.clean("def load(path):\n    x = **y**") != "def load(path):\n    x = **y**"


def test_list_sentences_vote_and_names_do_not(spark):
    en = "The river board reviewed the annual budget of the town after the second reading. Nobody had asked for it."
    de = "* Der Förderkreis verschob die Sitzung, weil niemand danach gefragt hatte.\n* Das Protokoll der Stadt fehlte noch immer."
    rows = [(1, "c", None, "en", None, None, f"{en}\n{de}"), (2, "c", None, "en", None, None, f"# Zezarglolfol\n{en} [Brenzenwolden](https://v.example/p)"), (3, "c", None, "en", None, None, de)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, language.found(df).collect())) == [(1, "de"), (1, "en"), (3, "de")]
    assert language.segments(df.where("rid = 3")).count() == 2


def test_lines_that_name_the_own_host_may_be_text(spark):
    one = "Mill.example was the first site of the town that told of the wheel"
    two = "Read more on mill.example every week."
    urls = {0: "https://mill.example/a", 1: "https://mill.example/b", 2: "https://mill.example/c", 3: "https://race.example/d", 4: "https://mill.example/e"}
    assert pairs_of(spark, one, one, LONG.format("nobody") + "\n" + one.replace("first", "last"), LONG.format("nobody") + "\n" + one.replace("first", "last"), urls=urls) == [(0, 1), (2, 3)]
    assert pairs_of(spark, f"{LONG.format('she')}\n{two}", LONG.format("she"), urls=urls) == [(0, 1)]


# --- limits of containers, defects of answers


def test_each_limit_of_a_container_binds():
    size = np.array([60] * 10 + [30] * 20 + [2] * 300)
    free = packing.best_fit(size, 100, 1, 1 << 30, 1e9)[0]
    for most, share in ((20, 1e9), (1 << 30, 0.4)):
        where, _, _ = packing.best_fit(size, 100, 1, most, share * 100 * 100)
        assert (where != free).any() and np.bincount(where).max() <= most < np.bincount(free).max() + (share < 1) * (1 << 31)
        cost = np.bincount(where, size.astype(float) ** 2)
        assert ((cost <= share * 100 * 100) | (np.bincount(where) == 1)).all()
    norm, dot = (packing.best_fit(size, 100, 1, 20, 0.5 * 100 * 100, rule)[0] for rule in ("norm", "dot"))
    assert (norm != dot).any()


def test_long_refusals_and_open_brackets():
    more = "You may ask an editor of the town, who has more time for such work and knows the mill by heart. " * 6
    assert pairs.defects("I'm sorry, but I can't help with this text. " + more, "The mill.", "en") == ["refusal"]
    assert pairs.defects("The old clerk was there. The wheel turned. " * 9 + 'Then she wrote: "I\'m sorry, but I can\'t help."', "The mill.", "en") == []
    assert pairs.defects("The clerk said I am not able to swim. He left.", "A clerk said: I am not able to swim.", "en") == []
    assert pairs.defects("The mill was rebuilt (by the people\nof the ford.", "x", "en") == ["truncated"]
    assert pairs.defects("The mill (see [1] was old.\n\nIt was rebuilt. It stands.", "x", "en") == []
    assert pairs.defects("I'm sorry, but I can't help with (this", "x", "en") == ["refusal", "truncated"]


def test_queue_rows_of_one_id_all_count(spark):
    p = spark.createDataFrame([("a", "q", "The mill stood by the river for years. It was of oak and stone.")], "pair_id string, queue_id string, text string")
    for order in ((0, 1), (1, 0)):
        q = [("q", "The mill stood by the river for years. It was of oak and stone.", "en"), ("q", "An old mill.", "de")]
        df = spark.createDataFrame([q[i] for i in order], "queue_id string, selected_source_text string, target_language string")
        assert sorted(map(tuple, pairs.found(p, df).collect())) == [("a", "copied_source"), ("a", "other_language")]


def test_classes_of_copies(spark):
    rows = [(i, f"c{i}", "test" if i % 2 else "train", "en", None, None, LONG.format("she")) for i in range(6)] + [(9, "c", "train", "en", None, None, LONG.format("he")), (10, "c", "train", "en", None, None, "alone here")]
    got = {r.rid: (r.copies, r.near_classes) for r in overlap.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {**{i: (6, 1) for i in range(6)}, 9: (1, 1)}


# --- schedules of a mix


def test_schedule_through_knots():
    s = mixture.stretches([(0.0, 2.0), (0.5, 0.0)])
    assert [x[:4] for x in s] == [(0.0, 0.5, 4.0, 0.0), (0.5, 1.0, 0.0, 0.0)] and [x[4] for x in s] == [0.0, 1.0]
    assert mixture.stretches([]) == [(0.0, 1.0, 1.0, 1.0, 0.0)] == mixture.stretches([(0.3, 0.0)])
    assert abs(sum((b - a) * (x + y) / 2 for a, b, x, y, _ in mixture.stretches([(0.9, 5), (0.1, 1), (0.4, 2)])) - 1) < 1e-12


def test_mix_follows_the_knots_of_its_caller(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 7 + 1), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "a", 0.5, 1, 0.8), ("m", "b", 0.5, 1, 0.8)], "mix_id string, source string, target_weight double, max_repeats int, total_share double")
    knots = spark.createDataFrame([("m", "a", 0.0, 2.0), ("m", "a", 0.5, 0.0), ("m", "a", 1.0, 0.0), ("m", "b", 0.0, 1.0), ("m", "b", 1.0, 1.0)], "mix_id string, source string, at double, weight double")
    at = {}
    for r in mixture.mix(docs, targets, schedule=knots).collect():
        at.setdefault(r.source, []).append(r.position)
    assert max(at["a"]) <= 0.5 and sum(x < 0.25 for x in at["a"]) > 0.65 * len(at["a"])  # three quarters of the integral lie there
    assert abs(sum(x < 0.5 for x in at["b"]) / len(at["b"]) - 0.5) < 0.1


# --- personal data in sentences that training never saw


def test_tagger_on_held_out_carriers():
    from held_carriers import HELD

    from corpusloom.llm import pii
    from corpusloom.llm import pii_carriers as made

    trained = " ".join(x for lang in made.CARRIERS for x in made.lines(lang))
    rng = np.random.default_rng(77)
    rows = []
    for lang, lines in HELD.items():
        for line in lines.strip().split("\n"):
            assert line not in trained
            rows += [made.filled(line.replace("\\n", "\n"), lang, rng) for _ in range(10)]
    got = pii.pieces(pa.array([t for t, _ in rows]))
    for k, kind in enumerate(pii.KINDS):
        want = {(i, a, b) for i, (_, sp) in enumerate(rows) for a, b, x in sp if x == k}
        have = {(i, a, b) for i, sp in enumerate(got) for a, b, x in sp if x == k}
        assert len(want & have) >= LEAST[kind] * max(len(want), len(have)), (kind, len(want), len(have), len(want & have))


LEAST = {"email": 0.95, "phone": 0.95, "id_number": 0.9, "street_address": 0.9, "person_name": 0.9}  # of what is wanted and of what is found


def test_no_address_by_a_bare_at():
    from corpusloom.llm import pii

    assert pii.EMAIL.findall("Look at example.com and Smith at john.smith@mail.com") == ["john.smith@mail.com"]
    assert pii.EMAIL.findall("write to jane at example dot com or a.b [at] c [dot] org") == ["jane at example dot com", "a.b [at] c [dot] org"]
