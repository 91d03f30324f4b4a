"""Problem 5: answers that are no usable rewrite of their prompt, each with its defects.

Copying is measured by running the answer through a suffix automaton of the prompt; refusals are found
by an automaton of phrases; truncation by a stack of open delimiters and the form of the last line; the
language by votes of stopwords and scripts.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import codepoints as C
from .language import code_of
from .textio import slices

DEFECTS = ("empty", "truncated", "refusal", "copied_source", "other_language")
COPIED, RUN, RUN_CJK = 0.9, 3, 5
REFUSED = 0.5  # share of the sentences that decline, from which an answer is a refusal wherever they stand

# Answers that only hold the place of one.
PLACEHOLDERS = {
    "null", "none", "nil", "na", "nooutput", "nooutputs", "empty", "emptystring", "todo", "tbd", "undefined", "nan", "noanswer", "noresponse",
    "placeholder", "notext", "blank", "无", "空", "暂无", "没有输出", "なし", "空欄", "未定", "keine", "leer", "aucun", "aucune", "vide", "ninguno", "vacío", "sintexto",
    "xxx", "loremipsum", "answer", "output", "text", "response", "rewrite", "inserttexthere", "yourtexthere",
}

# Phrases of an answer that declines the task (case and spacing folded).
REFUSALS = """
as a language model|as an ai|i am not able to|i'm not able to|i cannot comply|i can't comply|i cannot help|i can't help|i cannot assist|i can't assist
i cannot rewrite|i can't rewrite|i am unable to|i'm unable to|i won't be able to|i will not be able to|i have to decline|i must decline|something i have to decline
against my guidelines|against my policy|no rewrite is given|no rewrite will be offered|outside what i may|i must stay away from|i cannot provide|i can't provide|i cannot produce|i'm sorry, but i can't|i am sorry, but i cannot|i'm sorry, but i cannot|i cannot fulfil|i can't fulfill|i decline to|unable to process this|cannot process this request
als sprachmodell|als ki-modell|kann ich leider nicht|kann ich nicht umschreiben|darf ich diesen|ich kann diesen text nicht|ich kann ihnen dabei nicht|tut mir leid, aber|nicht nachkommen|muss ich ablehnen|gegen meine richtlinien|nicht möglich, diesen
je suis désolé, mais|je ne peux pas|il ne m'est pas possible|en tant que modèle de langue|en tant que modèle de langage|je dois décliner|je dois refuser|je ne suis pas en mesure|contraire à mes|je ne saurais
lo siento, pero|no puedo reescribir|no me es posible|como modelo de lenguaje|debo rechazar|no puedo ayudar|no puedo cumplir|no estoy en condiciones|va contra mis|no se ofrecerá
我无法|我不能|无法改写|作为语言模型|不便提供|不在我能处理|抱歉，我|对不起，请换|不能生成|恕我不能|无法提供|无法协助|违反我的|我只能拒绝|不能继续
できません|お応えできかね|控えさせていただ|言語モデルとして|提供できません|お断り|対応できかね|いたしかねます|お手伝いできません|ガイドラインにより
"""

# Words that are frequent in one of the languages and rare in the others.
STOPWORDS = {
    "en": "the of and to in is was for on that with as by at from it be were which had not are this an or its has have been near about after before",
    "de": "der die das und den von zu mit auf für im ist des dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war nur weil obwohl",
    "fr": "le la les des et du une est dans pour que qui sur au par plus pas ne ce avec sont aux il se cette ou son sa à été l d a venant près bien afin",
    "es": "el los las del y una es en por con para que no se su al lo como más o pero sus le ha sido fue porque aunque cerca hacia este unas unos",
}

QUOTED = re.compile(r"“[^“”]*”|„[^“”„]*[“”]|«[^«»]*»|\"[^\"\n]*\"|「[^「」]*」|『[^『』]*』|‘[^‘’\n]*’(?!\w)")
SENTENCE_END = set(".!?。！？…．｡")
CLOSERS = set("\"'”’»›)）]】」』*_`“")
LIST_ITEM = re.compile(r"^\s*(?:[-*+•·–]|\d{1,3}[.)、．]|[a-z][.)])\s+\S")
HEADING = re.compile(r"^\s*(?:#{1,6}\s+\S.*|={2,6}[^=].*={2,6}|\*\*[^*]+\*\*:?|<h[1-6][^>]*>.*</h[1-6]>)\s*$", re.I)
LINK_LINE = re.compile(r"(?:https?://\S+|\[[^\]\n]*\]\([^)\n]*\)|\[[^\]\n]*\]:\s*\S+|<https?://[^>\s]+>)[\s)\]）.]*$")
LEAD_IN = re.compile(r"\A\s*(?:(?:[^\n:：.!?。！？]{0,40}[.!。！]\s*)?[^\n:：.!?。！？]{0,80}(?:[:：]|\b(?:version|text|rewrite|Fassung|versión|nouvelle version)[^\n.。:：]{0,20}[.。])|[^\n。：]{0,40}次のとおりです。)\s*")
TOKEN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿々]|[^\W_぀-ヿ㐀-鿿豈-﫿]+")
CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿々]")


@lru_cache(1)
def refusal_automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in re.split(r"[|\n]", REFUSALS):
        if phrase.strip():
            a.add_word(phrase.strip(), len(phrase.strip()))
    a.make_automaton()
    return a


class SuffixAutomaton:
    """States of all substrings of a token sequence, with the end of each one's first occurrence."""

    def __init__(self, tokens: list[str]) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [-1]
        last = 0
        for i, c in enumerate(tokens):
            cur = self._state({}, -1, self.size[last] + 1, i)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][c]
                if self.size[q] == self.size[p] + 1:
                    self.link[cur] = q
                else:
                    twin = self._state(dict(self.next[q]), self.link[q], self.size[p] + 1, self.first[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = self.link[cur] = twin
            last = cur

    def _state(self, edges: dict, link: int, size: int, first: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.size.append(size)
        self.first.append(first)
        return len(self.next) - 1

    def blocks(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """(end in tokens, end of the first occurrence in the source, length) of the matches that cannot be prolonged."""
        out, s, n = [], 0, 0
        for i, c in enumerate(tokens):
            if n and c not in self.next[s]:
                out.append((i, self.first[s] + 1, n))
                while s and c not in self.next[s]:
                    s = self.link[s]
                    n = self.size[s]
            if c in self.next[s]:
                s = self.next[s][c]
                n += 1
            else:
                s = n = 0
        if n:
            out.append((len(tokens), self.first[s] + 1, n))
        return out


def copied_share(answer: str, source: str, enough: float = 0.0) -> float:
    """Share of the answer's tokens that lie in matches with the source, in the source's order.

    0 where the tokens that both hold are too few to reach enough, whatever their order.
    """
    a, b = TOKEN.findall(answer.casefold()), TOKEN.findall(source.casefold())
    if not a or not b:
        return 0.0
    if enough > 0:
        known = set(b)
        if sum(t in known for t in a) < enough * len(a):
            return 0.0
    least = RUN_CJK if len(CJK.findall(answer)) * 2 > len(a) else RUN
    least = min(least, len(a))
    auto = SuffixAutomaton(b)
    best: list[tuple[int, int, int]] = []  # (-covered, end in answer, end in source) of the best chain ending in each block, rising
    top = 0
    for end, at, n in auto.blocks(a):
        if n < least:
            continue
        covered = n
        for c, e, x in best:
            if n - c <= covered:
                break  # no chain from here on covers more
            fresh = min(n, end - e, at - x)
            if fresh > 0:
                covered = max(covered, fresh - c)
        insort(best, (-covered, end, at))
        top = max(top, covered)
    return top / len(a)


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    letters = "".join(TOKEN.findall(text.casefold()))
    return not letters or letters in PLACEHOLDERS and len(text) < 60


def plain_voice(text: str) -> str:
    """The text in the answer's own voice: quotations aside, case and spacing folded."""
    return re.sub(r"\s+", " ", QUOTED.sub(" ", text).casefold().replace("’", "'")).strip()


def is_refusal(text: str, source: str = "") -> bool:
    """Whether the answer, of whatever length, declines: in one of its first two sentences, or in half of them.

    A phrase that the source has too is part of what is rewritten.
    """
    plain = plain_voice(text)
    hits = list(refusal_automaton().iter(plain))
    if not hits:
        return False
    told = plain_voice(source) if source else ""
    sentences = [m.end() for m in re.finditer(r"[^.!?。！？]+[.!?。！？]*", plain)] or [len(plain)]
    declining = set()
    for end, size in hits:
        start = end - size + 1
        before = plain[start - 1 : start] if start else ""
        if (not before.isascii() or not before.isalnum()) and plain[start : end + 1] not in told:
            declining.add(bisect_right(sentences, start))
    return bool(declining) and (min(declining) < 2 or len(declining) >= REFUSED * len(sentences))


# Brackets and quotation marks that open and close.
BRACKETS = {")": "(", "）": "（", "]": "[", "】": "【", "」": "「", "』": "『", "}": "{", "»": "«"}
FENCED = re.compile(r"^[ \t]{0,3}(`{3,}|~{3,})[^\n]*\n[\s\S]*?^[ \t]{0,3}\1[`~]*[ \t]*$|`[^`\n]*`", re.M)


def open_at_end(text: str) -> bool:
    """Whether a fence is open, or a bracket or quotation of the last paragraph, or one after which no sentence ends.

    The stack runs over the whole text; in lines that are list items brackets may stay open, as in numberings.
    """
    if len(re.findall(r"^[ \t]{0,3}(`{3,}|~{3,})", text, re.M)) % 2:
        return True
    body = FENCED.sub(lambda m: " " * len(m[0]), text.rstrip())
    stack: list[tuple[str, int]] = []
    for m in BRACKET.finditer(body):
        c = m[0]
        if c in BRACKETS:
            # what was opened within this pair and not closed is left over
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == BRACKETS[c]), -1)
            if i >= 0:
                del stack[i:]
        else:
            stack.append((c, m.start()))
    if not stack:
        return False
    paragraph = body.rfind("\n\n") + 1
    for _, at in stack:
        line = body[body.rfind("\n", 0, at) + 1 :]
        after = body[at + 1 :]
        if (at >= paragraph or not any(c in SENTENCE_END for c in after)) and not (LIST_ITEM.match(line) and "\n" not in line):
            return True
    return False


BRACKET = re.compile("[" + re.escape("".join({*BRACKETS, *BRACKETS.values()})) + "]")


def letters(line: str) -> str:
    return "".join(c for c in line.casefold() if c.isalpha())


def is_truncated(text: str, source: str) -> bool:
    body = text.rstrip()
    if open_at_end(body):
        return True
    if re.search(r"^[ \t]{0,3}(?:`{3,}|~{3,})\s*$", body.rsplit("\n", 1)[-1]):
        return False  # a closed code block
    lines = body.split("\n")
    last = lines[-1].strip()
    if HEADING.match(last):
        return True
    if LIST_ITEM.match(lines[-1]):
        # items that are sentences make the last one a sentence too
        before = next((x.rstrip() for x in reversed(lines[:-1]) if x.strip()), "")
        return bool(LIST_ITEM.match(before)) and before[-1] in SENTENCE_END and last[-1] not in SENTENCE_END and last[-1] not in CLOSERS
    if LINK_LINE.search(last) or re.match(r"^\|.*\|$", last):
        return False
    if re.search(r"</(?:p|div|li|ul|ol|table|h\d|pre|code|blockquote)>$", last, re.I):
        return False
    core = last
    while core and (core[-1] in CLOSERS or core[-1].isspace()):
        core = core[:-1]
    if core and core[-1] in SENTENCE_END or not core:
        return False
    if len(core) < len(last) and QUOTED.search(last[max(0, len(last) - 80) :]) and last[-1] in "\"”“»」』’":
        return False  # a quotation that ends the text is complete
    # a closing line without a full stop that the source also closes with
    key = letters(last)
    tail = [letters(x) for x in source.rstrip().split("\n")]
    kept = []
    for x, raw in zip(reversed(tail), reversed(source.rstrip().split("\n"))):
        if raw.strip() and raw.rstrip()[-1:] in SENTENCE_END and kept and not kept[-1]:
            break
        kept.append(x)
        if len([k for k in kept if k]) >= 4:
            break
    if key and key in [k for k in kept if k]:
        return False
    return True


def votes(text: str) -> dict[str, float]:
    """Weight of each language in the text, quotations and code aside."""
    plain = QUOTED.sub(" ", re.sub(r"`{3}.*?(?:`{3}|\Z)|`[^`\n]*`|https?://\S+", " ", text, flags=re.S))
    out = dict.fromkeys(("zh", "ja", *STOPWORDS), 0.0)
    han = len(re.findall(r"[㐀-鿿豈-﫿]", plain))
    kana = len(re.findall(r"[぀-ヿ]", plain))
    # one text may hold both: kana take the Han letters of their line along
    for line in re.split(r"[\n。！？]", plain):
        k, h = len(re.findall(r"[぀-ヿ]", line)), len(re.findall(r"[㐀-鿿豈-﫿]", line))
        if k * 8 > h and k:
            out["ja"] += (k + h) / 2
        else:
            out["zh"] += h / 1.6
    if han + kana == 0:
        out["zh"] = out["ja"] = 0.0
    words = re.findall(r"[^\W\d_぀-ヿ㐀-鿿豈-﫿]+", plain.casefold())
    hits = {k: sum(w in s for w in words) for k, s in _stop().items()}
    total = sum(hits.values())
    for k, v in hits.items():
        out[k] += len(words) * v / total if total else 0.0
    return out


@lru_cache(1)
def _stop() -> dict[str, frozenset[str]]:
    return {k: frozenset(v.split()) for k, v in STOPWORDS.items()}


def is_other_language(text: str, target: str) -> bool:
    if target not in ("zh", "ja", *STOPWORDS):
        return False
    v = votes(text)
    best = max(v, key=lambda k: v[k])
    return v[best] >= 2 and best != target and v[best] > 0.5 * sum(v.values()) and v[target] < 0.4 * sum(v.values())


def defects(text: str | None, source: str | None, target: str | None) -> list[str]:
    """The defects of one answer; an empty one has no other."""
    if is_empty(text):
        return ["empty"]
    out = []
    refusal = is_refusal(text, source or "")
    if refusal:
        out.append("refusal")
    if is_truncated(text, source or "") and not (refusal and not open_at_end(text.rstrip())):  # a short refusal may lack its full stop
        out.append("truncated")
    if source:
        share = copied_share(text, source, COPIED)
        if share < COPIED:
            m = LEAD_IN.match(text)
            if m and m.end() < len(text):
                share = copied_share(text[m.end() :], source, COPIED)
        if share >= COPIED:
            out.append("copied_source")
    if is_other_language(text, code_of(target)):
        out.append("other_language")
    return out


def found(pairs: DataFrame, queue: DataFrame) -> DataFrame:
    """(pair_id, defect), distinct.

    Whole-row repeats of pairs and queue rows count once; where queue rows of one id differ, the answer is judged by each; a pair whose queue row is unknown is judged without
    prompt and target language; null and empty texts are 'empty'; null keys never join.
    """
    ship(pairs.sparkSession)
    p = pairs.select("pair_id", "queue_id", "text").dropDuplicates()
    q = queue.select(F.col("queue_id").alias("q_id"), F.col("selected_source_text").alias("source"), F.col("target_language").alias("target")).dropDuplicates()
    both = p.join(q, p.queue_id == q.q_id, "left").select("pair_id", F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), "target")

    def run(batches):
        for b in batches:
            for part in slices(b, "text"):
                new = []
                for name in ("text", "source"):
                    arr = part.column(name)
                    cp, off, _ = C.unify(*C.explode(arr))
                    new.append(C.implode(cp, off, C.valid_of(arr)).to_pylist())
                ids, kinds = [], []
                for key, text, source, target in zip(part.column("pair_id").to_pylist(), *new, part.column("target").to_pylist()):
                    for d in defects(text, source, target):
                        ids.append(key)
                        kinds.append(d)
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(kinds)], names=["pair_id", "defect"])

    return both.mapInArrow(run, "pair_id string, defect string").distinct()
